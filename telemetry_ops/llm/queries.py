"""Queries of the numbered operators over the given tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from telemetry_ops.llm import (
    brown_lm,
    chat,
    crf,
    divergence,
    mixing,
    ngram_join,
    prefix_hash,
    prefix_trie,
    risk_rules,
    sanitise,
    string_kernel,
    tokens,
    warc,
)
from telemetry_ops.llm.text import table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op2_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hash.prefix_fingerprints(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(
        "SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text "
        "FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_digests(chat.format_chats(turns.unionByName(own)))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"))


def op5_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.brown_scores(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.language_id(table(spark, sf_dir, "documents"))


def op8_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.span_report(table(spark, sf_dir, "documents"))


def op10_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_kernel.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(spark, table(spark, sf_dir, "pages"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard,
        op2_prefix_fingerprints,
        op3_chat_format,
        op4_sentencepiece,
        op5_brown_lm,
        op6_source_mixing,
        op7_language_crf,
        op8_risk_rules,
        op9_sanitise,
        op10_string_kernel,
        op11_warc,
        op12_source_divergence,
        op13_prefix_trie,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"[x FOR x IN string_split_regex({}, '[\x20\x09-\x0D]+') IF x <> '']"

SQL: dict[str, str] = {
    "op1_ngram_jaccard": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5
    THEN list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT p.a, p.b, shared = na.n AND na.n = nb.n AS same
  FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE 100 * shared >= 80 * (na.n + nb.n - shared)
), r(a, b) AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles,
  least(d.doc_id, (SELECT min(r.b) FROM r WHERE r.a = d.doc_id)) AS component_id,
  least(d.doc_id, (SELECT min(l.b) FROM l WHERE l.a = d.doc_id AND l.same)) AS class_id,
  (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
""",
    "op3_chat_format": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS LAST, r, x)) AS turns_sha256,
  CAST(sum(CASE WHEN r = 'assistant' THEN length(x) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS LAST, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(r) + length(x) + {" + ".join(
      f"(length(x) - length(replace(x, '{c}', ''))) // {len(c)}"
      for c in (chr(92), "<|", "<s>", "</s>", "<SYS>>", "</SYS>>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
  )}) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS attachment_tokens
FROM t GROUP BY conv_id
""",
    "op11_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS answer
  FROM pages
)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string([array_to_string([
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(d, 5 * g + 1, 5))::INTEGER >> (15 - 5 * k)) & 31), 1)
    FOR k IN range(4)], '') FOR g IN range(8)], '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM answer THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM answer THEN answer END AS refers_to
FROM p
""",
    "op12_source_divergence": f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
v AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
l AS (SELECT g.lang, count(v.term)::HUGEINT AS v, coalesce(sum(v.n), 0) AS n FROM (SELECT DISTINCT lang FROM d) AS g LEFT JOIN v USING (lang) GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
m AS (SELECT g.lang, g.source, v.term, v.n AS all_n, coalesce(c.n, 0) AS n,
    coalesce(sum(c.n) OVER (PARTITION BY g.lang, g.source), 0) AS total
  FROM g JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
p AS (SELECT m.*, 1 + (1000000000 * (m.n + 2)::HUGEINT) // (m.total + 2 * l.v) AS p,
    1 + (1000000000 * (m.all_n + 2)::HUGEINT) // (l.n + 2 * l.v) AS q FROM m JOIN l USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q
), k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM f)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM k WHERE part = 'pair' OR rank <= 10
""",
    "op13_prefix_trie": """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k FROM conversations
), c AS (
  SELECT conv_id, xor(4294967295::UBIGINT, list_reduce(
      list_prepend(4294967295::UBIGINT, [ord(substr(s, i, 1))::UBIGINT FOR i IN range(1, len(s) + 1)]),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % 6 AS h
  FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM conversations)
), b AS (
  SELECT c.conv_id, t.k, t.r, t.x FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.k <= c.h
  UNION ALL SELECT c.conv_id, t.k, t.r, t.x FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h
), u AS (
  SELECT conv_id, list(length(x) ORDER BY k) AS chars, list(sha256(length(r) || ':' || r || x) ORDER BY k) AS turns FROM b GROUP BY 1
), e AS (
  SELECT c.conv_id, coalesce(len(u.turns), 0) AS length, coalesce(u.turns, []) AS turns, u.chars FROM c LEFT JOIN u USING (conv_id)
), n AS (
  SELECT conv_id, length, unnest(range(length + 1)) AS d, sha256(array_to_string(turns[:d], ',')) AS node,
    CASE WHEN d > 0 THEN chars[d] ELSE 0 END AS chars FROM e
), g AS (
  SELECT d, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = d), '')) AS ends_sha256
  FROM n GROUP BY ALL
), up AS (
  SELECT g.*, p.node AS parent, p.conv_id AS parent_conv_id
  FROM g LEFT JOIN n ON n.conv_id = g.conv_id AND n.d = g.d - 1 LEFT JOIN g AS p ON p.d = n.d AND p.node = n.node
), k AS (SELECT d - 1 AS d, parent AS node, count(*) AS n_children FROM up WHERE parent IS NOT NULL GROUP BY ALL),
a AS (SELECT up.*, coalesce(k.n_children, 0) AS n_children FROM up LEFT JOIN k USING (d, node)),
s AS (
  SELECT n.d, n.node, count(*) FILTER (a.n_children = 0) AS n_leaves, sum((a.n_convs - 1) * a.chars) AS saved_tokens
  FROM a JOIN n ON n.conv_id = a.conv_id AND n.d <= a.d GROUP BY ALL
)
SELECT a.conv_id, a.d::BIGINT AS depth, a.parent_conv_id, a.n_convs, a.n_children, s.n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, a.ends_sha256
FROM a JOIN s USING (d, node)
""",
}
