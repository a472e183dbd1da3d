"""Personal data and the terms that give it away, by built-in functions alone.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers, found by regular expressions. Their
values are the protected entities. How strongly a term, any word outside base spans, reveals an entity is its
pointwise mutual information, ``log p(t, e) / (p(t) p(e))``, against the entity's information ``-log p(e)``, counted
over all documents; a term that reaches ``ALPHA`` of it is removed, or generalised to its shape if other
documents use it without the entity often enough. This holds in every text, also where the entity is not named.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetry_ops.functions.session import broadcast_if_small, stage

#: Share of an entity's information that a term may reveal.
ALPHA = 0.9
#: Different texts that must hold a term with an entity, and share of a term's documents from which it is removed.
SUPPORT, REMOVE = 2, 0.9

_LOCAL = "[A-Za-z0-9._%+-]"
#: Starts only where a run begins (or where the last match ended), and never gives characters back, which
#: finds the same matches without rescanning long runs.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a match to be possible; cheaper than the match.
_HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
KINDS = tuple(PATTERNS)
WORD = r"[\p{L}\p{N}]++"
SPAN = "struct<kind: string, start: int, end: int, value: string>"
_NONE = "array<struct<kind: string, start: int, end: int, value: string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, i: acc
        + F.when(i % 2 == 1, F.substring(turned, i, F.lit(1)).cast("int")).otherwise(
            F.when(F.substring(turned, i, F.lit(1)).cast("int") < 5, 2 * F.substring(turned, i, F.lit(1)).cast("int")).otherwise(
                2 * F.substring(turned, i, F.lit(1)).cast("int") - 9
            )
        ),
    )
    return total % 10 == 0


_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": lambda m: F.length(_digits(m)).between(16, 19) & _luhn(_digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}


def spans(text: Column, pattern: str, kind: str, keep: Callable[[Column, Column, Column], Column]) -> Column:
    """Kept matches with code point offsets: what lies between matches and the matches alternate."""
    both = F.arrays_zip(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))

    def step(acc, x):
        begin = acc["pos"] + F.length(x["0"])
        end = begin + F.coalesce(F.length(x["1"]), F.lit(0))
        one = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["1"].alias("value"))
        hit = x["1"].isNotNull() & keep(x["1"], begin, end)
        return F.struct(end.alias("pos"), F.when(hit, F.concat(acc["found"], F.array(one))).otherwise(acc["found"]).alias("found"))

    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(_NONE).alias("found"))
    return F.aggregate(both, zero, step, lambda acc: acc["found"])


def base_spans(text: Column) -> Column:
    """Valid base spans by kind, then start."""
    none = F.array().cast(_NONE)
    return F.concat(
        *[
            F.when(_HINTS[k](text), spans(text, PATTERNS[k], k, lambda m, b, e, k=k: VALID[k](m))).otherwise(none)
            for k in KINDS
        ]
    )


def _entity(span: Column) -> Column:
    value = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"], F.lit(":"), value)


def _clear(text: Column, base: Column) -> Column:
    """The text with blanks for its base spans: what stays in clear, at the same offsets."""
    ordered = F.array_sort(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def step(acc, s):
        begin = F.greatest(acc["pos"], s["start"])
        out = F.concat(
            acc["out"], F.substring(text, acc["pos"] + 1, begin - acc["pos"]), F.repeat(F.lit(" "), F.greatest(s["end"] - begin, F.lit(0)))
        )
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    blanked = F.aggregate(ordered, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))
    return F.when(F.size(base) == 0, text).otherwise(blanked)


def _terms(clear: Column) -> Column:
    """Distinct lower-cased words of any length."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(clear, F.lit(WORD), F.lit(0))), lambda w: F.lower(w)))


def disclosing_terms(texts: DataFrame) -> DataFrame:
    """``term, remove``: the terms to act on wherever they stand in clear, and whether they go or become their shape.

    Copies of a text are one row here, with their number; documents of a term, of an entity and of both are counted
    over all of ``texts``, however far apart both stand. Since both together have no more documents than the entity, a
    term that reaches ``ALPHA`` is in ``n_e ** ALPHA * total ** (1 - ALPHA)`` documents at most: only such
    terms, and entities of ``SUPPORT`` texts, are paired. An entity of all documents has no information to reveal.
    """
    rows = texts.select("text", base_spans(F.col("text")).alias("base"))
    words = rows.select(_clear(F.col("text"), F.col("base")).alias("clear"))
    # The outer form spares a test for an empty list, which would make the list twice; null joins nothing.
    words = words.select(F.explode_outer(_terms(F.col("clear"))).alias("term"))
    rows = rows.where(F.size("base") > 0).groupBy(F.md5(F.col("text").cast("binary")).alias("key"))
    rows = rows.agg(F.count("*").alias("copies"), F.first("text").alias("text"), F.first("base").alias("base"))
    rows = stage(rows.select(F.monotonically_increasing_id().alias("id"), "copies", "text", "base"), "protected-texts")
    total = float(max(1, texts.count()))
    held = rows.select("id", "copies", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity"))
    entities = held.groupBy("entity").agg(F.count("*").alias("texts"), F.sum("copies").alias("n_e"))
    entities = stage(entities.where((F.col("texts") >= SUPPORT) & (F.col("n_e") < total)).select("entity", "n_e"), "entities")
    n_entities, most = entities.agg(F.count("*"), F.max("n_e")).first()
    held = stage(held.join(broadcast_if_small(entities, n_entities, 64), "entity"), "text-entities")
    within = lambda n_e: F.col("n_t") <= 1.000001 * F.pow(n_e, F.lit(ALPHA)) * total ** (1 - ALPHA)
    counts = words.groupBy("term").agg(F.count("term").alias("n_t")).where((F.col("n_t") >= SUPPORT) & within(F.lit(float(most or 0))))
    counts = stage(counts, "term-documents")
    near = rows.join(broadcast_if_small(held.select("id"), held.count(), 16), "id", "left_semi")
    near = near.select("id", _clear(F.col("text"), F.col("base")).alias("clear")).select("id", F.explode_outer(_terms(F.col("clear"))).alias("term"))
    near = near.join(broadcast_if_small(counts, counts.count(), 64), "term")
    together = near.join(held, "id").where(within(F.col("n_e"))).groupBy("entity", "term", "n_e", "n_t")
    together = together.agg(F.count("*").alias("texts"), F.sum("copies").alias("n_te")).where(F.col("texts") >= SUPPORT)
    p = lambda c: F.col(c) / F.lit(total)
    chosen = together.where(F.log(p("n_te") / (p("n_t") * p("n_e"))) >= ALPHA * -F.log(p("n_e")))
    return chosen.groupBy("term").agg(F.max(F.col("n_te") >= REMOVE * F.col("n_t")).alias("remove"))


def _listed(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def _shape(value: Column) -> Column:
    return F.when(value.rlike("^[0-9]+$"), F.lit("<NUMBER>")).when(value.rlike(r"^\p{Lu}"), F.lit("<NAME>")).otherwise(F.lit("<WORD>"))


def _replaced(text: Column, found: Column) -> Column:
    """The text with each span's placeholder; spans inside an earlier one are covered by it."""
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["kind"].alias("kind"))))

    def step(acc, s):
        name = (
            F.when(s["kind"] == "term", F.lit(""))
            .when(s["kind"] == "shape", _shape(s["value"]))
            .otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        )
        fresh = s["start"] >= acc["pos"]
        out = F.concat(acc["out"], F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), name)
        return F.struct(
            F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(fresh, out).otherwise(acc["out"]).alias("out")
        )

    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    return F.aggregate(
        ordered, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text)))
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with their columns, the text sanitised, and ``base`` and ``found`` spans of the old text.

    A null text stays null and has no span. Spans of terms have kind ``term`` (removed) or ``shape``
    (generalised). The words of all texts meet the table of terms, and the texts what was found in them, by broadcast
    if that is counted as small. All columns of the documents are kept as they are, whatever their names; where one is
    called ``base`` or ``found``, the spans get that name with underscores behind it. Repeated rows stay and count
    as documents of their own; an empty table gives no rows.
    """
    kept = docs.columns
    base_name, found_name = _free("base", kept), _free("found", kept)
    texts = docs.where("text is not null")
    terms = stage(disclosing_terms(texts.select("text")), "disclosing-terms")
    key = F.md5(F.col("text").cast("binary"))
    words = texts.select(key.alias("__key"), "text", base_spans(F.col("text")).alias("base"))
    words = words.select("__key", _clear(F.col("text"), F.col("base")).alias("clear"))
    words = words.select("__key", F.explode_outer(_terms(F.col("clear"))).alias("term"))
    hits = words.join(broadcast_if_small(terms, terms.count(), 64), "term").groupBy("__key")
    hits = stage(hits.agg(*[F.collect_set(F.when(F.col("remove") == gone, F.col("term"))).alias(c) for c, gone in (("__gone", True), ("__shaped", False))]), "disclosing-texts")
    size = hits.agg(F.sum(1 + F.size("__gone") + F.size("__shaped"))).first()[0] or 0
    # The user's columns travel in a struct, so that none of them can clash with a name used here.
    own = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    rows = texts.select(own, "text", base_spans(F.col("text")).alias("base"))
    some = rows.join(broadcast_if_small(hits, size, 64), F.col("__key") == key, "left").withColumn("__clear", _clear(F.col("text"), F.col("base")))
    gone = lambda w: F.array_contains(F.col("__gone"), F.lower(w))
    shaped = lambda w: F.array_contains(F.col("__shaped"), F.lower(w))
    named = F.transform(
        spans(F.col("__clear"), WORD, "term", lambda m, b, e: gone(m) | shaped(m)),
        lambda s: F.struct(
            F.when(gone(s["value"]), F.lit("term")).otherwise(F.lit("shape")).alias("kind"),
            s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
        ),
    )
    extra = F.when(F.col("__key").isNotNull(), named).otherwise(F.array().cast(_NONE))
    some = some.withColumn("found", F.concat("base", extra))
    text = F.when(F.size("found") == 0, F.col("text")).otherwise(_replaced(F.col("text"), F.col("found"))).alias("text")
    done = some.select(
        *[text if c == "text" else F.col("row").getField(c).alias(c) for c in kept], F.col("base").alias(base_name), F.col("found").alias(found_name)
    )
    none = F.array().cast(_NONE)
    return docs.where("text is null").select(*[F.col(f"`{c}`") for c in kept], none.alias(base_name), none.alias(found_name)).unionByName(done)


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def span_report(docs: DataFrame) -> DataFrame:
    """``doc_id``, base spans per kind, their digest, and all spans, per document."""
    found = sanitise(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    kinds = F.array(*[F.lit(k) for k in (*KINDS, "shape", "term")])
    by_kind = F.array_sort(F.transform("found", lambda s: F.struct(F.array_position(kinds, s["kind"]).alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return found.select(
        "doc_id", *[count(k) for k in KINDS],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(by_kind).alias("spans"),
    )
