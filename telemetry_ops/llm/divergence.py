"""Divergence of sources by run-length columns.

Each (language, source) group is a column of term counts. Terms whose counts agree in every group are
one entry with a width, and entries are sorted by their counts, so that equal counts stand together; a
column is then a short list of runs. For a pair of groups the boundaries of their runs are intersected,
``f`` is computed once per joint run and multiplied by its length. All numbers are integers.

The sorted vocabulary is cut into blocks, the groups into tiles; a task sees one block for two tiles and
returns partial sums. Nothing is kept for a whole language in one place, and a hot group is only one
column among the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemetry_ops.functions.session import broadcast_if_small, stage
from telemetry_ops.llm.text import column, slices, small_batches, tidy

#: Documents of a language that must hold a term.
LEAST_DOCUMENTS = 10
SCALE = 1_000_000_000
#: Terms per group in the report of terms.
TOP = 10
#: Counts per block of the vocabulary, columns per tile, bytes of text that are counted at a time.
BLOCK_COUNTS, TILE, COUNT_BYTES = 1 << 18, 256, 8 << 20

#: Upper-case letters become lower-case ones, and whatever is no letter of ASCII a space; other bytes stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))

COUNTS = "lang string, source string, term string, n long, docs long"


def split_terms(text: bytes) -> list[bytes]:
    """Matches of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased."""
    return text.translate(_FOLD).split()


def _tally(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and their counts; sorting beats the hashing of ``np.unique`` here."""
    codes = np.sort(codes)
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
    return codes[starts], np.diff(np.append(starts, len(codes)))


def _slice_counts(langs: list, sources: list, texts: list) -> pa.RecordBatch:
    """Occurrences and documents per (language, source, term) of a slice."""
    words = [split_terms(t) for t in texts]
    sizes = [len(w) for w in words]
    flat = np.empty(sum(sizes), dtype=object)
    flat[:] = list(chain.from_iterable(words))
    terms, names = pd.factorize(flat)
    (lang, lang_names), (source, source_names) = pd.factorize(np.array(langs, dtype=object)), pd.factorize(np.array(sources, dtype=object))
    group, width = lang * len(source_names) + source, max(1, len(names))
    firsts, _ = _tally(np.repeat(np.arange(len(texts)), sizes) * width + terms)  # each term once per document
    cells, n = _tally(np.repeat(group, sizes) * width + terms)
    _, docs = _tally(group[firsts // width] * width + firsts % width)

    def named(codes, values):
        return pa.array(values, pa.binary()).cast(pa.string()).take(pa.array(codes))

    of = cells // width
    columns = [named(of // len(source_names), lang_names), named(of % len(source_names), source_names), named(cells % width, names)]
    return pa.record_batch([*columns, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])


@tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "text", COUNT_BYTES):
            yield _slice_counts(*(column(piece, c) for c in ("lang", "source", "text")))


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(1e9 * (count + 2) / (total + 2 * terms))``, in decimals that cannot overflow."""
    whole = (count + 2).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", whole, (total + 2 * terms).cast("decimal(20,0)"))


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """The same of an array: long division by thousands, exact for totals below 9e15 and in Python beyond."""
    below = int(total) + 2 * int(terms)
    if below <= 0:  # no term is kept, nothing is shared out
        return np.ones(len(counts), dtype=np.int64)
    if below >= 9 * 10**15:
        return np.array([1 + SCALE * (int(c) + 2) // below for c in counts], dtype=np.int64)
    left = counts.astype(np.int64) + 2
    found, left = left // below, left % below
    for _ in range(3):
        found, left = found * 1000 + left * 1000 // below, left * 1000 % below
    return found + 1


def term_value(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def runs(begins: np.ndarray, ends: np.ndarray, values: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and counts of the runs of one column of ``length`` places.

    Places from ``begins`` to ``ends``, ascending and apart, hold ``values``; all others hold 0.
    """
    starts, counts = np.zeros(2 * len(begins) + 1, dtype=np.int64), np.zeros(2 * len(begins) + 1, dtype=np.int64)
    starts[1::2], starts[2::2], counts[1::2] = begins, ends, values
    wide = np.append(starts[1:], length) > starts
    starts, counts = starts[wide], counts[wide]
    fresh = np.append(True, counts[1:] != counts[:-1])[: len(counts)]
    return starts[fresh], counts[fresh]


def joint_sum(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], length: int) -> int:
    """Sum of ``f`` over all places, from two columns of (starts, shares)."""
    starts = np.union1d(a[0], b[0])
    p = a[1][np.searchsorted(a[0], starts, "right") - 1]
    q = b[1][np.searchsorted(b[0], starts, "right") - 1]
    return int(np.sum((p - q) * (p - q) // (p + q) * np.diff(np.append(starts, length))))


PARTS = "lang string, a long, b long, value long"
_PARTS = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64())])


def _pairs(entries: pa.Table, groups: pa.Table, tile: int) -> pa.Table:
    """Partial sums of all pairs of a cell: one block of the vocabulary, the columns of two tiles."""
    if not groups.num_rows:
        return _PARTS.empty_table()
    ids, totals = groups["id"].to_numpy(), groups["total"].to_numpy()
    terms, length, i, j = (groups[c][0].as_py() for c in ("terms", "length", "i", "j"))
    order = np.argsort(ids, kind="stable")
    ids, totals = ids[order], totals[order]
    # Entries of a cell come in no order; the counts themselves give it.
    rows = entries.to_pandas() if entries.num_rows else pd.DataFrame({"width": [], "columns": [], "counts": []})
    rows = sorted(zip(rows["columns"], rows["counts"], rows["width"], strict=True), key=lambda r: [v for c in zip(r[0], r[1]) for v in c])
    widths = np.array([r[2] for r in rows], dtype=np.int64)
    ends = np.cumsum(widths)
    begins = ends - widths  # terms of other tiles only have their places behind these
    sizes = [len(r[0]) for r in rows]
    at = np.repeat(np.arange(len(rows)), sizes)
    who = np.concatenate([r[0] for r in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
    n = np.concatenate([r[1] for r in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
    by = np.argsort(who, kind="stable")  # stays ascending by entry inside each column
    who, at, n = who[by], at[by], n[by]
    columns = []
    for one, total in zip(ids, totals):
        lo, hi = np.searchsorted(who, [one, one + 1])
        starts, counts = runs(begins[at[lo:hi]], ends[at[lo:hi]], n[lo:hi], length)
        columns.append((starts, shares(counts, total, terms)))
    a, b, value = [], [], []
    for x in range(len(ids)):
        for y in range(x + 1, len(ids)):
            if (ids[x] // tile, ids[y] // tile) == (i, j):
                a.append(ids[x]), b.append(ids[y])
                value.append(joint_sum(columns[x], columns[y], length) if length else 0)
    lang = groups["lang"][0].as_py()
    return pa.table([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(value, pa.int64())], schema=_PARTS)


def term_counts(documents: DataFrame) -> DataFrame:
    """``COUNTS``: occurrences of each term in each group, and the documents of the group that hold it."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c) for c in ("lang", "source", "text")]
    counted = small_batches(documents).select(*named).mapInArrow(_count, COUNTS)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def source_divergence(
    documents: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP, *, tile: int = TILE, block_counts: int = BLOCK_COUNTS
) -> DataFrame:
    """How far sources of a language are apart, and the terms that set each apart.

    Returns ``lang, source, part, item, value, rank``. Part ``pair`` compares a group with every other group of
    its language by the sum of ``f`` over the kept terms, all ranks; part ``term`` lists the ``top`` kept terms
    that are more frequent in the group than in its language. A null text, language or source is the
    empty string; every row counts as a document, whether its ids or texts repeat or not; equal values rank
    by item in byte order. A language whose terms are all too rare keeps its pairs, with 0. Other columns are
    ignored; an empty table gives no rows.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    counts = stage(term_counts(documents), "term-counts")
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    vocabulary = vocabulary.where(F.col("docs") >= least_documents).drop("docs")
    vocabulary = stage(vocabulary, "vocabulary")
    found = stage(counts.drop("docs").join(vocabulary, ["lang", "term"]), "kept-counts")
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    groups = documents.select(*named).distinct().join(found.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = groups.join(langs, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
    groups = stage(groups.withColumn("id", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1), "groups")
    n_groups = groups.count()

    small = broadcast_if_small(groups, n_groups, 128)
    valued = found.join(small, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), "id", "n",
        share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"),
    )
    telling = valued.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", term_value(F.col("p"), F.col("q")).alias("value"))

    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    telling = telling.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    pairs = _pair_sums(valued, groups, max(1, -(-found.count() // block_counts)), tile)
    sides = pairs.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("s"), "value")
    one = small.select("lang", F.col("id").alias("_a"), "source")
    other = small.select("lang", F.col("id").alias("_b"), F.col("source").alias("item"))
    named_pairs = sides.select("lang", F.col("s.a").alias("_a"), F.col("s.b").alias("_b"), "value").join(one, ["lang", "_a"]).join(other, ["lang", "_b"])
    paired = named_pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    paired = paired.withColumn("rank", F.row_number().over(best))
    return paired.unionByName(telling)


def _pair_sums(valued: DataFrame, groups: DataFrame, blocks: int, tile: int) -> DataFrame:
    """``lang, a, b, value`` of all pairs of groups ``a < b``, whether they share a term or not."""
    listed = F.sort_array(F.collect_list(F.struct("id", "n")))
    columns = valued.groupBy("lang", "item").agg(listed.alias("entry"))  # as many as there are groups at most
    entries = columns.groupBy("lang", "entry").agg(F.count("*").alias("width"))
    entries = stage(entries.repartitionByRange(blocks, "lang", "entry").withColumn("block", F.spark_partition_id()), "entries")

    tiles = F.array_distinct(F.transform("entry", lambda e: F.floor(e["id"] / tile)))
    both = F.flatten(F.transform("tiles", lambda t: F.transform("reach", lambda u: F.struct(F.least(t, u).alias("i"), F.greatest(t, u).alias("j")))))
    spans = groups.groupBy("lang").agg(F.floor((F.count("*") - 1) / tile).alias("last"))
    cells = (
        entries.withColumn("tiles", tiles)
        .join(broadcast_if_small(spans, spans.count(), 64), "lang")
        .withColumn("reach", F.sequence(F.lit(0).cast("long"), "last"))
        .select("lang", "block", "width", "entry", F.explode(F.array_distinct(both)).alias("cell"))
        .select("lang", "block", "width", F.filter("entry", lambda e: F.floor(e["id"] / tile).isin(F.col("cell.i"), F.col("cell.j"))).alias("entry"), "cell.i", "cell.j")
        .select("lang", "block", "i", "j", "width", F.col("entry.id").alias("columns"), F.col("entry.n").alias("counts"))
    )
    # Each block of a language meets its columns, those without an entry in it too; a language without terms has one block.
    held = entries.groupBy("lang", "block").agg(F.sum("width").alias("length"))
    bare = groups.where("terms = 0").select("lang", F.lit(-1).alias("block"), F.lit(0).cast("long").alias("length")).distinct()
    held = held.unionByName(bare)
    met = (
        groups.join(spans, "lang")
        .select("lang", "id", "total", "terms", F.floor(F.col("id") / tile).alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("u"))
        .select("lang", "id", "total", "terms", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"))
        .join(held, "lang")
    )
    cell = ["lang", "block", "i", "j"]
    met = met.toDF(*met.columns)  # columns of its own, since both sides come from one table
    parts = cells.groupBy(*cell).cogroup(met.groupBy(*cell)).applyInArrow(lambda entries, groups: _pairs(entries, groups, tile), PARTS)
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
