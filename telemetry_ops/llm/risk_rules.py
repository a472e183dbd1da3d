"""Quality rules whose cutoffs come with a limited risk of rejecting a good document.

Each rule rejects a text whose ratio exceeds a cutoff. Labelled documents are the holdout: per stratum and
rule, cutoffs are tested from the loosest to tighter ones; a cutoff is certified while the exact
binomial p-value of "its false rejection rate exceeds the rule's share of ``RISK``" stays within
``ERROR / (strata * rules)``. Testing in a fixed order needs no further correction inside a sequence, and the
Bonferroni share covers all strata and rules together. Of the certified cutoffs the most useful is taken.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetry_ops.functions.session import broadcast_if_small, stage
from telemetry_ops.llm.text import column, slices, small_batches, split_words

WINDOW = 5
RULES = ("symbols", "caps", "dup_lines", "repeats")
#: Share of good documents of a stratum that all rules together may reject, and the chance of error.
RISK, ERROR = 0.03, 0.05
#: Cutoffs are k / STEPS.
STEPS = 50
#: Good documents that a rejected bad one must outweigh.
GOOD_WEIGHT = 10

COUNTS = (
    "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "symbols double, caps double, dup_lines double, repeats double"
)


def repeated_words(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per text, the words inside windows of ``WINDOW`` words that its text holds twice or more."""
    n = len(codes)
    m = n - WINDOW + 1
    if m <= 0:
        return np.zeros(len(ends), np.int64)
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    c = (codes + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    c ^= c >> np.uint64(29)
    key = owner[:m].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(WINDOW):
        key = (key ^ c[i : i + m]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(32)
    start = np.flatnonzero(owner[:m] == owner[WINDOW - 1 :])
    _, inverse, count = np.unique(key[start], return_inverse=True, return_counts=True)
    twice = start[count[inverse] > 1]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    return np.bincount(owner, weights=np.cumsum(edge[:n]) > 0, minlength=len(ends)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "text"):
            texts = [t or b"" for t in column(piece, "text")]
            codes, distinct, ends = split_words(texts)
            words = np.diff(ends, prepend=0)
            chars = np.array([len(t.decode("utf-8", "replace")) - len(t) + len(t.translate(None, b" \t\n\v\f\r")) for t in texts], np.int64)
            symbols = np.array([len(t) - len(t.translate(None, b"#*$%&|<>")) for t in texts], np.int64)
            shouted = np.array([len(s := w.decode("utf-8", "replace")) > 1 and s.isupper() for w in distinct], bool)
            loud = np.bincount(np.repeat(np.arange(len(ends)), words), weights=shouted[codes] if len(codes) else None, minlength=len(ends))
            lines, again = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for i, t in enumerate(texts):
                own = [line for line in t.split(b"\n") if line.strip()]
                lines[i], again[i] = len(own), len(own) - len(set(own))
            repeats = repeated_words(codes, ends)
            values = [
                words, chars, symbols, again, repeats,
                symbols / np.maximum(chars, 1), loud / np.maximum(words, 1), again / np.maximum(lines, 1), repeats / np.maximum(words, 1),
            ]
            names = [f.split()[0] for f in COUNTS.split(", ")]
            ids = [piece.column(piece.schema.get_field_index(c)) for c in ("doc_id", "stratum")]
            yield pa.record_batch([*ids, *(pa.array(v) for v in values)], names)


def text_counts(docs: DataFrame, stratum: Column) -> DataFrame:
    """One row of ``COUNTS`` per document. Null and empty texts have no words, lines or ratios above 0."""
    rows = small_batches(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), stratum.cast("string").alias("stratum"), F.col("text").cast("binary").alias("text")
    )
    return rows.mapInArrow(_counts, COUNTS)


def binomial_tail(k: int, n: int, p: float) -> float:
    """Chance of at most ``k`` among ``n``: the exact p-value of "the rate is above ``p``"."""
    i = np.arange(min(k, n) + 1)
    if n == 0:
        return 1.0
    steps = np.concatenate([[0.0], np.cumsum(np.log(n - i[:-1]) - np.log(i[1:]))])
    return float(min(1.0, np.exp(steps + i * math.log(p) + (n - i) * math.log1p(-p)).sum()))


def certified(good: np.ndarray, bad: np.ndarray, risk: float, error: float) -> tuple[float | None, float | None]:
    """Cutoff and p-value from counts of good and bad documents per cell, ``cell / STEPS`` being exceeded by later cells."""
    n = int(good.sum())
    best, chosen, p_chosen = 0, None, None
    for cut in range(STEPS - 1, 0, -1):
        lost, caught = int(good[cut + 1 :].sum()), int(bad[cut + 1 :].sum())
        p = binomial_tail(lost, n, risk)
        if p > error:
            break
        if caught - GOOD_WEIGHT * lost > best:
            best, chosen, p_chosen = caught - GOOD_WEIGHT * lost, cut / STEPS, p
    return chosen, p_chosen


def _choose(error: float):
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        stratum, rule = cells[["stratum", "rule"]].iloc[0]
        good, bad = np.zeros(STEPS + 1, np.int64), np.zeros(STEPS + 1, np.int64)
        np.add.at(good, cells["cell"].to_numpy(), cells["good"].to_numpy())
        np.add.at(bad, cells["cell"].to_numpy(), cells["bad"].to_numpy())
        cutoff, p = certified(good, bad, RISK / len(RULES), error)
        return pd.DataFrame({"stratum": [stratum], "rule": [rule], "cutoff": [cutoff], "p_value": [p], "n_good": [int(good.sum())]})

    return run


def risk_cutoffs(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """``stratum, rule, cutoff, p_value, n_good``; a null cutoff means that none could be certified.

    ``labels`` holds ``doc_id`` and ``quality`` (1 good, 0 bad; null is no label). All labelled rows
    count; they are summed per cell, so that a group has at most ``STEPS + 1`` rows.
    """
    marked = labels.where("quality in (0, 1)").select("doc_id", "quality")
    cells = F.explode(
        F.array(*[F.struct(F.lit(r).alias("rule"), F.least(F.ceil(F.col(r) * STEPS), F.lit(STEPS)).cast("int").alias("cell")) for r in RULES])
    )
    summed = stage(
        counts.join(marked, "doc_id")
        .select("stratum", "quality", cells.alias("c"))
        .groupBy("stratum", "c.rule", "c.cell")
        .agg(F.sum("quality").cast("long").alias("good"), F.sum(1 - F.col("quality")).cast("long").alias("bad")),
        "rule-cells",
    )
    tests = max(1, summed.select("stratum").distinct().count() * len(RULES))
    return summed.groupBy("stratum", "rule").applyInPandas(
        _choose(ERROR / tests), "stratum string, rule string, cutoff double, p_value double, n_good long"
    )


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of each document, with the names of the rules it breaks.

    Strata are values of a column of the documents (null is ``und``). Where labels are too few to
    certify a cutoff, its rule rejects nothing. A repeated row is judged again with equal result.
    """
    counts = stage(text_counts(docs, F.coalesce(F.col(stratum).cast("string"), F.lit("und"))), "text-counts")
    cutoffs = stage(risk_cutoffs(counts, labels).groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff")), "cutoffs")
    limits = cutoffs.select("stratum", *[F.col(r).alias(f"max_{r}") for r in RULES])
    limits = broadcast_if_small(limits, limits.count(), 100)
    broken = F.filter(
        F.array(*[F.when(F.col(r) > F.col(f"max_{r}"), F.lit(r)) for r in RULES]), lambda r: r.isNotNull()
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counts.join(limits, "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.size(broken) == 0)).alias("kept"),
        broken.alias("broken_rules"),
    )
