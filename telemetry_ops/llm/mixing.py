"""Mixing documents to target token shares of domains, by built-in functions alone.

A classifier is counted from the labelled documents, their distinct words and marks of their make-up being
its features, and gives each document posteriors over the domains. The rate of a document, the expected number of its
occurrences in the mix, is nonnegative; rates are the minimum of

    sum_k (expected tokens of k - target of k)^2 / (2 total^2) + RIDGE sum_d tokens_d / total (rate_d - 1)^2 / 2

``RIDGE`` is so small that every target is reached that can be, small domains included; where they cannot all be, the
fewest tokens are misplaced. In the minimum the gradient, projected to nonnegative rates, vanishes:
``rate = max(0, 1 - sum_k m_k p_k)`` with one multiplier per domain, found by Newton steps. Posteriors are rounded to ``1 / LEVELS``, so that the order of their sums does not
matter; a step is one aggregation over the cells of equal posteriors.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetry_ops.functions.session import broadcast_if_small, stage
from telemetry_ops.llm.text import SPACES

#: Domains as the labels tell them.
DOMAINS = ("good", "poor", "toxic")
#: Target shares of tokens.
TARGETS = {"good": 0.96, "poor": 0.03, "toxic": 0.01}
#: The mix holds so many times the natural tokens of the first domain.
ANCHOR = 1.02
#: A feature is evidence if a domain uses it this many times as often as the rest do, and so many standard
#: deviations more often than by chance.
RATIO, DEVIATIONS = 12.0, 6.0
#: Labelled documents that the classifier learns from, at most (about; chosen by a hash of their ids).
SAMPLE = 20_000
#: Share of a domain's labelled documents that must use the feature: what one group of copies uses tells nothing.
LEAST_SHARE = 0.02
#: Evidence that a document gives for a domain at most, and smoothing counts.
MOST, SMOOTH = 30.0, 1.0
LEVELS = 1 << 20
#: Newton steps at most, and how far a domain's tokens may be from its target, as a share of that target, without a warning.
RIDGE, STEPS, TOLERANCE = 1e-6, 60, 0.005


def domain(labels: DataFrame) -> DataFrame:
    """``doc_id, domain`` (index) of rows whose two labels are known; of a repeated id, the worst."""
    known = labels.where("toxic in (0, 1) and quality in (0, 1)")
    worst = F.max(F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0))
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(worst.alias("domain"))


def _features(docs: DataFrame, *keys: Column) -> DataFrame:
    """Rows ``keys, tokens, feature, mark`` of each document: a feature per word, and three marks of its make-up:
    the shares of symbols, of capitals and of distinct words. A word may recur.

    Each step has a projection of its own, so that no word list is made twice, nor once per word. The outer form
    spares the test for an empty list, which would make the list once more; the marks are always there.
    """
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r"))
    size = F.greatest(F.length(text), F.lit(1))
    share = lambda mark, pattern: F.concat(F.lit(mark), F.floor(40 * F.regexp_count(text, F.lit(pattern)) / size))
    rows = docs.select(
        *keys, F.split(trimmed, SPACES).alias("w"), share(" symbols ", "[#*$%&|<>]").alias("m0"), share(" capitals ", "[A-Z]").alias("m1")
    )
    names = [c for c in rows.columns if c not in ("w", "m0", "m1")]
    fresh = F.concat(F.lit(" distinct "), F.floor(20 * F.size(F.array_distinct("w")) / F.size("w")))
    rows = rows.select(*names, "w", "m0", "m1", fresh.alias("m2"))
    tokens = F.when((F.size("w") == 1) & (F.col("w")[0] == ""), 0).otherwise(F.size("w")).cast("long").alias("tokens")
    rows = rows.select(*names, tokens, F.concat(F.array("m0", "m1", "m2"), "w").alias("w"))
    return rows.select(*names, "tokens", F.posexplode_outer("w").alias("at", "word")).select(
        *names, "tokens", F.xxhash64("word").alias("feature"), (F.col("at") < 3).alias("mark")
    )


def evidence(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``feature, e_0 .. e_k``: log of how much more often a domain uses a feature than the others do.

    About ``SAMPLE`` labelled documents are counted, those with equal texts once. Only telling features are kept, of which
    a domain has fewer than the mean number of features of its documents over ``LEAST_SHARE``.
    """
    marked = domain(labels)
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h")).join(marked, "doc_id")
    marked = stage(labelled.groupBy("h", "domain").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "domain"), "labelled-texts")
    part = min(1.0, SAMPLE / max(1, marked.count()))
    marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= int(part * (1 << 30)))
    documents = {r["domain"]: r["count"] for r in marked.groupBy("domain").count().collect()}
    marked = broadcast_if_small(marked, sum(documents.values()), 16)
    learn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(marked, "doc_id")
    n = len(DOMAINS)
    used = _features(learn, F.col("doc_id"), F.col("domain")).select("doc_id", "domain", "feature").distinct()
    counts = used.groupBy("feature").agg(
        *[F.sum((F.col("domain") == k).cast("long")).alias(f"c_{k}") for k in range(n)]
    )
    counts = stage(counts, "feature-counts")
    totals = [float(t or 0) for t in counts.agg(*[F.sum(f"c_{k}") for k in range(n)]).first()]
    everything = max(sum(totals), 1.0)
    all_ = sum((F.col(f"c_{k}") for k in range(1, n)), F.col("c_0"))
    rates = []
    for k in range(n):
        share = totals[k] / everything
        own = (F.col(f"c_{k}") + SMOOTH * share) / max(totals[k], 1.0)
        rest = (all_ - F.col(f"c_{k}") + SMOOTH * (1 - share)) / max(everything - totals[k], 1.0)
        sure = F.col(f"c_{k}") - all_ * share >= DEVIATIONS * F.sqrt(all_ * share)
        sure = sure & (F.col(f"c_{k}") >= LEAST_SHARE * documents.get(k, 0))
        rates.append(F.when((own > RATIO * rest) & sure, F.log(own / rest)).otherwise(0.0).alias(f"e_{k}"))
    found = counts.select("feature", *rates)
    return found.where(" or ".join(f"e_{k} > 0" for k in range(n)))


def posteriors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text_hash, tokens, p`` per document; ``p`` in steps of ``1 / LEVELS``, one per domain.

    Rows with the same id and text are one document.
    """
    n = len(DOMAINS)
    shares = {r["domain"]: r["count"] for r in domain(labels).groupBy("domain").count().collect()}
    whole = sum(shares.values()) + n
    table = stage(evidence(docs, labels), "feature-evidence")
    table = broadcast_if_small(table, table.count(), 64)
    keys = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")]
    hits = (
        _features(docs, *keys)
        .join(table, "feature", "left")
        .where("mark or e_0 is not null")
        .groupBy("doc_id", "text_hash", "tokens", "feature")
        .agg(*[F.first(f"e_{k}").alias(f"e_{k}") for k in range(n)])
    )
    sums = hits.groupBy("doc_id", "text_hash", "tokens").agg(
        *[F.coalesce(F.sum(f"e_{k}"), F.lit(0.0)).alias(f"e_{k}") for k in range(n)]
    )
    sums = stage(sums, "document-evidence")
    # What the lack of any telling feature of a domain says, counted over the labelled documents.
    silent = [F.sum((F.col(f"e_{k}") == 0).cast("long")).alias(f"s_{k}") for k in range(n)]
    marked = sums.select("doc_id", *[f"e_{k}" for k in range(n)]).join(domain(labels), "doc_id")
    seen = {r["domain"]: r for r in marked.groupBy("domain").agg(F.count("*").alias("n"), *silent).collect()}
    logits = []
    for k in range(n):
        rest = [r for d, r in seen.items() if d != k]
        own = (seen[k][f"s_{k}"] + 1) / (seen[k]["n"] + 2) if k in seen else 1.0
        other = (sum(r[f"s_{k}"] for r in rest) + 1) / (sum(r["n"] for r in rest) + 2) if rest else 1.0
        prior = F.log(F.lit((shares.get(k, 0) + 1) / whole))
        told = F.least(F.col(f"e_{k}"), F.lit(MOST))
        logits.append(prior + F.when(F.col(f"e_{k}") == 0, F.lit(math.log(own / other))).otherwise(told))
    weights = [F.exp(x - F.greatest(*logits)) for x in logits]
    levels = [F.round(LEVELS * w / sum(weights[1:], weights[0])) for w in weights]
    first = F.lit(float(LEVELS)) - sum(levels[2:], levels[1])
    return sums.select(
        "doc_id", "text_hash", "tokens", F.array(*[(x / LEVELS) for x in (F.greatest(first, F.lit(0.0)), *levels[1:])]).alias("p")
    )


def _rate(p: Column, multipliers: np.ndarray) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - sum((p[k] * float(m) for k, m in enumerate(multipliers)), F.lit(0.0)))


def _state(cells: DataFrame, multipliers: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected tokens per domain, how they fall as multipliers grow, and half the sum of squared rates of all tokens."""
    n = len(DOMAINS)
    rate, tokens, p = F.col("rate"), F.col("tokens"), F.col("p")
    moved = F.when(rate > 0, tokens).otherwise(0)
    sums = [F.sum(rate * tokens * p[k]) for k in range(n)]
    sums += [F.sum(moved * p[j] * p[k]) for j in range(n) for k in range(n)] + [F.sum(rate * rate * tokens) / 2]
    found = np.array([float(v or 0) for v in cells.withColumn("rate", _rate(p, multipliers)).agg(*sums).first()])
    return found[:n], found[n:-1].reshape(n, n), float(found[-1])


def _multipliers(documents: DataFrame, targets: dict[str, float] | None, anchor: float) -> tuple[DataFrame, np.ndarray, dict]:
    """Cells of equal posteriors, multipliers, and the report of ``fit_rates``. Warns of targets that are not reached."""
    targets = targets or TARGETS
    n = len(DOMAINS)
    cells = stage(documents.groupBy("p").agg(F.sum("tokens").alias("tokens")), "posterior-cells")
    m = np.zeros(n)
    now, fall, squares = _state(cells, m)
    natural, total = now, max(float(now.sum()), 1.0)
    goal = np.array([natural[0] * anchor * targets[d] / targets[DOMAINS[0]] for d in DOMAINS])
    slack = np.full(n, RIDGE * total)
    # The multipliers maximise the dual, which is concave and quadratic in parts.
    value = lambda m, squares: -squares - m @ goal - m @ (slack * m) / 2
    for _ in range(STEPS):
        gradient = now - goal - slack * m
        if (np.abs(gradient) <= 1e-9 * np.maximum(goal, 1.0)).all():
            break
        step, share = np.linalg.solve(fall + np.diag(slack), gradient), 1.0
        while share > 1e-6:
            new = _state(cells, m + share * step)
            if value(m + share * step, new[2]) >= value(m, squares) + 1e-4 * share * (gradient @ step):
                break
            share /= 2
        else:
            break  # no better within double precision
        m = m + share * step
        now, fall, squares = new
    report = {d: {"natural": float(natural[k]), "target": float(goal[k]), "expected": float(now[k])} for k, d in enumerate(DOMAINS)}
    missed = {d: r for d, r in report.items() if abs(r["expected"] - r["target"]) > TOLERANCE * max(r["target"], 1.0)}
    if missed:
        warnings.warn(f"Tokens of the mix are off their targets: {missed}", stacklevel=3)
    return cells, m, report


def fit_rates(documents: DataFrame, targets: dict[str, float] | None = None, anchor: float = ANCHOR) -> tuple[DataFrame, dict]:
    """``p, rate`` per cell of equal posteriors, and what was reached: natural, target and expected tokens."""
    cells, multipliers, report = _multipliers(documents, targets, anchor)
    return cells.select("p", _rate(F.col("p"), multipliers).alias("rate")), report


def mix_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``doc_id, text_hash, tokens, p_<domain>.., rate`` per document.

    Null and empty texts have no token and the prior as posterior. Without labels all posteriors are
    equal, and so are the rates. Targets missed by more than ``TOLERANCE`` raise a warning. Columns beyond ``doc_id`` and ``text`` are not read.
    """
    documents = stage(posteriors(docs, labels), "posteriors")
    _, multipliers, _ = _multipliers(documents, targets, ANCHOR)
    joined = documents.withColumn("rate", _rate(F.col("p"), multipliers))
    return joined.select("doc_id", "text_hash", "tokens", *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The documents, with their columns, that a draw by their rates keeps: always from a rate of 1 on,
    below it by a hash of id and text, so that a draw can be repeated. Repetition above 1 is left to the reader
    of ``mix_rates``."""
    rates = mix_rates(docs, labels, targets)
    drawn = F.pmod(F.xxhash64(F.lit("draw"), "doc_id", "text_hash"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.col("rate")
    out = rates.where(~drawn).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    out = broadcast_if_small(out, out.count(), 24)
    same = F.col("__id").eqNullSafe(docs["doc_id"].cast("long")) & (F.col("__hash") == F.xxhash64(docs["text"]))
    return docs.join(out, same, "left_anti")
