"""Divergence of sources: runs, joint runs and the whole report against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemetry_ops.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, id long, width string"


def words(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, least=10, top=10):
    docs = [(lang or "", source or "", words(text)) for text, lang, source in rows]
    found = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t in df if df[t] >= least]
        whole = Counter(t for d in mine for t in d[2] if df[t] >= least)
        by = {s: Counter(t for d in mine if d[1] == s for t in d[2] if df[t] >= least) for s in {d[1] for d in mine}}
        p = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: B023, E731
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in by.items():
            pairs = [(o, sum(f(p(c, t), p(d, t)) for t in kept)) for o, d in by.items() if o != s]
            terms = [(t, f(p(c, t), p(whole, t))) for t in kept if c[t] > 0 and p(c, t) > p(whole, t)]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]):
                    found.append((lang, s, part, item, value, k + 1))
    return sorted(found)


def corpus(seed=3, n=240):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "émile", "Ünï", "naïve", "a1b", "x-y", "日本", "it's", *[f"w{chr(97 + k)}" for k in range(20)]]
    rows = []
    for k in range(n):
        source = rng.choice(["s0", "s0", "s0", "s1", "s2", "s3", None])
        text = " ".join(rng.choices(vocabulary, k=rng.randrange(0, 40)))
        rows.append((text, rng.choice(["en", "en", "en", "fr", None]), source))
    rows += [(None, "en", "silent"), ("", "en", "silent"), ("123 456", "en", "digits"), ("rare words only", "xx", "a"), ("others", "xx", "b"), ("lonely", "yy", "only")]
    rows += [("copy of copy", "en", "s0")] * 12 + [("long " * 60_000, "en", "s1")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(k, t, lang, s, "clash", 5, "clash") for k, (t, lang, s) in enumerate(rows)], SCHEMA)


def report(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def test_report_is_that_of_brute_force(spark):
    rows = corpus()
    assert report(D.source_divergence(frame(spark, rows).repartition(5))) == brute(rows)


@pytest.mark.parametrize("tile, counts", [(1, 7), (3, 1 << 18)])
def test_tiles_and_blocks_change_nothing(spark, tile, counts):
    rows = corpus(9, 150)
    assert report(D.source_divergence(frame(spark, rows), 3, 4, tile=tile, block_counts=counts)) == brute(rows, 3, 4)


def test_empty_table(spark):
    assert D.source_divergence(frame(spark, [])).collect() == []
    only = frame(spark, [(None, None, None)])
    assert D.source_divergence(only).collect() == []  # one group, no other and no term


def test_runs_and_joint_sums():
    rng = np.random.default_rng(1)
    for _ in range(200):
        length = int(rng.integers(1, 30))
        dense = [rng.integers(0, 3, length), rng.integers(0, 3, length)]
        columns = []
        for d in dense:
            at = np.flatnonzero(d)
            starts, counts = D.runs(at, at + 1, d[at], length)
            assert (counts[1:] != counts[:-1]).all()
            assert np.array_equal(np.repeat(counts, np.diff(np.append(starts, length))), d)
            columns.append((starts, D.shares(counts, int(d.sum()), length)))
        p, q = (D.shares(d, int(d.sum()), length) for d in dense)
        assert D.joint_sum(*columns, length) == int(((p - q) ** 2 // (p + q)).sum())


def test_shares_are_exact_at_any_size(spark):
    rng = random.Random(5)
    cases = [(rng.randrange(10 ** rng.randrange(1, 16)), rng.randrange(10**16), rng.randrange(1, 10**7)) for _ in range(300)]
    cases = [(min(c, t), t, v) for c, t, v in cases]
    want = [1 + 10**9 * (c + 2) // (t + 2 * v) for c, t, v in cases]
    assert [int(D.shares(np.array([c]), t, v)[0]) for c, t, v in cases] == want
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k long, c long, t long, v long").withColumn("p", D.share(F.col("c"), F.col("t"), F.col("v")))
    assert [r["p"] for r in df.orderBy("k").collect()] == want
