"""The shingle join against all pairs."""

import random

import numpy as np
import pytest

from telemetry_ops.llm import ngram_join as J
from telemetry_ops.llm.components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.translate(LOW).split(" ") if w]


def shingles(text):
    w = words(text or "")
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                top[max(x, y)] = min(x, y)
    lowest = {}
    for i, (d, _) in enumerate(rows):
        lowest[root(i)] = min(d, lowest.get(root(i), d))
    return {d: (len(sets[i]), lowest[root(i)], links[i]) for i, (d, _) in enumerate(rows)}


def near_copies(seed, n, size, edits):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    base = [word() for _ in range(size)]
    line = [word() for _ in range(12)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    for _ in range(n):
        out.append(" ".join(line + [word() for _ in range(rng.randrange(3, 40))]))
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = J.ngram_jaccard_join(df).collect()
    assert len(got) == len(rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in got}


@pytest.mark.parametrize("seed", (1, 2))
def test_equals_all_pairs(spark, seed):
    texts = near_copies(seed, 150, 60, 6) + near_copies(seed + 10, 60, 30, 3) + ["a b c", "a b c", "A  b\tc", "a b", "a b c d e", "", " \n", "x"]
    random.Random(seed).shuffle(texts)
    rows = [(1000 - 3 * i, t) for i, t in enumerate(texts)] + [(5000, None)]
    assert found(spark, rows) == brute(rows)


def test_late_shingles_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(J, "LATE_SHINGLES", 20)
    monkeypatch.setattr(J, "GROUP_MEMBERS", 3)
    monkeypatch.setattr(J, "BLOCK_BYTES", 2000)
    rows = list(enumerate(near_copies(3, 80, 50, 5)))
    assert found(spark, rows) == brute(rows)


def test_long_text_and_extra_columns(spark):
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcdefghijk", k=4)) for _ in range(60_000))
    rows = [(1, text), (2, text + " more words here"), (3, "short text")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, n int, g int, shingle int")
    got = {r["doc_id"]: r["component_id"] for r in J.ngram_jaccard_join(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_missing_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "a b c d e f")], "doc_id long, text string")
    got = sorted((tuple(r) for r in J.ngram_jaccard_join(df).collect()), key=str)
    assert got == [(4, 2, 4, 4, 2), (4, 2, 4, 4, 2), (9, 2, 4, 4, 2), (None, 2, None, None, None)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.ngram_jaccard_join(df).collect() == []


def test_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(5)
    a = [np.unique(rng.integers(0, 60, 30)) for _ in range(5)]
    b = [np.unique(rng.integers(0, 60, 30)) for _ in range(6)]
    na, nb = (np.array([len(s) for s in x]) for x in (a, b))
    cut_a, cut_b = [[s[s < 25] for s in x] for x in (a, b)]
    open_, bound = J.overlaps(cut_a, cut_b, na, nb, na - [len(s) for s in cut_a], nb - [len(s) for s in cut_b])
    for row, i in zip(bound, open_):
        assert all(row[j] >= len(np.intersect1d(a[i], b[j])) for j in range(6))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130)) and len(got) == 71
