"""Learnt operators on the smallest tables: exact counts, held-out quality, odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from telemetry_ops.llm import brown_lm, crf, mixing, risk_rules, string_kernel

SF = "/root/testdata/sf0.01"
ODD = [(None, None, None), (900001, "", "en"), (900002, None, "en"), (900003, "12 34 !!", "en"), (900004, "Rock'n'roll  \t x", None)]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([*ODD, ODD[-1]], "doc_id long, text string, lang string")
    return real.unionByName(odd).selectExpr("*", "1 AS key", "2 AS words", "3 AS margin", "'x' AS stratum", "4 AS tokens").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.select("doc_id", "text", "lang").collect()


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def test_brown_counts_and_gain(docs, rows):
    c = Counter()
    n = 0
    for r in rows:
        if fold(r["doc_id"], 7) != 2:
            w = words(r["text"])
            c.update(w)
            c["\n"] += 1
            n += len(w) + 1
    v = len(c)
    want = Counter()
    for r in rows:
        t = [*words(r["text"]), "\n"]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        want[(r["doc_id"], fold(r["doc_id"], 7) == 2, len(t), sum(w in c for w in t), n, round(base, 6))] += 1
    got = brown_lm.brown_scores(docs).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    held = [r for r in got if r["held_out"]]
    assert all(r["score"] < 0 for r in got)
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_gains_equal_brute_force():
    rng = np.random.default_rng(1)
    size, k = 40, 6
    pairs = rng.integers(0, 4, (size, size)) * (rng.random((size, size)) < 0.3)
    pairs[3, 3] = 9
    classes = rng.integers(0, k, size)

    def value(c):
        g = np.zeros((k, k))
        np.add.at(g, (np.repeat(c, size), np.tile(c, size)), pairs.ravel())
        return g, brown_lm.likelihood(g)

    grid, now = value(classes)
    after = np.stack([np.bincount(classes, weights=pairs[i], minlength=k) for i in range(size)])
    before = np.stack([np.bincount(classes, weights=pairs[:, i], minlength=k) for i in range(size)])
    got = brown_lm.gains(grid, classes, after, before, np.diag(pairs).astype(float))
    for u in range(size):
        for b in range(k):
            moved = classes.copy()
            moved[u] = b
            assert got[u, b] - got[u, classes[u]] == pytest.approx(value(moved)[1] - now, abs=1e-8)


def test_every_word_is_clustered_and_scores_are_normalised(spark, monkeypatch):
    rng = random.Random(4)
    kinds = [[f"{kind}{i}" for i in range(60)] for kind in "abc"]
    rows = []
    for d in range(3000):
        begin = rng.randrange(3)
        rows.append((d, " ".join(rng.choice(kinds[(begin + i) % 3]) for i in range(rng.randrange(1, 30)))))
    rows += [(9000, "neverseen a1 neverseen2 neverseen3"), (None, None), (9001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learnt = Counter(w for d, t in rows if fold(d, 7) != 2 for w in words(t))
    for common in (brown_lm.COMMON, 60):  # most words are then placed and looked up in joins
        monkeypatch.setattr(brown_lm, "COMMON", common)
        model, lexicon = brown_lm.fit(brown_lm._texts(docs))
        known = {w.decode(): (int(model.counts[i]), int(model.classes[i])) for w, i in model.place.items()}
        known |= {bytes(r["word"]).decode(): (r["n"], r["class"]) for r in lexicon.collect()}
        assert {w: n for w, (n, _) in known.items()} == learnt and all(0 <= c < brown_lm.CLASSES for _, c in known.values())
        assert len(model.history) > 1 and all(a < b for a, b in zip(model.history, model.history[1:]))
        if common > len(learnt):
            whole = np.zeros((brown_lm.CLASSES + 1, brown_lm.CLASSES + 1))
            for d, t in rows:
                if fold(d, 7) != 2:
                    path = [brown_lm.CLASSES, *(known[w][1] for w in words(t)), brown_lm.CLASSES]
                    np.add.at(whole, (path[:-1], path[1:]), 1)
            assert brown_lm.likelihood(whole) == pytest.approx(model.history[-1])
        # After any class: all words, one unseen word of each class, and the end.
        inside = np.zeros(brown_lm.CLASSES + 1)
        for n, c in known.values():
            inside[c] += (n + 1) / 10 ** model.mass[c]
        inside[: brown_lm.CLASSES] += 10 ** -model.mass[: brown_lm.CLASSES]
        inside[brown_lm.CLASSES] = 1.0
        assert np.allclose((10**model.transitions) @ inside, 1.0)

        def score(t):
            total, before = 0.0, brown_lm.CLASSES
            for w in words(t):
                n, c = known.get(w) or (0, int(model.endings[brown_lm.suffix(w.encode())]))
                total += model.transitions[before, c] + math.log10(n + 1) - model.mass[c]
                before = c
            return total + model.transitions[before, brown_lm.CLASSES]

        got = brown_lm.brown_scores(docs).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["score"] == pytest.approx(score(dict(rows)[r["doc_id"]]), abs=1e-6)
        held = [r for r in got if r["held_out"]]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.1 * sum(r["n_tokens"] for r in held)


def test_class_pairs_are_those_of_all_bigrams(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(d, " ".join(f"w{int(rng.random() ** 2 * 300)}" for _ in range(rng.randrange(0, 20)))) for d in range(800)]
    monkeypatch.setattr(brown_lm, "COMMON", 20)  # most neighbours are two words beyond the common ones
    model, lexicon = brown_lm.fit(brown_lm._texts(spark.createDataFrame(rows, "doc_id long, text string")))
    known = {w.decode(): int(model.classes[i]) for w, i in model.place.items()}
    known |= {bytes(r["word"]).decode(): r["class"] for r in lexicon.collect()}
    whole = np.zeros((brown_lm.CLASSES + 1, brown_lm.CLASSES + 1))
    for d, t in rows:
        if fold(d, 7) != 2:
            path = [brown_lm.CLASSES, *(known[w] for w in words(t)), brown_lm.CLASSES]
            np.add.at(whole, (path[:-1], path[1:]), 1)
    assert np.allclose(model.transitions, np.log10(brown_lm._smoothed(whole)[1]))


def test_language_held_out(docs, rows):
    lang = {r["doc_id"]: r["lang"] for r in rows}
    got = crf.language_id(docs).collect()
    assert len(got) == len(rows)
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) for r in got)
    real = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900000]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in real]) > 0.97
    odd = {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] in (None, 900001, 900002, 900003)}
    assert set(odd.values()) == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    k, sizes = 3, np.array([4, 0, 2, 5])
    scores, trans, start = rng.normal(size=(sizes.sum(), k)), rng.normal(size=(k, k)), rng.normal(size=k)
    got, log_z, pairs = crf.forward_backward(scores, sizes, trans, start, pairs=True)
    at, expected = 0, np.zeros((k, k))
    for n in sizes:
        want, total = np.zeros((n, k)), 0.0
        for path in np.ndindex(*(k,) * n):
            w = np.exp(sum(scores[at + i, p] for i, p in enumerate(path)) + (start[path[0]] if n else 0) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            total += w
            for i, p in enumerate(path):
                want[i, p] += w
        for path in np.ndindex(*(k,) * n):
            w = np.exp(sum(scores[at + i, p] for i, p in enumerate(path)) + (start[path[0]] if n else 0) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            for a, b in zip(path, path[1:]):
                expected[a, b] += w / total
        if n:
            assert np.allclose(got[at : at + n], want / total) and math.isclose(log_z[at : at + n].sum(), math.log(total))
        at += n
    assert np.allclose(pairs, expected)


def test_rule_counts(docs, rows, labels):
    want = Counter()
    for r in rows:
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        seen = Counter(windows)
        covered = {j for i, x in enumerate(windows) if seen[x] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        want[(r["doc_id"], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed)] += 1
    got = risk_rules.quality_rules(docs, labels).collect()
    assert Counter(tuple(r)[:7] for r in got) == want
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert all(r["kept"] == (not r["base_failed"] and not r["broken_rules"]) for r in got)


def test_certified_cutoffs_keep_their_risk():
    rng = np.random.default_rng(3)
    risk, error, broken = 0.05, 0.1, 0
    for _ in range(200):
        good = np.bincount(np.minimum((rng.beta(1, 8, 400) * 50).astype(int), 50), minlength=51)
        bad = np.bincount(rng.integers(0, 51, 300), minlength=51)
        cut, p = risk_rules.certified(good, bad, risk, error)
        if cut is not None:
            assert p <= error
            # beta(1, 8) exceeds x with chance (1 - x) ** 8
            broken += (1 - (cut + 0.02)) ** 8 > risk
    assert broken <= 0.15 * 200
    assert risk_rules.certified(np.zeros(51, int), np.ones(51, int), risk, error) == (None, None)
    assert risk_rules.binomial_tail(2, 10, 0.3) == pytest.approx(sum(math.comb(10, i) * 0.3**i * 0.7 ** (10 - i) for i in range(3)))


def test_kernel_equals_enumeration():
    def phi(span):
        c, word = [], []
        for i, w in enumerate(span.split()):
            c += [string_kernel.EDGE, *map(string_kernel.letter, map(ord, w))]
            word += [i] * (len(w) + 1)
        c.append(string_kernel.EDGE)
        out, squares = Counter(), 0.0
        for i in range(len(word)):
            ends = max(j for j in range(len(word)) if word[j] <= word[i] + 1) + 1  # the edge behind the next word
            for a in range(1, string_kernel.REACH):
                for b in range(a + 1, string_kernel.REACH):
                    if i + b <= ends:
                        out[(c[i], c[i + a], c[i + b])] += string_kernel.DECAY ** (b - 2)
                        squares += string_kernel.DECAY ** (2 * b - 4)
        return {k: v / math.sqrt(squares) for k, v in out.items()}

    ws = ["idiot", "i-d-i-o-t", "idiiot", "plain", "a", "éclair", "trash", "go away now", "a b c d", "no. yes"]
    got = string_kernel.kernel(ws, ws)
    f = [phi(w.replace("é", "e")) for w in ws[:-1]]
    for i, a in enumerate(f):
        for j, b in enumerate(f):
            assert got[i, j] == pytest.approx(sum(v * b.get(k, 0) for k, v in a.items()))
    assert got[0, 2] > 0.6 > got[0, 3]
    # Margins of all spans of many texts at once are those of the kernel.
    machine = string_kernel.Machine(np.random.default_rng(0).normal(size=64**3).astype(np.float32), 0.25)
    laid = string_kernel.Layout([*ws, "", "One two three four. Five\nsix  seven", " "])
    seen = set()
    for first, last, margin in machine.spans(laid):
        for a, b, m in zip(first.tolist(), last.tolist(), margin.tolist()):
            _, code, weight = string_kernel.subsequences([laid.string(a, b)])
            assert m == pytest.approx((machine.table[code] * weight).sum() + 0.25, abs=1e-4)
            seen.add(laid.string(a, b))
    assert {"One two three four.", "two three four.", "Five", "six  seven"} <= seen and "four. Five" not in seen
    long = "q" * 5000 + " bad"
    assert string_kernel.Layout([long]).words == -(-5000 // string_kernel.LONGEST) + 1
    assert [s for _, s in string_kernel.Layout(["x b-a-d y -z- c d e", "f"]).disguised()] == ["bad", "cde"]
    assert machine.worst(["", " \n"])[1] == [None, None]


def test_toxicity_finds_planted_insults(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("aeinorstlm", k=rng.randrange(3, 9))) for _ in range(400)]
    bad = ["gruffwit", "zwackling"]
    rows, marks = [], []
    for i in range(1500):
        w = rng.choices(vocabulary, k=rng.randrange(5, 60))
        if toxic := i % 5 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        marks.append((i, int(toxic), 1))
    rows += [(5000, "you g-r-u-f-f-w-i-t here"), (5001, "such a gruffxwit now"), (5002, "z w a c k l i n g"), (5003, ""), (5004, None), (None, "gruffwit")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, quality int")
    got = {r["doc_id"]: r for r in string_kernel.toxicity(docs, labels).collect()}
    held = [i for i in range(1500) if fold(i, 4) == 2]
    assert all(got[i]["held_out"] for i in held)
    assert np.mean([got[i]["predicted"] == int(i % 5 == 0) for i in held]) > 0.98
    assert [got[i]["predicted"] for i in (5000, 5001, 5002, 5003, 5004, None)] == [1, 1, 1, 0, 0, 1]
    none = string_kernel.toxicity(docs, labels.where("false")).collect()
    assert {r["predicted"] for r in none} == {0}


def test_toxicity_learns_sentences_of_ordinary_words(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("aeinorstlm", k=rng.randrange(3, 9))) for _ in range(400)]
    phrase = vocabulary[:3]
    rows, marks = [], []
    for i in range(1500):
        w = rng.choices(vocabulary, k=rng.randrange(5, 60))  # each of the three words stands in other texts too
        if i % 5 == 0:
            at = rng.randrange(len(w))
            w[at:at] = phrase
        rows.append((i, " ".join(w), "x", 1.0))
        marks.append((i, int(i % 5 == 0), 1))
    rows += [(6000, " ".join(["plain"] * 60_000 + phrase), "x", 1.0), (6001, " plain plain ".join(phrase), "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, worst string, margin double")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, quality int")
    got = {r["doc_id"]: r["predicted"] for r in string_kernel.toxicity(docs, labels).collect()}
    held = [i for i in range(1500) if fold(i, 4) == 2]
    assert np.mean([got[i] for i in held if i % 5 == 0]) >= 0.9
    assert np.mean([got[i] for i in held if i % 5]) <= 0.05
    assert got[6000] == 1 and got[6001] == 0


def test_rates_reach_their_targets(docs, labels, rows):
    documents = mixing.posteriors(docs, labels)
    rates, report = mixing.fit_rates(documents, {"good": 0.9, "poor": 0.06, "toxic": 0.04})
    for k, d in enumerate(mixing.DOMAINS):
        assert abs(report[d]["expected"] - report[d]["target"]) < 0.03 * sum(r["natural"] for r in report.values())
    assert all(r["rate"] >= 0 for r in rates.collect())
    got = documents.collect()
    assert len(got) == len({(r["doc_id"], r["text"]) for r in rows})
    assert all(abs(sum(r["p"]) - 1) < 1e-9 for r in got)
    kept = mixing.mixed(docs, labels).collect()
    assert 0 < len(kept) <= len(rows) and kept[0].__fields__ == docs.columns


@pytest.mark.parametrize("shares", [(76, 12, 12), (90, 7, 3), (998, 1, 1)])
def test_each_domain_reaches_its_own_target(spark, shares):
    rows = [([float(j == k) for j in range(3)], 1000 * s) for k, s in enumerate(shares)] + [([0.875, 0.0625, 0.0625], 5000), ([0.998, 0.001, 0.001], 9000)]
    _, report = mixing.fit_rates(spark.createDataFrame(rows, "p array<double>, tokens long"))
    for r in report.values():
        assert abs(r["expected"] - r["target"]) <= 0.005 * r["target"]


def test_targets_out_of_reach_are_reported(spark, docs, labels):
    rows = spark.createDataFrame([([0.5, 0.25, 0.25], 1000)], "p array<double>, tokens long")
    with pytest.warns(UserWarning, match="off their targets"):
        mixing.fit_rates(rows)
    found = mixing.posteriors(docs, labels).collect()
    assert any(0 < r["p"][2] < 1 / 256 for r in found)  # not rounded away: the target is 1 %


def test_packed_neighbours_add_up():
    """Rows of a word are added up over batches, whose ends may cut it, and come out once."""
    width, found, want = 10, {}, Counter()
    rows = [(0, [3, 7], [1, 2]), (2, [0], [5]), (2, [0, 9], [1, 1]), (2, [4, 9], [2, 1 << 30]), (2, [9], [1 << 30]), (5, [1], [1])]
    for w, codes, counts in rows:
        for c, n in zip(codes, counts):
            want[w, c] += n
    pack = lambda w, c, n: brown_lm._packed(w * width + np.array(c), np.array(n, np.int32), width)
    pieces = pa.Table.from_batches([pack(*r) for r in rows]).combine_chunks()
    for step in (1, 2, 4, len(rows)):
        found = {}
        for batch in brown_lm._merged(width)(iter(pieces.to_batches(max_chunksize=step))):
            u, codes, n = brown_lm._unpacked(batch)
            for i, c, x in zip(u, codes, n):
                key = batch.column(0)[i].as_py(), int(c)
                assert key not in found
                found[key] = int(x)
        assert found == want


def test_words_in_arrow_are_those_of_the_rule():
    odd = [b"", b" \t\x0b", b" \xff\x00A \xc3\x89 \x1c\x85b ", b"a\x00 a a\x00\x00", None, b"x\x0bY\x0cz\rq\n", b"\xe2\x80\x83 \xc2\xa0A a"]
    rows = pa.record_batch([pa.array(odd * 2, pa.binary())], ["text"])
    for piece in (rows, rows.slice(3, 4), rows.slice(4, 1), rows.slice(0, 0)):
        codes, distinct, ends = brown_lm._tokenised(piece)
        got = [distinct[int(c)].as_py() for c in codes]
        want = [re.findall(rb"[^\x20\x09-\x0D]+", (t or b"").lower()) for t in piece.column(0).to_pylist()]
        assert got == [w for t in want for w in t] and ends.tolist() == list(np.cumsum([len(t) for t in want]))
        assert len(set(distinct.to_pylist())) == len(distinct)


def test_texts_are_read_three_times(spark, docs, monkeypatch):
    """For counts, neighbours of all words at once, and scores."""
    read, run = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, f, schema: (read.append("text" in df.columns), run(df, f, schema))[1])
    brown_lm.brown_scores(docs.limit(50))
    assert sum(read) == 3


def test_gains_find_few_logarithms(monkeypatch):
    rng = np.random.default_rng(2)
    size, k, found, xlogx = 500, 20, [], brown_lm._xlogx
    monkeypatch.setattr(brown_lm, "_xlogx", lambda x: (found.append(np.size(x)), xlogx(x))[1])
    after, before = rng.integers(0, 4, (2, size, k))
    brown_lm.gains(rng.integers(1000, 2000, (k, k)).astype(float), rng.integers(0, k, size), after, before, np.zeros(size))
    assert sum(found) < size * k * k  # 1.5 times as many cells of neighbours' classes, each before and after


def test_rows_beyond_the_common_words_add_up():
    """Also those without a common neighbour, and whatever follows them."""
    rows = [(-9, [3], [7]), (-9, [], [8, 8]), (-9, [3, 4], []), (-5, [], []), (-2, [1], []), (-2, [], [6])]
    pack = lambda w, c, o: brown_lm._rows(
        np.array([w]), np.array([len(c)]), np.array(c, np.int64), np.ones(len(c), np.int32), np.array(o, np.int64), np.array([len(o)])
    )
    pieces = pa.Table.from_batches([pack(*r) for r in rows]).combine_chunks()
    for step in (1, 2, 4, len(rows)):
        found = {}
        for batch in brown_lm._merged(10)(iter(pieces.to_batches(max_chunksize=step))):
            u, codes, n = brown_lm._unpacked(batch)
            others, owner = brown_lm._values(batch.column(3), np.int64), brown_lm._owners(batch.column(3), np.int64)
            for i, w in enumerate(batch.column(0).to_pylist()):
                assert w not in found
                found[w] = dict(zip(codes[u == i].tolist(), n[u == i].tolist())), others[owner == i].tolist()
        assert found == {-9: ({3: 2, 4: 1}, [7, 8, 8]), -5: ({}, []), -2: ({1: 1}, [6])}


def test_words_in_buckets_keep_their_neighbours(monkeypatch):
    """Whatever the pieces, batches and buckets, of which far fewer than words are moved."""
    rng = random.Random(6)
    texts = [" ".join(f"w{int(rng.random() ** 3 * 400)}" for _ in range(rng.randrange(0, 40))) for _ in range(300)]
    seen = Counter(w for t in texts for w in t.split())
    common = [w for w, _ in seen.most_common(90)]
    rank, size = {w: i for i, w in enumerate([*common, "\n"])}, 91
    h = {w: int(brown_lm._hashes(pa.array([w.encode()]))[0]) for w in seen}
    want = {h[w]: (Counter(), Counter()) for w in seen if w not in rank}
    for t in texts:
        path = ["\n", *t.split(), "\n"]
        for a, b in zip(path, path[1:]):
            for w, near, skip in ((a, b, 0), (b, a, size)):
                if near in rank:
                    want.setdefault(rank.get(w, h.get(w)), (Counter(), Counter()))[0][rank[near] + skip] += 1
            if a not in rank and b not in rank:
                want[h[a]][1][h[b]] += 1
    monkeypatch.setattr(brown_lm, "BUCKETS", 8)
    monkeypatch.setattr(brown_lm, "ALONE", 100)
    buckets, alone, bits = brown_lm._buckets(np.array([seen[w] for w in common]), sum(seen.values()))
    assert len(buckets) == size and 1 < len(alone) < 20 and len(set(buckets)) == len(alone) + 8 and bits == 3
    rows = pa.record_batch([pa.array([t.encode() for t in texts])], ["text"])
    for piece, step in ((1 << 9, 1), (1 << 9, 7), (1 << 20, 1000)):
        monkeypatch.setattr(brown_lm, "PIECE_BYTES", piece)
        moved = pa.Table.from_batches(brown_lm._neighbours(pa.array([w.encode() for w in common]), buckets, bits)(iter([rows])))
        if piece > len(" ".join(texts)):
            assert moved.num_rows < len(seen) / 5
        batches = moved.sort_by("bucket").combine_chunks().to_batches(max_chunksize=step)
        found = {}
        for batch in brown_lm._merged(2 * size)(brown_lm._opened(alone)(iter(batches))):
            u, codes, n = brown_lm._unpacked(batch)
            others, owner = brown_lm._values(batch.column(3), np.int64), brown_lm._owners(batch.column(3), np.int64)
            for i, w in enumerate(batch.column(0).to_pylist()):
                assert w not in found
                found[w] = Counter(dict(zip(codes[u == i].tolist(), n[u == i].tolist()))), Counter(others[owner == i].tolist())
        assert found == want


def test_empty_tables(spark, docs, labels):
    none = docs.where("false")
    assert brown_lm.brown_scores(none).collect() == []
    assert crf.language_id(none).collect() == []
    assert risk_rules.quality_rules(none, labels).collect() == []
    assert string_kernel.toxicity(none, labels).collect() == []
    assert mixing.mix_rates(none, labels).collect() == []
    assert {r["kept"] for r in risk_rules.quality_rules(docs, labels.where("false")).where("not base_failed").collect()} == {True}
    assert mixing.mix_rates(docs, labels.where("false")).count() > 0
