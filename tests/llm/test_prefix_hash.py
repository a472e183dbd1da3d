"""Fingerprints against plain strings."""

import hashlib
import random

from telemetry_ops.llm import prefix_hash as P


def expected(rows):
    """Rows with an id in descending order, each followed by the next, the last by the first."""
    ordered = sorted(rows, key=lambda r: (r[0], r[1] or ""), reverse=True)
    texts = [t or "" for _, t in ordered]
    out = []
    for i, (d, _) in enumerate(ordered):
        a, b = texts[i], texts[(i + 1) % len(texts)]
        cut = len(a) // 3
        edited = a[: len(a) - cut] + b[:cut]
        prefix = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        out.append((d, len(a), hashlib.sha256(edited.encode()).hexdigest(), prefix(a, edited), prefix(a, b)))
    return sorted(out)


def got(df):
    rows = df.collect()
    return rows, sorted((r["doc_id"], r["n_chars"], r["edited_sha256"], r["common_prefix_edited"], r["common_prefix_next"]) for r in rows)


def test_equals_strings(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_BYTES", 3000)
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab é😀\n", k=rng.choice([0, 1, 2, 3, 15, 16, 17, 40, 400]))) for _ in range(150)] + [None, "", "same", "same"]
    rows = [(rng.randrange(-(2**60), 2**60), t) for t in texts]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, bucket int, k string").repartition(5)
    found, compared = got(P.prefix_fingerprints(df))
    assert compared == expected(rows)
    by_text = {}
    texts = dict(rows)
    for r in found:
        by_text.setdefault(texts[r["doc_id"]] or "", set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in by_text.values())
    assert len({next(iter(v)) for v in by_text.values()}) == len(by_text)


def test_repeated_missing_single_and_empty(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    rows = [(3, "abcdef"), (3, "xyzxyz"), (3, "abcdef"), (1, "qqqqqq")]
    assert got(P.prefix_fingerprints(frame(rows)))[1] == expected(rows)
    (one,) = P.prefix_fingerprints(frame([(None, "abcabcabc")])).collect()
    assert one["edited_sha256"] == hashlib.sha256(b"abcabcabc").hexdigest() and one["near_next"] == 1.0
    assert P.prefix_fingerprints(frame([])).collect() == []


def test_spans_and_extensions():
    a, b = P.Prefix("the quick brown fox jumps"), P.Prefix("xx quick brown dog")
    assert P.same_span(a, 4, b, 3, 11) and not P.same_span(a, 4, b, 3, 14) and not P.same_span(a, 4, b, 3, 40)
    assert P.common_extension(a, 4, b, 3) == len("quick brown ")
    joined = a.followed_by(9, b, 7)
    assert P.fingerprint(joined) == P.fingerprint(P.Prefix("the quickxx quic"))


def test_likeness_follows_shared_text():
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefgh ", k=3000))
    other = "".join(rng.choices("abcdefgh ", k=3000))
    near = P.likeness(*(P.fingerprint(P.Prefix(t)) for t in (text, "new start " + text[:1400] + "edit" + text[1400:])))
    half = P.likeness(*(P.fingerprint(P.Prefix(t)) for t in (text, text[:1500] + other[:1500])))
    far = P.likeness(*(P.fingerprint(P.Prefix(t)) for t in (text, other)))
    assert near > 0.85 > half > 0.1 > far
