"""Piece encoding: exact round trip, and the best segmentation of each word."""

import random

import numpy as np
import pytest

from telemetry_ops.llm import tokens as T

TEXTS = ["", " ", "  two  spaces ", "plain words here", "▁ literal ▁▁x", "tab\tnew\nline", "é ñ 日本 😀", "x" * 3000, " " * 700, "a\x00b", "▁", "end ", "\x00M \x00M", "\n\n a\n", "a\n▁ \n  b"]


@pytest.fixture(scope="module")
def v():
    return T.vocabulary(T.MODEL)


def test_round_trip(v):
    raw = [t.encode() for t in TEXTS]
    for text, ids in zip(raw, T.encode_texts(raw, v)):
        assert T.decode_ids(ids, v) == text


def best(word, v):
    """Highest score of a segmentation, by plain dynamic programming over strings."""
    score = {p: s for p, s in zip((v.pieces[i] for i in v.ids), v.scores)}
    top = [0.0] + [-np.inf] * len(word)
    for end in range(1, len(word) + 1):
        c = word[end - 1]
        top[end] = top[end - 1] + v.byte_score * len(c.encode())
        for start in range(max(0, end - v.longest), end):
            top[end] = max(top[end], top[start] + score.get(word[start:end], -np.inf))
    return top[-1]


def test_equals_plain_search(v):
    rng = random.Random(3)
    words = ["▁" + "".join(rng.choices("abcdehinorst é日", k=rng.randrange(1, 14))).replace(" ", "") for _ in range(200)]
    score = dict(zip(v.ids.tolist(), v.scores))
    for word, ids in zip(words, T.encode_words(words, v)):
        bytes_ = set(v.byte_ids.tolist())
        got = sum(score.get(i, v.byte_score if i in bytes_ else -np.inf) for i in ids.tolist())
        assert got == pytest.approx(best(word, v))


def test_long_words_are_searched_as_a_whole(v, monkeypatch):
    rng = random.Random(4)
    score, bytes_ = dict(zip(v.ids.tolist(), v.scores)), set(v.byte_ids.tolist())
    runs = ["".join(rng.choices(["tion", "ment", "the", "日本", "é", "😀", "x", "Qz", "▁"], k=k)) for k in (260, 500, 900)]
    same = T.encode_words(["▁" + r[:500] for r in runs], v)
    monkeypatch.setattr(T, "BLOCK", 97)
    for r, ids in zip(runs, same):  # both searches find the same pieces
        assert T._long_word("▁" + r[:500], v).tolist() == ids.tolist()
    runs = [r.replace("▁", "") for r in runs] + ["internationalization" * 100]
    for r, ids in zip(runs, T.encode_texts([r.encode() for r in runs], v)):
        assert len(r) > T.LONGEST_WORD and T.decode_ids(ids, v) == r.encode()
        assert sum(score.get(i, v.byte_score if i in bytes_ else -np.inf) for i in ids.tolist()) == pytest.approx(best("▁" + r, v))
    remembering = T.Encoder(v)
    monkeypatch.setattr(T, "LONG_REMEMBERED", 1000)
    for _ in range(3):
        assert [len(i) for i in remembering.encode([runs[-1].encode()])] == [len(ids)]
        assert len(remembering.place) == 1


def test_frame_round_trip(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, "y"), (3, TEXTS[3], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    back = T.decode(T.encode(df)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in back if r["doc_id"] is not None) == sorted([(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3])])
    assert all(r["exact"] for r in T.round_trip(df).collect())
    assert T.round_trip(spark.createDataFrame([], "doc_id long, text string")).collect() == []
