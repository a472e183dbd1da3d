"""Language field: every language is learnt, repeated ids do not crowd others out, words of mixed texts get their own."""

import random

import pyarrow as pa
import pytest

from telemetry_ops.llm import crf

SCHEMA = "doc_id long, text string, lang string, source string, words string, h long"
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüéèñßøåçğ"


def vocabulary(k, n=60):
    """Words of an invented language with syllables of its own."""
    rng = random.Random(1000 + k)
    parts = ["".join(rng.choices(LETTERS, k=rng.randrange(2, 4))) for _ in range(12)]
    return ["".join(rng.choices(parts, k=rng.randrange(2, 4))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "clash", "clash", 1) for i, t, lang in rows], SCHEMA)


def texts(rng, words, n, size=30):
    return [" ".join(rng.choices(words, k=size)) for _ in range(n)]


def test_seventy_languages_are_all_learnt(spark):
    rng, rows = random.Random(1), []
    for k in range(70):
        rows += [(len(rows) + j, t, f"l{k:02}") for j, t in enumerate(texts(rng, vocabulary(k), 12))]
    df = frame(spark, rows)
    field = crf.fit(df)
    assert field.labels == [f"l{k:02}" for k in range(70)] and field.weights.size <= crf.WEIGHTS
    got = [(r["lang_pred"], rows[r["doc_id"]][2]) for r in crf.predict(df, field).where("held_out").collect()]
    assert len(got) > 100 and sum(a == b for a, b in got) / len(got) >= 0.97


def test_repeated_ids_crowd_nobody_out(spark):
    rng = random.Random(2)
    one, other = vocabulary(1), vocabulary(2)
    rows = [(7, t, "aa") for t in texts(rng, one, 6000, 8)] + [(100 + k, t, "zz") for k, t in enumerate(texts(rng, other, 500))]
    rows += [(7, "same same", "aa")] * 300
    df = frame(spark, rows)
    got = [r["lang_pred"] for r in crf.predict(df, crf.fit(df)).where("doc_id >= 100").collect()]
    assert got.count("zz") / len(got) >= 0.97


def test_words_of_mixed_sentences(spark):
    rng = random.Random(3)
    langs = {f"l{k}": vocabulary(k, 200) for k in range(3)}
    rows = [(j * 3 + k, t, lang) for k, (lang, words) in enumerate(langs.items()) for j, t in enumerate(texts(rng, words, 150))]
    field = crf.fit(frame(spark, rows))
    mixed, truth = [], []
    for k in range(40):
        runs = [(lang, rng.choices(langs[lang], k=rng.randrange(2, 7))) for lang in rng.choices(list(langs), k=4)]
        mixed.append((k, " ".join(w for _, ws in runs for w in ws), None))
        truth.append([lang for lang, ws in runs for _ in ws])
    got = {r["doc_id"]: r["words"] for r in crf.word_languages(frame(spark, [*mixed, (900, None, None), (901, "", None)]), field).collect()}
    pairs = [(w["lang"], t) for k, labels in enumerate(truth) for w, t in zip(got[k], labels, strict=True)]
    assert sum(a == b for a, b in pairs) / len(pairs) >= 0.97
    assert got[900] == got[901] == [] and all(0 <= w["score"] <= 1 for k in range(40) for w in got[k])
    switches = {r["doc_id"]: r["n_switches"] for r in crf.predict(frame(spark, mixed), field).collect()}
    assert sum(switches[k] == sum(a != b for a, b in zip(t, t[1:])) for k, t in enumerate(truth)) >= 30


@pytest.mark.parametrize("rows", [[(1, None, "en"), (2, "words", None)], []])
def test_nothing_to_learn(spark, rows):
    assert crf.fit(frame(spark, rows)).labels == []


def test_very_long_text(spark):
    words = {k: vocabulary(k) for k in (5, 6)}
    rng = random.Random(5)
    rows = [(2 * j + k, t, f"l{k}") for k in (5, 6) for j, t in enumerate(texts(rng, words[k], 60))]
    rows += [(9_001, " ".join(words[5] * 3000), "l5"), (9_002, "".join(words[6] * 300), "l6")]
    got = {r["doc_id"]: r for r in crf.language_id(frame(spark, rows)).where("doc_id > 9000").collect()}
    assert got[9_001]["lang_pred"] == "l5" and got[9_001]["n_words"] == 180_000 and got[9_002]["lang_pred"] == "l6"


def test_marginals_are_found_for_small_pieces_of_a_batch(monkeypatch):
    held = []
    read = crf.Reader.read

    def watched(self, raw):
        held.append(sum(len(t) for t in raw))
        return read(self, raw)

    monkeypatch.setattr(crf.Reader, "read", watched)
    texts = ["una casa grande " * 2000] * 40
    field = crf.train([["una", "casa", "grande"]] * 4 + [["the", "house"]] * 4, ["es"] * 4 + ["en"] * 4)
    batch = pa.record_batch([pa.array(texts)], ["text"])
    kept = list(crf._keep(field, 0.35)(iter([batch])))
    assert sum(b.num_rows for b in kept) == 40 and max(held) <= 512 << 10 and sum(held) == 40 * len(texts[0])
