"""Language of words in code-switched text by a linear-chain conditional random field.

Every word gets a label. Its features are affixes, character n-grams, the word itself if it is in the lexicon,
and its shape; they are hashed, so that a word's score per label is a sum of learnt weights. Transitions
between neighbours are learnt too. Training maximises the likelihood of labelled word
sequences (a document's words all bear its language) by forward-backward gradients; a text's languages
are its words' mean marginals, again by forward-backward.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemetry_ops.llm.text import column, fold, slices, small_batches, tidy

FOLDS, HELD = 5, 0
UNKNOWN = "und"
#: Hashed features, and weights at most: beyond 64 languages there are fewer features, never fewer languages.
FEATURES, WEIGHTS, LEAST_FEATURES = 1 << 17, 1 << 23, 1 << 13
#: The bound of the sample: so many labelled documents in all, shared out evenly over the languages, but so many of
#: each language in any case; and words of one document. A longer document is represented by equally spaced
#: runs of words from all of it.
SAMPLE_ROWS, LEAST_SAMPLE, SAMPLE_WORDS, RUN = 4000, 24, 120, 20
#: Texts in which a word must occur in the sample to enter the lexicon.
LEXICON = 3
EPOCHS, RATE, RIDGE = 12, 0.5, 1e-6
#: Bytes of text whose marginals are found at a time; each word takes some numbers per language in several arrays at once.
READ_BYTES = 512 << 10
#: Words that a worker remembers before it starts anew.
REMEMBERED = 120_000

PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long"
_SALT = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.arange(128, dtype=np.uint64) * _SALT


def words_of(text: str) -> list[str]:
    """Lower-cased words with a letter, without the marks around them."""
    out = []
    for w in text.lower().split():
        if not w.isalpha():
            w = w.strip("".join({c for c in w if not c.isalpha()}))
        if w:
            out.append(w)
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def features(words: list[str], lexicon: np.ndarray, width: int = FEATURES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, hashed feature and weight; n-grams of a word weigh together as much as two affixes."""
    n = len(words)
    padded = [f"\x02{w}\x03" for w in words]
    size = np.array([len(w) for w in padded], np.int64)
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(n), size)
    end = np.cumsum(size)
    begin = end - size
    owners, keys, weights = [], [], []

    def add(own, key, weight, salt):
        owners.append(own)
        keys.append(_mix(key ^ _SALTS[salt]))
        weights.append(weight)

    grams = {}
    h = codes.copy()
    for length in range(2, 6):
        m = max(0, len(codes) - length + 1)
        h = _mix(h[:m] * _SALT + codes[length - 1 :][:m])
        grams[length] = h
    for length in (2, 3, 4):
        m = len(grams[length])
        inside = np.flatnonzero(owner[:m] == owner[length - 1 :][:m])
        own = owner[inside]
        add(own, grams[length][inside], 2.0 / np.maximum(size[own] - length + 1, 1), length)
    for length in (2, 3, 4, 5):  # affixes, the edge included
        long_ = np.flatnonzero(size >= length)
        add(long_, grams[length][begin[long_]], np.ones(len(long_)), 16 + length)
        add(long_, grams[length][end[long_] - length], np.ones(len(long_)), 32 + length)
    if n:
        whole = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
        if len(lexicon):
            at = np.minimum(np.searchsorted(lexicon, whole), len(lexicon) - 1)
            known = np.flatnonzero(lexicon[at] == whole)
            add(known, whole[known], np.full(len(known), 1.5), 64)
        ascii_ = np.array([w.isascii() for w in words])
        add(np.arange(n), ascii_.astype(np.uint64), np.full(n, 0.3), 65)
    return np.concatenate(owners), (np.concatenate(keys) % np.uint64(width)).astype(np.int64), np.concatenate(weights)


@dataclass
class Field:
    labels: list[str]
    weights: np.ndarray  # features x labels
    transitions: np.ndarray  # labels x labels
    start: np.ndarray
    lexicon: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        own, key, weight = features(words, self.lexicon, len(self.weights))
        return np.stack(
            [np.bincount(own, weights=weight * self.weights[key, k], minlength=len(words)) for k in range(len(self.labels))], axis=1
        ) if words else np.zeros((0, len(self.labels)))


def forward_backward(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Marginals of all words; sequences of the given sizes advance together, longest first.

    Also the log-likelihood normaliser per sequence and, if asked for, the summed expected transitions.
    """
    k = scores.shape[1] if scores.ndim == 2 else len(start)
    order = np.argsort(-sizes, kind="stable")
    begin = (np.cumsum(sizes) - sizes)[order]
    size = sizes[order]
    top = scores.max(1, keepdims=True) if len(scores) else np.zeros((0, 1))
    local = np.exp(scores - top)
    trans, first = np.exp(transitions), np.exp(start)
    alpha, scale = np.zeros_like(local), np.ones(len(local))
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest), "left")  # sequences with more than t words
    for t in range(longest):
        at = begin[: live[t]] + t
        a = local[at] * (first if t == 0 else alpha[at - 1] @ trans)
        scale[at] = a.sum(1)
        alpha[at] = a / scale[at][:, None]
    beta = np.ones_like(local)
    expected = np.zeros((k, k))
    for t in range(longest - 2, -1, -1):
        at = begin[: live[t + 1]] + t
        nxt = local[at + 1] * beta[at + 1] / scale[at + 1][:, None]
        if pairs:
            expected += trans * (alpha[at].T @ nxt)
        beta[at] = nxt @ trans.T
    marginal = alpha * beta
    marginal /= np.maximum(marginal.sum(1, keepdims=True), 1e-300)
    log_z = np.log(np.maximum(scale, 1e-300)) + (top[:, 0] if len(local) else 0)
    return marginal, log_z, expected


def train(texts: list[list[str]], langs: list[str]) -> Field:
    """Accelerated gradient ascent over the sample; per-feature steps (Adagrad)."""
    labels = sorted(set(langs))
    width = FEATURES
    while width * len(labels) > WEIGHTS and width > LEAST_FEATURES:
        width //= 2
    index = {c: i for i, c in enumerate(labels)}
    use = [i for i, c in enumerate(langs) if c in index and texts[i]]
    k = len(labels)
    empty = Field(labels, np.zeros((width, max(k, 1))), np.zeros((max(k, 1),) * 2), np.zeros(max(k, 1)), np.zeros(0, np.uint64))
    if not use:
        return empty
    seen = pd.Series([w for i in use for w in set(texts[i])]).value_counts()
    frequent = np.array(seen.index[seen >= LEXICON], dtype=object)
    lexicon = np.sort(pd.util.hash_array(frequent, categorize=False)) if len(frequent) else np.zeros(0, np.uint64)
    distinct = sorted(seen.index)
    place = {w: i for i, w in enumerate(distinct)}
    own, key, weight = features(distinct, lexicon, width)
    f = Field(labels, np.zeros((width, k)), np.zeros((k, k)), np.zeros(k), lexicon)
    squares, trans_squares, start_squares = np.full((width, k), 1e-8), np.full((k, k), 1e-8), np.full(k, 1e-8)
    codes = [np.array([place[w] for w in texts[i]]) for i in use]
    gold = [index[langs[i]] for i in use]
    rng = np.random.default_rng(7)
    for epoch in range(EPOCHS):
        shuffled = rng.permutation(len(use))
        for part in np.array_split(shuffled, max(1, len(use) // 500)):
            sizes = np.array([len(codes[i]) for i in part])
            flat = np.concatenate([codes[i] for i in part])
            y = np.repeat([gold[i] for i in part], sizes)
            batch, inverse = np.unique(flat, return_inverse=True)
            wanted = np.zeros(len(distinct), bool)
            wanted[batch] = True
            hit = wanted[own]
            renumber = np.cumsum(wanted) - 1
            o, c, v = renumber[own[hit]], key[hit], weight[hit]
            emission = np.stack([np.bincount(o, weights=v * f.weights[c, j], minlength=len(batch)) for j in range(k)], axis=1)
            marginal, _, expected = forward_backward(emission[inverse], sizes, f.transitions, f.start, pairs=True)
            delta = -marginal
            delta[np.arange(len(y)), y] += 1
            per_word = np.stack([np.bincount(inverse, weights=delta[:, j], minlength=len(batch)) for j in range(k)], axis=1)
            n = len(y)
            for j in range(k):
                g = np.bincount(c, weights=v * per_word[o, j], minlength=width) / n - RIDGE * f.weights[:, j]
                squares[:, j] += g * g
                f.weights[:, j] += RATE * g / np.sqrt(squares[:, j])
            observed = np.zeros((k, k))
            np.add.at(observed, ([gold[i] for i in part],) * 2, sizes - 1)
            g = (observed - expected) / n
            trans_squares += g * g
            # Texts may switch: a step ends inside the bound that keeps a word's own evidence from being outvoted by
            # endless runs of one language. What all transitions have in common changes no probability.
            f.transitions += 0.1 * g / np.sqrt(trans_squares)
            f.transitions = np.maximum(f.transitions - f.transitions.max(), -3.0)
            first = np.cumsum(sizes) - sizes
            g = delta[first].sum(0) / n
            start_squares += g * g
            f.start += 0.1 * g / np.sqrt(start_squares)
    return f


def _runs(words: list[str]) -> list[str]:
    """Words of the sample: all of a short text, equally spaced runs of a long one."""
    if len(words) <= SAMPLE_WORDS:
        return words
    starts = np.linspace(0, len(words) - RUN, SAMPLE_WORDS // RUN).astype(int)
    return [w for s in starts for w in words[s : s + RUN]]


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "text"):
            runs = [" ".join(_runs(words_of(t.decode("utf-8", "replace")))) for t in column(piece, "text")]
            kept = [piece.column(piece.schema.get_field_index(c)) for c in ("lang", "h")]
            yield pa.record_batch([*kept, pa.array(runs, pa.string())], ["lang", "h", "words"])


def fit(docs: DataFrame) -> Field:
    """Learn every language of the documents with a text and a language outside the held fold.

    The sample has the documents with the smallest hashes of each language, ``max(LEAST_SAMPLE, SAMPLE_ROWS //
    languages)`` of them; rows that repeat an id and a text count once. Languages are counted first, which reads one
    column; then texts are read once, where each row's hash is below its language's bound, one that lets
    about twice the wanted number through.
    """
    rows = small_batches(docs).where("text is not null and lang is not null").where(fold(F.col("doc_id"), FOLDS) != HELD)
    rows = rows.select(F.col("lang").cast("string").alias("lang"), "text", F.col("doc_id").cast("string").alias("id"))
    counts = rows.groupBy("lang").count().toPandas()  # one row per language
    if not len(counts):
        return train([], [])
    each = max(LEAST_SAMPLE, SAMPLE_ROWS // len(counts))
    share = (2.0 * each + 50) / counts["count"]
    bound = [int(x) for x in np.minimum(share, 1.0) * float(1 << 62)]
    bounds = docs.sparkSession.createDataFrame(list(zip(counts["lang"].tolist(), bound)), "lang string, bound long")
    place = F.shiftrightunsigned(F.xxhash64("id", "text"), 2)
    near = rows.select("lang", "id", "text", place.alias("h")).join(F.broadcast(bounds), "lang").where("h <= bound")  # one row per language
    near = near.select("lang", "h", F.col("text").cast("binary").alias("text")).mapInArrow(_sample, "lang string, h long, words string").distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "words"))
    local = near.withColumn("place", first).where(F.col("place") <= each).toPandas().sort_values(["lang", "h", "words"])
    return train([w.split(" ") if w else [] for w in local["words"]], local["lang"].tolist())


class Reader:
    """Languages of texts; remembers the scores of words, a bounded number of them."""

    def __init__(self, field: Field):
        self.field, self.names = field, [*field.labels, UNKNOWN]
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(field.labels)))

    def words(self, raw: list[bytes | None]) -> list[list[dict]]:
        """The words of each text with the likeliest language of each and its marginal."""
        f, found = self.field, []
        for t in raw:
            words = words_of(t.decode("utf-8", "replace")) if t else []
            if not words or not f.labels:
                found.append([{"word": w, "lang": UNKNOWN, "score": 0.0} for w in words])
                continue
            marginal, _, _ = forward_backward(f.emissions(words), np.array([len(words)]), f.transitions, f.start)
            best = marginal.argmax(1)
            found.append([{"word": w, "lang": f.labels[b], "score": float(m[b])} for w, b, m in zip(words, best, marginal)])
        return found

    def read(self, raw: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, words and switches of each text."""
        f, k = self.field, len(self.field.labels)
        texts = [words_of(t.decode("utf-8", "replace")) if t else [] for t in raw]
        if len(self.known) > REMEMBERED:
            self.known, self.table = {}, np.zeros((0, k))
        new = list({w for ws in texts for w in ws if w not in self.known})
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.table = np.concatenate([self.table, *(f.emissions(new[i : i + 20_000]) for i in range(0, len(new), 20_000))])
        sizes = np.array([len(ws) for ws in texts], np.int64)
        change = np.zeros(len(texts), np.int64)
        if not k:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), sizes, change
        at = np.fromiter((self.known[w] for ws in texts for w in ws), np.int64, int(sizes.sum()))
        marginal, _, _ = forward_backward(self.table[at], sizes, f.transitions, f.start)
        owner = np.repeat(np.arange(len(texts)), sizes)
        total = [np.bincount(owner, weights=marginal[:, j], minlength=len(texts)) for j in range(k)]
        share = np.stack(total, axis=1) / np.maximum(sizes, 1)[:, None]
        word = marginal.argmax(1)
        if len(word) > 1:
            moved = (word[1:] != word[:-1]) & (owner[1:] == owner[:-1])
            change = np.bincount(owner[1:], weights=moved, minlength=len(texts)).astype(np.int64)
        best = np.where(sizes > 0, share.argmax(1), k)
        return [self.names[b] for b in best], np.clip(np.where(sizes > 0, share.max(1), 0.0), 0.0, 1.0), sizes, change


def _predict(f: Field):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(f)
        for batch in batches:
            for piece in slices(batch, "text", READ_BYTES):
                lang, score, sizes, change = reader.read(column(piece, "text"))
                yield pa.record_batch(
                    [
                        *(piece.column(piece.schema.get_field_index(c)) for c in ("doc_id", "held_out")),
                        pa.array(lang, pa.string()), pa.array(score), pa.array(sizes), pa.array(change),
                    ],
                    [c.split()[0] for c in PREDICTED.split(", ")],
                )

    return run


def _keep(f: Field, least: float):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(f)
        for batch in batches:
            for piece in slices(batch, "text", READ_BYTES):
                lang, score, _, _ = reader.read([t if t is None else t.encode("utf-8", "surrogatepass") for t in column(piece, "text")])
                yield piece.filter(pa.array((np.array(lang, object) != UNKNOWN) & (score >= least)))

    return run


def with_language(docs: DataFrame, field: Field, least: float) -> DataFrame:
    """The documents, with their columns, whose language is known with this score at least."""
    return docs.mapInArrow(_keep(field, least), docs.schema)


def predict(docs: DataFrame, field: Field) -> DataFrame:
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"),
        F.col("text").cast("binary").alias("text"),
    )
    return rows.mapInArrow(_predict(field), PREDICTED)


def _label_words(f: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("score", pa.float64())]))
        reader = Reader(f)
        for batch in batches:
            for piece in slices(batch, "text", 256 << 10):
                labels = pa.array(reader.words(column(piece, "text")), kind)
                yield pa.record_batch([piece.column(piece.schema.get_field_index("doc_id")), labels], ["doc_id", "words"])

    return run


def word_languages(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id, words``: each word of a text, in order, with its own language and marginal; null and empty texts have none."""
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_label_words(field), "doc_id long, words array<struct<word: string, lang: string, score: double>>")


def language_id(docs: DataFrame) -> DataFrame:
    """One row of ``PREDICTED`` per document; ``score`` is the mean marginal of the language over the words.

    Null texts and texts without a letter are ``und`` with score 0, as is every text if nothing can be learnt.
    ``n_switches`` counts neighbouring words of different languages. Repeated rows are predicted again.
    """
    return predict(docs, fit(docs))
