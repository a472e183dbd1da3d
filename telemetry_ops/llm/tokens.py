"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

Text becomes pieces as in SentencePiece: a space is put in front and every space becomes U+2581. It is cut
into words that start at such a mark; no piece spans a word's end, so a word is segmented alone, once
per batch. Words of equal length advance together: for each end position and piece length, polynomial
hashes of all their substrings probe the sorted piece keys, and a vectorised maximum keeps score and
backpointer. What no piece covers falls back to bytes, so that every text is decoded exactly.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetry_ops.llm.text import column, lists, slices, small_batches, tidy

MARK = "\u2581"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Stands for U+2581 in a text, which is spelt in bytes; words have no space of their own.
LITERAL = " " + MARK
#: Offset of the Zipf-Mandelbrot law that turns ranks into probabilities.
OFFSET = 1000.0
#: Words of equal length that advance together, at most.
TOGETHER = 4096
#: Characters up to which words of one length advance together. A longer one goes alone, so many characters at a time.
LONGEST_WORD, BLOCK = 512, 1 << 14
#: Characters of longer words that an encoder remembers.
LONG_REMEMBERED = 1 << 22

ENCODED = "doc_id long, n_tokens long, ids array<int>"


class Vocabulary:
    """Pieces of a model file, with scores for a search over whole segmentations.

    The file's scores are merge ranks, whose sums mean nothing; the piece of rank ``r`` gets
    the Zipf-Mandelbrot log-probability of ``1 / (r + OFFSET)`` instead, so that few and frequent pieces
    win. A byte costs more than any piece.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(self.size)]
        self.byte_ids = np.full(256, -1, np.int32)
        normal = []
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                # A mark behind another character would cross a word's end.
                if MARK not in piece.lstrip(MARK):
                    normal.append(i)
        rank = {i: r for r, i in enumerate(sorted(normal, key=lambda i: (-model.get_score(i), i)))}
        self.longest = max(len(self.pieces[i]) for i in normal)
        keys = np.array([hash_of(self.pieces[i]) for i in normal], np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        assert (self.keys[1:] != self.keys[:-1]).all(), "Two pieces share a hash"
        #: Leading bits of the keys: most substrings are no piece, and are told so without a search.
        self.leading = np.zeros(1 << 20, bool)
        self.leading[self.keys >> np.uint64(44)] = True
        self.ids = np.array(normal, np.int32)[order]
        norm = np.log(np.sum(1.0 / (np.arange(len(normal)) + OFFSET)))
        self.scores = np.array([-np.log(rank[i] + OFFSET) - norm for i in normal])[order]
        self.byte_score = 2.0 * self.scores.min()
        self.bytes_of = [p.replace(MARK, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            if i >= 0:
                self.bytes_of[i] = bytes([b])
        self.byte_size = np.array([len(b) for b in self.bytes_of], np.int64)
        self.byte_start = np.cumsum(self.byte_size) - self.byte_size
        self.byte_pool = np.frombuffer(b"".join(self.bytes_of), np.uint8)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def hash_of(piece: str) -> int:
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for c in piece:
            h = h * _FACTOR + np.uint64(ord(c) + 1)
    return int(h)


def _powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _FACTOR, np.uint64))])


def _same_length(words: list[str], v: Vocabulary) -> list[np.ndarray]:
    """Piece ids of words that all have the same length. Arrays are by position, then word."""
    n, m = len(words[0]), len(words)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n)
    codes = np.ascontiguousarray(codes.T).astype(np.uint64) + np.uint64(1)
    prefix = np.zeros((n + 1, m), np.uint64)
    for i in range(n):
        prefix[i + 1] = prefix[i] * _FACTOR + codes[i]
    power = _powers(min(n, v.longest))
    width = np.where(codes > 0x10000, 4, np.where(codes > 0x800, 3, np.where(codes > 0x80, 2, 1)))
    best = np.full((n + 1, m), -np.inf)
    best[0] = 0
    back = np.zeros((n + 1, m), np.int32)
    piece = np.full((n + 1, m), -1, np.int32)
    for end in range(1, n + 1):
        top, start, which = best[end], back[end], piece[end]
        top[:] = best[end - 1] + v.byte_score * width[end - 1]
        start[:] = end - 1
        for length in range(1, min(end, v.longest) + 1):
            key = prefix[end] - prefix[end - length] * power[length]
            some = np.flatnonzero(v.leading[key >> np.uint64(44)])
            if not len(some):
                continue
            key = key[some]
            at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
            score = np.where(v.keys[at] == key, best[end - length][some] + v.scores[at], -np.inf)
            better = score > top[some]
            some, at = some[better], at[better]
            top[some] = score[better]
            start[some] = end - length
            which[some] = v.ids[at]
    # All words go back together; their pieces fill the columns of a matrix from the right.
    rows = np.arange(m)
    taken = np.zeros((m, n), np.int32)
    at, used = np.full(m, n), n
    first = np.full(m, n)
    while (live := np.flatnonzero(at > 0)).size:
        used -= 1
        taken[live, used] = piece[at[live], live]
        first[live] = used
        at[live] = back[at[live], live]
    # A word that ends early in this count has its pieces at the right end as well.
    sizes = n - first
    flat = taken[np.repeat(rows, sizes), np.repeat(first, sizes) + _within(sizes)]
    ends = np.cumsum(sizes).tolist()
    out = [flat[i:j] for i, j in zip([0, *ends], ends)]
    for i in np.unique(np.repeat(rows, sizes)[flat < 0]).tolist():
        out[i] = _spelt(words[i], back[:, i], piece[:, i], v)
    return out


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. inside each run of the given sizes."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _spelt(word: str, back: np.ndarray, piece: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Pieces of a word with a character that goes into bytes."""
    found, at = [], len(word)
    while at > 0:
        start = int(back[at])
        if piece[at] >= 0:
            found.append(np.array([piece[at]], np.int32))
        else:
            found.append(v.byte_ids[list(word[start:at].replace(MARK, " ").encode("utf-8", "surrogatepass"))])
        at = start
    return np.concatenate(found[::-1])


def _long_word(word: str, v: Vocabulary) -> np.ndarray:
    """Piece ids of a long word, by the same search: blocks of it look their pieces up at once and carry the scores
    of the last ``v.longest`` positions on; a position keeps its last piece and the length of that."""
    codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    taken, piece = np.ones(n + 1, np.int16), np.full(n + 1, -1, np.int32)
    power = _powers(v.longest)
    best = [0.0]
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        first = max(0, a + 1 - v.longest)
        part = codes[first:b].astype(np.uint64) + np.uint64(1)
        own = part[a - first :]
        spelt = (v.byte_score * np.where(own > 0x10000, 4, np.where(own > 0x800, 3, np.where(own > 0x80, 2, 1)))).tolist()
        key = np.zeros(b - a, np.uint64)  # of the substrings that end behind each character
        ends, sizes, found = [], [], []
        for length in range(1, min(b, v.longest) + 1):
            low = max(0, length - 1 - a)
            key[low:] += part[a + 1 + low - length - first : b - length - first + 1] * power[length - 1]
            some = low + np.flatnonzero(v.leading[key[low:] >> np.uint64(44)])
            at = np.minimum(np.searchsorted(v.keys, key[some]), len(v.keys) - 1)
            same = v.keys[at] == key[some]
            ends.append(some[same])
            found.append(at[same])
            sizes.append(np.full(len(ends[-1]), length))
        ends, sizes, found = np.concatenate(ends), np.concatenate(sizes), np.concatenate(found)
        order = np.argsort(ends, kind="stable")  # shorter pieces first
        bounds = np.searchsorted(ends[order], np.arange(b - a + 1)).tolist()
        size, ids, scores = sizes[order].tolist(), v.ids[found[order]].tolist(), v.scores[found[order]].tolist()
        for i in range(b - a):
            top, length, which = best[-1] + spelt[i], 1, -1
            for j in range(bounds[i], bounds[i + 1]):
                score = best[-size[j]] + scores[j]
                if score > top:
                    top, length, which = score, size[j], ids[j]
            best.append(top)
            taken[a + 1 + i], piece[a + 1 + i] = length, which
        best = best[-v.longest :]
    out, at = array("i"), n
    while at > 0:
        start = at - int(taken[at])
        if piece[at] >= 0:
            out.append(int(piece[at]))
        else:
            out.extend(v.byte_ids[list(word[start:at].replace(MARK, " ").encode("utf-8", "surrogatepass"))][::-1].tolist())
        at = start
    return np.frombuffer(out, np.int32)[::-1].copy()


def encode_words(words: list[str], v: Vocabulary) -> list[np.ndarray]:
    found: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, group in by_length.items():
        if n > LONGEST_WORD:
            for i in group:
                found[i] = _long_word(words[i], v)
        elif n:
            step = max(1, TOGETHER * 16 // max(16, n))
            for k in range(0, len(group), step):
                part = group[k : k + step]
                for i, ids in zip(part, _same_length([words[i] for i in part], v)):
                    found[i] = ids
    return found


def cut(text: str) -> list[str]:
    """Keys of the words: ``w`` is the word ``MARK + w``, and `` w`` the word ``w`` without a mark in front.

    A run of spaces is in front of its word. No piece holds a line feed, which is a word of its own; so is a mark
    of the text itself, ``LITERAL``.
    """
    plain = MARK not in text and "  " not in text
    first, *lines = text.split("\n")
    words = first.split(" ") if plain else _runs(" " + first)
    for line in lines:
        words.append(" \n")
        found = line.split(" ") if plain else _runs(line)
        if plain and not found[0]:
            words += found[1:]
        else:
            if plain:
                found[0] = " " + found[0]
            words += found
    return words


def _runs(line: str) -> list[str]:
    """Keys of a line whose spaces may come in runs, or that holds marks of its own."""
    words: list[str] = []
    for k, segment in enumerate(line.split(MARK)):
        if k:
            words.append(LITERAL)
        first, *rest = segment.split(" ")
        if first:
            words.append(" " + first)
        run = ""
        for part in rest:
            if part:
                words.append(run + part)
                run = ""
            else:
                run += MARK
        if run:
            words.append(run[1:])
    return words


class Encoder:
    """Encodes texts; remembers the pieces of words, a bounded number of them."""

    def __init__(self, v: Vocabulary, remembered: int = 200_000):
        self.v, self.remembered = v, remembered
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.long = 0
        self.size, self.start, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Piece ids of each text."""
        if len(self.place) > self.remembered or self.long > LONG_REMEMBERED:
            self.forget()
        words = [cut(t.decode("utf-8", "replace")) if t else [] for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        flat = list(chain.from_iterable(words))
        place = self.place
        new = [w for w in set(flat) if w not in place]
        place.update(zip(new, range(len(place), len(place) + len(new))))
        self.long += sum(n for n in map(len, new) if n > LONGEST_WORD)
        literal = self.v.byte_ids[list(MARK.encode())]
        found = encode_words(["" if w == LITERAL else w[1:] if w[:1] == " " else MARK + w for w in new], self.v)
        found = [literal if w == LITERAL else ids for w, ids in zip(new, found)]
        size = np.array([len(f) for f in found], np.int64)
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, *found])
        at = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
        n = self.size[at]
        ends = np.cumsum(n)
        ids = self.pool[np.repeat(self.start[at], n) + _within(n)]
        bounds = np.concatenate([[0], ends])[np.cumsum(sizes)].tolist()
        return [ids[i:j] for i, j in zip([0, *bounds], bounds)]


def encode_texts(texts: list[bytes | None], v: Vocabulary) -> list[np.ndarray]:
    return Encoder(v).encode(texts)


def decode_texts(ids: list[np.ndarray], v: Vocabulary) -> list[bytes]:
    """The texts' bytes; the space that encoding puts in front goes."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    n = v.byte_size[flat]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    whole = v.byte_pool[np.repeat(v.byte_start[flat] - (ends - n), n) + np.arange(total)].tobytes()
    bounds = np.concatenate([[0], ends])[np.cumsum([0, *map(len, ids)])].tolist()
    return [whole[a + 1 : b] for a, b in zip(bounds[:-1], bounds[1:])]


def decode_ids(ids: np.ndarray, v: Vocabulary) -> bytes:
    return decode_texts([ids], v)[0]


def _encode(path: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(path))
        for batch in batches:
            for part in slices(batch, "text"):
                ids = encoder.encode(column(part, "text"))
                doc = part.column(part.schema.get_field_index("doc_id"))
                yield pa.record_batch([doc, pa.array([len(i) for i in ids], pa.int64()), lists(ids, pa.int32())], ["doc_id", "n_tokens", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            ids = [np.asarray(i if i is not None else [], np.int32) for i in batch.column(at).to_pylist()]
            texts = [t.decode("utf-8", "replace") for t in decode_texts(ids, v)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(batch.num_columns) if k != at), pa.array(texts, pa.string())],
                [*(f.name for k, f in enumerate(batch.schema) if k != at), "text"],
            )

    return run


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, n_tokens, ids`` of each document. A null or empty text has no token; a repeated row is
    encoded again; columns beyond ``doc_id`` and ``text`` are not read."""
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_encode(model), ENCODED)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``ids`` back to ``text``, other columns kept. A null list is an empty text."""
    kept = [c for c in encoded.columns if c != "ids"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "ids")
    return encoded.select(*kept, "ids").mapInArrow(_decode(model), f"{kinds}, text string")


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256, exact`` per document.

    Each batch of ids is decoded again where it was made, so that text is not moved; ``exact``
    tells whether the decoded bytes are the text's. ``n_tokens`` of a null or empty text is 0.
    """
    import hashlib

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        encoder = Encoder(v)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = column(part, "text")
                ids = encoder.encode(texts)
                back = decode_texts(ids, v)
                yield pa.record_batch(
                    [
                        part.column(part.schema.get_field_index("doc_id")),
                        pa.array([len(i) for i in ids], pa.int64()),
                        lists(ids, pa.int32()),
                        pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
                        pa.array([b == (t or b"") for b, t in zip(back, texts)], pa.bool_()),
                    ],
                    ["doc_id", "n_tokens", "ids", "decoded_sha256", "exact"],
                )

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"{ENCODED}, decoded_sha256 string, exact boolean")
