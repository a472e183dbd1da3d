"""Scores of texts under a class-based bigram model in the manner of Brown et al.

Every training word gets a class by likelihood. The ``COMMON`` most frequent words are exchanged in sweeps: their
neighbours stay distributed, one row per word, and every task finds the class that raises the likelihood of each of its
words most; only the class of each common word and the table of class pairs, both of bounded size, are known to all.
Moves are made at once for a share of the words; a sweep after which the likelihood is not higher is taken back
and tried with half the share. Then every other word is put into the class in which its common neighbours are likeliest,
and the pairs of two such words are counted too, so that the class pairs are those of all bigrams. A token's
probability is that of its class after the class before, times that of its word in the class. Each class keeps the mass of one unseen word; an unseen word takes the class that
most words with its ending have.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from telemetry_ops.functions.session import stage
from telemetry_ops.llm.text import coded_words, fold, hash_words, most_frequent, slices, small_batches

FOLDS, HELD = 7, 2
#: Classes of words; one more, the last, is that of the end.
CLASSES = 48
#: Sweeps at most; clustering ends before if a sweep gains less than ``RISE`` nats a token.
SWEEPS, RISE = 12, 0.01
#: Share of the words that may move in one sweep, and the least one after sweeps that were taken back.
SHARE, LEAST = 0.7, 0.02
#: Words that are exchanged in sweeps, and whose counts and classes every worker holds; those of the others are joined.
COMMON = 1 << 17
#: Groups of endings, for unseen words.
SUFFIXES = 256
#: Weight of the class shares in transitions.
MU = 20.0
PIECE_BYTES = 4 << 20
#: Words are moved in buckets, at least this many of common and of other words, and more where a bucket would hold more tokens
#: than ``FULL``. A common word with more tokens than ``ALONE`` has a bucket of its own.
BUCKETS, FULL, ALONE = 1 << 11, 1 << 17, 1 << 18
#: Words of which the gains of all classes are found at a time, and words that are placed at a time.
BATCH, ROWS = 512, 4096

SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Words of a bucket, with numbers of entries, entries, and hashes of others, one behind the other.
BUNDLE = StructType([StructField("bucket", LongType()), *(StructField(c, BinaryType()) for c in ("words", "sizes", "codes", "counts", "follows", "others"))])
#: Words beyond the common ones with the class of an unseen word with its ending and those of their common neighbours, -1
#: for others; and pairs of two such words.
RARE = "rare array<struct<w:binary,e:int,b:int,a:int>>, pairs array<struct<p:long,pe:int,c:long,ce:int>>"


def suffix(word: bytes) -> int:
    """Group of an unseen word: by its last three bytes."""
    return zlib.crc32(word[-3:]) % SUFFIXES


def _suffixes(words: pa.Array) -> np.ndarray:
    ends = pc.binary_slice(words, -3).dictionary_encode()
    return np.array([suffix(w) for w in ends.dictionary.to_pylist()], np.int64)[ends.indices.to_numpy()]


def _texts(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(
        F.monotonically_increasing_id().alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"),
        F.col("text").cast("binary").alias("text"),
    )


def _tokenised(piece: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    return coded_words(pc.ascii_lower(pc.fill_null(piece.column(piece.schema.get_field_index("text")), b"").view(pa.string())))


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "text", PIECE_BYTES):
            codes, distinct, _ = _tokenised(piece)
            yield pa.record_batch([distinct, pa.array(_hashes(distinct)), pa.array(np.bincount(codes, minlength=len(distinct)))], ["word", "h", "n"])


def _hashes(words: pa.Array) -> np.ndarray:
    """Hashes below zero, so that rows of words beyond the common ones can lie beside those of ranks."""
    return hash_words(words.to_numpy(zero_copy_only=False)).view(np.int64) | np.iinfo(np.int64).min if len(words) else np.zeros(0, np.int64)


def _with_ends(codes: np.ndarray, ends: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, each closed by the end, and where each text ends."""
    return np.insert(codes, ends, end), ends + np.arange(1, len(ends) + 1)


def _ranks(distinct: pa.Array, common: pa.Array) -> np.ndarray:
    """Rank of each word, -1 beyond the common ones, and the end's behind them all."""
    ranks = pc.fill_null(pc.index_in(distinct, value_set=common), -1).to_numpy()
    return np.append(ranks, len(common)).astype(np.int64)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return keys, n.astype(np.int64)
    bits = int(n.max()).bit_length()
    if int(keys.max()).bit_length() + bits < 63:  # numbers are sorted far faster than their order is found
        both = np.sort(keys << bits | n)
        keys, n = both >> bits, both & (1 << bits) - 1
    else:
        order = np.argsort(keys)
        keys, n = keys[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(n, first)


def _bytes(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Values of each row, which end at ``ends``, as bytes: rows are moved and read again in every sweep, which costs far less
    than lists of structs."""
    offsets = pa.py_buffer((np.append(0, ends) * x.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(x)])


def _rows(words: np.ndarray, ends: np.ndarray, codes: np.ndarray, n: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """A row per word of its codes and counts, which end at ``ends``, and of ``others``, of which it has ``sizes``."""
    return pa.record_batch(
        [pa.array(words.astype(np.int64)), _bytes(codes.astype(np.int32), ends), _bytes(n, ends), _bytes(others, np.cumsum(sizes, dtype=np.int64))],
        ["word", "codes", "counts", "others"],
    )


def _packed(keys: np.ndarray, n: np.ndarray, width: int) -> pa.RecordBatch:
    """A row per word of sorted ``keys`` (word times ``width`` plus code), without others."""
    words = np.unique(keys // width)
    return _rows(words, np.searchsorted(keys, (words + 1) * width), keys % width, n, np.zeros(0, np.int64), np.zeros_like(words))


def _filed(words: np.ndarray, keys: np.ndarray, n: np.ndarray, others: np.ndarray, sizes: np.ndarray, width: int) -> pa.RecordBatch:
    """A row of each of ``words``, whose places in it sorted ``keys`` have."""
    return _rows(words, np.searchsorted(keys, np.arange(1, len(words) + 1) * width), keys % width, n, others, sizes)


def _values(column: pa.Array, kind) -> np.ndarray:
    """Values of all rows, whose bytes lie one behind the other."""
    if not len(column):
        return np.zeros(0, kind)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)
    begin, end = offsets[column.offset], offsets[column.offset + len(column)]
    return np.frombuffer(data, kind, (end - begin) // np.dtype(kind).itemsize, begin) if end > begin else np.zeros(0, kind)


def _owners(column: pa.Array, kind) -> np.ndarray:
    """Row of each value."""
    return np.repeat(np.arange(len(column)), pc.binary_length(column).to_numpy() // np.dtype(kind).itemsize)


def _unpacked(batch: pa.RecordBatch, kind=np.int64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and count of each entry."""
    return _owners(batch.column(1), np.int32), _values(batch.column(1), np.int32), _values(batch.column(2), kind)


def _bundles(buckets: np.ndarray, words: np.ndarray, ends: np.ndarray, codes: np.ndarray, n: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """The rows of ``_rows`` as one row per bucket, in which words lie one after the other: far fewer rows are moved and sorted."""
    last = np.append(np.flatnonzero(np.diff(buckets)), len(buckets) - 1)
    small, inner, outer = np.int32, ends[last], np.cumsum(sizes, dtype=np.int64)[last]
    lists = ((words.astype(np.int64), last + 1), (np.diff(ends, prepend=0).astype(small), last + 1), (codes.astype(small), inner))
    lists = (*lists, (n.astype(small), inner), (sizes.astype(small), last + 1), (others, outer))
    return pa.record_batch([pa.array(buckets[last].astype(np.int64)), *(_bytes(*x) for x in lists)], BUNDLE.names)


def _gathered(x: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Values of rows of ``sizes`` that lie one behind the other, by another order of the rows."""
    moved, begin = sizes[order], np.cumsum(sizes) - sizes
    return x[np.repeat(begin[order] - (np.cumsum(moved) - moved), moved) + np.arange(len(x))]


def _opened(alone: np.ndarray):
    """Rows of words, equal ones one after the other, of sorted buckets; a bucket is held, but for those of one word, ``alone``."""

    def rows(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        words, sizes, codes, n, follows, others = (_values(whole.column(i + 1), kind) for i, kind in enumerate((np.int64, *[np.int32] * 4, np.int64)))
        order = np.argsort(words)
        ends = np.cumsum(sizes[order], dtype=np.int64)
        return _rows(words[order], ends, _gathered(codes, sizes, order), _gathered(n, sizes, order), _gathered(others, follows, order), follows[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            buckets = batch.column(0).to_numpy()
            begin = int(np.searchsorted(buckets, buckets[-1]))
            if held and buckets[0] != of:
                yield rows(held)
                held = []
            if begin:
                yield rows([*held, batch.slice(0, begin)])
                held = []
            held, of = [*held, batch.slice(begin)], buckets[-1]
            if of in alone:
                yield rows(held)
                held = []
        if held:
            yield rows(held)

    return run


def _buckets(times: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bucket of each common word and the end, ranks dealt out; buckets of one word; and bits of a hash that are its bucket."""
    size, rare = len(times) + 1, total - int(times.sum())
    dealt = max(BUCKETS, -(-total // FULL))
    hot = int((times > ALONE).sum())
    buckets = hot + np.arange(size) % dealt
    buckets[:hot], buckets[-1] = np.arange(hot), hot + dealt
    return buckets, np.append(np.arange(hot), hot + dealt), min(62, int(max(BUCKETS, rare // FULL)).bit_length() - 1)


def _neighbours(common: pa.Array, buckets: np.ndarray, bits: int):
    """What a piece has next to each of its words, in buckets: ranks of common words behind it, and of those before it after
    them; a word beyond the common ones has its hash for a rank, and in ``others`` those of all such words that follow it."""
    size = len(common) + 1
    width = 2 * size
    by = np.argsort(buckets, kind="stable")
    place = np.argsort(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", PIECE_BYTES):
                codes, distinct, ends = _tokenised(piece)
                ranks = _ranks(distinct, common)
                u, _ = _with_ends(codes.astype(np.int64), ends, len(distinct))
                r = ranks[u]
                before = np.concatenate([[size - 1], r[:-1]])  # a text begins as if after an end
                known = (r >= 0) & (before >= 0)
                a, b = before[known], r[known]
                keys, n = np.unique(np.concatenate([place[a] * width + b, place[b] * width + size + a]), return_counts=True)
                at = np.unique(keys // width)
                if len(at):
                    none = np.zeros(0, np.int64), np.zeros_like(at)
                    yield _bundles(buckets[by[at]], by[at], np.searchsorted(keys, (at + 1) * width), keys % width, n, *none)
                rare = np.flatnonzero(ranks < 0)
                if not len(rare):
                    continue
                h = _hashes(distinct.take(pa.array(rare)))
                mine = ~((h & np.iinfo(np.int64).max) >> (63 - bits))  # below those of common words
                order = np.argsort(mine)
                h, mine = h[order], mine[order]
                w = np.zeros(len(ranks), np.int64)
                w[rare[order]] = np.arange(len(rare))
                w, at = w[u], np.flatnonzero(r < 0)  # an end follows the last word of a piece
                left, right = before[at], r[at + 1]
                keys, n = np.unique(
                    np.concatenate([w[at[right >= 0]] * width + right[right >= 0], w[at[left >= 0]] * width + size + left[left >= 0]]), return_counts=True
                )
                both = at[right < 0]
                both = both[np.argsort(w[both], kind="stable")]
                ends = np.searchsorted(keys, np.arange(1, len(h) + 1) * width)
                yield _bundles(mine, h, ends, keys % width, n, h[w[both + 1]], np.bincount(w[both], minlength=len(h)))

    return run


def _merged(width: int):
    """Adds up the rows of each word, which come one after the other; what is held is one batch and one word's entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        held = none, none, none, none
        for batch in batches:
            if not batch.num_rows:
                continue
            u, codes, n = _unpacked(batch, np.int32)
            word, keys, counts, others = held
            rows = np.concatenate([word, batch.column(0).to_numpy()])
            new = np.append(True, rows[1:] != rows[:-1])
            place = np.cumsum(new) - 1
            others = np.concatenate([others, _values(batch.column(3), np.int64)])
            sizes = np.append(np.full(len(word), len(held[3])), pc.binary_length(batch.column(3)).to_numpy() // others.itemsize)
            sizes = np.bincount(place, weights=sizes).astype(np.int64)
            keys, counts = _summed(np.concatenate([keys, place[u + len(word)] * width + codes]), np.concatenate([counts, n]))
            words, last = rows[new], place[-1]  # the last word may go on
            begin, end = int(np.searchsorted(keys, last * width)), len(others) - int(sizes[-1])
            if last:
                yield _filed(words[:-1], keys[:begin], counts[:begin], others[:end], sizes[:-1], width)
            held = words[-1:], keys[begin:] - last * width, counts[begin:], others[end:]
        if len(held[0]):
            yield _filed(*held, np.array([len(held[3])]), width)

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x, 1e-300)  # of which nothing is left in a sum
    return np.log(x) * x


def likelihood(grid: np.ndarray) -> float:
    """Of all classes after the one before, in nats, with the words' shares in their classes; but for a constant."""
    return float(_xlogx(grid).sum() - _xlogx(grid.sum(1)).sum() - _xlogx(grid.sum(0)).sum())


def gains(grid: np.ndarray, old: np.ndarray, after: np.ndarray, before: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Likelihood that each word (row) adds if it is in each class (column), all other words staying where they are.

    ``after`` and ``before`` count the classes of a word's neighbours, the word's own repetitions ``own`` among them.
    """
    at, k = np.arange(len(old)), len(grid)
    right, left = after.astype(float), before.astype(float)
    right[at, old] -= own  # a word after itself follows it to its new class
    left[at, old] -= own
    rise = lambda x, d: _xlogx(x + d) - _xlogx(x)
    out = np.zeros((len(old), k))
    for mine, other, table in ((right, left, grid.T), (left, right, grid)):
        u, j = np.nonzero(mine)
        if not len(u):
            continue
        value, home, each = mine[u, j], old[u], np.arange(len(u))
        # Words share most of their counts of a class, so that few logarithms are found for all.
        kinds, kind = np.unique(value * k + j, return_inverse=True)
        v, c = np.divmod(kinds, k)
        c = c.astype(np.int64)
        found = (_xlogx(table[c] + v[:, None]) - _xlogx(table)[c])[kind]
        same = np.flatnonzero(j == home)  # with the neighbour's class, of the word in each class; the word itself is taken out
        cells = table[j[same]] - other[u[same]]
        found[same] = rise(cells, value[same, None])
        cell = table[j, home] - value
        cell[same] -= other[u[same], home[same]] + own[u[same]]
        found[each, home] = rise(cell, value)
        first = np.flatnonzero(np.diff(u, prepend=-1))
        out[u[first]] += np.add.reduceat(found, first)
    diagonal = np.tile(np.diag(grid).astype(float), (len(old), 1))
    diagonal[at, old] -= right[at, old] + left[at, old] + own
    out += _xlogx(diagonal + right + left + own[:, None]) - _xlogx(diagonal + right) - _xlogx(diagonal + left) + _xlogx(diagonal)
    for mine, totals in ((right, grid.sum(1)), (left, grid.sum(0))):
        whole = mine.sum(1) + own
        sums = np.tile(totals.astype(float), (len(old), 1))
        sums[at, old] -= whole
        out -= rise(sums, whole[:, None])
    return out


def _grid_of(classes: np.ndarray):
    k, size = CLASSES + 1, len(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = np.zeros(k * k)
        for batch in batches:
            word = batch.column(0).to_numpy()
            u, other, n = _unpacked(batch)
            behind = other < size
            grid += np.bincount(classes[word[u[behind]]] * k + classes[other[behind]], weights=n[behind], minlength=k * k)
        at = np.flatnonzero(grid)
        yield pa.record_batch([pa.array(at), pa.array(grid[at].astype(np.int64))], ["cell", "n"])

    return run


def _cells(rows: DataFrame) -> np.ndarray:
    """The table of class pairs from ``cell, n``."""
    grid = np.zeros((CLASSES + 1) ** 2)
    for r in rows.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        grid[r["cell"]] = r["n"]
    return grid.reshape(CLASSES + 1, CLASSES + 1)


def _moves(classes: np.ndarray, grid: np.ndarray, drawn: np.ndarray):
    """Words, of those ``drawn``, that have a better class, given all others; the last class is left to the end."""
    k, size = CLASSES + 1, len(classes)
    slots = np.concatenate([classes, classes + k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.filter(pa.array(drawn[whole.column(0).to_numpy()]))
            for begin in range(0, whole.num_rows, BATCH):
                batch = whole.slice(begin, BATCH)
                word = batch.column(0).to_numpy()
                u, other, n = _unpacked(batch)
                both = np.bincount(u * 2 * k + slots[other], weights=n, minlength=len(word) * 2 * k).reshape(len(word), 2 * k)
                own = np.bincount(u, weights=n * (other == word[u]), minlength=len(word))
                gain = gains(grid, classes[word], both[:, :k], both[:, k:], own)[:, :CLASSES]
                best, at = gain.argmax(1), np.arange(len(word))
                better = gain[at, best] > gain[at, classes[word]] + 1e-9
                yield pa.record_batch([pa.array(word[better].astype(np.int32)), pa.array(best[better].astype(np.int32))], ["word", "best"])

    return run


def cluster(neighbours: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Class of each common word by its rank, the end last; table of class pairs; likelihood after each sweep that was kept."""
    # Frequent words start in classes of their own, the rest are dealt out, the end alone in the last.
    classes = np.arange(size) % CLASSES
    classes[-1] = CLASSES
    count = lambda c: _cells(neighbours.mapInArrow(_grid_of(c), "cell long, n long"))
    grid = count(classes)
    tokens, history, share = grid.sum(), [likelihood(grid)], SHARE
    rng = np.random.default_rng(11)
    for _ in range(SWEEPS if tokens else 0):
        drawn = rng.random(size) < share
        drawn[-1] = False
        found = neighbours.mapInArrow(_moves(classes, grid, drawn), "word int, best int").toPandas()
        moved = classes.copy()
        moved[found["word"].to_numpy(np.int64)] = found["best"].to_numpy(np.int64)
        new = count(moved)
        rise = likelihood(new) - history[-1]
        if rise <= 0:
            share /= 2
            if share < LEAST:
                break
            continue
        classes, grid = moved, new
        history.append(history[-1] + rise)
        if rise < RISE * tokens:
            break
    return classes, grid, history


def _smoothed(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of all classes, and of each class after each one before."""
    shares = (grid.sum(0) + 0.5) / (grid.sum() + 0.5 * len(grid))
    return shares, (grid + MU * shares[None, :]) / (grid.sum(1, keepdims=True) + MU)


def _placed(classes: np.ndarray, grid: np.ndarray):
    """The best class of words that have none yet, ``h, best``; without ``h``, what they add to the class pairs; and, with
    ``before``, what words follow one of that class ``n`` times.

    All of them move at once, so the likelihood is that of their neighbours under the class pairs of the common words. The
    pairs are smoothed, or an empty class, which fits any single word best, would take them all.
    """
    k = len(grid)
    slots = np.concatenate([classes, classes + k])
    shares, steps = _smoothed(grid)
    behind, ahead = np.log(steps), np.log(steps / shares[None, :])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added = np.zeros(k * k)
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS):
                batch = whole.slice(begin, ROWS)
                h = batch.column(0).to_numpy()
                u, other, n = _unpacked(batch)
                follows, first = (read(batch.column(3), np.int64) for read in (_values, _owners))
                both = np.bincount(u * 2 * k + slots[other], weights=n, minlength=len(h) * 2 * k).reshape(len(h), 2 * k)
                right, left = both[:, :k], both[:, k:]
                best = (right @ behind.T + left @ ahead)[:, :CLASSES].argmax(1)
                best = np.where(both.any(1), best, h % CLASSES)  # without a common neighbour: dealt out
                mine, near = best[u], slots[other]
                cells = np.where(near < k, mine * k + near, (near - k) * k + mine)
                added += np.bincount(cells, weights=n, minlength=k * k)
                m, blank = len(follows), pa.nulls
                yield pa.record_batch(
                    [
                        pa.array(np.concatenate([h, follows])),
                        pa.concat_arrays([pa.array(best.astype(np.int32)), blank(m, pa.int32())]),
                        pa.concat_arrays([blank(len(h), pa.int32()), pa.array(best[first].astype(np.int32))]),
                        pa.concat_arrays([blank(len(h), pa.int64()), pa.array(np.ones(m, np.int64))]),
                    ],
                    ["h", "best", "before", "n"],
                )
        at = np.flatnonzero(added)
        yield pa.record_batch(
            [pa.nulls(len(at), pa.int64()), pa.array(at.astype(np.int32)), pa.nulls(len(at), pa.int32()), pa.array(added[at].astype(np.int64))],
            ["h", "best", "before", "n"],
        )

    return run


@dataclass
class Model:
    place: dict[bytes, int]
    counts: np.ndarray  # of common words
    classes: np.ndarray  # of common words and the end
    endings: np.ndarray  # class of unseen words by suffix
    transitions: np.ndarray  # log10, before x after
    mass: np.ndarray  # log10 of what a word's count, plus one, is divided by in its class
    n: int
    v: int
    ends: int
    history: list[float]


def fit(texts: DataFrame) -> tuple[Model, DataFrame]:
    """The model and the lexicon ``word, h, n, class`` of all training words that are not common."""
    return _fit(texts)[:2]


def _fit(texts: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """Those of ``fit``, and ``h, class`` of each hash in the lexicon."""
    learn = texts.where("not held_out").select("text")
    counts = learn.mapInArrow(_unigrams, "word binary, h long, n long").groupBy("word").agg(F.first("h").alias("h"), F.sum("n").alias("n"))
    counts = stage(counts, "word-counts")
    ends = learn.count()
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    n, v = (total or 0) + ends, distinct + (ends > 0)
    top = most_frequent(counts, "word", "n", COMMON)
    place = {bytes(w): i for i, w in enumerate(top["word"])}
    size = len(place) + 1
    common = pa.array(list(place), pa.binary())
    times = top["n"].to_numpy(np.int64)
    buckets, alone, bits = _buckets(times, total or 0)
    pieces = learn.mapInArrow(_neighbours(common, buckets, bits), BUNDLE).repartition("bucket").sortWithinPartitions("bucket")
    # A word has at most two neighbours for each common word; one beyond them is at most as frequent as any of them, and meets
    # another such word each time.
    opened, merged = _opened(alone), _merged(2 * size)
    words = stage(pieces.mapInArrow(lambda batches: merged(opened(batches)), "word long, codes binary, counts binary, others binary"), "word-neighbours")
    classes, grid, history = cluster(words.where("word >= 0").drop("others"), size)
    placed = stage(words.where("word < 0").mapInArrow(_placed(classes, grid), "h long, best int, before int, n long"), "word-classes")
    found = placed.where("h is not null and best is not null").select("h", F.col("best").alias("class"))
    pairs = placed.where("before is not null").groupBy("h", "before").agg(F.sum("n").alias("n")).join(found, "h")
    grid = grid + _cells(placed.where("h is null").select(F.col("best").alias("cell"), "n"))
    grid = grid + _cells(pairs.select((F.col("before") * (CLASSES + 1) + F.col("class")).alias("cell"), "n"))
    lexicon = stage(counts.join(found, "h").select("word", "h", "n", "class"), "lexicon")
    k = CLASSES + 1
    transitions = np.log10(_smoothed(grid)[1])
    mass = 1.0 + np.bincount(classes[:-1], weights=times + 1, minlength=k)
    members = np.zeros((SUFFIXES, k))
    np.add.at(members, (_suffixes(common), classes[:-1]), 1)
    ending = F.crc32(F.substring("word", -3, 3)) % SUFFIXES
    for r in lexicon.groupBy(ending.alias("ending"), "class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        mass[r["class"]] += r["n"] + r["v"]
        members[r["ending"], r["class"]] += r["v"]
    model = Model(place, times, classes, members.argmax(1), transitions, np.log10(mass), int(n), int(v), ends, history)
    return model, lexicon, found


def _score(model: Model):
    size_log = np.log10(model.n + model.v + 1.0)
    end_gain = np.log10(model.ends + 1.0)
    vocabulary = pa.array(list(model.place), pa.binary())
    counts, known, endings, transitions, mass, ended = model.counts, model.classes, model.endings, model.transitions, model.mass, model.ends > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", PIECE_BYTES):
                codes, distinct, ends = _tokenised(piece)
                size, texts = len(distinct), len(ends)
                rank = _ranks(distinct, vocabulary)[:-1]
                common, beyond = rank >= 0, np.flatnonzero(rank < 0)
                unknown = distinct.take(pa.array(beyond))
                gain = np.zeros(size + 1)
                gain[:size][common] = np.log10(counts[rank[common]] + 1.0)
                # The last code is the end: alone in its class, never rare.
                classes = np.full(size + 1, CLASSES)
                classes[:size][common] = known[rank[common]]
                classes[beyond] = endings[_suffixes(unknown)]
                inside = np.where(np.append(common, False), gain - mass[classes], 0.0)
                u, close = _with_ends(codes.astype(np.int64), ends, size)
                rare, c = np.append(~common, False)[u], classes[u]
                begin = np.concatenate([[0], close[:-1]]) if texts else close
                owner = np.repeat(np.arange(texts), np.diff(close, prepend=0))
                previous = np.concatenate([[size], u[:-1]]) if texts else u
                open_ = rare | np.append(~common, False)[previous]  # the class of a rare word comes from the lexicon
                steps = np.where(open_, 0.0, transitions[classes[previous], c]) + inside[u]
                h = np.zeros(size + 1, np.int64)
                h[beyond] = _hashes(unknown)
                sums = lambda x: np.add.reduceat(x, begin) if texts else np.zeros(0)
                tokens = np.diff(ends, prepend=0) + 1
                at = np.flatnonzero(rare)
                both = at[np.append(~common, False)[previous[at]]]
                near = np.where(rare, -1, c).astype(np.int32)
                words = pa.StructArray.from_arrays(
                    [distinct.take(pa.array(u[at])), *(pa.array(x.astype(np.int32)) for x in (c[at], np.append(CLASSES, near)[at], near[at + 1]))],
                    ["w", "e", "b", "a"],
                )
                pairs = pa.StructArray.from_arrays(
                    [pa.array(h[previous[both]]), pa.array(classes[previous[both]].astype(np.int32)), pa.array(h[u[both]]), pa.array(c[both].astype(np.int32))],
                    ["p", "pe", "c", "ce"],
                )
                offsets = lambda x: pa.array(np.searchsorted(owner[x], np.arange(texts + 1)).astype(np.int32))
                yield pa.record_batch(
                    [
                        *(piece.column(piece.schema.get_field_index(k)) for k in ("key", "doc_id", "held_out")),
                        pa.array(tokens),
                        pa.array((sums((~rare).astype(np.int64)) - (not ended)).astype(np.int64)),
                        pa.array(sums(gain[u]) + end_gain - tokens * size_log),
                        pa.array(sums(steps)),
                        pa.ListArray.from_arrays(offsets(at), words),
                        pa.ListArray.from_arrays(offsets(both), pairs),
                    ],
                    ["key", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "pairs"],
                )

    return run


def _table(spark: SparkSession, model: Model) -> DataFrame:
    """``class, mass, into, out``: what a rare word of a class meets; log10 of the class after and before each one."""
    rows = [(c, float(model.mass[c]), model.transitions[:, c].tolist(), model.transitions[c].tolist()) for c in range(CLASSES + 1)]
    return spark.createDataFrame(rows, "class int, mass double, into array<double>, out array<double>")


def brown_scores(docs: DataFrame) -> DataFrame:
    """One row of ``SCORED`` per document; scores are log10 probabilities of the whole text with its end.

    A null or empty text is its end alone. Documents whose id has remainder ``HELD`` are not learnt from. Words
    outside the ``COMMON`` most frequent meet their counts and classes in a join, and in two where two of them are neighbours.
    Without training texts every base score is 0 and the model falls back to uniform classes.
    Repeated rows are learnt from and scored again; columns beyond ``doc_id`` and ``text`` are not read. Words of equal counts
    are taken in order where only some are common, which changes where they are looked up, not their scores.
    """
    texts = _texts(docs)
    model, lexicon, classes = _fit(texts)
    first = stage(
        texts.mapInArrow(_score(model), f"key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, {RARE}"),
        "common-scores",
    )
    table = F.broadcast(_table(docs.sparkSession, model))  # one row per class
    step = lambda steps, near: F.when(F.col(near) >= 0, F.get(steps, F.col(near))).otherwise(0.0)
    gain = F.log10(F.coalesce("count", F.lit(0)) + 1)
    words = first.select("key", F.inline("rare")).join(lexicon.select(F.col("word").alias("w"), F.col("class").alias("k"), F.col("n").alias("count")), "w", "left")
    words = words.withColumn("class", F.coalesce("k", "e")).join(table, "class").select(
        "key", F.col("count").isNotNull().cast("long").alias("known"), gain.alias("gain"),
        (step("into", "b") + step("out", "a") + gain - F.col("mass")).alias("steps"),
    )
    pairs = first.select("key", F.inline("pairs"))
    for word, ending in (("p", "pe"), ("c", "ce")):
        pairs = pairs.join(classes.select(F.col("h").alias(word), F.col("class").alias("k")), word, "left").withColumn(ending, F.coalesce("k", ending)).drop("k")
    pairs = pairs.join(table.withColumnRenamed("class", "pe"), "pe").select(
        "key", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("gain"), F.get("out", F.col("ce")).alias("steps")
    )
    rest = words.unionByName(pairs).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("known", "gain", "steps")])
    zero = lambda c: F.coalesce(c, F.lit(0))
    return first.drop("pairs").join(rest, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("known")).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("gain")).alias("base_score"), (F.col("score") + zero("steps")).alias("score"),
    )
