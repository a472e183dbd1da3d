"""Document fingerprints from modular prefix hashes.

``H[i]`` is the sum of ``code[j] * BASE ** j`` over ``j < i``, modulo a prime, under two primes. A span's
hash is ``(H[end] - H[begin]) * BASE ** -begin``: any two spans, of one text or of two, compare in
constant time, and the longest common extension of two positions is a binary search over lengths.

A fingerprint is the length, the hash of the whole text, and the smallest ``SKETCH`` mixed hashes of
its spans of ``SPAN`` code points, so that the likeness of two fingerprints estimates how many spans
their texts share.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetry_ops.llm.text import column, slices, small_batches

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 1299709)
SPAN = 16
SKETCH = 64
#: Bytes of text that one sorted bucket of ids should hold, and buckets at most (then they grow).
BUCKET_BYTES, BUCKETS = 16 << 20, 20_000

RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, common_prefix_edited long, common_prefix_next long"
)

_powers: list[np.ndarray] = []
_inverse: list[np.ndarray] = []


def _grow(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        step = np.uint64(pow(base, len(out), prime))
        out = np.concatenate([out, out * step % np.uint64(prime)])
    return out


def powers(n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Powers of each base and of its inverse, for ``n`` positions at least."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [_grow(b, p, n) for b, p in zip(BASES, PRIMES)]
        _inverse[:] = [_grow(pow(b, -1, p), p, n) for b, p in zip(BASES, PRIMES)]
    return _powers, _inverse


class Prefix:
    """Prefix arrays of one text."""

    def __init__(self, text: str, arrays: list[np.ndarray] | None = None):
        self.text = text
        self.n = len(text)
        if arrays is None:
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
            up, _ = powers(self.n + 1)
            arrays = []
            for k, prime in enumerate(PRIMES):
                h = np.zeros(self.n + 1, np.uint64)
                np.cumsum(codes * up[k][: self.n] % np.uint64(prime), out=h[1:])
                arrays.append(h % np.uint64(prime))
        self.arrays = arrays
        self._spans = None

    def hashes(self, begin, length) -> np.ndarray:
        """Combined 62-bit hashes of the spans; ``begin`` may be an array."""
        begin = np.asarray(begin)
        _, down = powers(self.n + 1)
        parts = []
        for k, prime in enumerate(PRIMES):
            h, p = self.arrays[k], np.uint64(prime)
            parts.append((h[begin + length] + p - h[begin]) % p * down[k][begin] % p)
        return parts[0] << np.uint64(31) | parts[1]

    def spans(self) -> np.ndarray:
        """Mixed hashes of all spans of ``SPAN`` code points; of the whole text if it is shorter."""
        if self._spans is None:
            if self.n == 0:
                self._spans = np.zeros(0, np.uint64)
            elif self.n <= SPAN:
                self._spans = mixed(self.hashes(np.zeros(1, np.int64), self.n))
            else:
                self._spans = mixed(self.hashes(np.arange(self.n - SPAN + 1), SPAN))
        return self._spans

    def followed_by(self, keep: int, other: "Prefix", take: int) -> "Prefix":
        """The first ``keep`` code points, then the first ``take`` of the other, by array algebra."""
        up, _ = powers(keep + take + 1)
        arrays = []
        for k, prime in enumerate(PRIMES):
            p = np.uint64(prime)
            tail = (other.arrays[k][1 : take + 1] * up[k][keep] + self.arrays[k][keep]) % p
            arrays.append(np.concatenate([self.arrays[k][: keep + 1], tail]))
        made = Prefix(self.text[:keep] + other.text[:take], arrays)
        if keep > SPAN and take > SPAN:
            joint = mixed(made.hashes(np.arange(keep - SPAN + 1, keep), SPAN))
            made._spans = np.concatenate([self.spans()[: keep - SPAN + 1], joint, other.spans()[: take - SPAN + 1]])
        return made


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def same_span(a: Prefix, i: int, b: Prefix, j: int, length: int) -> bool:
    return i + length <= a.n and j + length <= b.n and bool(a.hashes(i, length) == b.hashes(j, length))


def common_extension(a: Prefix, i: int, b: Prefix, j: int) -> int:
    """Code points that ``a`` from ``i`` and ``b`` from ``j`` have in common, by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if same_span(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def sketch(spans: np.ndarray) -> np.ndarray:
    """The smallest distinct values."""
    few = np.partition(spans, 4 * SKETCH)[: 4 * SKETCH] if len(spans) > 8 * SKETCH else spans
    low = np.unique(few)[:SKETCH]
    return low if len(low) == SKETCH or few is spans else np.unique(spans)[:SKETCH]


def fingerprint(p: Prefix) -> str:
    """``length:whole:sketch`` in hexadecimal. Equal texts have equal fingerprints."""
    whole = int(p.hashes(0, p.n))
    return f"{p.n:x}:{whole:016x}:{sketch(p.spans()).astype('>u8').tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard similarity of two fingerprints' span sets; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.split(":")[2]), ">u8") for f in (a, b))
    if not len(x) or not len(y):
        return 0.0
    union = np.union1d(x, y)[:SKETCH]
    return float(np.isin(union, np.intersect1d(x, y)).mean())


def _described(doc_id, p: Prefix, print_: str, following: Prefix, following_print: str) -> tuple:
    take = min(p.n // 3, following.n)
    edited = p.followed_by(p.n - p.n // 3, following, take)
    edited_print = fingerprint(edited)
    return (
        doc_id,
        p.n,
        hashlib.sha256(edited.text.encode("utf-8", "surrogatepass")).hexdigest(),
        print_,
        edited_print,
        likeness(print_, edited_print),
        likeness(print_, following_print),
        common_extension(p, 0, edited, 0),
        common_extension(p, 0, following, 0),
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    return pa.record_batch(
        [pa.array(v, k) for v, k in zip(zip(*rows), kinds)], [f.split()[0] for f in RESULT.split(", ")]
    )


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order; each is described once its successor, or its bucket's end, is seen."""
    waiting = None  # bucket, id, arrays, fingerprint
    for batch in batches:
        for piece in slices(batch, "text"):
            out = []
            for doc_id, raw, bucket, after in zip(*(column(piece, c) for c in ("doc_id", "text", "bucket", "after"))):
                p = Prefix((raw or b"").decode("utf-8", "replace"))
                mark = fingerprint(p)
                if doc_id is None:
                    out.append(_described(None, p, mark, p, mark))
                    continue
                if waiting and waiting[0] == bucket:
                    out.append(_described(*waiting[1:], p, mark))
                    waiting = None
                elif waiting:
                    out.append(_described(*waiting[1:], *waiting[2:]))
                    waiting = None
                if not after:
                    waiting = (bucket, doc_id, p, mark)
            if out:
                yield _batch(out)
    if waiting:
        yield _batch([_described(*waiting[1:], *waiting[2:])])


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """Number of bounds below the id, by two searches over arrays of about the root of their number."""
    width = max(1, math.isqrt(len(bounds)))
    parts = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    below = lambda values: F.size(F.filter(values, lambda b: b < doc_id))
    longs = lambda values: F.array(*[F.lit(int(v)) for v in values])
    coarse = F.least(below(longs([p[-1] for p in parts])), F.lit(len(parts) - 1))
    return coarse * width + below(F.element_at(F.array(*[longs(p) for p in parts]), coarse + 1))


def prefix_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document in ``RESULT``; ``common_prefix_*`` count code points by binary search.

    A document's edited text ends with the head of the next one in descending id, the first following
    the last. Equal ids follow in descending text. A null text is empty; two empty texts are alike.
    A row without an id is outside that order and counts as its own next document. Columns beyond
    ``doc_id`` and ``text`` are not read. The text is shuffled once, into buckets of consecutive ids;
    each bucket also gets the first row of the next.
    """
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    size = texts.where("doc_id is not null").agg(F.sum(F.octet_length("text")), F.max("doc_id")).first()
    wanted = min(BUCKETS, max(1, -(-(size[0] or 0) // BUCKET_BYTES)))
    ids = texts.select("doc_id").where("doc_id is not null")
    tops: list[int] = [0]
    if size[1] is not None:
        cuts = ids.agg(
            F.percentile_approx("doc_id", [i / wanted for i in range(1, wanted + 1)], 4 * wanted + 100)
        ).first()[0]
        cuts = sorted({*(int(c) for c in cuts[:-1] if c < size[1]), size[1]})
        # Percentiles may be rounded: the largest id of each bucket is a bound that some row has.
        tops = sorted(r[0] for r in ids.groupBy(_bucket(F.col("doc_id"), cuts).alias("k")).agg(F.max("doc_id")).select("max(doc_id)").collect())
    bucket = _bucket(F.col("doc_id"), tops)
    bounds = F.array(*[F.lit(int(t)) for t in tops])
    place = lambda k, after: F.struct(k.cast("int").alias("bucket"), F.lit(after).alias("after"))
    spread = texts.withColumn(
        "k", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(len(tops)))).otherwise(bucket).cast("int")
    ).select(
        "doc_id",
        "text",
        F.explode(
            F.when(
                F.col("doc_id") == F.element_at(bounds, F.col("k") + 1),
                F.array(place(F.col("k"), False), place((F.col("k") + 1) % len(tops), True)),
            ).otherwise(F.array(place(F.col("k"), False)))
        ).alias("at"),
    ).select("doc_id", "text", "at.bucket", "at.after")
    ordered = spread.repartition(len(tops), "bucket").sortWithinPartitions("bucket", "after", F.desc("doc_id"), F.desc("text"))
    return ordered.mapInArrow(_along, RESULT)
