"""Shared pieces of the text operators: word rules, Arrow batches cut by bytes, label folds."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, for regular expressions.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that a Python worker turns into words at a time; one longer text is its own slice.
SLICE_BYTES = 2 << 20


#: Bytes of one Arrow batch between the JVM and a Python worker; both sides hold it at once.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """Bounds the Arrow batches of the frame's session, since texts may be long; returns the frame."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """``crc32`` of the id as text, modulo ``folds``; a null id has the remainder of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def tidy(run: Callable) -> Callable:
    """A batch function that hands freed memory back when its partition ends: idle workers stay in the executor."""

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            with suppress(OSError, AttributeError):  # only the GNU library has it
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def most_frequent(counts: DataFrame, item: str, n: str, limit: int) -> pd.DataFrame:
    """The ``limit`` items with the largest counts, most frequent first, equal counts by item, on the driver.

    The counts' own distribution, at most some ten thousand steps of a logarithmic scale, tells down to which
    step all fit; of the step that no longer fits, the first ones in order are taken by a top-k over tasks. No task
    sends more than its share.
    """
    step = F.floor(F.log2(F.col(n).cast("double")) * 1024)
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("items")).toPandas().sort_values("step", ascending=False)
    fit = steps["items"].cumsum() <= limit
    parts, rest = [], limit - int(steps["items"][fit].sum())
    if fit.any():
        parts.append(counts.where(step >= int(steps["step"][fit].min())).select(item, n).toPandas())
    if rest and not fit.all():
        split = int(steps["step"][~fit].max())
        parts.append(counts.where(step == split).select(item, n).orderBy(F.desc(n), item).limit(rest).toPandas())
    if not parts:
        return pd.DataFrame({item: [], n: []})
    return pd.concat(parts).sort_values([n, item], ascending=[False, True], ignore_index=True)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about ``limit`` bytes of the binary column, one row at least."""
    if not batch.num_rows:
        return
    sizes = pa.compute.binary_length(batch.column(batch.schema.get_field_index(column)))
    ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(ends):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def split_words(texts: list[bytes | None]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Codes of all words in a row, the distinct words, and where each text's words end.

    Bytes are split at ASCII white space, which is exactly ``[\\x20\\x09-\\x0D]``.
    """
    words = [t.split() if t else [] for t in texts]
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    flat = np.empty(int(ends[-1]) if len(ends) else 0, dtype=object)
    flat[:] = list(chain.from_iterable(words))
    codes, distinct = pd.factorize(flat)
    return codes, distinct, ends


def coded_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """``split_words`` of strings without nulls, whose distinct words stay in Arrow, as bytes.

    The ASCII kernel splits at the same six bytes, whatever the others are.
    """
    words = pc.ascii_split_whitespace(texts)
    flat, offsets = words.flatten(), words.offsets.to_numpy()
    some = pc.not_equal(flat, "")  # empty at either end of a text
    ends = np.append(0, np.cumsum(some.to_numpy(zero_copy_only=False)))[offsets[1:] - offsets[0]]
    coded = flat.filter(some).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.view(pa.binary()), ends


def hash_words(distinct) -> np.ndarray:
    """A stable 64-bit hash of each word."""
    return pd.util.hash_array(np.asarray(distinct, dtype=object), categorize=False)


def lists(values: list[np.ndarray], dtype: pa.DataType) -> pa.ListArray:
    """One list per array."""
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=dtype))
