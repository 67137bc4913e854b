"""Shared pieces of the operators in this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the near-duplicate and substring operators: runs of anything but ASCII white space.
#: ``bytes.split()`` without arguments cuts at exactly these six characters.
ASCII_SPACE = "\x20\x09-\x0D"

_MASK = (1 << 64) - 1
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that the cluster names in spark.checkpoint.dir.

    Where that setting is absent a temporary folder is chosen and set, in local mode alone: on a
    cluster other machines would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docloom-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/docloom-{name}-{uuid.uuid4().hex}"


class Tables:
    """Written tables in the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, shared_dir(spark, name)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def remove(self, name: str) -> None:
        """Free a table that no unfinished result reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n in taken:
            n += "_"
        taken.add(n)
        out.append(n)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise (two buffers, whatever the number of steps)."""
    x = x.copy()
    t = x >> np.uint64(30)
    x ^= t
    x *= _MIX1
    np.right_shift(x, np.uint64(27), out=t)
    x ^= t
    x *= _MIX2
    np.right_shift(x, np.uint64(31), out=t)
    x ^= t
    return x


def join_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two runs put together, from their hashes; the order counts."""
    x = a * _GOLD
    x += b
    return mix64(x)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes, by doubling; empty if there are fewer."""
    if len(h) < k:
        return h[:0]
    if k == 1:
        return mix64(h)
    half = window_hashes(h, k // 2)
    n = k // 2
    out = join_hashes(half[: len(half) - n], half[n:])
    return out if k % 2 == 0 else join_hashes(out[: len(h) - k + 1], h[k - 1 :])


class WordHashes(dict):
    """64-bit hashes of words (bytes); a bounded memo, since words follow Zipf's law."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        got = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.LIMIT:
            self[word] = got
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_BASE = 0xD1342543DE82EF95
_SPACE_BYTE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def span_hashes(raw: np.ndarray, a: np.ndarray, z: np.ndarray, part: int = 1 << 19) -> np.ndarray:
    """Hashes of the bytes raw[a:z] of each of the spans (in order, apart), about ``part`` bytes at a time.

    A polynomial over random values of the bytes, got from prefix sums and mixed with the length."""
    out, k = np.empty(len(a), np.uint64), 0
    while k < len(a):
        m = max(k + 1, int(np.searchsorted(a, a[k] + part)))
        lo, hi = int(a[k]), int(z[m - 1])
        power, inverse = _powers_to(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_TABLE[raw[lo:hi]] * power[: hi - lo], out=sums[1:])
        out[k:m] = (sums[z[k:m] - lo] - sums[a[k:m] - lo]) * inverse[a[k:m] - lo]
        k = m
    return mix64(out + (z - a).astype(np.uint64) * _GOLD)


def cut_words(column: pa.Array, part: int = 1 << 19, lower: bool = False):
    """(hashes, words of each value, starts, ends, bytes) of the words of a string column.

    Taken straight from the column's buffers, so no word becomes a Python object.  ``lower`` takes
    A-Z for a-z."""
    none = np.zeros(0, np.int64)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return none.astype(np.uint64), none, none, none, none.astype(np.uint8)
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    size = int(at[-1] - at[0])
    if not size:
        return none.astype(np.uint64), np.zeros(len(column), np.int64), none, none, none.astype(np.uint8)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    if lower:
        raw = _LOWER[raw]
    edges = at - at[0]
    inside = np.zeros(size + 1, bool)
    inside[:size] = ~_SPACE_BYTE[raw]
    # a word starts behind white space or with its value, and ends before white space or the next value
    starts = inside[:size].copy()
    starts[1:] &= ~inside[: size - 1]
    ends = inside[:size] & ~inside[1:]
    filled = edges[:-1] < edges[1:]
    first, last = edges[:-1][filled], edges[1:][filled] - 1
    starts[first] = inside[first]
    ends[last] = inside[last]
    a, z = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    counts = np.diff(np.searchsorted(a, edges))
    return span_hashes(raw, a, z, part), counts, a, z, raw


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words of each value) of a string column."""
    return cut_words(column)[:2]


def number_lists(column: pa.Array, kind) -> list[np.ndarray]:
    """The values of a list column as arrays (empty for null), without Python numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets)
    values = np.asarray(column.values)
    empty = np.zeros(0, kind)
    valid = np.asarray(column.is_valid())
    return [values[offsets[i] : offsets[i + 1]].astype(kind, copy=False) if valid[i] else empty for i in range(len(column))]


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value of a string column, b'' for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    else:
        column = column.cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about ``limit`` bytes of text each: bounds what is in memory at once."""
    import pyarrow.compute as pc

    i = batch.schema.get_field_index(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(i)), 0)).astype(np.int64)
    total, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(start, end - start)
        start = end


def tidy(run):
    """An Arrow function that gives its memory back to the system when its task is done.

    Workers outlive tasks, and what one operator's task held would else add to the next one's."""

    def wrapped(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(batches)
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under the operator's own names: other columns can't clash."""
    return df.select(*(df[old].alias(new) for new, old in columns.items()))


def host_of(column):
    """Host part of a URL, lower case; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(column, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

