"""Helpers that several corpus operators share."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space; words of the contracts are runs of any other characters.
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
NO_ID = -(2**63)
LONG_WORD = 64
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; a temporary one only in local mode, where driver and executors are one process."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = conf.get("spark.master") or ""
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='mailsift-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def whole_id(docs: DataFrame, name: str = "doc_id") -> Column:
    """The id as a long, a null as the least; ids must be whole numbers, as their order decides what stays."""
    kind = docs.schema[name].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{name} must be a whole number, not {kind.simpleString()}; number the rows first")
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written in the shared folder: its lineage ends there and it is computed once."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow over batches of at most ``BATCH_BYTES``, so that long rows don't fill a worker.

    The limit is a setting of the session, read when the plan runs, so it stays as it is set here.
    """
    conf = df.sparkSession.conf
    if int(re.sub(r"\D", "", conf.get(BATCH_SETTING))) > BATCH_BYTES:
        conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text under private names, with two join keys.

    Rows that agree in id and text share their keys, so they get the same result; a null id is a
    value of its own. Other columns are left behind, so their names cannot clash.
    """
    return docs.select(
        whole_id(docs).alias("_d"),
        F.xxhash64("text").alias("_h"),
        F.col("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("_text"),
        *more,
    )


def packed(docs: DataFrame) -> DataFrame:
    """The keys of ``keyed``, and each row whole as the struct ``row``: no column name of the caller can clash with others."""
    return docs.select(whole_id(docs).alias("_d"), F.xxhash64("text").alias("_h"), F.struct("*").alias("row"))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an array."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E6C63D0676A9A99)  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_BYTE = mix(np.arange(256, dtype=np.uint64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """len + 1 prefix sums of a polynomial hash of bytes, modulo 2^64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Hash of bytes [start, end), the same wherever the span stands."""
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def inverse_powers(n: int) -> np.ndarray:
    return _powers(_INVERSE, n)


_PRIME = np.uint64(2**31 - 1)
_MOD_BASES = (1_340_871_413, 709_312_027)
_MOD_BYTE = [(mix(np.arange(256, dtype=np.uint64) + np.uint64(256 * (k + 1))) % (_PRIME - np.uint64(1)) + np.uint64(1)).astype(np.uint64) for k in range(2)]


def _mod_powers(base: int, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of base modulo the prime, by doubling."""
    out = np.ones(max(1, n), np.uint64)
    size = 1
    while size < n:
        step = np.uint64(pow(base, size, int(_PRIME)))
        more = min(size, n - size)
        out[size : size + more] = out[:more] * step % _PRIME
        size += more
    return out


class Rolling:
    """Prefix sums of two polynomial hashes of bytes modulo a prime, which have no texts that collide by their form."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.powers = [_mod_powers(b, n + 1) for b in _MOD_BASES]
        self.prefix = [np.zeros(n + 1, np.uint64) for _ in _MOD_BASES]
        for k, prefix in enumerate(self.prefix):
            np.cumsum(_MOD_BYTE[k][data] * self.powers[k][:n] % _PRIME, out=prefix[1:])
            prefix %= _PRIME

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n bytes from a and from b hash alike."""
        out = np.ones(len(a), bool)
        for p, w in zip(self.prefix, self.powers, strict=True):
            out &= (p[a + n] + _PRIME - p[a]) % _PRIME * w[b] % _PRIME == (p[b + n] + _PRIME - p[b]) % _PRIME * w[a] % _PRIME
        return out

    def windows(self, size: int) -> np.ndarray:
        """A hash of 62 bits of each ``size`` bytes, the same wherever they stand."""
        n = len(self.prefix[0]) - size
        out = np.zeros(n, np.uint64)
        for p, base in zip(self.prefix, _MOD_BASES, strict=True):
            back = _mod_powers(pow(base, -1, int(_PRIME)), n)
            out = out << np.uint64(31) | (p[size:] + _PRIME - p[:-size]) % _PRIME * back % _PRIME
        return mix(out)


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Whether the n bytes from a equal those from b, pair by pair."""
    out, ends = np.ones(len(a), bool), np.cumsum(n)
    i = 0
    while i < len(a):
        before = ends[i] - n[i]
        j = max(i + 1, int(np.searchsorted(ends, before + most, side="right")))
        size = n[i:j]
        owner = np.repeat(np.arange(j - i), size)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        differ = data[a[i:j][owner] + at] != data[b[i:j][owner] + at]
        out[i:j] = np.bincount(owner[differ], minlength=j - i) == 0
        i = j
    return out


def digests(pieces, size: int = 8) -> np.ndarray:
    """BLAKE2 digests of byte strings, as rows of ``size`` / 8 numbers."""
    return np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=size).digest() for x in pieces]), np.uint64).reshape(-1, size // 8)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of all texts, and len + 1 bounds of each text's words."""
    space = np.zeros(256, bool)
    space[list(WHITE)] = True
    inside = ~space[data]
    first = inside.copy()  # a word starts where it is inside and the byte before isn't, or a text begins
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[cuts > 0]
    last[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word, and len + 1 bounds of each text's words.

    Words of over ``LONG_WORD`` bytes are hashed by BLAKE2: the polynomial's modulus is a power of two, and
    long words can be so formed that it takes them for equal.
    """
    start, end, bounds = words(data, offsets)
    out = span_hash(prefix_hash(data), start, end, inverse_powers(len(data) + 1))
    long = np.flatnonzero(end - start > LONG_WORD)
    if len(long):
        out[long] = digests(data[start[i] : end[i]].tobytes() for i in long)[:, 0]
    return out, bounds


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of k words of each text, and the text each belongs to.

    whole: a text of 1 to k - 1 words has one window, all its words.
    """
    n = np.diff(bounds)
    count = np.maximum(n - k + 1, 0)
    owner = np.repeat(np.arange(len(n)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + bounds[:-1][owner]
    out = np.zeros(len(at), np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(3) + hashes[at + i])
    if whole:
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            extra = []
            for d in short:
                h = np.zeros(1, np.uint64)
                for x in hashes[bounds[d] : bounds[d + 1]]:
                    h = mix(h * np.uint64(3) + x)
                extra.append(h[0])
            out, owner = np.concatenate([out, np.array(extra, np.uint64)]), np.concatenate([owner, short])
            order = np.argsort(owner, kind="stable")
            out, owner = out[order], owner[order]
    return out, owner


def batches(column: pa.Array, most: int = 1 << 20):
    """(first row, row after the last, bytes, offsets) of runs of rows of about ``most`` bytes of text."""
    data, offsets = flat(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
