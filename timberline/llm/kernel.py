"""Vectorised byte and word primitives shared by the text operators.

Every helper works on a *chunk*: the UTF-8 bytes of several documents laid end
to end, plus the offsets at which each document starts.  Chunks are cut by
bytes, so a worker's memory depends on the chunk size and on the longest single
document, never on the number of rows in an Arrow batch.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U = np.uint64
CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch, by which the memory of both ends of a pipe to Python is bounded.
BATCH_ROWS = 1000
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)

#: Bytes that separate words, \x20 and \x09-\x0D.
WORD_SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"

_IS_WORD = np.ones(256, bool)
_IS_WORD[list(WORD_SEPARATORS)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


# ----------------------------------------------------------------- storage


def work_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir; a temporary one only where that is unset and the master local, as in tests."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set, and executors of a cluster share no local folder")
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="timberline-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, so that a lost executor costs only the stage it was in.

    Shuffle files of plans that are of no more use are deleted by Spark's cleaner
    once the driver has collected their plans, so that is done here.
    """
    spark = df.sparkSession
    _collect(spark)
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    schema = df.schema
    del df
    _collect(spark)
    out = spark.read.schema(schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` made, once all that is read from them has been written in its turn."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame) -> DataFrame:
    """df itself, whose session now hands batches of BATCH_ROWS rows at most to Python: rows here are whole texts or packed blobs."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def _collect(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give memory that a worker has freed back to the system: it stays alive between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def fresh(name: str, df: DataFrame) -> str:
    """A column name like this one that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions_for(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


# ------------------------------------------------------------------ chunks


class Chunk:
    """Documents laid end to end: data (uint8), off (int64, one more than documents), rows (their positions in the batch)."""

    __slots__ = ("data", "off", "first", "n")

    def __init__(self, data: np.ndarray, off: np.ndarray, first: int):
        self.data, self.off, self.first, self.n = data, off, first, len(off) - 1


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary Arrow column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if pa.types.is_null(column.type):
        column = pa.array([""] * len(column), pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    data = data[off[0] : off[-1]]
    return data, off - off[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    data, off = text_buffers(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield Chunk(data[off[i] : off[j]], off[i : j + 1] - off[i], i)
        i = j


# ------------------------------------------------------------------ hashes

_pow: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown."""
    have = _pow.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = np.ones(size, np.uint64)
        m = 1
        while m < size:
            out[m : 2 * m] = out[:m] * U(pow(base, m, 1 << 64))
            m *= 2
        have = _pow[base] = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    h = np.array(h, np.uint64)
    t = np.empty_like(h)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0)):
        np.right_shift(h, U(shift), out=t)
        np.bitwise_xor(h, t, out=h)
        if factor:
            np.multiply(h, U(factor), out=h)
    return h


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """H with H[j]-H[i] a polynomial of bytes i..j; one longer than data."""
    codes = _BYTE_CODE[_LOWER[data]] if lower else _BYTE_CODE[data]
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(codes * powers(_BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes start..end, alike wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(_BASE_INV, len(prefix))[start] + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def window_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Polynomial (to be mixed) of bytes i..i+k-1 for every i that has as many: sums of doubling widths, put together by the bits of k."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    part, width, done = _BYTE_CODE[data], 1, 0
    out, t = np.zeros(n, np.uint64), np.empty(len(data), np.uint64)
    while width <= k:
        if k & width:
            np.multiply(part[done : done + n], U(pow(_BASE, done, 1 << 64)), out=t[:n])
            out += t[:n]
            done += width
        if width * 2 <= k:
            m = len(part) - width
            np.multiply(part[width:], U(pow(_BASE, width, 1 << 64)), out=t[:m])
            part = part[:m]
            part += t[:m]
        width *= 2
    return out


# ------------------------------------------------------------------- words


class Words:
    """start, end: of each word in the chunk; at: index of each document's first word, one more than documents."""

    __slots__ = ("start", "end", "at", "doc")

    def __init__(self, chunk: Chunk, is_word: np.ndarray = _IS_WORD):
        on = is_word[chunk.data]
        prev = np.empty(len(on), bool)
        prev[:1] = False
        prev[1:] = on[:-1]
        inner = chunk.off[:-1][chunk.off[:-1] < len(on)]
        prev[inner] = False
        self.start = np.flatnonzero(on & ~prev)
        nxt = np.empty(len(on), bool)
        nxt[-1:] = False
        nxt[:-1] = on[1:]
        nxt[inner[inner > 0] - 1] = False
        self.end = np.flatnonzero(on & ~nxt) + 1
        self.at = np.searchsorted(self.start, chunk.off)
        self.doc = np.repeat(np.arange(chunk.n), np.diff(self.at))


def word_hashes(chunk: Chunk, words: Words, lower: bool = True) -> np.ndarray:
    return span_hash(prefix_hash(chunk.data, lower), words.start, words.end)


def shingle_hashes(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i..i+k-1 for each i; the last k-1 of the chunk are not defined (0)."""
    n = len(word_hash)
    out = np.zeros(n, np.uint64)
    if n >= k:
        acc = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            acc = acc * U(0xD1342543DE82EF95) + word_hash[j : n - k + 1 + j]
        out[: n - k + 1] = mix(acc)
    return out


def doc_shingles(chunk: Chunk, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray, Words]:
    """(document, hash) of every k-word shingle; a document with fewer words, but some, gives its whole sequence as one."""
    words = Words(chunk)
    wh = word_hashes(chunk, words, lower)
    sh = shingle_hashes(wh, k)
    n_words = np.diff(words.at)
    last = words.at[1:][words.doc] if len(words.doc) else np.zeros(0, np.int64)
    keep = np.arange(len(wh)) + k <= last
    doc, out = words.doc[keep], sh[keep]
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = n_words[short] > j
            extra[has] = extra[has] * U(0xD1342543DE82EF95) + wh[words.at[short[has]] + j]
        extra = mix(extra ^ (n_words[short].astype(np.uint64) << U(56)) ^ U(0x5851F42D4C957F2D))
        doc, out = np.concatenate([doc, short]), np.concatenate([out, extra])
        order = np.argsort(doc, kind="stable")
        doc, out = doc[order], out[order]
    return doc, out, words


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def doc_sets(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash), sorted by document and hash."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if not len(doc):
        return doc, h
    first = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])
    return doc[first], h[first]


def split_points(doc: np.ndarray, n: int) -> np.ndarray:
    """Where each of n documents starts in a sorted document column, one more than n."""
    return np.searchsorted(doc, np.arange(n + 1))
