"""Helpers the operators of this subpackage share: hashing in numpy, materialising, record blobs."""

from __future__ import annotations

import ctypes
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: The fixed odd base of the polynomial byte hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that are hashed at once; a longer text is hashed alone.
CHUNK_BYTES = 1 << 20
#: Rows that go to Python at once.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000
#: Bytes of input whose records share a bucket.
BUCKET_BYTES = 64 << 20
#: Rows and bytes of text that Python works on at once.
PIECE_ROWS, PIECE_BYTES = 2048, 8 << 20
#: ASCII letters and digits and every byte of a multi-byte character belong to words.
WORD_BYTE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_powers: dict[str, np.ndarray] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``; only a local session without it gets one of its own."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and cut its lineage.

    A session that has Spark's usual number of rows in a batch for Python gets BATCH_ROWS from here on, since rows are texts.
    """
    if df.sparkSession.conf.get(BATCH, "10000") == "10000":
        df.sparkSession.conf.set(BATCH, str(BATCH_ROWS))
    if shared_folder(df.sparkSession) and not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(taken, *names: str) -> list[str]:
    """The names with as many underscores before them as it takes to clash with none of the taken ones."""
    used, out = {t.lower() for t in taken}, []
    for n in names:
        while n.lower() in used:
            n = f"_{n}"
        out.append(n)
    return out


def input_bytes(docs: DataFrame) -> int | None:
    """Bytes that Spark expects docs to have, from the sizes of its files; None where it can't know."""
    n = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else None


def buckets(docs: DataFrame) -> int:
    """Number of hash buckets for record blobs: one for each BUCKET_BYTES of input, and at least twice the shuffle partitions, which evens out what shares a partition."""
    return max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (input_bytes(docs) or 0) // BUCKET_BYTES, 1)


def release() -> None:
    """Give memory that Python no longer uses back to the system, since workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pieces(batches, column: int):
    """The batches in slices of at most PIECE_ROWS rows and about PIECE_BYTES of text in a column, so that memory stays bounded."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, min(at + PIECE_ROWS, int(np.searchsorted(ends, before + PIECE_BYTES, side="right"))))
            yield b.slice(at, to - at)
            at = to
    release()


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = 1 << max(20, (n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 22:
            _powers[key] = have
    return have[:n]


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of consecutive texts, and the number of words per text.

    A word is a maximal run of ASCII letters, digits and non-ASCII characters; its hash depends on its bytes alone.
    """
    n = len(raw)
    texts = len(at) - 1
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(texts, np.int64)
    inside = WORD_BYTE[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = at[(at > 0) & (at < n)]
    before[cuts] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_power(BASE, n) * (raw.astype(np.uint64) + np.uint64(1)), out=total[1:])
    hashes = mix((total[end] - total[start]) * _power(INVERSE, n)[start])
    return hashes, np.diff(np.searchsorted(start, at))


def ngram_sets(column: pa.Array, n: int):
    """Yield, text by text, the sorted distinct hashes of its n-grams of lower-cased words.

    A text of fewer than n words has one gram of all its words; one without words, or a null, has none.
    """
    for grams, counts in ngram_chunks(column, n):
        at = 0
        for c in counts:
            yield np.unique(grams[at : at + c])
            at += c


def ngram_chunks(column: pa.Array, n: int):
    """Yield (gram hashes, grams per text) for runs of texts of about CHUNK_BYTES."""
    raw, at = strings(pc.utf8_lower(column))
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK_BYTES, side="right")) - 1)
        hashes, words = word_hashes(raw[at[first] : at[last]], at[first : last + 1] - at[first])
        yield grams_of(hashes, words, n)
        first = last


def grams_of(hashes: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """N-gram hashes from word hashes of consecutive texts."""
    counts = np.where(words >= n, words - n + 1, (words > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(words)])[:-1]
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)])[:-1], counts) + np.arange(counts.sum())
    left = np.repeat(starts + words, counts) - first
    out = np.zeros(len(first), np.uint64)
    for k in range(n):
        there = left > k
        value = hashes[np.minimum(first + k, max(len(hashes) - 1, 0))] if len(hashes) else np.zeros(0, np.uint64)
        out = out * np.uint64(BASE) + np.where(there, value, np.uint64(0)) + np.uint64(k + 1)
    return mix(out), counts
