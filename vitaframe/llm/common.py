"""Shared pieces of the training-data operators.

Texts are split with numpy on the UTF-8 buffers of Arrow columns: both word
classes that the operators use are unions of whole bytes (every byte of a
multi-byte character is >= 0x80), so byte classes give exactly the words of
the regular expressions, for whole batches at once.
"""

from __future__ import annotations

import atexit
import contextvars
import ctypes
import hashlib
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U = np.uint64
_BYTES = np.arange(256)
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z.
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
#: [^\x20\x09-\x0D]
NONSPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
SAME = _BYTES.astype(np.uint8)
#: Odd multipliers of the rolling hash.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Keys of the digests of long words.
_KEYS = (b"vitaframe words 0", b"vitaframe words 1")
#: Digests of long words that this process has met, by key; emptied when full.
_LONG: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})
LONG_WORDS = 200_000
PIECE_BYTES = 1 << 20
BATCH_ROWS = 1000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def pieces(column: pa.Array, limit: int = PIECE_BYTES):
    """Runs of rows of about `limit` bytes; a longer text is a piece of its own, never cut: (first row, end row, bytes, offsets)."""
    data, offs = utf8(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def spans(data: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of the first word of each row (one more entry than rows)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    w = kind[data]
    before = np.empty_like(w)
    before[0], before[1:] = False, w[:-1]
    at = offs[:-1]
    before[at[at < n]] = False
    after = np.empty_like(w)
    after[-1], after[:-1] = False, w[1:]
    at = offs[1:]
    after[at[at > 0] - 1] = False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; another `which` is a hash of its own, made from the bytes anew.

    Words of up to 7 bytes are themselves a number, which a bijection mixes, so no
    two of them collide; those of up to 15 bytes are two numbers, mixed one after
    the other, so words that share either never collide; longer ones have a keyed
    BLAKE2 digest.
    """
    if not len(starts):
        return np.zeros(0, U)
    size = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))

    def tail(at: np.ndarray, n: np.ndarray, length: np.ndarray) -> np.ndarray:
        return eight[at] & ((U(1) << (n.astype(U) * U(8))) - U(1)) | length.astype(U) << U(56)

    base, other = U(_BASES[which]), U(_BASES[1 - which])
    short = np.minimum(size, 7)
    out = mix(tail(starts, short, short) * base + U(which))
    at = np.flatnonzero((size > 7) & (size < 16))
    if len(at):
        out[at] = mix(mix(eight[starts[at]] * other + U(which)) + tail(starts[at] + 8, size[at] - 8, size[at]) * base)
    at = np.flatnonzero(size > 15)
    if len(at):
        known, raw, key = _LONG[which], data.tobytes(), _KEYS[which]
        if len(known) > LONG_WORDS:
            known.clear()
        found = []
        for i, j in zip(starts[at].tolist(), ends[at].tolist()):
            w = raw[i:j]
            h = known.get(w)
            if h is None:
                h = int.from_bytes(hashlib.blake2b(w, digest_size=8, key=key).digest(), "little")
                if j - i <= 64:
                    known[w] = h
            found.append(h)
        out[at] = np.array(found, U)
    return out


def row_hashes(data: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, which: int = 0) -> np.ndarray:
    """`hashes` of long data, a run of rows of about PIECE_BYTES at a time."""
    out = np.empty(len(starts), U)
    i, n = 0, len(offs) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + PIECE_BYTES, "right")) - 1))
        s = slice(first[i], first[j])
        out[s] = hashes(data[offs[i] : offs[j]], starts[s] - offs[i], ends[s] - offs[i], which)
        i = j
    return out


def rolling(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """The hash of the n values from each position on; shorter than h by n - 1."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out, b = h[:m].copy(), U(_BASES[which])
    for k in range(1, n):
        out *= b
        out += h[k : k + m]
    return mix(out)


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """Which of the positions that `rolling` covers start n words of one row."""
    total = int(first[-1])
    m = total - n + 1
    if m <= 0:
        return np.zeros(0, bool)
    end = np.repeat(first[1:], np.diff(first))
    return np.arange(m) + n <= end[:m]


def split_words(texts: list[str | None]) -> list[list[bytes]]:
    """The ALNUM words of each text as bytes, for small tables and tests."""
    table = bytes(LOWER[i] if ALNUM[i] else 0x20 for i in range(256))
    return [(t or "").encode().translate(table).split() for t in texts]


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores before it as keep it apart from the columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def give_back() -> None:
    """Freed memory that Arrow's pool and the C library keep goes back to the system, where they can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker, which Spark keeps for later tasks of any stage, keeps no freed memory."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return own


_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset in local mode (tests) a temporary one.

    On a cluster without that setting there is no such folder, and an error says so.
    """
    set_by = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not set_by:
        app = spark.sparkContext.applicationId
        if app not in _FOLDERS:
            if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            _FOLDERS[app] = f"file://{tempfile.mkdtemp(prefix='vitaframe-')}"
            spark.sparkContext.setCheckpointDir(_FOLDERS[app])
        set_by = _FOLDERS[app]
    return set_by.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session has ended already
        pass


#: The `scratch` blocks that this thread or task of the driver is in, from the outermost on.
_SCOPES: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one, deleted when the `scratch` around it or the driver ends."""
    path = f"{shared_folder(spark)}/vitaframe/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    for scope in _SCOPES.get():
        scope.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[str], None]]:
    """Tables written inside are deleted at the end, but for those whose folders are given to the function that this yields.

    Blocks of other threads are left alone.
    """
    made: list[str] = []
    kept: set[str] = set()
    token = _SCOPES.set((*_SCOPES.get(), made))
    try:
        yield kept.add
    finally:
        _SCOPES.reset(token)
        for path in made:
            if path not in kept:
                _drop(spark, path)


def tune(spark: SparkSession) -> None:
    """For frames of whole texts that the caller runs: Arrow batches of BATCH_ROWS rows at most, in this session from now on.

    Such a frame runs after its function has returned, and Spark has this limit as a setting of the session only.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: While a table is written: Arrow batches of whole texts hold fewer rows than Spark's default, and exchange files go as soon as the table stands.
_WHILE_WRITING = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


#: Of each session that writes: how many writers there are, and its own settings.
_WRITERS: dict[int, tuple[int, dict[str, str | None]]] = {}
_LOCK = threading.Lock()


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """The settings of `_WHILE_WRITING`; the session's own ones come back when the last writer of any thread is done."""
    me = id(spark._jsparkSession)
    with _LOCK:
        n, before = _WRITERS.get(me, (0, None))
        if before is None:
            before = {k: spark.conf.get(k, None) for k in _WHILE_WRITING}
            for k, v in _WHILE_WRITING.items():
                spark.conf.set(k, v)
        _WRITERS[me] = n + 1, before
    try:
        yield
    finally:
        with _LOCK:
            n, before = _WRITERS.pop(me)
            if n > 1:
                _WRITERS[me] = n - 1, before
            else:
                for k, v in before.items():
                    if v is None:
                        spark.conf.unset(k)
                    else:
                        spark.conf.set(k, v)


def written(df: DataFrame, name: str, keep: Callable[[str], None] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors. keep: told the table's folder."""
    path = new_folder(df.sparkSession, name)
    if keep is not None:
        keep(path)
    with writing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """`written` in n buckets by a hash of the key, so that a later meeting by that key leaves these rows where they lie.

    The table's name is given back to the catalog at once; only the folder stays.
    """
    spark = df.sparkSession
    table = f"vitaframe_{name}_{uuid.uuid4().hex}"
    with writing(spark):
        df.write.bucketBy(n, key).option("path", new_folder(spark, name)).saveAsTable(table)
    out = spark.table(table)
    out.schema  # resolved before the name goes
    spark.sql(f"DROP TABLE {table}")
    return out


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder under the shared one before the driver ends."""
    _drop(spark, path)
