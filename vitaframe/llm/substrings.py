"""Operator 9, substring dedup with a log-structured fingerprint index.

Documents arrive in batches of ascending doc_id, packed in shards of about
SHARD_BYTES of text: one row each, written once, bucketed by shard, never cut
anew and never shuffled. Of every window of 13 words a shard asks with one
fingerprint, packed in sorted arrays by fingerprint range (bucket), at the task
of that bucket. There the batch's own fingerprints are held, those of one bucket
at a time, and the sorted immutable runs of earlier batches are merge-joined
with them, one slice of a run after another. The answer for a shard is one bit
per fingerprint; what no older run holds becomes a new run, and runs are
compacted into one when more than `most_runs` stand side by side. A hot window
costs one entry per shard, however many documents hold it. Answers go back to
where the shard's texts lie.

The number of buckets follows the batch, not the corpus: a corpus of more than
BATCH_WINDOWS windows is taken in more batches, so a task holds about
BUCKET_ENTRIES fingerprints, and packets keep some entries each, at any size.
The fingerprint range is worked through in `passes` parts, each with its own
runs, so that the exchange files of one part at a time are on disk.

Verification: an entry is 64 bits of one hash of its words and CHECK_BITS of an
independent one, and a match needs both; of n different windows n**2 / 2**97 are
expected to match falsely, one in a thousand runs over 100 TB.

Defined results: words are maximal runs of non-space characters, unchanged; a
null or empty text has none and gives the digest of the empty string; rows with
a null doc_id are never removed from and never a source; rows of one doc_id
don't remove from each other; equal rows are each returned; texts are taken
whole, a text longer than a shard is a shard of its own; an empty table gives
an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NONSPACE, drop_folder, inside, new_folder, pieces, rolling, row_hashes, spans, tune, writing, written_by

WINDOW = 13
SHARD_BYTES = 4 << 20
#: Documents of a shard; owners are sent in 16 bits.
SHARD_DOCS = 1 << 15
CHECK_BITS = 32
PASSES = 3
#: Batches of a table by doc_id, at least, and runs that may stand side by side: with three and one the index is compacted once.
BATCHES, MOST_RUNS = 3, 1
#: Fingerprints of a batch in one bucket, about, and the most buckets as a power of two.
BUCKET_ENTRIES, MOST_BITS = 1 << 19, 17
BATCH_WINDOWS = BUCKET_ENTRIES << MOST_BITS
#: Entries of a run in one row.
SLICE = 1 << 19

SHARD_SCHEMA = "shard long, ids binary, known binary, sizes binary, text binary"
#: Asking and answering shards have numbers from 0 on, slices of runs have none; `first` orders slices by their first mark.
ENTRY_SCHEMA = "bucket int, shard long, first long, n int, width int, marks binary, checks binary, owners binary, ids binary"
_NAMES = [c.split()[0] for c in ENTRY_SCHEMA.split(", ")]
_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())


def pack(marks: np.ndarray) -> tuple[int, bytes]:
    """Sorted 64-bit numbers: the first, then differences of as many bytes as the largest needs."""
    step = marks.copy()
    step[1:] -= marks[:-1]
    if len(step):
        step[0] = 0
    width = max(1, (int(step.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(step).view(np.uint8).reshape(-1, 8)[:, :width]
    return width, (int(marks[0]) if len(marks) else 0).to_bytes(8, "little") + np.ascontiguousarray(planes.T).tobytes()


def unpack(width: int, data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=8).reshape(width, -1)
    step = np.zeros((planes.shape[1], 8), np.uint8)
    step[:, :width] = planes.T
    out = step.view(np.uint64).ravel()
    if len(out):
        out[0] = int.from_bytes(data[:8], "little")
    return np.cumsum(out, dtype=np.uint64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names=_NAMES)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts packed in shards, in order of their ids, null ones last."""
    number = TaskContext.get().partitionId() << 32
    ids: list = []
    texts: list[bytes] = []
    held = 0

    def flush() -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
        row = (np.array([ids[k] or 0 for k in order], np.int64), np.array([ids[k] is not None for k in order], bool), np.array([len(texts[k]) for k in order], np.int64))
        text = zstandard.compress(b"".join([texts[k] for k in order]), 3)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in row), pa.array([text], pa.binary())], names=["shard", "ids", "known", "sizes", "text"])

    for batch in batches:
        keys = batch.column(0).to_pylist()
        for i, j, data, offs in pieces(batch.column(1)):
            for lo in range(i, j, 1024):  # a piece may hold very many empty texts
                hi = min(lo + 1024, j)
                if len(ids) + hi - lo > SHARD_DOCS:
                    yield flush()
                    ids, texts, held, number = [], [], 0, number + 1
                raw = data.tobytes() if lo == i else raw
                ids += keys[lo:hi]
                texts += [raw[a:b] for a, b in zip(offs[lo - i : hi - i].tolist(), offs[lo - i + 1 : hi - i + 1].tolist())]
            held += int(offs[-1])
            if held >= SHARD_BYTES:
                yield flush()
                ids, texts, held, number = [], [], 0, number + 1
    if ids:
        yield flush()


def shards(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) in shards, written and bucketed by their numbers."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written_by(docs.select("doc_id", "text").mapInArrow(_shards, SHARD_SCHEMA), "shards", "shard", n)


class _Shard:
    """The texts of one shard and the distinct fingerprints of their windows whose buckets are from low on and below high."""

    def __init__(self, row: dict, bits: int, window: int, low: int, high: int) -> None:
        self.ids, self.known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool)
        self.raw = zstandard.decompress(row["text"])
        data, offs = np.frombuffer(self.raw, np.uint8), np.r_[0, np.cumsum(np.frombuffer(row["sizes"], np.int64))]
        self.starts, self.ends, self.first = spans(data, offs, NONSPACE)
        h = row_hashes(data, offs, self.starts, self.ends, self.first)
        marks = rolling(h, window)
        ok = inside(self.first, window) & np.repeat(self.known, np.diff(self.first))[: len(marks)]
        if (low, high) != (0, 1 << bits):
            bucket = marks >> np.uint64(64 - bits)
            ok &= (bucket >= np.uint64(low)) & (bucket < np.uint64(high))
        #: Word places of the windows, in text order.
        self.at = np.flatnonzero(ok)
        m = marks[self.at]
        # from the words' bytes anew, by another hash
        c = rolling(row_hashes(data, offs, self.starts, self.ends, self.first, 1), window, 1)[self.at]
        c = (c >> np.uint64(64 - CHECK_BITS)).astype(np.uint32)
        #: Which of the distinct fingerprints each window has.
        self.marks, self.checks, self.group, begin, order = _distinct(m, c)
        #: The row with the smallest id that holds each: rows stand in order of their ids.
        least = np.minimum.reduceat(self.at[order], begin) if len(begin) else self.at
        self.owner = np.searchsorted(self.first, least, "right") - 1
        self.bucket = (self.marks >> np.uint64(64 - bits)).astype(np.int64)


def _distinct(m: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(marks, checks) of each distinct entry in order, the entry of every input, and where its inputs begin in `order`."""
    order = np.argsort(m)
    ms, cs = m[order], c[order]
    same = ms[1:] == ms[:-1]
    if (cs[1:] != cs[:-1])[same].any():  # a mark with several checks
        order = np.lexsort((c, m))
        ms, cs = m[order], c[order]
        same = (ms[1:] == ms[:-1]) & (cs[1:] == cs[:-1])
    new = np.r_[True, ~same] if len(m) else np.zeros(0, bool)
    group = np.empty(len(m), np.int64)
    group[order] = np.cumsum(new) - 1
    return ms[new], cs[new], group, np.flatnonzero(new), order


def _ask(bits: int, window: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                s = _Shard(row, bits, window, low, high)
                edge = np.r_[0, np.flatnonzero(np.diff(s.bucket)) + 1, len(s.bucket)] if len(s.bucket) else np.zeros(0, int)
                rows = []
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    used, small = np.unique(s.owner[a:b], return_inverse=True)
                    rows.append((int(s.bucket[a]), row["shard"], None, b - a, *pack(s.marks[a:b]), s.checks[a:b].tobytes(), small.astype("<u2").tobytes(), s.ids[used].tobytes()))
                yield _batch(rows)

    return run


def _slices(bucket: int, marks: np.ndarray, checks: np.ndarray) -> Iterator[tuple]:
    for i in range(0, len(marks), SLICE):
        m, c = marks[i : i + SLICE], checks[i : i + SLICE]
        yield (bucket, None, int(m[0]) - (1 << 63), len(m), *pack(m), c.tobytes(), None, None)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {n: batch.column(i)[k].as_py() for i, n in enumerate(_NAMES)}


class _Bucket:
    """What a batch asks in one bucket; slices of older runs are met one after another."""

    def __init__(self, bucket: int) -> None:
        self.bucket, self.asked, self.entries = bucket, [], None

    def _close(self) -> None:
        marks = np.concatenate([unpack(r["width"], r["marks"]) for r in self.asked])
        checks = np.concatenate([np.frombuffer(r["checks"], np.uint32) for r in self.asked])
        ids = np.concatenate([np.frombuffer(r["ids"], np.int64)[np.frombuffer(r["owners"], "<u2")] for r in self.asked])
        m, c, group, begin, order = _distinct(marks, checks)
        least = np.minimum.reduceat(ids[order], begin)
        self.dup, self.group, self.entries = least[group] < ids, group, (m, c)
        self.old = np.zeros(len(m), bool)
        self.asked = [(r["shard"], r["n"]) for r in self.asked]

    def meet(self, row: dict) -> None:
        """A slice of an older run: its owners all have smaller ids."""
        if self.entries is None:
            if not self.asked:
                return
            self._close()
        m, c = self.entries
        marks, checks = unpack(row["width"], row["marks"]), np.frombuffer(row["checks"], np.uint32)
        lo, hi = np.searchsorted(m, marks[0]), np.searchsorted(m, marks[-1], "right")
        own = np.arange(lo, hi)
        at = np.searchsorted(marks, m[lo:hi])
        while len(own):  # once, but for marks with several checks
            here = (at < len(marks)) & (marks[np.minimum(at, len(marks) - 1)] == m[own])
            own, at = own[here], at[here]
            self.old[own[checks[at] == c[own]]] = True
            at = at + 1

    def out(self, keep: bool) -> Iterator[tuple]:
        """An answer for every shard with a repeat, and the bucket's part of the new run."""
        if self.entries is None:
            if not self.asked:
                return
            self._close()
        dup, at = self.dup | self.old[self.group], 0
        for shard, n in self.asked:
            if (bits := dup[at : at + n]).any():
                yield (self.bucket, shard, None, n, 0, np.packbits(bits).tobytes(), None, None, None)
            at += n
        if keep:
            yield from _slices(self.bucket, self.entries[0][~self.old], self.entries[1][~self.old])


def _merge(keep: bool):
    """Rows of each bucket, those of the batch first and then the slices of older runs -> answers and the new run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Bucket | None = None
        for row in _rows(batches):
            if held is None or held.bucket != row["bucket"]:
                if held is not None:
                    yield _batch(list(held.out(keep)))
                held = _Bucket(row["bucket"])
            if row["shard"] is None:
                held.meet(row)
            else:
                held.asked.append(row)
        if held is not None:
            yield _batch(list(held.out(keep)))

    return run


def _compacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of several runs, by bucket and first mark -> slices of one run. Runs hold no entry in common."""
    bucket, m, c = None, np.zeros(0, np.uint64), np.zeros(0, np.uint32)

    def ready(upto: int) -> pa.RecordBatch:
        nonlocal m, c
        order = np.argsort(m)
        m, c = m[order], c[order]
        k = int(np.searchsorted(m, np.uint64(upto))) if upto < 1 << 64 else len(m)
        done = _batch(list(_slices(bucket, m[:k], c[:k])))
        m, c = m[k:], c[k:]
        return done

    for row in _rows(batches):
        if row["bucket"] != bucket:
            yield ready(1 << 64)
            bucket = row["bucket"]
        elif len(m) >= SLICE:  # nothing that follows stands before this slice
            yield ready(row["first"] + (1 << 63))
        m, c = np.r_[m, unpack(row["width"], row["marks"])], np.r_[c, np.frombuffer(row["checks"], np.uint32)]
    yield ready(1 << 64)


class FingerprintIndex:
    """Sorted runs of window fingerprints, of buckets low to high, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, bits: int, window: int = WINDOW, most_runs: int = MOST_RUNS, part: tuple[int, int] = (0, 1), folder: str | None = None) -> None:
        self.spark, self.bits, self.window, self.most_runs = spark, bits, window, most_runs
        self.low, self.high = ((1 << bits) * (part[0] + k) // part[1] for k in (0, 1))
        self.folder = folder or new_folder(spark, "runs")
        self.runs: list[str] = []
        self.compactions = 0
        self._made = 0

    def _write(self, df: DataFrame, order: tuple, run, name: str) -> str:
        """Deals rows to the tasks of their buckets, in order, and writes what comes of them, answers and slices apart."""
        self._made += 1
        path = f"{self.folder}/{name}-{self._made}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with writing(self.spark):
            df.repartition(n, "bucket").sortWithinPartitions("bucket", *order).mapInArrow(run, ENTRY_SCHEMA).withColumn("answer", F.col("shard").isNotNull()).write.partitionBy("answer").parquet(path)
        return path

    def _read(self, paths: list[str], answers: bool) -> DataFrame:
        every = [self.spark.read.schema(ENTRY_SCHEMA + ", answer boolean").parquet(p).where(F.col("answer") == answers).drop("answer") for p in paths]
        return reduce(DataFrame.unionByName, every)

    def entries(self) -> DataFrame:
        """The slices of all runs."""
        return self._read(self.runs, False)

    def add(self, docs: DataFrame, keep: bool = True) -> DataFrame:
        """Answers for a batch whose ids are all larger than those before; then a run with its fingerprints.

        The batch is a table of `shards`, whose numbers the answers name, or (doc_id, text), of which shards are made here.
        keep=False leaves the batch out of the index, when no further one follows.
        """
        own = docs if "sizes" in docs.columns else shards(docs)
        asked = own.select(*[c.split()[0] for c in SHARD_SCHEMA.split(", ")]).mapInArrow(_ask(self.bits, self.window, self.low, self.high), ENTRY_SCHEMA)
        every = asked.unionByName(self.entries()) if self.runs else asked
        path = self._write(every, (F.col("shard").isNull(), "shard", "first"), _merge(keep), "run")
        if keep:
            self.runs.append(path)
            if len(self.runs) > self.most_runs:
                self.compact()
        return self._read([path], True)

    def compact(self) -> None:
        """All runs become one, and the old ones' slices go; answers stay."""
        if self.runs:
            path = self._write(self.entries(), ("first",), _compacted, "compacted")
            self._forget()
            self.runs = [path]
            self.compactions += 1

    def _forget(self) -> None:
        for path in self.runs:
            drop_folder(self.spark, f"{path}/answer=false")

    def close(self) -> None:
        """The runs go; answers stay."""
        self._forget()
        self.runs = []


def _apply(bits: int, window: int):
    """A shard and the answers about it -> the digest of each document."""

    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if not len(own) and len(answers):
            raise ValueError(f"answers about shard {answers.column('shard')[0].as_py()}, which has no texts")
        for row in own.to_pylist():
            s = _Shard(row, bits, window, 0, 1 << bits)
            dup = np.zeros(len(s.marks), bool)
            for b, n, a in zip(*(answers.column(c).to_pylist() for c in ("bucket", "n", "marks"))):
                lo, hi = np.searchsorted(s.bucket, [b, b + 1])
                if n != hi - lo:
                    raise ValueError(f"an answer of bucket {b} is about {n} fingerprints, its shard has {hi - lo}")
                dup[lo:hi] = np.unpackbits(np.frombuffer(a, np.uint8), count=hi - lo).astype(bool)
            doc = np.searchsorted(s.first, s.at, "right") - 1
            # a repeat of another shard or batch, or of a smaller id in this one
            hit = s.at[dup[s.group] | (s.ids[s.owner][s.group] < s.ids[doc])]
            change = np.zeros(len(s.starts) + window + 1, np.int64)
            np.add.at(change, hit, 1)
            np.add.at(change, hit + window, -1)
            gone = np.cumsum(change)[: len(s.starts)] > 0
            removed = np.r_[0, np.cumsum(gone)]
            for k, (doc_id, known, a, b) in enumerate(zip(s.ids.tolist(), s.known.tolist(), s.first[:-1].tolist(), s.first[1:].tolist())):
                begin, end = s.starts[a:b], s.ends[a:b]
                lost = int(removed[b] - removed[a])
                if lost:
                    begin, end = begin[~gone[a:b]], end[~gone[a:b]]
                kept = b" ".join([s.raw[x:y] for x, y in zip(begin.tolist(), end.tolist())])
                out.append((doc_id if known else None, b - a, lost, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.Table.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def remove(own: DataFrame, answers: DataFrame, bits: int, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the text of the words that stay) of every document of `shards`; texts aren't shuffled."""
    tune(own.sparkSession)
    return own.groupBy("shard").cogroup(answers.select("shard", "bucket", "n", "marks").groupBy("shard")).applyInArrow(_apply(bits, window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def shard_bits(windows: int) -> int:
    """Buckets as a power of two, so that one holds about BUCKET_ENTRIES windows of a batch."""
    return min(MOST_BITS, max(4, int(windows // BUCKET_ENTRIES).bit_length()))


def dedup(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES, passes: int = PASSES, most_runs: int = MOST_RUNS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept for every document of a table, in batches by doc_id."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    windows = (d.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    batches = max(batches, -(-windows // BATCH_WINDOWS))
    cuts = d.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    bits = shard_bits(windows // batches)
    parts = []
    for k in range(len(cuts) + 1):
        above = F.col("doc_id") > cuts[k - 1] if k else F.lit(True)
        upto = F.col("doc_id") <= cuts[k] if k < len(cuts) else F.lit(True)
        parts.append(shards(d.where((above & upto) | F.col("doc_id").isNull() if not k else above & upto)))
    answers: list[list[DataFrame]] = [[] for _ in parts]
    for p in range(passes):
        index = FingerprintIndex(spark, bits, window, most_runs, (p, passes))
        for k, part in enumerate(parts):
            answers[k].append(index.add(part, keep=k < len(parts) - 1))
        index.close()
    return reduce(DataFrame.union, [remove(part, reduce(DataFrame.union, own), bits, window) for part, own in zip(parts, answers)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every window of every document, in batches by doc_id."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
