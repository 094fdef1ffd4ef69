"""Operator 10, BPE encoding and decoding through a distinct-word table.

Spark splits the texts; each block of documents keeps its words once, numbered
by frequency, and its texts as these numbers; both are written once, bucketed by
block. The words go, packed, to the task of their hash bucket, which encodes every
distinct word once for all blocks and sends the ids back to where the texts of
the block lie; there they are joined to the texts by position. Decoding joins
each id to its piece and strings the pieces together. A hot word is sent once per
block, and texts are never shuffled.

Defined results: a null or empty text has no ids and decodes to the empty
string; ids of documents, null or repeated, pass through row by row; texts are
taken whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, tune, written_by
from .wordbpe import default_path, vocabulary

BLOCK_WORDS = 2_000_000
BLOCK_DOCS = 20_000
#: The most buckets that words go to, so that a block's packet for one holds several words whatever the corpus.
BUCKETS = 4096
#: Distinct words of a bucket that its task remembers at once.
KNOWN = 2_000_000
#: Words of the texts that are packed in one row.
ROW_WORDS = 100_000
WORD_SCHEMA = "block long, bucket int, at long, data binary, words boolean"
_NAMES = ["block", "bucket", "at", "data", "words"]
_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.bool_())


def _join(parts: list[bytes]) -> bytes:
    """Parts behind their lengths, compressed: rows are written and shuffled in this form."""
    return zstandard.compress(np.array([len(parts), *map(len, parts)], "<u8").tobytes() + b"".join(parts), 3)


def _parts(data: bytes) -> list[bytes]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    at = 8 * (n + 1) + np.r_[0, np.cumsum(np.frombuffer(raw, "<u8", n, 8))].astype(np.int64)
    return [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _pack(x: np.ndarray) -> bytes:
    """Numbers as bytes of one weight each; as many weights as the largest needs."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u4").ravel().astype(np.int64)


def _split(path: str, buckets: int):
    def texts(docs: list, rank: np.ndarray) -> bytes:
        ids, known = np.array([d or 0 for d, _ in docs], np.int64), np.array([d is not None for d, _ in docs], bool)
        return _join([ids.tobytes(), known.tobytes(), np.array([len(x) for _, x in docs], np.int64).tobytes(), _pack(rank[np.concatenate([x for _, x in docs])])])

    def flush(block: int, docs: list, words: dict[str, int]) -> Iterator[pa.RecordBatch]:
        names = list(words)
        number = np.fromiter(words.values(), np.int64, len(names))
        use = np.zeros(len(names), np.int64)
        for _, ids in docs:
            use += np.bincount(ids, minlength=len(names))
        bucket = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in names), np.int64, len(names))
        rank = np.empty(len(names), np.int64)
        order = np.argsort(-use, kind="stable")
        rank[order] = np.arange(len(names))
        # number[k] is k: words are numbered as they come
        assert not len(number) or number[-1] == len(names) - 1
        rows, held, size = [], [], 0
        for doc, ids in docs:
            held.append((doc, ids))
            size += len(ids)
            if size >= ROW_WORDS:
                rows.append((block, None, len(rows), texts(held, rank), False))
                held, size = [], 0
        if held:
            rows.append((block, None, len(rows), texts(held, rank), False))
        by = np.lexsort((rank, bucket))
        cut = np.flatnonzero(np.diff(bucket[by])) + 1
        for own in np.split(by, cut) if len(by) else []:
            ranks = _pack(np.diff(rank[own], prepend=0))
            text = "\n".join([names[i] for i in own]).encode("utf-8", "surrogatepass")
            rows.append((block, int(bucket[own[0]]), -1, _join([ranks, text]), True))
        for i in range(0, len(rows), 100):
            part = rows[i : i + 100]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], t) for k, t in enumerate(_TYPES)], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = vocabulary(path).pretokens
        base, k = TaskContext.get().partitionId() << 24, 0
        docs: list = []
        held = 0
        words: dict[str, int] = {}
        number = words.setdefault
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([number(w, len(words)) for w in split(text.as_py())] if text.is_valid else [], np.int32)
                docs.append((doc, ids))
                held += len(ids) + 1
                if held >= BLOCK_WORDS or len(docs) >= BLOCK_DOCS:
                    yield from flush(base + k, docs, words)
                    docs, held, k = [], 0, k + 1
                    words = {}
                    number = words.setdefault
        if docs:
            yield from flush(base + k, docs, words)

    return run


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        bucket, known = None, {}
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["bucket"] != bucket:
                    bucket, known = r["bucket"], {}
                ranks, names = _parts(r["data"])
                names = names.decode("utf-8", "surrogatepass").split("\n")
                got = []
                for w in names:
                    ids = known.get(w)
                    if ids is None:
                        if len(known) >= KNOWN:
                            known.clear()
                        ids = known[w] = v.encode(w)
                    got.append(ids)
                length = np.fromiter(map(len, got), np.int64, len(got))
                flat = np.fromiter((i for ids in got for i in ids), np.int64, int(length.sum()))
                rows.append((r["block"], bucket, -1, _join([ranks, _pack(length), _pack(flat)]), True))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], names=_NAMES)

    return run


def _gather(flat: np.ndarray, begin: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """The runs of `flat` that `pick` names, one after another."""
    length = (begin[1:] - begin[:-1])[pick]
    total = int(length.sum())
    if not total:
        return flat[:0]
    step = np.ones(total, np.int64)
    full = length > 0
    s, n = begin[:-1][pick][full], length[full]
    at = np.cumsum(n) - n
    step[at[0]] = s[0]
    step[at[1:]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return flat[np.cumsum(step)]


def _finish(path: str, ids: bool, texts: bool):
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string())[: 6 if texts else 5 if ids else 4]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(types)]

    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        """The texts of one block and the ids of its words, by their numbers."""
        letters, where = _letters(path)
        order, lengths, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for data in answers.column("data").to_pylist():
            for into, part in zip((order, lengths, flat), _parts(data)):
                into.append(_unpack(part))
            order[-1] = np.cumsum(order[-1])
        rank, length = np.concatenate(order), np.concatenate(lengths)
        by = np.argsort(rank)
        flat = _gather(np.concatenate(flat), np.r_[0, np.cumsum(length)], by)
        begin = np.r_[0, np.cumsum(length[by])]
        out: list = []
        for data in own.column("data").to_pylist():
            keys, known, size, ranks = _parts(data)
            ranks = _unpack(ranks)
            if len(ranks) and ranks.max() >= len(rank):
                raise ValueError("a block's texts name words that have no answer")
            edge = np.r_[0, np.cumsum(np.frombuffer(size, np.int64))]
            for doc, real, a, b in zip(np.frombuffer(keys, np.int64).tolist(), np.frombuffer(known, bool).tolist(), edge[:-1], edge[1:]):
                ids_ = _gather(flat, begin, ranks[a:b])
                raw = _gather(letters, where, ids_)[:-1].tobytes()  # pieces are joined by one space
                out.append((doc if real else None, len(ids_), hashlib.sha256(ids_.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest(), ids_.astype(np.int32) if ids or texts else None, raw.decode("utf-8", "surrogatepass") if texts else None))
        return pa.Table.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names=names)

    return run


@lru_cache(maxsize=4)
def _letters(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The id-to-piece table: bytes of all pieces, a space after each, and where each begins."""
    pieces = [(p + " ").encode("utf-8", "surrogatepass") for p in vocabulary(path).pieces()]
    return np.frombuffer(b"".join(pieces), np.uint8), np.r_[0, np.cumsum([len(p) for p in pieces])]


def round_trip(docs: DataFrame, path: str | None = None, ids: bool = False, texts: bool = False) -> DataFrame:
    """Per document: n_tokens, digests of its ids and of the decoded text; with ids=True also the ids, with texts=True both themselves."""
    path = path or default_path()
    tune(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(n, BUCKETS)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    split = written_by(d.mapInArrow(lean(_split(path, buckets)), WORD_SCHEMA), "words", "block", n)
    answers = split.where("words").repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_encode(path)), WORD_SCHEMA)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if texts else ", ids array<int>" if ids else "")
    own = split.where("not words").select("block", "data")
    return own.groupBy("block").cogroup(answers.select("block", "data").groupBy("block")).applyInArrow(_finish(path, ids, texts), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document there and back."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
