"""Operator 1, benchmark decontamination over a positional inverted index.

`build_index` tokenises whole texts and stores, for each shard of documents,
the postings of every training token: sorted term fingerprints, their counts
and their positions. Shards hold about SHARD_WORDS words whatever the corpus
size, so neither building nor searching shuffles text or postings, and a hot
word is spread over all shards. `search` intersects, shard by shard, the
position lists of a phrase shifted by each word's offset, starting from the
rarest word of the phrase in that shard; `proximity` reports spans that hold
all words of an item within a number of words, from the same postings.

A shard has a number of its own, stored with it. A benchmark beyond BLOCK_BYTES
is searched in several passes, whose matches meet by shard number and place.

Defined results: a null or empty text has no words and no hits; a null id is
kept as null; repeated rows and ids are returned row by row; an item without
words has no window; the same item id in several rows counts once; the windows of
an item with a null id hit words and contaminate like all others, but name no
item. Very long texts make a shard of their own and are never cut. Extra columns
are ignored. Terms are compared by 64-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, LOWER, hashes, lean, pieces, spans, tune, written

WINDOW = 10
SHARD_WORDS = 1 << 20
#: Benchmarks beyond so many bytes of text are searched in several passes over the stored index, each with a block of items of about this size.
BLOCK_BYTES = 16 << 20

#: The words of an item are near in a document if a span of so many times the item's number of words holds them all.
NEAR = 2

INDEX_SCHEMA = T.StructType([T.StructField("shard", T.LongType()), *(T.StructField(n, T.BinaryType()) for n in ("ids", "known", "lengths", "terms", "counts", "positions"))])
MATCH_SCHEMA = "shard long, place int, doc_id long, n_words long, hits array<int>, items array<string>, near array<string>"


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers by bytes of one weight, so that the empty high bytes compress away."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _flush(shard: int, ids: list, lengths: list, words: list) -> pa.RecordBatch:
    length = np.concatenate(lengths)
    h = np.concatenate(words)
    words.clear()
    order = np.argsort(h, kind="stable")
    h = h[order]
    # one position is left free after each document, so no phrase runs over into the next
    at = np.arange(len(h), dtype=np.uint32)
    at += np.repeat(np.arange(len(length), dtype=np.uint32), length)
    at = at[order]
    del order
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    known = np.array([i is not None for i in ids], bool)
    row = [np.array([i or 0 for i in ids], np.int64).tobytes(), known.tobytes(), length.astype(np.int64).tobytes(), h[first].tobytes(), np.diff(np.r_[first, len(h)]).astype(np.uint32).tobytes(), _planes(at)]
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *(pa.array([x], pa.binary()) for x in row)], names=INDEX_SCHEMA.names)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list = []
    lengths: list = []
    words: list = []
    shard, held = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        keys = batch.column(0).to_pylist()
        for i, j, data, offs in pieces(batch.column(1)):
            starts, ends, first = spans(data, offs, ALNUM)
            words.append(hashes(LOWER[data], starts, ends))
            lengths.append(np.diff(first))
            ids += keys[i:j]
            held += len(starts) + (j - i)
            if held >= SHARD_WORDS:
                yield _flush(shard, ids, lengths, words)
                ids, lengths, words, held, shard = [], [], [], 0, shard + 1
    if ids:
        yield _flush(shard, ids, lengths, words)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored positional index of whole texts, one row per shard."""
    return written(docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(lean(_index), INDEX_SCHEMA), "postings")


def phrases(texts: list[str | None], window: int = WINDOW) -> list[tuple[int, np.ndarray]]:
    """(number of the text, fingerprints of a window's words) of every window; a text of fewer words is one window."""
    out: list[tuple[int, np.ndarray]] = []
    for k, t in enumerate(texts):
        data = np.frombuffer((t or "").encode(), np.uint8)
        starts, ends, _ = spans(data, np.array([0, len(data)]), ALNUM)
        h = hashes(LOWER[data], starts, ends)
        if len(h):
            n = min(window, len(h))
            out += [(k, h[i : i + n]) for i in range(len(h) - n + 1)]
    return out


class Shard:
    """One row of the index, opened for searching."""

    def __init__(self, row: dict) -> None:
        self.terms = np.frombuffer(row["terms"], np.uint64)
        counts = np.frombuffer(row["counts"], np.uint32).astype(np.int64)
        self.begin = np.r_[0, np.cumsum(counts)]
        self.positions = _unplanes(row["positions"])
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        known = np.frombuffer(row["known"], bool)
        self.ids = [int(i) if k else None for i, k in zip(np.frombuffer(row["ids"], np.int64), known)]
        self.starts = np.cumsum(self.lengths + 1) - (self.lengths + 1)

    def slots(self, words: np.ndarray) -> np.ndarray:
        """Where the terms stand; -1 for those without postings."""
        if not len(self.terms):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, at, -1)

    def postings(self, slot: int) -> np.ndarray:
        return self.positions[self.begin[slot] : self.begin[slot + 1]]

    def phrase(self, slots: np.ndarray) -> np.ndarray:
        """Positions where the terms stand one after another: offset-adjusted lists, met from the rarest on."""
        count = self.begin[slots + 1] - self.begin[slots]
        found: np.ndarray | None = None
        for k in np.argsort(count, kind="stable"):
            own = self.postings(slots[k])
            if found is None:
                found = own[own >= k].astype(np.int64) - k
            else:
                at = np.searchsorted(own, found + k)
                found = found[(at < len(own)) & (own[np.minimum(at, len(own) - 1)] == found + k)]
            if not len(found):
                break
        return found if found is not None else np.zeros(0, np.int64)

    def near(self, slots: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the shortest spans, of `within` words at most, that hold every term.

        Only places within reach of the rarest term's postings can end a span; of each, the last place of every term up to it is looked up.
        """
        lists = sorted((self.postings(s).astype(np.int64) for s in np.unique(slots)), key=len)
        low = lists[0]
        # stretches around the rarest term's places, merged where they overlap
        begin, end = low, low + within
        new = np.r_[True, begin[1:] > end[:-1]]
        begin, end = begin[new], np.maximum.reduceat(end, np.flatnonzero(new))
        ends = np.unique(np.concatenate([own[(k := np.searchsorted(begin, own, "right") - 1) >= 0][own[k >= 0] < end[k[k >= 0]]] for own in lists]))
        start = ends.copy()
        for own in lists:
            k = np.searchsorted(own, ends, "right") - 1
            ends, start, k = ends[k >= 0], start[k >= 0], k[k >= 0]
            np.minimum(start, own[k], out=start)
            keep = ends - start < within
            ends, start = ends[keep], start[keep]
        keep = self.doc(start) == self.doc(ends)
        ends, start = ends[keep], start[keep]
        first = np.r_[True, start[1:] > start[:-1]] if len(start) else np.zeros(0, bool)
        return start[first], ends[first] + 1

    def doc(self, position) -> np.ndarray:
        return np.searchsorted(self.starts, position, "right") - 1


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The index rows of a batch, one at a time; their binary fields are read where Arrow has them."""
    for k in range(batch.num_rows):
        yield {n: batch.column(n)[k].as_py() if n == "shard" else batch.column(n)[k].as_buffer() for n in INDEX_SCHEMA.names}


def _plan(found: list[tuple[int, np.ndarray]]):
    """Windows as rows of numbers of distinct terms, with -1 past the end of short ones."""
    terms = np.unique(np.concatenate([w for _, w in found])) if found else np.zeros(0, np.uint64)
    width = max((len(w) for _, w in found), default=0)
    table = np.full((len(found), width), -1, np.int64)
    for k, (_, w) in enumerate(found):
        table[k, : len(w)] = np.searchsorted(terms, w)
    return terms, table, np.array([i for i, _ in found], np.int64)


class _Items:
    """What a pass searches for: windows as rows of term numbers, the terms of each item, and the items' ids."""

    def __init__(self, names: list[str | None], texts: list[str | None], window: int) -> None:
        self.names = names
        self.terms, self.table, self.owner = _plan(phrases(texts, window))
        whole = phrases(texts, 1 << 62)
        self.whole = [(k, np.searchsorted(self.terms, np.unique(w)), len(w)) for k, w in whole]


def _searcher(shared, near: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: _Items = shared.value
        for batch in batches:
            for row in _rows(batch):
                shard = Shard(row)
                n = len(shard.ids)
                hits: list[list[int]] = [[] for _ in range(n)]
                items: list[set[str]] = [set() for _ in range(n)]
                close: list[set[str]] = [set() for _ in range(n)]
                if len(own.table):
                    slot = np.r_[shard.slots(own.terms), -2]  # -1 of the table reads the last
                    where = slot[own.table]
                    spots: list[np.ndarray] = []
                    pairs: list[np.ndarray] = []
                    for k in np.flatnonzero((where != -1).all(axis=1)):
                        w = where[k][where[k] != -2]
                        at = shard.phrase(w)
                        if len(at):
                            pairs.append(np.stack([shard.doc(at), np.full(len(at), own.owner[k])], 1))
                            spots.append((at[:, None] + np.arange(len(w))).ravel())
                    if spots:
                        at = np.unique(np.concatenate(spots))
                        doc = shard.doc(at)
                        for d, p in zip(doc.tolist(), (at - shard.starts[doc]).tolist()):
                            hits[d].append(p)
                        for d, k in np.unique(np.concatenate(pairs), axis=0).tolist():
                            if own.names[k] is not None:
                                items[d].add(own.names[k])
                    for k, numbers, words in own.whole if near else []:
                        slots = slot[numbers]
                        if own.names[k] is not None and (slots >= 0).all():
                            for d in np.unique(shard.doc(shard.near(slots, near * words)[0])).tolist():
                                close[d].add(own.names[k])
                number = pa.array(np.full(n, row["shard"]), pa.int64())
                yield pa.RecordBatch.from_arrays([number, pa.array(np.arange(n), pa.int32()), pa.array(shard.ids, pa.int64()), pa.array(shard.lengths), pa.array(hits, pa.list_(pa.int32())), *(pa.array([sorted(x) for x in names], pa.list_(pa.string())) for names in (items, close))], names=["shard", "place", "doc_id", "n_words", "hits", "items", "near"])

    return run


def blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[tuple[list[str | None], list[str | None]]]:
    """The items in blocks that a task can hold: one block if all texts together stay under the limit, else by a hash of the row. Copies of a row are one item."""
    b = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").alias("t")).where("t is not null").distinct()
    size = b.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // limit) or 1
    for k in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        rows = part.collect()
        yield [r.i for r in rows], [r.t for r in rows]


def search(index: DataFrame, benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, limit: int = BLOCK_BYTES, near: int = NEAR) -> DataFrame:
    """Per document: words, positions of the words hit by an item's window, the items, and the items whose words are near (near=0: none).

    The index is read once per block of items.
    """
    tune(index.sparkSession)
    out: list[DataFrame] = []
    for names, texts in blocks(benchmark, item_id, text, limit):
        # bounded by the limit, about 100 bytes for each of a block's words
        shared = index.sparkSession.sparkContext.broadcast(_Items(names, texts, window))
        out.append(index.mapInArrow(lean(_searcher(shared, near)), MATCH_SCHEMA))
    found = reduce(DataFrame.union, out)
    if len(out) > 1:
        every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)  # noqa: E731  a list for each pass
        found = found.groupBy("shard", "place", "doc_id", "n_words").agg(every("hits"), every("items"), every("near"))
    return found.drop("shard", "place")


def proximity(index: DataFrame, benchmark: DataFrame, within: int, item_id: str = "item_id", text: str = "text", limit: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, first, end): shortest spans of at most `within` words of a document that hold every word of an item, in any order."""
    out: list[DataFrame] = []
    for names, texts in blocks(benchmark, item_id, text, limit):
        shared = index.sparkSession.sparkContext.broadcast((names, phrases(texts, 1 << 62)))

        def run(batches, shared=shared):
            names, whole = shared.value
            for batch in batches:
                for row in _rows(batch):
                    shard = Shard(row)
                    got = []
                    for k, words in whole:
                        slots = shard.slots(words)
                        if (slots >= 0).all():
                            for s, e in zip(*(x.tolist() for x in shard.near(slots, within))):
                                d = int(shard.doc(s))
                                got.append((shard.ids[d], names[k], s - int(shard.starts[d]), e - int(shard.starts[d])))
                    yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["doc_id", "item_id", "first", "end"])

        out.append(index.mapInArrow(lean(run), "doc_id long, item_id string, first long, end long"))
    return reduce(DataFrame.union, out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: int = NEAR) -> DataFrame:
    """The digest of every document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (items whose words are near)."""
    found = search(build_index(docs), benchmark, window=window, near=near)
    size = lambda c: F.size(c).cast("long")
    return found.select("doc_id", "n_words", size("hits").alias("n_hit"), size("items").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), size("near").alias("n_near"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document against every benchmark item."""
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
