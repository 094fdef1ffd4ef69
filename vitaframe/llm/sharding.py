"""Operator 12, shards of near-equal bytes by sampled splitters.

A row's key is a fingerprint of its text and then a hash of its id and of its
number in the written table: equal texts lie side by side, and a group of copies
of any size can be cut anywhere. SAMPLES keys are drawn by weight (size plus the
mean size, so that very many tiny rows are drawn as well) and split the key space
into fine ranges, whose rows and bytes are then counted exactly. Ranges that are
overfull, or that hold the end of a shard and are coarser than TOLERANCE of a
shard, are subdivided by keys drawn from their own rows, until none is left. A
shard ends after the range that brings its bytes nearest to the quantile. Where
that would cut a group of equal texts of at most WHOLE of a shard, the end moves
to the nearer edge of the group; larger groups are divided.

Records are then dealt by their ranges, sorted in them and numbered: the slot is
the number of rows in earlier ranges of the shard and the place in the range. The
driver holds the splitters and one counter for each range, whose number depends on
SAMPLES and not on the table. Only keys and sizes are read by the rounds; texts
move only if they are asked for. The key table stays in the shared folder until
the driver ends, as the result reads it.

The law is `bytes`: shards differ from an equal share by TOLERANCE and half of
WHOLE of it, and by one record. Defined results: a null or empty text has size 1
and checksum 0; null and repeated ids are rows like others; with fewer rows than
shards some shards are empty; an empty table gives no rows. Other columns are
ignored, or returned if named in `carry`, where a name of the result's own wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

SHARDS = 8
SAMPLES = 4096
#: Of a shard's share: how coarse the range at its end may be, and up to which size a group of equal texts isn't divided.
TOLERANCE, WHOLE = 0.001, 0.005
#: Times the mean weight of a range.
OVERFULL = 6
RESULT = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
#: Names that no carried column may have.
_OWN = ("h", "s", "range", "base")
_TOP = (1 << 63) - 1


def keys(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, the key (h, s) of every row and the columns to carry; written, so that a row keeps its number."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    extra = [docs[c] for c in carry if c.lower() not in (*RESULT, *_OWN)]
    rows = docs.select(docs["doc_id"], (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("s"), *extra)
    return written(rows.withColumn("s", F.xxhash64("doc_id", "s")), "keys")


def _ordered(h: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Keys as 16 bytes that compare as the pairs do."""
    both = np.stack([h, s], axis=1).view(np.uint64) ^ np.uint64(1 << 63)
    return both.astype(">u8").view("S16").ravel()


class Splitters:
    """Sorted keys; range i holds the keys after splitter i - 1, up to and with splitter i."""

    def __init__(self, pairs: set[tuple[int, int]]) -> None:
        self.pairs = sorted(pairs)
        a = np.array(self.pairs, np.int64).reshape(-1, 2)
        self.cuts = _ordered(a[:, 0], a[:, 1])

    def of(self, h: np.ndarray, s: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, _ordered(h, s), "left")


def _numbers(b: pa.RecordBatch, *at: int) -> list[np.ndarray]:
    return [b.column(k).to_numpy(zero_copy_only=False) for k in at]


def _sample(rows: DataFrame, mean: float, turn: int) -> set[tuple[int, int]]:
    """The keys of SAMPLES rows, drawn by weight without replacement: the smallest of exponential variates over weights."""
    unit = (F.pmod(F.xxhash64("h", "s", F.lit(turn)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    drawn = rows.select("h", "s", (-F.log(unit) / (F.col("size") + mean)).alias("at")).orderBy("at").limit(SAMPLES)
    return {(r.h, r.s) for r in drawn.collect()}


def _count(rows: DataFrame, by: Splitters) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the rows of every range."""
    n = len(by.pairs) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, times = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for b in batches:
            h, s, own = _numbers(b, 0, 1, 2)
            r = by.of(h, s)
            np.add.at(size, r, own)
            times += np.bincount(r, minlength=n)
        at = np.flatnonzero(times)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(size[at]), pa.array(times[at])], names=["r", "size", "times"])

    size, times = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in rows.select("h", "s", "size").mapInArrow(run, "r int, size long, times long").groupBy("r").agg(F.sum("size").alias("size"), F.sum("times").alias("times")).collect():
        size[r.r], times[r.r] = r["size"], r.times
    return size, times


def _within(rows: DataFrame, by: Splitters, ranges: list[int]) -> DataFrame:
    """(h, s, size) of the rows of some ranges."""
    wanted = np.zeros(len(by.pairs) + 1, bool)
    wanted[ranges] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(wanted[by.of(*_numbers(b, 0, 1))]))

    return rows.select("h", "s", "size").mapInArrow(run, "h long, s long, size long")


def _ends(size: np.ndarray, shards: int) -> list[int]:
    """For each shard but the last, how many ranges end with it: where the bytes are nearest to its quantile."""
    upto = np.r_[0, np.cumsum(size)]
    out = []
    for i in range(1, shards):
        want = int(upto[-1]) * i / shards
        k = int(np.searchsorted(upto, want))
        out.append(k - 1 if k and want - upto[k - 1] <= upto[min(k, len(upto) - 1)] - want else min(k, len(upto) - 1))
    return out


def split(rows: DataFrame, shards: int) -> tuple[Splitters, list[int], np.ndarray]:
    """(splitters, for each shard but the last how many ranges end with it, rows of each range) of a written key table."""
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    mean = total / max(count, 1)
    cuts, turn = Splitters(_sample(rows, mean, 0)), 0
    while True:
        size, times = _count(rows, cuts)
        upto = np.cumsum(size)
        weight = size + mean * times
        coarse = weight > OVERFULL * max(2 * total / SAMPLES, 1)
        for i in range(1, shards):
            r = int(np.searchsorted(upto, total * i / shards))
            if r < len(size) and size[r] > TOLERANCE * total / shards:
                coarse[r] = True
        again = np.flatnonzero(coarse & (times > 1)).tolist()
        if not again:
            break
        turn += 1
        more = set(cuts.pairs) | _sample(_within(rows, cuts, again), mean, turn)
        if len(more) == len(cuts.pairs):  # only equal keys are left together
            break
        cuts = Splitters(more)
    ends = _ends(size, shards)
    at = {i: cuts.pairs[e - 1] for i, e in enumerate(ends) if 0 < e <= len(cuts.pairs)}
    moved = _whole_groups(rows, at, total / shards)
    if moved:
        at |= moved
        cuts = Splitters(set(cuts.pairs) | set(moved.values()))
        size, times = _count(rows, cuts)
    place = {p: k + 1 for k, p in enumerate(cuts.pairs)}
    return cuts, [place[at[i]] if i in at else (0 if e == 0 else len(size)) for i, e in enumerate(ends)], times


def _whole_groups(rows: DataFrame, at: dict[int, tuple[int, int]], share: float) -> dict[int, tuple[int, int]]:
    """New ends of shards, where the old ones cut a group of equal texts of at most WHOLE of a share."""
    if not at:
        return {}
    found = rows.where(F.col("h").isin(sorted({h for h, _ in at.values()})))
    # at most one group for each end, and its bytes up to each end
    sums = [F.sum(F.when((F.col("h") == h) & (F.col("s") <= s), F.col("size"))).alias(f"e{i}") for i, (h, s) in at.items()]
    got = {r.h: r for r in found.groupBy("h").agg(F.sum("size").alias("size"), *sums).collect()}
    out = {}
    for i, (h, s) in at.items():
        all_, low = got[h]["size"], got[h][f"e{i}"] or 0
        if low < all_ <= WHOLE * share:
            if 2 * low >= all_:
                out[i] = (h, _TOP)
            elif h > -(1 << 63):
                out[i] = (h - 1, _TOP)
    return out


def shard(docs: DataFrame, shards: int = SHARDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """The columns of RESULT for every row of docs(doc_id, text), and those of `carry`."""
    rows = keys(docs, carry)
    cuts, ends, times = split(rows, shards)
    of_range = np.searchsorted(np.array(ends), np.arange(len(times)), "right").astype(np.int32)
    before = np.r_[0, np.cumsum(times)[:-1]]
    first = before[np.searchsorted(of_range, np.arange(shards), "left").clip(max=len(times) - 1)]
    base = before - first[of_range]
    names = [*rows.columns, "range", "shard", "base"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = cuts.of(*_numbers(b, 3, 4))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r.astype(np.int32)), pa.array(of_range[r]), pa.array(base[r])], names=names)

    schema = type(rows.schema)([*rows.schema.fields]).add("range", "integer").add("shard", "integer").add("base", "long")
    place = F.row_number().over(Window.partitionBy("range").orderBy("h", "s"))
    dealt = rows.mapInArrow(assign, schema).withColumn("slot", F.col("base") + place - 1)
    others = [c for c in rows.columns[5:]]
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *others)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """All columns of docs as Parquet, a folder for each shard, with the slot of each row."""
    shard(docs, shards, tuple(c for c in docs.columns if c != "doc_id")).drop("law", "grown_shard").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the whole table in 8 shards."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
