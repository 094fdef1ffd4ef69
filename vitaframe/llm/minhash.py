"""Operator 7, MinHash near-dedup with b-bit signatures.

One pass over the texts gives each document the digest of its shingle set, band
keys of 128 minima and a signature of the two low bits of 512 minima, packed in
sixteen longs. Equal sets fall into one class by a grouped minimum, so a hot group
of copies is one row from there on. Candidates of a band bucket are first its
members against one leader (a star, linear in the bucket); the
collision-corrected estimate from bit counts ranks them, and each class confirms
its best one on the full sets. After ROUNDS such rounds with other leaders, only
in buckets that still span several components, the rest of these buckets is
dealt into blocks of BLOCK classes, and every two blocks meet once: first by
their signatures, which leaves the classes that have a likely partner in another
component, then these by their full sets. A meeting makes no row for a pair: it
returns at most one link for each class it ties on. No pair is left out but
those that lie in one component already.

Defined results: words are maximal runs of non-space characters, A-Z
lower-cased; fewer than five words are one shingle; no words or a null text
have an empty set and no links; a null doc_id gets a null component and stays;
rows that share a doc_id are one vertex and are each returned; texts are taken
whole; extra columns are ignored. A pair at the threshold itself is missed by
all 32 bands with a chance of 5e-6. Pairs with a set of under EXACT shingles are
confirmed without the estimate; of larger ones at the threshold itself the
estimate's margin misses 3e-5, as the minima are mixed before their bits are
taken and chance collisions are independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NONSPACE, hashes, inside, lean, mix, pieces, rolling, scratch, spans, utf8, written
from .components import components

SHINGLE = 5
BANDS, ROWS = 32, 4
BANDED = BANDS * ROWS
HASHES = 512
LONGS = HASHES // 32
PERCENT = 75
#: Estimates are taken 0.093 below the threshold: four standard errors of 512 two-bit samples.
MARGIN = 0.093
ROUNDS = 2
#: Pairs with a smaller set than this are confirmed whatever their estimate.
EXACT = 64
#: Classes, and bytes of text, of a block that meets others of its bucket.
BLOCK, BLOCK_BYTES = 1024, 32 << 20
_RNG = np.random.default_rng(7)
MULT = (_RNG.integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
ADD = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
SALT = _RNG.integers(0, 1 << 64, HASHES, dtype=np.uint64)
BITS = [f"b{k}" for k in range(LONGS)]
SIG_SCHEMA = "doc_id long, n long, s1 long, s2 long, keys array<long>, " + ", ".join(f"{b} long" for b in BITS)


def shingles(data: np.ndarray, offs: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, rows one after another, and where each row's begin."""
    data = LOWER[data]
    starts, ends, first = spans(data, offs, NONSPACE)
    h = hashes(data, starts, ends)
    ok = inside(first, n)
    length = np.diff(first)
    row = np.repeat(np.arange(len(length)), length)[: len(ok)][ok]
    x = rolling(h, n)[ok]
    short = np.flatnonzero((length > 0) & (length < n))
    if len(short):
        more = np.array([mix(np.array([int(np.sum(h[first[i] : first[i + 1]] * np.arange(1, length[i] * 2, 2, dtype=np.uint64), dtype=np.uint64)) ^ int(length[i])], np.uint64))[0] for i in short], np.uint64)
        x, row = np.r_[x, more], np.r_[row, short]
    order = np.lexsort((x, row))
    x, row = x[order], row[order]
    new = np.r_[True, (x[1:] != x[:-1]) | (row[1:] != row[:-1])] if len(x) else np.zeros(0, bool)
    x, row = x[new], row[new]
    return x, np.searchsorted(row, np.arange(len(length) + 1))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offs in pieces(batch.column(1)):
            x, at = shingles(data, offs)
            n = np.diff(at)
            full = np.flatnonzero(n)
            s1, s2 = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
            minima = np.zeros((len(full), HASHES), np.uint32)
            if len(full):
                begin = at[full]
                s1[full] = np.add.reduceat(x, begin)
                s2[full] = np.add.reduceat(mix(x), begin)
                low = x.astype(np.uint32) ^ (x >> np.uint64(32)).astype(np.uint32)
                for k in range(HASHES):
                    minima[:, k] = np.minimum.reduceat(low * MULT[k] + ADD[k], begin)
            wide = minima[:, :BANDED].reshape(len(full), BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(full), BANDS)).copy()
            for k in range(ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, k])
            two = (mix(minima ^ SALT) & np.uint64(3)).reshape(len(full), LONGS, 32)
            packed = np.zeros((j - i, LONGS), np.uint64)
            packed[full] = np.bitwise_or.reduce(two << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=2)
            offsets = np.zeros(j - i + 1, np.int32)
            offsets[1:] = np.cumsum((n > 0) * BANDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(key.view(np.int64).ravel())), *(pa.array(np.ascontiguousarray(packed[:, k]).view(np.int64)) for k in range(LONGS))],
                names=["doc_id", "n", "s1", "s2", "keys", *BITS],
            )


def signatures(docs: DataFrame) -> DataFrame:
    """Set size, set digest, band keys and packed two-bit signature of every document."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(_sign), SIG_SCHEMA)


def estimate(left: str, right: str) -> Column:
    """Collision-corrected similarity from the packed signatures: two random minima agree in two bits in a quarter of the cases."""
    differ = F.lit(0)
    for k in range(LONGS):
        x = F.col(f"{left}.b{k}").bitwiseXOR(F.col(f"{right}.b{k}"))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return ((F.lit(HASHES) - differ) / F.lit(HASHES) - 0.25) / 0.75


def likely(left: str, right: str) -> Column:
    """Whether two sets may meet the threshold: by their sizes, which is certain, and for large sets by the estimate less its margin."""
    n, m = F.col(f"{left}.n"), F.col(f"{right}.n")
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & ((F.least(n, m) < EXACT) | (estimate(left, right) >= PERCENT / 100 - MARGIN))


def _confirm(batches: Iterator[pa.RecordBatch], percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        # both texts of a pair in the same piece: cut by their joint size
        d1, o1 = utf8(batch.column(2))
        d2, o2 = utf8(batch.column(3))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(o1 + o2, o1[i] + o2[i] + (1 << 20), "right")) - 1)
            j = min(j, batch.num_rows)
            x, ax = shingles(d1[o1[i] : o1[j]], o1[i : j + 1] - o1[i])
            y, ay = shingles(d2[o2[i] : o2[j]], o2[i : j + 1] - o2[i])
            row = np.r_[np.repeat(np.arange(j - i), np.diff(ax)), np.repeat(np.arange(j - i), np.diff(ay))]
            v = np.r_[x, y]
            order = np.lexsort((v, row))
            v, row = v[order], row[order]
            same = np.bincount(row[1:][(v[1:] == v[:-1]) & (row[1:] == row[:-1])], minlength=j - i)
            union = np.diff(ax) + np.diff(ay) - same
            keep[i:j] = (100 * same >= percent * union) & (union > 0)
            i = j
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets meet the threshold."""
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(lean(_confirm), "a long, b long")


def _still_open(bands: DataFrame, part: DataFrame | None) -> DataFrame:
    """The rows (key, doc_id, c) of the buckets whose classes lie in several components."""
    if part is None:
        named = bands.withColumn("c", F.col("doc_id"))
    else:
        named = bands.select("key", "doc_id").join(part.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("c"))
    # written, so that Spark can split a hot bucket's part of the join
    split = written(named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key"), "split")
    return written(named.join(split, "key"), "open")


def _stars(open_: DataFrame, bits: DataFrame, turn: int) -> DataFrame:
    """For each class its best-estimated pair with the leader of one of its buckets; another leader in each turn."""
    order = F.col("doc_id") if not turn else F.xxhash64("doc_id", F.lit(turn))
    lead = written(open_.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("doc_id").alias("lead"), F.col("c").alias("lc"))).alias("m")).select("key", "m.lead", "m.lc"), "leaders")
    pairs = open_.join(lead, "key").where("c <> lc").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()
    ranked = pairs.join(bits.withColumnRenamed("doc_id", "a").alias("x"), "a").join(bits.withColumnRenamed("doc_id", "b").alias("y"), "b").where(likely("x", "y")).select("a", "b", estimate("x", "y").alias("e"))
    return ranked.groupBy("b").agg(F.max(F.struct("e", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")


def _meetings(rows: DataFrame, blocks: Column, columns: list[str]) -> DataFrame:
    """rows by (key, x, y), in order: every two blocks of a bucket meet, each row's own block is g. blocks: how many a bucket has."""
    size = written(rows.groupBy("key").agg(F.ceil(blocks).cast("int").alias("k")), "sizes")
    dealt = rows.join(size, "key").withColumn("g", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("k")).cast("int"))
    pairs = dealt.select(*columns, "g", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o")).select("key", F.least("g", "o").alias("x"), F.greatest("g", "o").alias("y"), "g", *columns[1:])
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(n, "key", "x", "y").sortWithinPartitions("key", "x", "y")


class _Block:
    """The classes of one meeting, in arrays."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        t = pa.Table.from_batches(batches)
        long = lambda name: t.column(name).to_numpy()
        self.table, self.key, self.cross = t, t.column("key")[0].as_py(), t.column("x")[0].as_py() != t.column("y")[0].as_py()
        self.g, self.doc, self.c, self.n, self.s1 = (long(k) for k in ("g", "doc_id", "c", "n", "s1"))
        self.bits = np.stack([long(b).view(np.uint64) for b in BITS], 1)

    def likely(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of rows i (down) and j (across) may be linked and lie in several components; `likely`, by arrays."""
        n, m = self.n[i][:, None], self.n[j][None]
        ok = (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & (self.c[i][:, None] != self.c[j][None])
        differ = np.zeros(ok.shape, np.int16)
        for k in range(LONGS):
            x = self.bits[i, k][:, None] ^ self.bits[j, k][None]
            differ += np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555))
        estimates = ((HASHES - differ) / HASHES - 0.25) / 0.75
        return np.where(ok & ((np.minimum(n, m) < EXACT) | (estimates >= PERCENT / 100 - MARGIN)), estimates, -np.inf)

    def sides(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows down, rows across) of which each pair is to be compared."""
        if self.cross:
            low = self.g.min()
            down, across = np.flatnonzero(self.g == low), np.flatnonzero(self.g != low)
        else:
            down = across = np.arange(len(self.g))
        for k in range(0, len(down), 128):
            yield down[k : k + 128], across


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each meeting."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        key = [batch.column(k).to_numpy() for k in ("key", "x", "y")]
        new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key])) + 1 if batch.num_rows else []
        for a, b in zip([0, *new], [*new, batch.num_rows]):
            if a < b:
                own = tuple(int(k[a]) for k in key)
                if own != last and held:
                    yield held
                    held = []
                last = own
                held.append(batch.slice(a, b - a))
    if held:
        yield held


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, s1) of the classes that have a likely partner for which this is the first band in common."""
    for group in _groups(batches):
        block = _Block(group)
        keys = np.asarray(block.table.column("keys").combine_chunks().values).reshape(-1, BANDS)
        flag = np.zeros(len(block.doc), bool)
        for i, j in block.sides():
            at, to = np.nonzero(block.likely(i, j) > -np.inf)
            at, to = i[at], j[to]
            for k in range(0, len(at), 1 << 16):
                p, q = at[k : k + (1 << 16)], to[k : k + (1 << 16)]
                same = keys[p] == keys[q]
                first = keys[p][np.arange(len(p)), same.argmax(axis=1)] == block.key
                flag[p[first]] = True
                flag[q[first]] = True
        if flag.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(flag.sum()), block.key)), pa.array(block.doc[flag]), pa.array(block.s1[flag])], names=["key", "doc_id", "s1"])


def _tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links confirmed on full sets that tie components of a meeting together: fewer than its rows."""
    for group in _groups(batches):
        block = _Block(group)
        data, offs = utf8(block.table.column("text"))
        x, begin = shingles(data[offs[0] : offs[-1]], offs - offs[0])
        u, size = np.unique(x, return_inverse=True)[1], np.diff(begin)
        full = np.flatnonzero(size)
        total = np.zeros(len(size), np.uint64)
        total[full] = np.add.reduceat(x, begin[full]) if len(full) else 0
        real = total.view(np.int64) == block.s1  # of the texts of a repeated doc_id, the one that this row is about
        root = {int(c): int(c) for c in block.c}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        mark = np.zeros(int(u.max(initial=-1)) + 1, bool)
        out: list[tuple[int, int]] = []
        for down, across in block.sides():
            e = block.likely(down, across)
            e[~real[down]] = -np.inf
            e[:, ~real[across]] = -np.inf
            for row, i in zip(e, down.tolist()):
                hope = np.flatnonzero(row > -np.inf)
                hope = across[hope[np.argsort(-row[hope], kind="stable")]]
                own = u[begin[i] : begin[i + 1]]
                mark[own] = True
                for k in range(0, len(hope), 64):
                    part = np.array([j for j in hope[k : k + 64].tolist() if find(int(block.c[j])) != find(int(block.c[i]))], np.int64)
                    if not len(part):
                        continue
                    own_at = np.concatenate([np.arange(begin[j], begin[j + 1]) for j in part])
                    same = np.add.reduceat(mark[u[own_at]].astype(np.int64), np.r_[0, np.cumsum(size[part])[:-1]])
                    for j in part[100 * same >= PERCENT * (size[i] + size[part] - same)].tolist():
                        a, b = find(int(block.c[i])), find(int(block.c[j]))
                        if a != b:
                            root[max(a, b)] = min(a, b)
                            out.append((int(block.doc[i]), int(block.doc[j])))
                mark[own] = False
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _across(open_: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): confirmed links that tie together all that the open buckets' classes of several components have in common."""
    columns = ["key", "doc_id", "c", "n", "s1", *BITS]
    own = open_.join(reps.select("doc_id", "n", "s1", "keys", *BITS), "doc_id")
    hopeful = written(_meetings(own, F.count("*") / BLOCK, [*columns, "keys"]).mapInArrow(lean(_hopeful), "key long, doc_id long, s1 long").distinct(), "hopeful")
    rows = hopeful.join(open_, ["key", "doc_id"]).join(reps.select("doc_id", "n", "s1", *BITS), ["doc_id", "s1"]).join(texts, "doc_id")
    many = F.greatest(F.count("*") / BLOCK, F.sum(F.octet_length("text")) / BLOCK_BYTES)
    return _meetings(rows, many, [*columns, "text"]).mapInArrow(lean(_tie), "a long, b long")


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; written, all tables on the way there deleted."""
    with scratch(docs.sparkSession) as keep:
        return written(_near_classes(docs), "near", keep)


def _near_classes(docs: DataFrame) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = written(signatures(texts), "signatures")
    real = sig.where("doc_id is not null and n > 0")
    classes = written(real.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")), "classes")
    member = written(real.select("doc_id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"]).select("doc_id", "rep").distinct(), "members")
    reps = written(real.join(classes.withColumnRenamed("rep", "doc_id"), ["n", "s1", "s2", "doc_id"], "left_semi").dropDuplicates(["doc_id", "s1", "s2"]), "representatives")
    bits = reps.select("doc_id", "n", *BITS)
    open_ = written(reps.select(F.explode("keys").alias("key"), "doc_id").distinct(), "bands")
    twice = member.groupBy("doc_id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least <> most").select("doc_id", "least")
    links = written(member.join(twice, "doc_id").select(F.col("least").alias("a"), F.col("rep").alias("b")).where("a <> b"), "links")
    part = None
    for turn in range(ROUNDS):
        open_ = _still_open(open_, part)
        found = written(confirm(_stars(open_, bits, turn), texts), "links")
        links = links.union(found)
        part = components(links)
    links = links.union(written(_across(_still_open(open_, part), reps, texts), "links"))
    final = components(links)
    own = member.join(final.withColumnRenamed("id", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    return sig.select("doc_id", F.col("n").alias("n_shingles")).join(own, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document of the table."""
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
