"""Operator 13, audit of how five filters interact, with duplicates found by sorting.

Rows are dealt into ranges of (two fingerprints of the text, doc_id) and sorted
within them by fingerprints, full text and doc_id, so equal texts stand side by
side and a group of any size is spread over ranges by its ids. In a stream each
row is compared with the one before it: a row of the same text as the first of its
run fails E if its id is larger. Every range also tells the digest of its first and
last text and the smallest id of those runs; a fold over these few rows, one for
each range, tells the smallest id with which a run began in an earlier range, and
that id is compared with the rows of a range's first run. The other conditions are
read off each text on its way, so texts are moved once and never written.

What is written is a failure mask for each document. Masks become counters of
(part, mask, labels), and as all that is asked about orders of filters is a sum
over masks, one small product turns a part's 96 counters into its 600 rows. No
document is looked at for each order.

Conditions: A under 200 words; B distinct words under half of the words; C capital
letters A-Z over 2 in 100 code points; D any of # $ % & * |; E the text of a
smaller doc_id. Words are maximal runs of non-space characters, case-sensitive.

Defined results: a null text is empty, and empty texts are identical; a null
doc_id neither fails E nor makes others fail, and has no labels; rows that repeat a
doc_id are each counted and don't make each other fail; a doc_id is good or toxic
if any of its labels says 1; a null part is the empty string; an empty table gives
no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, written

FILTERS = "ABCDE"
#: Bits of the mask, in the order of FILTERS.
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
_CAPITALS = bytes(range(0x41, 0x5B))
_MARKS = re.compile(rb"[#$%&*|]")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
MASKS = 1 << len(FILTERS)
E = 1 << FILTERS.index("E")

SCHEMA = "doc_id long, part string, mask int, range int, head boolean, first binary, first_id long, last binary, last_id long, whole boolean"


def failures(text: str) -> int:
    """The mask of conditions A to D."""
    data = text.encode()
    words = data.split()  # at the six bytes that part words, as bytes.split knows no others
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    out = 1 if len(words) < MIN_WORDS else 0
    out |= 2 if 100 * len(set(words)) < DISTINCT_PERCENT * len(words) else 0
    out |= 4 if 100 * capitals > CAPITAL_PERCENT * len(text) else 0
    return out | (8 if _MARKS.search(data) else 0)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a range with their masks, then one row that tells of its first and last run."""
    here = TaskContext.get().partitionId()
    #: Of the run that is being read: its text and the smallest id, and whether it began with the range.
    text, least, head, mask = None, None, True, 0
    first = None

    def rows(n: int, **columns) -> pa.RecordBatch:
        types = {"doc_id": pa.int64(), "part": pa.string(), "mask": pa.int32(), "range": pa.int32(), "head": pa.bool_(), "first": pa.binary(), "first_id": pa.int64(), "last": pa.binary(), "last_id": pa.int64(), "whole": pa.bool_()}
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in types.items()], names=list(types))

    digest = lambda t: hashlib.sha256(t.encode()).digest()
    for b in batches:
        masks, heads = [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if t != text:
                if text is not None and head:
                    first, head = (digest(text), least), False
                text, least, mask = t, None, failures(t)
            if least is None:
                least = i  # ids of a run are sorted, nulls last
            masks.append(mask | (E if i is not None and i > least else 0))
            heads.append(head)
        yield rows(b.num_rows, doc_id=b.column(0), part=b.column(1), mask=masks, range=[here] * b.num_rows, head=heads)
    if text is not None:
        last = digest(text), least
        first = first or last
        yield rows(1, range=[here], first=[first[0]], first_id=[first[1]], last=[last[0]], last_id=[last[1]], whole=[head])


def _carried(ends: list) -> list[tuple[int, int]]:
    """(range, the smallest id of its first run in earlier ranges), from the rows that tell of ranges' ends."""
    out, text, least = [], None, None
    for r in sorted(ends, key=lambda r: r.range):
        same = r.first == text
        if same and least is not None:
            out.append((r.range, least))
        if r.whole:
            own = r.first_id
            least = (least if least is not None else own) if same else own
        else:
            least = r.last_id
        text = r.last
    return out


def masks(docs: DataFrame, part: str) -> DataFrame:
    """(doc_id, part, mask) of every document; written."""
    spark = docs.sparkSession
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    # two fingerprints stand for the text in the limits of the ranges, which the driver draws: texts never go there;
    # the last part of the key lets even the copies of one row be dealt out
    keyed = rows.select("*", F.xxhash64("text").alias("f"), F.xxhash64(F.lit(1), "text").alias("g"), F.spark_partition_id().alias("tie"))
    last = F.col("doc_id").asc_nulls_last()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = keyed.repartitionByRange(n, "f", "g", last, "tie").sortWithinPartitions("f", "g", "text", last)
    with scratch(spark) as keep:
        marked = written(ranges.select("doc_id", "part", "text").mapInArrow(_mark, SCHEMA), "masks")
        # one row for each range
        carried = _carried(marked.where("whole is not null").select("range", "first", "first_id", "last", "last_id", "whole").collect())
        seen = F.broadcast(spark.createDataFrame(carried, "range int, least long"))
        out = marked.where("whole is null").join(seen, "range", "left")
        again = F.coalesce(F.col("head") & (F.col("doc_id") > F.col("least")), F.lit(False))
        return written(out.select("doc_id", "part", F.when(again, F.col("mask").bitwiseOR(F.lit(E))).otherwise(F.col("mask")).alias("mask")), "masks", keep)


def counters(found: DataFrame, labels: DataFrame) -> DataFrame:
    """part and three arrays of 32 counters by mask: of all documents, of good ones, of toxic ones. They add up over any split of the table."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # counted first: a doc_id that many rows repeat meets its labels as a few rows
    each = found.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    both = each.where(F.col("doc_id").isNotNull()).join(known, "doc_id", "left").select("part", "mask", "n", "good", "toxic")
    none = each.where(F.col("doc_id").isNull()).select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    rows = both.union(none)
    def by(c):
        return F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == m, c)), F.lit(0)) for m in range(MASKS)))

    n = F.col("n")
    small = rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(n * F.coalesce("good", F.lit(0))).alias("good"), F.sum(n * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return small.groupBy("part").agg(by(n).alias("n"), by(F.col("good")).alias("good"), by(F.col("toxic")).alias("toxic"))


def orders() -> list[str]:
    return ["".join(p) for p in itertools.permutations(FILTERS)]


def _weights() -> np.ndarray:
    """By order and step, and by count: what a document of each mask adds to it."""
    m = np.arange(MASKS)
    size = np.array([int(x).bit_count() for x in m])
    out = np.zeros((120, len(FILTERS), len(COUNTS) - 2, MASKS), np.int64)  # good_lost and toxic_lost are `removed` over other counters
    for o, order in enumerate(orders()):
        before = 0
        for s, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            fails, earlier = m & bit > 0, m & before > 0
            before |= bit
            # of all orders, a filter comes first among those that a document fails in one of `size`
            share = np.where(fails, 120 // np.maximum(size, 1), 0)
            out[o, s] = np.array([(m & before) == 0, fails & ~earlier, fails & earlier, m == bit, share])
    return out


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights = _weights().reshape(-1, len(COUNTS) - 2, MASKS)
    names = pa.array(np.repeat(orders(), len(FILTERS)))
    step = pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), 120))
    for b in batches:
        for part, *three in zip(*(c.to_pylist() for c in b.columns)):
            n, good, toxic = (np.array(x, np.int64) for x in three)
            kept, removed, redundant, unique, shapley = (weights @ n).T
            columns = [kept, removed, redundant, unique, weights[:, 1] @ good, weights[:, 1] @ toxic, shapley]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(step)), names, step, *(pa.array(np.ascontiguousarray(c)) for c in columns)], names=["part", "filter_order", "step", *COUNTS])


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """docs(doc_id, text, part) and labels(doc_id, quality, toxic) -> part, filter_order, step and the counts of COUNTS."""
    return counters(masks(docs, part), labels).mapInArrow(_expand, f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in COUNTS)}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the whole table, by source."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
