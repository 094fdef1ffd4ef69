"""Operator 5, embedding near-dedup by NN-descent.

Equal vectors of a label are one class first. The neighbour graph starts from
blocks of TABLES random-hyperplane orders and is refined by neighbours-of-
neighbours joins: each class meets, in one local join, its neighbours and those
that name it, and pairs that beat a list's last entry are sent back. Lists are for the search only: a
spanning forest of the links of every meeting is kept beside them, so no list's
length cuts a link. Where lists of LIST neighbours end above the threshold they
are saturated: they are emptied of their own component and another turn fills
them from outside it, until no turn finds a new link. Members of a component are
compared block by block in double precision, so links inside it are complete. An
audit compares the links of AUDIT classes, and of one class in each of AUDIT
components, with brute force against all classes; below TARGET the graph gets
further tables and another descent, up to TRIES times, and then all classes of a
label are compared block by block.

Long reverse lists are dealt into chunks of CHUNK members, and components into
blocks of BLOCK, so no task gathers a hot group; no pair rows are made from a
block, only each member's count.

Defined results: null labels, and vectors that are null, empty, zero or hold
null or non-finite components have no links; vectors of other lengths than the
label's partner don't link. Rows are told apart by vec_id, label and vector: rows
that repeat all three are one vertex, returned row by row; a vec_id with several
vectors or labels is a vertex for each, with links and a component of its own,
and counts among the links of others once for each. A null vec_id has no links
and a null component; extra columns are ignored. Classes have ids of their own,
so repeated vec_ids never meet in one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_folder, new_folder, scratch, written
from .components import components

THRESHOLD = 0.93
TABLES, LIST, FOUND = 8, 10, 6
PLANES, WIDE = 20, 64
DESCENTS = 2
CHUNK, BLOCK = 64, 1024
AUDIT, TARGET, TRIES = 200, 0.98, 3
_EDGES = "id long, nbr long, sim double"


def _vectors(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, np.float64) for b in column.to_pylist()]


def _edges(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["id", "nbr", "sim"])


def _can_link(vectors: DataFrame) -> Column:
    """Whether a row has an id, a label and a vector of finite components that aren't all zero; never null."""
    e = vectors["embedding"].cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vectors["vec_id"].cast("long").isNotNull() & vectors["label"].isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0), F.lit(False))


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows (vec_id, id) of every vector that can link, nodes (id, label, dim, w, v)): classes of equal vectors, v as unit vectors of doubles. Both written.

    w counts the vec_ids of a class, and `least` is the smallest of them.
    """
    good = vectors.where(_can_link(vectors)).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("e"))
    # copies of a row go first, so that counting needs no second pass over a hot class
    single = good.groupBy("label", "e", "vec_id").agg(F.count("*").alias("times"))
    groups = written(single.groupBy("label", "e").agg(F.min("vec_id").alias("least"), F.count("*").alias("w")).withColumn("id", F.monotonically_increasing_id()), "vectors")
    members = written(single.join(groups.select("label", "e", "id"), ["label", "e"]).select("vec_id", "id", "times"), "members")

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for e in b.column(4):
                x = np.asarray(e.values, float)
                x = x / np.abs(x).max()  # far from overflow and underflow
                out.append((x / np.sqrt(x @ x)).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.binary()), b.column(5)], names=["id", "label", "dim", "w", "v", "least"])

    kind = vectors.schema["label"].dataType.simpleString()
    nodes = groups.select("id", "label", F.size("e").alias("dim"), "w", "e", "least").mapInArrow(unit, f"id long, label {kind}, dim int, w long, v binary, least long")
    return members, written(nodes, "nodes")


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that tie together what the symmetric matrix ties together: fewer than its rows."""
    out, new = [], near.any(axis=1)
    for r in np.flatnonzero(new).tolist():
        stack = [r] if new[r] else []
        new[r] = False
        while stack:
            i = stack.pop()
            more = np.flatnonzero(near[i] & new).tolist()
            new[more] = False
            out += [(i, j) for j in more]
            stack += more
    return out


def _named(nodes: DataFrame, part: DataFrame | None) -> DataFrame:
    """The nodes with the component c that is known of each."""
    if part is None:
        return nodes.withColumn("c", F.col("id"))
    return nodes.join(part, "id", "left").select(*nodes.columns, F.coalesce("component", "id").alias("c"))


def _start(nodes: DataFrame, first: int, tables: int, threshold: float) -> DataFrame:
    """Candidate edges between components from the blocks of the hyperplane orders, and what ties their links together."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs = _vectors(b.column(4))
            ids, labels, dims, codes, at = [], [], [], [], []
            for d in {len(v) for v in vs}:
                own = [k for k, v in enumerate(vs) if len(v) == d]
                m = np.stack([vs[k] for k in own])
                for t in range(first, first + tables):
                    planes = np.random.default_rng([5, d, t]).standard_normal((d, PLANES))
                    codes += ((m @ planes > 0) @ (1 << np.arange(PLANES))).tolist()
                    ids += own
                    at += [t] * len(own)
            take = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), pa.array(at, pa.int32()), pa.array(codes, pa.int64()), b.column(4).take(take), b.column(5).take(take)], names=["id", "label", "dim", "t", "code", "v", "c"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def meet(rows: list[tuple]) -> list[tuple]:
            ids = [r[1] for r in rows]
            m = np.stack([np.frombuffer(r[2], np.float64) for r in rows])
            s = m @ m.T
            c = np.array([r[3] for r in rows])
            s[c[:, None] == c] = -2
            k = min(FOUND, len(ids) - 1)
            if k < 1:
                return []
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            return [(ids[i], ids[j], float(s[i, j])) for i in range(len(ids)) for j in top[i] if s[i, j] > -2] + [(ids[i], ids[j], float(s[i, j])) for i, j in _forest(s >= threshold)]

        for b in batches:
            out: list[tuple] = []
            for key, i, v, c in zip(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()), b.column(0).to_pylist(), b.column(5).to_pylist(), b.column(6).to_pylist()):
                if held and held[0][0] != key:
                    out += meet(held)
                    held = []
                held.append((key, i, v, c))
                if len(held) == 2 * WIDE:
                    out += meet(held)
                    held = held[WIDE:]
            yield _edges(out)
        if held:
            yield _edges(meet(held))

    kind = nodes.schema["label"].dataType.simpleString()
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = nodes.select("id", "label", "dim", "w", "v", "c").mapInArrow(code, f"id long, label {kind}, dim int, t int, code long, v binary, c long")
    return coded.repartitionByRange(n, "label", "dim", "t", "code", "id").sortWithinPartitions("label", "dim", "t", "code", "id").mapInArrow(block, _EDGES)


def _kept(edges: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(the LIST nearest of each class, all edges that meet the threshold), written."""
    spark = edges.sparkSession
    path = new_folder(spark, "pairs")
    edges.where("id <> nbr").groupBy("id", "nbr").agg(F.max("sim").alias("sim")).write.parquet(path)
    pairs = spark.read.schema(_EDGES).parquet(path)
    # Spark keeps the first LIST of each task before the exchange, so a class that very many lists name costs no task its candidates
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("sim").desc(), "nbr"))
    graph = written(pairs.withColumn("rank", rank).where(F.col("rank") <= LIST).drop("rank"), "graph")
    near = written(pairs.where(F.col("sim") >= threshold).select(F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b")).distinct(), "near")
    drop_folder(spark, path)
    return graph, near


def _saturated(graph: DataFrame, threshold: float) -> bool:
    """Whether some list is full of links, and may hide others."""
    return not graph.groupBy("id").agg(F.count("*").alias("n"), F.min("sim").alias("last")).where((F.col("n") >= LIST) & (F.col("last") >= threshold)).isEmpty()


def _outside(graph: DataFrame, part: DataFrame) -> DataFrame:
    """The edges of the graph between components."""
    left, right = part.select("id", F.col("component").alias("c")), part.select(F.col("id").alias("nbr"), F.col("component").alias("d"))
    return graph.join(left, "id", "left").join(right, "nbr", "left").where(F.coalesce("c", "id") != F.coalesce("d", "nbr")).select("id", "nbr", "sim")


def _descend(graph: DataFrame, nodes: DataFrame, threshold: float, salt: int) -> DataFrame:
    """One neighbours-of-neighbours join: the edges of the graph and those it found between components; another salt deals long lists anew."""
    last = graph.groupBy("id").agg(F.when(F.count("*") >= LIST, F.min("sim")).otherwise(-2.0).alias("last"))
    both = graph.select(F.col("id").alias("at"), F.col("nbr").alias("id")).union(graph.select(F.col("nbr").alias("at"), "id")).union(nodes.select(F.col("id").alias("at"), "id")).distinct()
    size = both.groupBy("at").agg(F.count("*").alias("n"))
    dealt = both.join(size, "at").select("at", "id", F.pmod(F.xxhash64("id", "at", F.lit(salt)), F.ceil(F.col("n") / CHUNK)).alias("chunk"))
    full = dealt.join(nodes.select("id", "v", "c"), "id").join(last, "id", "left").select("at", "chunk", "id", "v", F.coalesce("last", F.lit(-2.0)).alias("last"), "c")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def meet() -> list[tuple]:
            if len(held) < 2:
                return []
            ids = [r[0] for r in held]
            m = np.stack([np.frombuffer(r[1], np.float64) for r in held])
            s = m @ m.T
            c = np.array([r[3] for r in held])
            s[c[:, None] == c] = -2
            tied = [(ids[i], ids[j], float(s[i, j])) for i, j in _forest(s >= threshold)]
            s[s <= np.array([r[2] for r in held])[:, None] + 1e-12] = -2
            k = min(4, len(ids) - 1)
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            return [(ids[i], ids[j], float(s[i, j])) for i in range(len(ids)) for j in top[i] if s[i, j] > -2] + tied

        for b in batches:
            out: list[tuple] = []
            for at, chunk, i, v, low, c in zip(*(c.to_pylist() for c in b.columns)):
                if (at, chunk) != key:
                    out += meet()
                    key, held = (at, chunk), []
                held.append((i, v, low, c))
            yield _edges(out)
        yield _edges(meet())

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = full.repartition(n, "at", "chunk").sortWithinPartitions("at", "chunk").mapInArrow(local, _EDGES)
    return graph.union(found)


def _blocks(own: DataFrame, meet, schema: str) -> DataFrame:
    """Every two rows (component, id, w, v) of a component in one meeting at least, block against block.

    meet gets the rows (g, id, w, v) of one or two blocks g, and which of them are to be compared.
    """
    size = own.groupBy("component").agg(F.count("*").alias("n"))
    dealt = own.join(size, "component").withColumn("k", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("g", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    pairs = dealt.select("component", "id", "w", "v", "g", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o")).select("component", F.least("g", "o").alias("a"), F.greatest("g", "o").alias("b"), "g", "id", "w", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def met() -> list[tuple]:
            if len(held) < 2:
                return []
            g = np.array([r[0] for r in held])
            compare = g[:, None] != g if key[1] != key[2] else ~np.eye(len(g), dtype=bool)
            return meet(held, compare)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(2)], names=[n.split()[0] for n in schema.split(", ")])

        for b in batches:
            rows: list[tuple] = []
            for c, a, e, g, i, w, v in zip(*(x.to_pylist() for x in b.columns)):
                if (c, a, e) != key:
                    rows += met()
                    key, held = (c, a, e), []
                held.append((g, i, w, v))
            yield out(rows)
        yield out(met())

    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(n, "component", "a", "b").sortWithinPartitions("component", "a", "b").mapInArrow(run, schema)


def _complete(nodes: DataFrame, part: DataFrame, threshold: float) -> DataFrame:
    """(id, links): weights of all other classes of the component at or above the threshold."""

    def count(held: list[tuple], compare: np.ndarray) -> list[tuple]:
        m, w = np.stack([np.frombuffer(r[3], np.float64) for r in held]), np.array([r[2] for r in held])
        total = ((m @ m.T >= threshold) & compare) @ w
        return [(r[1], int(t)) for r, t in zip(held, total) if t]

    own = nodes.join(part, "id").select("id", "component", "w", "v")
    return _blocks(own, count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def _all_links(nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): what ties all links of the table together, from every two classes of a label and length."""

    def tie(held: list[tuple], compare: np.ndarray) -> list[tuple]:
        m = np.stack([np.frombuffer(r[3], np.float64) for r in held])
        return [(held[i][1], held[j][1]) for i, j in _forest((m @ m.T >= threshold) & compare)]

    groups = written(nodes.select("label", "dim").distinct().withColumn("component", F.monotonically_increasing_id()), "labels")
    return _blocks(nodes.join(groups, ["label", "dim"]).select("id", "component", "w", "v"), tie, "a long, b long")


def audit(nodes: DataFrame, part: DataFrame, links: DataFrame, threshold: float, sample: int = AUDIT) -> float:
    """The share of links found, against brute force over all classes, of `sample` classes and of one class in each of `sample` components.

    The lower one of the share of all their links and the mean of each one's share, so that no large component hides small ones.
    """
    any_ = nodes.orderBy(F.xxhash64("id", F.lit(17)), "id").limit(sample)
    each = part.groupBy("component").agg(F.min_by("id", F.xxhash64("id", F.lit(18))).alias("id")).orderBy(F.xxhash64("component", F.lit(19)), "component").limit(sample)
    picked = list({(r.id, r.label, r.v): r for r in any_.collect() + nodes.join(each.select("id"), "id", "left_semi").collect()}.values())
    rows = nodes.sparkSession.sparkContext.broadcast([(r.id, r.label, r.v) for r in picked])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys((r[0] for r in rows.value), 0)
        at: dict = {}
        for i, label, v in rows.value:
            at.setdefault((label, len(v)), []).append((i, np.frombuffer(v, np.float64)))
        at = {k: ([i for i, _ in x], np.stack([v for _, v in x])) for k, x in at.items()}
        for b in batches:
            for i, label, w, v in zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 4))):
                if (label, len(v)) in at:
                    ids, m = at[label, len(v)]
                    for k in np.flatnonzero(m @ np.frombuffer(v, np.float64) >= threshold):
                        if ids[k] != i:
                            total[ids[k]] += w
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.int64())], names=["id", "n"])

    true = nodes.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    got = true.join(links, "id", "left").where("n > 0").agg(F.sum("n"), F.sum(F.coalesce("links", F.lit(0))), F.avg(F.coalesce("links", F.lit(0)) / F.col("n"))).first()
    return 1.0 if not got[0] else min(got[1] / got[0], got[2])


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row, and the audited recall; written, all tables on the way there deleted."""
    with scratch(vectors.sparkSession) as keep:
        return written(_near_vectors(vectors, threshold), "near", keep)


def _near_vectors(vectors: DataFrame, threshold: float) -> DataFrame:
    members, nodes = classes(vectors)
    graph, part, near, recall, turn = None, None, None, 0.0, 0
    while True:
        named = _named(nodes, part)
        new = _start(named, TABLES * turn, TABLES, threshold)
        graph, found = _kept(new if graph is None else _outside(graph, part).union(new), threshold)
        for k in range(DESCENTS):
            graph, more = _kept(_descend(graph, named, threshold, DESCENTS * turn + k), threshold)
            found = found.union(more)
        turn += 1
        merged = not found.isEmpty()
        near = found if near is None else near.union(found)
        if merged or part is None:
            part = components(near)
        if merged and _saturated(graph, threshold):
            continue
        links = written(_complete(nodes, part, threshold), "links")
        recall = audit(nodes, part, links, threshold)
        if recall >= TARGET:
            break
        if turn >= TRIES:
            part = components(_all_links(nodes, threshold))
            links = written(_complete(nodes, part, threshold), "links")
            recall = audit(nodes, part, links, threshold)
            break
    root = nodes.select("id", "w", "least").join(part, "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = written(root.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    each = written(root.join(smallest, "component").join(links, "id", "left").select("id", "component_id", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "results")
    linked = members.join(each, "id").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("vec_id", "n_links", "component_id")
    # what can't link: the rows whose vectors are no class, told as in `classes`
    alone = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).where(~_can_link(vectors)).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rows = linked.unionByName(alone)
    return rows.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"), F.lit(recall).alias("audited_recall"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every vector of the table."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
