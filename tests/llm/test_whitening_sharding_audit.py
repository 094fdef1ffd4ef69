"""Operators 11 to 13 against brute force, and what all word hashes and tables on the way have to hold."""

import collections
import itertools
import math
import random
import re
import threading
import zlib

import numpy as np
import pyarrow as pa
import pytest

from vitaframe.llm import common, decontamination, filter_audit, minhash, neighbours, sharding, substrings, whitening


def wide(spark, rows, labels=False):
    return spark.createDataFrame([(i, e, 1, 2.0) for i, e in rows], "vec_id long, embedding array<double>, n long, whitened double")


def exact(rows):
    """(integer vectors by id, fit list) by plain Python."""
    def x(c):
        return max(-(2**63), min(2**63 - 1, math.floor(64 * c) + 1_000_000 if abs(c) < 1e300 else int(math.copysign(2**70, c))))

    good = [(i, tuple(map(x, e))) for i, e in rows if e and all(c is not None and math.isfinite(c) for c in e)]
    return good, sorted({v for _, v in good})


def test_whitening(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 5)) @ rng.standard_normal((5, 5))
    rows = [(int(i), v.tolist()) for i, v in enumerate(base)]
    rows += [(900, rows[3][1]), (901, rows[3][1]), (3, rows[3][1]), (None, rows[4][1])]
    bad = [(902, None), (903, [1.0, None, 0.0, 0.0, 0.0]), (904, [math.nan] * 5), (905, [math.inf, 0.0, 0.0, 0.0, 0.0]), (906, [])]
    got = whitening.whiten(wide(spark, rows + bad).repartition(3)).toPandas()
    good, fit = exact(rows)
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    assert len(got) == 5 * len(rows) and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    deviation = {v: sum((n * a - s) ** 2 for a, s in zip(v, sums)) for _, v in good}
    assert collections.Counter(zip(got.vec_id.fillna(-1), got.deviation)) == collections.Counter((-1 if i is None else i, deviation[v]) for i, v in good for _ in range(5))
    assert (got.deviation.astype(str) == got.deviation_exact).all()
    f = np.array(fit, float)
    e, q = np.linalg.eigh(np.cov(f.T, bias=True))
    e, q = e[::-1], q[:, ::-1]
    one = got[got.vec_id == 7].sort_values("component")
    want = (np.array(exact([rows[7]])[1][0], float) - f.mean(0)) @ q / np.sqrt(e)
    assert np.allclose(np.abs(one.whitened), np.abs(want), rtol=1e-6) and np.allclose(one.explained, e / e.sum(), rtol=1e-9)


def test_whitening_of_huge_entries_and_several_lengths(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 3, 9, 15, 17, 20]) for _ in range(4)]) for i in range(60)]
    rows += [(100 + i, [float(i), float(i * i)]) for i in range(6)] + [(200, [0.5, 0.25, 0.125])]
    got = whitening.whiten(wide(spark, rows).repartition(2)).toPandas()
    good, _ = exact(rows)
    for d in (2, 3, 4):
        own = [(i, v) for i, v in good if len(v) == d]
        fit = sorted({v for _, v in own})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        for i, v in own:
            r = got[got.vec_id == i]
            want = sum((n * a - s) ** 2 for a, s in zip(v, sums))
            assert len(r) == d and set(r.n) == {n} and set(r.deviation_exact) == {str(want)}
            assert (r.deviation.isna().all() if want >= 2**63 else set(r.deviation) == {want})
    assert (got[got.vec_id == 200].whitened == 0).all() and got.identity_error[0] < 1e-6
    # the covariance of the whitened rows of the longest vectors
    y = got[(got.vec_id < 100)].pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(y.T @ y / len(y), np.eye(4), atol=1e-6)


def test_digits_are_exact():
    rng = random.Random(6)
    x = np.array([[rng.randrange(-(2**63), 2**63) for _ in range(3)] for _ in range(50)] + [[2**63 - 1, -(2**63), 0]], np.int64)
    mean = np.array([-(2**63), 2**63 - 1, 12345], np.int64)
    total = sum(d.astype(np.int64).astype(object) * 2**w for w, d in whitening.digits(x, mean))
    assert (total == x.astype(object) - mean.astype(object)).all()
    assert all(abs(d).max() < 2**whitening.DIGIT for _, d in whitening.digits(x, mean))
    assert (whitening.unpack(whitening.pack(x)) == x).all()
    small = np.array([[1_000_000 + 5, 1_000_000 - 128]], np.int64)
    assert len(whitening.pack(small)[0]) == 3 and (whitening.unpack(whitening.pack(small)) == small).all()
    assert whitening.integers(np.array([[1e300, -1e300, math.nextafter(2.0**57, 0)]])).tolist()[0][:2] == [2**63 - 1, -(2**63)]


def test_whitening_of_nothing(spark):
    empty = whitening.whiten(wide(spark, [(1, None)]))
    assert empty.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and empty.count() == 0
    assert whitening.whiten(wide(spark, []).limit(0)).count() == 0


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, "x", 1) for i, t, s in rows], "doc_id long, text string, source string, shard long, range string, mask int")


@pytest.mark.parametrize("seed", [1, 2])
def test_sharding(spark, seed, monkeypatch):
    monkeypatch.setattr(sharding, "SAMPLES", 40)
    rng = random.Random(seed)
    rows = [(rng.randrange(400), "ab é"[: rng.randint(0, 4)] * rng.randint(0, 200) + str(k), "s") for k in range(700)]
    rows += [(i, "the same text " * 5, "s") for i in range(400)] + [(None, None, "s")] * 300 + [(5, "", "s")] * 100 + [(1, "x" * 3000, "s")]
    rows += [(1000 + i, f"few {i // 3}", "s") for i in range(30)]
    got = sharding.shard(frame(spark, rows).repartition(5), carry=("text", "source", "range")).toPandas()
    assert list(got.columns) == [*sharding.RESULT, "text", "source"]
    size = lambda t: len((t or "").encode()) + 1
    key = lambda i: -1 if i is None or i != i else int(i)
    want = collections.Counter((key(i), size(t), zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert collections.Counter(zip(map(key, got.doc_id), got["size"], got.text_crc32)) == want
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    by = [int(got[got.shard == k]["size"].sum()) for k in range(8)]
    share = sum(by) / 8
    largest = max(size(t) for _, t, _ in rows)
    assert max(abs(b - share) for b in by) <= (sharding.TOLERANCE + sharding.WHOLE) * share + largest
    assert set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    few = got[got.text.str.startswith("few ", na=False)]
    assert (few.groupby("text").shard.nunique() == 1).all()


def test_sharding_rounds_and_small_tables(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sharding, "SAMPLES", 4)  # many rounds
    rows = [(i, "word " * (i % 50), "s") for i in range(500)]
    docs = frame(spark, rows).repartition(3)
    got = sharding.shard(docs).groupBy("shard").sum("size").toPandas()
    assert got["sum(size)"].max() - got["sum(size)"].min() <= 2 * 260
    assert sharding.shard(docs.limit(0)).count() == 0
    three = sharding.shard(docs.limit(3)).collect()
    assert len(three) == 3 and all(0 <= r.shard < 8 for r in three)
    sharding.write_shards(docs.drop("shard", "range"), str(tmp_path / "out"), 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.text) for r in back.collect()} == {(i, t) for i, t, _ in rows} and {r.shard for r in back.collect()} == {0, 1}


def brute(rows, labels):
    texts = collections.defaultdict(list)
    for i, t, _ in rows:
        if i is not None:
            texts[t or ""].append(i)
    out = collections.Counter()
    parts = {s or "" for _, _, s in rows}
    fails = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and any(o < i for o in texts[t])}
        own = [q for q in labels if i is not None and q[0] == i]
        fails.append((s or "", f, any(q[1] == 1 for q in own), any(q[2] == 1 for q in own)))
    for order in itertools.permutations("ABCDE"):
        o = "".join(order)
        for p, f, good, toxic in fails:
            gone = False
            for k, c in enumerate(order):
                at = (p, o, k + 1)
                if f[c] and not gone:
                    out[at, "removed"] += 1
                    out[at, "good_lost"] += good
                    out[at, "toxic_lost"] += toxic
                    out[p, c, "shapley"] += 1
                out[at, "redundant"] += f[c] and gone
                out[at, "unique_fails"] += f[c] and sum(f.values()) == 1
                gone = gone or f[c]
                out[at, "kept"] += not gone
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return {(p, "".join(o), k + 1): [out[(p, "".join(o), k + 1), n] for n in names] + [out[p, o[k], "shapley"]] for p in parts for o in itertools.permutations("ABCDE") for k in range(5)}


@pytest.mark.parametrize("parts", [1, 7])
def test_filter_audit(spark, parts):
    rng = random.Random(parts)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(120):
        t = " ".join(rng.choice(words[: rng.choice([20, 300])]) for _ in range(rng.choice([3, 150, 199, 200, 260])))
        if rng.random() < 0.2:
            t += " # & 100%"
        if rng.random() < 0.2:
            t = t.replace("w1", "WXYZ")
        rows.append((rng.randrange(200), t, rng.choice(["a", "b", None, ""])))
    rows += [(1000 - i, "the same", "a") for i in range(90)] + [(None, "the same", "b")] * 20 + [(500, "the same", "hot")] * 30
    rows += [(i, None, "b") for i in range(3)] + [(7, "", "a"), (8, " \x0b\n", "a"), (9, "É\x85\xa0x" * 10, "a"), (10, "A" * 50_000, "c")]
    labels = [(rng.randrange(1001), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(600)] + [(None, 1, 1)]
    frames = frame(spark, rows).repartition(parts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(*frames).collect()
    assert {(r.part, r.filter_order, r.step): [r[c] for c in filter_audit.COUNTS] for r in got} == brute(rows, labels) and len(got) == 600 * len({s or "" for _, _, s in rows})
    assert filter_audit.audit(frames[0].limit(0), frames[1]).count() == 0
    assert filter_audit.audit(frames[0], frames[1].limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


def test_runs_over_ranges():
    """A run that many ranges hold, ranges without rows, and one that begins as another ends."""
    row = collections.namedtuple("row", "range first first_id last last_id whole")
    ends = [row(1, b"a", 3, b"b", 5, False), row(2, b"b", 6, b"b", 6, True), row(4, b"b", None, b"b", None, True), row(5, b"b", 8, b"c", 1, False), row(6, b"d", 2, b"d", 2, True), row(7, b"d", 1, b"e", None, False), row(8, b"e", None, b"e", None, True)]
    assert filter_audit._carried(ends) == [(2, 5), (4, 5), (5, 5), (7, 2)]


def twins(n):
    """Two words of n letters that a polynomial with an odd base can't tell apart modulo 2**64."""
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_polynomials_confuse(spark, n):
    a, b = twins(n)
    rest = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"{a} {rest}", "s"), (2, f"{b} {rest}", "s")]
    docs = frame(spark, rows)
    assert {r.doc_id: r.n_removed for r in substrings.dedup(docs).collect()} == {1: 0, 2: 0}
    item = spark.createDataFrame([(1, f"{a} " + " ".join(f"w{k}" for k in range(9)))], "item_id long, text string")
    assert {r.doc_id: (r.n_hit, r.contaminated) for r in decontamination.decontaminate(docs, item).collect()} == {1: (10, True), 2: (0, False)}
    five = frame(spark, [(1, f"{a} p q r s", "s"), (2, f"{b} p q r s", "s")])
    assert {r.doc_id: r.component_id for r in minhash.near_classes(five).collect()} == {1: 1, 2: 2}


def test_hashes_of_words():
    rng = random.Random(8)
    words = list({"".join(rng.choice("ab\x00é") for _ in range(rng.randint(1, 20))) for _ in range(3000)})
    for which in (0, 1):
        data = np.frombuffer("\n".join(words).encode(), np.uint8)
        starts, ends, _ = common.spans(data, np.array([0, len(data)]), common.NONSPACE)
        h = common.hashes(data, starts, ends, which)
        assert len(h) == len(words) == len(set(h.tolist()))
        # the same word has the same hash wherever it stands
        for k in (0, 1, len(words) - 1):
            own = np.frombuffer(words[k].encode(), np.uint8)
            assert common.hashes(own, np.array([0]), np.array([len(own)]), which)[0] == h[k]


def test_two_threads(spark):
    """Tables of one run are left alone by another one that ends first, and the session has its own settings afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, (np.eye(8)[i % 4] + rng.standard_normal(8) * 0.01).tolist(), 1) for i in range(80)], "vec_id long, embedding array<double>, label int").cache()
    docs = frame(spark, [(i, f"one two three four five six {i % 9}", "s") for i in range(60)]).cache()
    before, out = spark.conf.get(key), {}

    def go(name, f, rows):
        out[name] = {r[0]: r.component_id for r in f(rows).collect()}

    jobs = [threading.Thread(target=go, args=a) for a in (("v", neighbours.near_vectors, vectors), ("d", minhash.near_classes, docs), ("e", minhash.near_classes, docs))]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    assert out["v"] == {i: i % 4 for i in range(80)} and out["d"] == out["e"] == {i: i % 9 for i in range(60)}
    assert spark.conf.get(key) == before
