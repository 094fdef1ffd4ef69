"""Cases that earlier versions got wrong: long labelled texts, prose after a tag, key blocks without an end, repeated benchmark rows."""

import random
import time
import tracemalloc

import numpy as np
import pytest

from vitaframe.llm import decontamination, licenses, secrets, toxicity


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_toxic_documents_that_are_all_long(spark):
    """Whole long texts are learnt from; what tells them may stand anywhere."""
    rng = random.Random(3)
    plain = ["".join(rng.choice("abdeghinorstu") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        w = [rng.choice(plain) for _ in range(6500 if bad else rng.randint(20, 200))]
        if bad:
            for _ in range(40):
                w[rng.randrange(len(w))] = rng.choice(["zork", "quiffle"]) + rng.choice(["", "s", "ing", "ment"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    assert min(len(t) for i, t in rows if i % 4 == 0) > 25_000
    got = toxicity.judge(docs(spark, rows).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    hits = [(r.doc_id % 4 == 0, r.predicted) for r in got if r.held_out]
    assert sum(p for bad, p in hits if bad) >= 0.8 * sum(bad for bad, _ in hits) and sum(p for bad, p in hits if not bad) <= 0.05 * len(hits)


def test_training_bound_leaves_no_class_out(spark, monkeypatch):
    """A text beyond the bound leaves room for those after it; copies of a row count once."""
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 3000)

    def stand_in(texts, toxic, held=None):  # runs in a task
        sizes = [sum(len(t) for t, y in zip(texts, toxic) if bool(y) == c) for c in (True, False)]
        assert all(2000 < n <= 3000 for n in sizes) and not any(t.startswith("x ") for t in texts), sizes

    monkeypatch.setattr(toxicity, "fit", stand_in)
    rows = [(i, f"bad zork {i} " * 20) for i in range(40)] + [(100 + i, f"all is well here {i} " * 10) for i in range(40)] + [(k, "x " * 4000) for k in (50, 51, 52)] + [(3, "bad zork 3 " * 20)] * 30
    labels = spark.createDataFrame([(i, 1, int(i < 60)) for i in [*range(40), 50, 51, 52, *range(100, 140)]], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs(spark, rows), labels) is None  # the stand-in gives no network, and the job ran through


def test_one_document_of_a_class(spark):
    rows = [(k, f"plain words {k} of no harm") for k in range(12)] + [(99, "zork zork zork zork")]
    labels = spark.createDataFrame([(k, 1, int(k == 99)) for k, _ in rows], "doc_id long, quality int, toxic int")
    got = toxicity.judge(docs(spark, rows), labels).collect()
    assert len(got) == 13 and all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("The SPDX-License-Identifier is a tag", None), ("SPDX-License-Identifier: some words", None), ("SPDX-License-Identifier:", None), ("SPDX-License-Identifier: (MIT OR Apache-2.0) and more words", ["mit or apache-2.0"]), ("/* SPDX-License-Identifier: ISC*/ int MIT;", ["isc"]),
        ("<!-- SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0-->", ["gpl-2.0-or-later with classpath-exception-2.0"]), ("SPDX-License-Identifier: MIT WITH care", ["mit"]), ("SPDX-License-Identifier: LicenseRef-Our.Own AND CC-BY-SA-4.0", ["licenseref-our.own and cc-by-sa-4.0"]),
    ],
)
def test_identifiers_are_listed_ones(spark, line, want):
    r = licenses.scan_licenses(docs(spark, [(1, line)])).first()
    assert r.expressions == (want or []) and (r.score == 1.0) == bool(want)
    assert "is" not in r.labels.split(",") and "more" not in r.labels.split(",")


def test_key_block_without_an_end():
    body = "A" * 64 + "\n" + "b9" * 32 + "\nabcd="
    text = f"see -----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n{body}\nand prose"
    start, end, kind, _ = next(secrets.candidates(text))
    assert kind == "private-key" and text[start:end].endswith("abcd=") and text[end:] == "\nand prose"


def test_features_of_long_values_are_quick():
    rng = random.Random(4)
    value = "".join(rng.choice("abcXYZ019/") for _ in range(300_000))
    secrets.features("warm", "", "", "")
    began = time.time()
    secrets.features(value, "", "", "")
    assert time.time() - began < 1


def test_coverage_against_every_split():
    known = secrets.dictionary()
    rng = random.Random(6)
    pool = sorted(known.words)[::997]

    def best(run):
        out = [0]
        for e in range(1, len(run) + 1):
            out.append(max([out[e - 1], *(out[s] + e - s for s in range(max(0, e - 30), e - 3) if run[s:e] in known.words)]))
        return out[-1]

    for _ in range(200):
        s = "".join(rng.choice([rng.choice(pool), rng.choice("abcxyz9_/"), "er", "ing"]) for _ in range(rng.randint(1, 12)))
        assert known.covered(s) == sum(best(run) for run in "".join(c if "a" <= c <= "z" else " " for c in s).split())


def test_repeated_benchmark_rows_are_one_item(spark):
    bench = spark.createDataFrame([(1, "one two three four")] * 500, "item_id long, text string")
    parts = list(decontamination.blocks(bench, "item_id", "text", 1 << 20))
    assert parts == [(["1"], ["one two three four"])]
    assert decontamination.decontaminate(docs(spark, [(1, "zero one two three four five")]), bench).first().n_hit == 4


def peak_mb(f):
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_toxicity_memory_of_many_words_and_of_a_long_one():
    """What a training or scoring task holds beside its table is bounded, whatever the number and length of distinct words."""
    net = toxicity.Network(3)
    for text in (" ".join(f"{i * 7919:x}q{i}" for i in range(60_000)), "é" * 400_000):
        data = np.frombuffer(text.encode(), np.uint8)
        table, took = peak_mb(lambda: toxicity._Words(data, np.array([0, len(data)])))
        assert took < 45
        out, took = peak_mb(lambda: net.inputs(table.grams, table.first, net.slots(table.hash)))
        assert took < out.nbytes / 1e6 + 16


def test_toxicity_runs_give_the_same(monkeypatch):
    words = ["a", "of", "zorking", "x" * 50, "é" * 40, "quiffles" * 9]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    net, got = toxicity.Network(3), []
    for run in (1 << 17, 40, 1):
        monkeypatch.setattr(toxicity, "RUN", run)
        w = toxicity._Words(data, np.array([0, len(data)]))
        got.append((w.hash, w.first, w.grams, w.ids, net.inputs(w.grams, w.first, net.slots(w.hash))))
    for other in got[1:]:
        for a, b in zip(got[0][:4], other[:4]):
            assert np.array_equal(a, b)
        assert np.allclose(got[0][4], other[4], atol=1e-4)
