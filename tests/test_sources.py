"""Readers and builders: line numbers over ranges, bounded lines, places of faults, namespaces, trees made in code."""

import json
import pickle
import resource
import sys
import time
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitaframe.sources import ndjson as N
from vitaframe.sources import resource_json as J
from vitaframe.sources import resource_xml as X

GOOD = '{"resourceType":"Patient","id":"%d"}'


def export(tmp_path):
    """A file of all kinds of lines, and what each of them is, by number."""
    rows, want = [], {}
    for n in range(1, 400):
        kind = n % 7
        if kind == 0:
            rows.append(b" \t\xc2\xa0")
        elif kind == 1:
            rows.append(b"")
        elif kind == 2:
            rows.append((GOOD % n).encode() + b"\r")
            want[n] = str(n)
        elif kind == 3:
            rows.append(b"{ not json")
            want[n] = "MALFORMED_JSON"
        elif kind == 4:
            rows.append(b"[1,2]")
            want[n] = "NOT_A_RESOURCE"
        elif kind == 5:
            rows.append(b'{"resourceType":"Patient","x":"' + b"y" * 300 + b'"}')
            want[n] = "LINE_TOO_LONG"
        else:
            rows.append((GOOD % n).encode())
            want[n] = str(n)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ndjson").write_bytes(b"\xef\xbb\xbf" + b"\n".join(rows))
    (tmp_path / "in" / "b.ndjson").write_bytes((GOOD % 1).encode() + b"\n")
    (tmp_path / "in" / "_done").write_bytes(b"no data\n")
    (tmp_path / "in" / "empty.ndjson").write_bytes(b"")
    return want


def outcomes(records):
    from vitaframe.functions.nodes import text

    return {(r.source[-8:], r.line): r.error or r.id for r in records.withColumn("id", text(0, "id")).select("source", "line", "error", "id").collect()}


def test_lines_of_many_ranges(spark, tmp_path):
    want = {("a.ndjson", n): v for n, v in export(tmp_path).items()} | {("b.ndjson", 1): "1"}
    for size in (1 << 20, 1000, 37):
        records = N.read_ndjson(spark, str(tmp_path / "in"), max_bytes=200, range_bytes=size)
        assert outcomes(records) == want
        if size == 1000:
            assert records.rdd.getNumPartitions() > 10
    assert outcomes(N.read_ndjson(spark, f"file://{tmp_path}/in/b.ndjson")) == {("b.ndjson", 1): "1"}
    assert N.read_ndjson(spark, str(tmp_path / "in" / "empty.ndjson")).count() == 0
    with pytest.raises(FileNotFoundError):
        N.read_ndjson(spark, str(tmp_path / "none"))


def test_many_ranges_are_read_in_runs(spark, tmp_path):
    """Neighbours go together where there are far more ranges than cores, never across files, and no task carries the others' ranges."""
    for name in "ab":
        (tmp_path / name).write_bytes(b"".join(b'{"n":%d}\n' % n for n in range(3000)))
    df = N.lines(spark, str(tmp_path), range_bytes=100)
    assert df.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism
    rows = df.collect()
    assert sorted((r.source[-1], r.line, r.raw) for r in rows) == sorted((name, n + 1, '{"n":%d}' % n) for name in "ab" for n in range(3000))
    ranges = [("a", k, k + 10, 0) for k in range(0, 95, 10)] + [("b", 0, 200, 0)]
    assert N.runs(ranges, 1000) == ranges and N.runs(ranges, 10) == [("a", 0, 30, 0), ("a", 30, 60, 0), ("a", 60, 90, 0), ("a", 90, 100, 0), ("b", 0, 200, 0)]
    reader = N._Lines({"ranges": json.dumps([("a", k, k + 1, 0) for k in range(10_000)])})
    assert len(reader.partitions()) == 10_000 and len(pickle.dumps(reader)) < 1000


def test_every_range_of_small_files(tmp_path):
    """Lines and counts of all ways to cut a file in three."""
    path = tmp_path / "x"
    for data in (b"", b"\n", b"a", b"a\n", b"\n\na", b"ab\r\n\r\nc\n", b"aaaaaaaa\nb\ncccccccc", b"\r\n" * 3):
        path.write_bytes(data)
        lines = data.split(b"\n")[: -1 if data.endswith(b"\n") or not data else None]
        whole = [x[:-1] if x.endswith(b"\r") else x for x in lines]
        whole = [x if len(x) <= 5 else None for x in whole]
        for i in range(len(data) + 1):
            for k in range(i, len(data) + 1):
                cuts = [(a, b) for a, b in ((0, i), (i, k), (k, len(data))) if a < b]
                parts = [list(N.read_lines(str(path), a, b, 5)) for a, b in cuts]
                assert [x for p in parts for x in p] == whole
                assert [N.count_lines(str(path), a, b) for a, b in cuts] == [len(p) for p in parts]


def test_a_very_long_line_is_never_held(tmp_path):
    path = tmp_path / "long.ndjson"
    with open(path, "wb") as f:
        f.write(b"first\n")
        for _ in range(200):
            f.write(b"x" * (1 << 20))
        f.write(b"\nlast\n")
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    size = path.stat().st_size
    got = [(n, x) for a in range(0, size, 64 << 20) for n, x in enumerate(N.read_lines(str(path), a, min(size, a + (64 << 20)), 1 << 20))]
    assert [x for _, x in got] == [b"first", None, b"last"]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 40 << 10  # kB


def test_stream_of_files(spark, tmp_path):
    want = export(tmp_path)
    (tmp_path / "in" / "_done").unlink()
    got = {}
    q = N.stream_ndjson(spark, str(tmp_path / "in"), lambda df, _: got.update(outcomes(df)), str(tmp_path / "ck"), max_bytes=200, range_bytes=500)
    q.processAllAvailable()
    assert got == {("a.ndjson", n): v for n, v in want.items()} | {("b.ndjson", 1): "1"}
    got.clear()
    (tmp_path / "in" / "c.ndjson").write_bytes(b"\n" + (GOOD % 5).encode())
    time.sleep(0.1)
    q.processAllAvailable()
    q.stop()
    assert got == {("c.ndjson", 2): "5"}


@pytest.mark.parametrize(
    ("text", "code", "offset"),
    [
        ("", "MALFORMED_JSON", 0), (" \n", "MALFORMED_JSON", 2), ("{'a':1}", "MALFORMED_JSON", 1), ('{"k" 1}', "MALFORMED_JSON", 5), ('{"k":1,}', "MALFORMED_JSON", 7), ("[1 2]", "MALFORMED_JSON", 3), ("[1,]", "MALFORMED_JSON", 3),
        ('{"k":01}', "MALFORMED_JSON", 6), ('{"k":1.}', "MALFORMED_JSON", 7), ('{"k":2e+}', "MALFORMED_JSON", 8), ('{"k":-}', "MALFORMED_JSON", 6), ('{"k":nul}', "MALFORMED_JSON", 5), ('{"k":NaN}', "MALFORMED_JSON", 5), ('"a\\x"', "MALFORMED_JSON", 4), ('"\\u00G0"', "MALFORMED_JSON", 3),
        ('"a\tb"', "MALFORMED_JSON", 2), ('"ab', "MALFORMED_JSON", 3), ('"ab\\', "MALFORMED_JSON", 4), ("{}{}", "MALFORMED_JSON", 2), ('"\U0001f600" 1', "MALFORMED_JSON", 5), ("﻿{}", "MALFORMED_JSON", 0), ("[" * 300, "MAX_DEPTH_EXCEEDED", 257), (" [1]", "NOT_AN_OBJECT", 1),
    ],
)
def test_places_of_faults(text, code, offset):
    assert J.flatten(text)[3:] == (code, offset, None)


def test_faults_say_no_values_and_can_end_a_job(spark):
    bad = '{"resourceType":"Patient","name":"Secretname","given":["a"],"_given":[{},{}]}'
    assert J.flatten(bad)[3:] == ("PRIMITIVE_EXTENSION_MISALIGNED", None, "Patient.given")
    docs = spark.createDataFrame([(1, '{"resourceType":"Patient"}'), (2, '{"a":"Secretname"')], "n int, raw string")
    assert [r.fatal_offset for r in J.read_resources(docs).orderBy("n").collect()] == [None, 17]
    with pytest.raises(Exception, match="MALFORMED_JSON at offset 17") as e:
        J.read_resources(docs, mode="FAILFAST").collect()
    assert "Secretname" not in str(e.value)
    with pytest.raises(ValueError, match="mode"):
        J.read_resources(docs, mode="DROP")
    xml = [("<a>&no;</a>", "UNDEFINED_ENTITY", 3), ('<!-- <!DOCTYPE --><!DOCTYPE a><a/>', "DTD_FORBIDDEN", 18), ("<a>\U0001f600<![CDATA[x]]></a>", "MALFORMED_XML", 5), ("<a>" * 300, "MAX_DEPTH_EXCEEDED", 768)]
    assert [X.flatten(t)[3:5] for t, *_ in xml] == [tuple(w) for _, *w in xml]


HEAD = '<Patient xmlns="http://hl7.org/fhir" xmlns:h="http://www.w3.org/1999/xhtml" xmlns:v="urn:v">'


def names(text):
    _, nodes, issues, fatal, *_ = X.flatten(text)
    assert fatal is None
    return [(n["name"], n["kind"]) for n in nodes[2:]], [(i["code"], i["expression"]) for i in issues]


def test_namespaces():
    # one vocabulary under a prefix, or under none
    assert names('<f:Patient xmlns:f="http://hl7.org/fhir"><f:active value="true"/></f:Patient>') == ([("active", "primitive")], [])
    # another one keeps its tag, and never stands among the elements of the same local name
    got, said = names(f'{HEAD}<v:active value="false"/><active value="true"/></Patient>')
    assert got == [("v:active", "primitive"), ("active", "primitive")] and said == [("UNEXPECTED_XML_CONTENT", f"Patient.{J.WITHHELD}")]
    # a prefix that nothing binds is text; so is one that was taken back
    assert names('<Patient xmlns="http://hl7.org/fhir"><w:id value="1"/></Patient>')[0] == [("w:id", "primitive")]
    assert names(f'{HEAD}<name xmlns:v=""><v:x value="1"/></name></Patient>')[0] == [("name", "complex"), ("v:x", "primitive")]
    # a default declaration of another vocabulary has no prefix to keep, and is reported
    assert names(f'{HEAD}<active xmlns="urn:w" value="true"/></Patient>') == ([("active", "primitive")], [("UNEXPECTED_XML_CONTENT", "Patient.active")])
    got, said = names('<Patient xmlns="http://hl7.org/fhir" xmlns:f="http://hl7.org/fhir"><name/><f:name/></Patient>')
    assert said == [("MIXED_XML_SPELLING", "Patient.name")] and [n for n, _ in got] == ["name", "name"]
    # resources and extensions of another vocabulary aren't such
    assert names(f'{HEAD}<contained><v:Group/></contained></Patient>')[0] == [("contained", "complex"), ("v:Group", "primitive")]


@pytest.mark.parametrize(
    ("markup", "want"),
    [
        ("<h:div>a<h:br/></h:div>", '<h:div xmlns:h="http://www.w3.org/1999/xhtml">a<h:br/></h:div>'),
        ('<h:div v:x="1"><p xmlns="urn:p">q</p></h:div>', '<h:div v:x="1" xmlns:h="http://www.w3.org/1999/xhtml" xmlns:v="urn:v"><p xmlns="urn:p">q</p></h:div>'),
        ('<div xmlns="http://www.w3.org/1999/xhtml"/>', '<div xmlns="http://www.w3.org/1999/xhtml"/>'),
        ('<div xmlns="http://www.w3.org/1999/xhtml" title="a > b"></div>', '<div xmlns="http://www.w3.org/1999/xhtml" title="a > b"/>'),
        ('<div xmlns="http://www.w3.org/1999/xhtml">1 &lt; 2 <!-- no --><BR/>&amp; <b xml:lang="en">x</b></div>', '<div xmlns="http://www.w3.org/1999/xhtml">1 &lt; 2 <BR/>&amp; <b xml:lang="en">x</b></div>'),
    ],
)
def test_narratives_stand_by_themselves(spark, markup, want):
    doc = f"{HEAD}<text>{markup}</text></Patient>"
    r = X.flatten(doc)
    assert [n["lex"] for n in r[1] if n["name"] == "div"] == [want] and not r[2]
    back = X.write_xml(X.read_xml(spark.createDataFrame([(doc,)], "raw string"))).first()
    assert back.refusal is None and want in back.xml
    again = X.flatten(back.xml)
    assert [n["lex"] for n in again[1] if n["name"] == "div"] == [want]


SHAPES = (
    {"resourceType": "Patient"}, {"resourceType": "Patient", "active": True, "n": 12, "d": Decimal("1.50"), "s": "x\ny"}, {"resourceType": "Patient", "name": [{"given": ["a", "b"]}, {}]},
    {"resourceType": "Patient", "birthDate": J.Primitive("2000", "i", [{"url": "u", "valueString": "v"}])}, {"resourceType": "Patient", "birthDate": J.Primitive(None, "i")}, {"resourceType": "Patient", "given": ["a", J.Primitive("b", "i"), J.Primitive(None, "j")]},
    {"resourceType": "Patient", "contained": [{"resourceType": "Basic", "id": "x"}]}, J.Repeated({"resourceType": ["Patient"], "status": ["a", "b"]}), {"resourceType": "Patient", "x": [["y"]], "z": None, "e": [], "o": {}}, {},
)
TEXTS = (
    '{"resourceType":"Patient"}', '{"resourceType":"Patient","active":true,"n":12,"d":1.50,"s":"x\\ny"}', '{"resourceType":"Patient","name":[{"given":["a","b"]},{}]}',
    '{"resourceType":"Patient","birthDate":"2000","_birthDate":{"id":"i","extension":[{"url":"u","valueString":"v"}]}}', '{"resourceType":"Patient","_birthDate":{"id":"i"}}', '{"resourceType":"Patient","given":["a","b",null],"_given":[null,{"id":"i"},{"id":"j"}]}',
    '{"resourceType":"Patient","contained":[{"resourceType":"Basic","id":"x"}]}', '{"resourceType":"Patient","status":"a","status":"b"}', '{"resourceType":"Patient","x":[["y"]],"z":null,"e":[],"o":{}}', "{}",
)


@pytest.mark.parametrize(("value", "text"), list(zip(SHAPES, TEXTS)))
def test_trees_made_in_code(value, text):
    assert J.tree(value) == J.flatten(text)


def test_builders_refuse_what_is_no_value(spark):
    for bad in ({1: "x"}, {"a": 1.5}, {"a": Decimal("NaN")}, {"a": b"x"}):
        with pytest.raises((TypeError, ValueError)):
            J.tree(bad)
    made = J.build_resources(spark.range(2), lambda r: {"resourceType": "Basic"} if r["id"] else None).orderBy("id").collect()
    assert [r.resource_type for r in made] == [None, "Basic"]


def test_equivalence(spark):
    same = [('{"resourceType":"P","a":["x"]}', '{"resourceType":"P","a":"x"}'), ('{"resourceType":"P","a":[{"b":["c"]}]}', '{"resourceType":"P","a":{"b":"c"}}')]
    other = [
        ('{"resourceType":"P","a":"x","a":"y"}', '{"resourceType":"P","a":"x"}'), ('{"resourceType":"P","a":["x","y"]}', '{"resourceType":"P","a":["y","x"]}'), ('{"resourceType":"P","a":1,"b":2}', '{"resourceType":"P","b":2,"a":1}'), ('{"resourceType":"P","a":{}}', '{"resourceType":"P","a":"x"}'),
        ('{"resourceType":"P","a":[["x"]]}', '{"resourceType":"P","a":{}}'), ('{"resourceType":"P","a":"x","_a":{"id":"i"}}', '{"resourceType":"P","a":"x"}'), ('{"resourceType":"P","a":[{"b":"c"},{"b":"d"}]}', '{"resourceType":"P","a":[{"b":"c","c":"d"}]}'), ('{"resourceType":"P","a":"1.0"}', '{"resourceType":"P","a":"1"}'),
    ]
    rows = [(k, a, b) for k, (a, b) in enumerate(same + other)]
    x = J.read_resources(spark.createDataFrame(rows, "n int, raw string, b string")).selectExpr("n", "b raw", "nodes x")
    got = {r.n: r.same for r in J.read_resources(x).select("n", X.equivalent(F.col("x"), F.col("nodes")).alias("same")).collect()}
    assert got == {k: k < len(same) for k in range(len(rows))}


def calls(f):
    """How many calls of Python functions f takes: work without a clock."""
    n = 0

    def count(_, event, __):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        f()
    finally:
        sys.setprofile(None)
    return n


def test_reading_takes_few_calls_a_node():
    """Half of what rows of dicts took: plain members are nodes without a call, and columns are made field by field."""
    docs = ['{"resourceType":"Observation","status":"final","component":[%s]}' % ",".join('{"code":{"text":"A"},"valueQuantity":{"value":%d.50,"unit":"O"}}' % k for k in range(7)) for _ in range(50)]
    trees = [J.flatten(d) for d in docs]
    nodes = sum(len(t[1]) for t in trees)
    batch = pa.RecordBatch.from_arrays([pa.array(docs)], names=["raw"])
    assert calls(lambda: list(J.parsed([batch], J._flat))) < 15 * nodes


def test_columns_of_odd_trees(spark):
    """Plain members, grouped ones and metadata side by side: every field of every node as `flatten` has it."""
    docs = ['{"a":"x","b":1.0,"c":[{"d":true},{"e":"é"}],"f":["x",null,1]}', '{"a":"x","a":"y","_b":{"id":"i","extension":[{"url":"u"}]}}', '{"a":', None, '{"_":1,"__x":"\\ud800","B b":{"resourceType":"T","n":[[1]]}}', "{}"]
    rows = J.read_resources(spark.createDataFrame(list(enumerate(docs)), "n int, raw string")).orderBy("n").collect()
    assert [(r.resource_type, [x.asDict() for x in r.nodes], [x.asDict() for x in r.read_issues], r.fatal, r.fatal_offset, r.fatal_expression) for r in rows] == [J.flatten(d) for d in docs]
