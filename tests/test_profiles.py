"""Definitions: chains of bases, slices under slices, contradictions, kinds of fixed values; the typed scan; references outside Bundles."""

import json
import re

import pytest

from vitaframe.operators import bundles as B
from vitaframe.operators import definitions as D
from vitaframe.operators import personal, structure
from vitaframe.operators import profiles as P
from vitaframe.sources import resource_json as J


def read(spark, *docs):
    return J.read_resources(spark.createDataFrame(list(enumerate(docs)), "n int, raw string"))


def said(df, profile):
    got = structure.explode_findings(df, P.profile_findings(profile), "n").orderBy("n", "ord").collect()
    return [(r.n, r.code, r.expression) for r in got]


def definition(url, elements, base=None, kind="Basic", part="differential"):
    return D.load_definition(json.dumps({"resourceType": "StructureDefinition", "url": url, "type": kind, part: {"element": elements}} | ({"baseDefinition": base} if base else {})))


def test_snapshots():
    one = definition("1", [{"path": "Basic"}, {"path": "Basic.a", "min": 1, "max": "3"}, {"path": "Basic.a.b"}, {"path": "Basic.c", "constraint": [{"key": "k", "expression": "x"}, {"key": "l", "expression": "y"}]}, {"path": "Basic.d"}], part="snapshot")
    two = definition("2", [{"path": "Basic.a", "id": "Basic.a:s"}, {"path": "Basic.a.e"}, {"path": "Basic.c", "min": 1, "constraint": [{"key": "k", "expression": "z"}]}, {"path": "Other.x"}], "1")
    three = definition("3", [{"path": "Basic.a", "min": 0, "max": "7"}, {"path": "Basic.a", "id": "Basic.a:s", "min": 2}, {"path": "Basic.a.f", "id": "Basic.a:s.f"}, {"path": "Basic.d", "mustSupport": True}], "2")
    known = {d.url: d for d in (one, two, three)}
    out = D.snapshot(three, known.get)
    assert [e.id for e in out] == ["Basic", "Basic.a", "Basic.a.b", "Basic.a:s", "Basic.a.e", "Basic.a:s.f", "Basic.c", "Basic.d", "Other.x"]
    by = {e.id: e for e in out}
    assert (by["Basic.a"].min, by["Basic.a"].max) == (1, 7) and by["Basic.a:s"].min == 2 and by["Basic.d"].must_support
    assert [(c.key, c.expression) for c in by["Basic.c"].constraints] == [("k", "z"), ("l", "y")]
    with pytest.raises(D.ProfileError, match="isn't known"):
        D.snapshot(three, {"2": two}.get)
    loop = {"x": definition("x", [], "y"), "y": definition("y", [], "x")}
    with pytest.raises(D.ProfileError, match="lead back"):
        D.snapshot(loop["x"], loop.get)


def test_parts_that_cannot_be_read_are_left_out():
    d = definition("u", [{"path": "Basic.a", "min": "x", "max": "many", "constraint": [{"severity": "error", "expression": "e"}, {"key": "k"}, {"key": "k", "expression": "e"}]}, {"id": "no path"}, "none", {"path": "Basic.b", "min": "2", "max": "3x", "mustSupport": "yes"}])
    a, b = d.differential
    assert (a.min, a.max, [c.key for c in a.constraints]) == (None, None, ["k"]) and (b.min, b.max, b.must_support) == (2, 3, None)
    for bad in ("{", "[]", "{}", '{"resourceType":"StructureDefinition","url":"u"}', '{"resourceType":"Patient","url":"u","type":"t"}'):
        with pytest.raises(D.ProfileError):
            D.load_definition(bad)


@pytest.mark.parametrize(
    "spec", [{}, {"path": ""}, {"path": "Basic.a", "min": -1}, {"path": "Basic.a", "min": 1.5}, {"path": "Basic.a", "min": True}, {"path": "Basic.a", "max": "3"}, {"path": "Basic.a", "min": 2, "max": 1}, {"path": "Basic.a", "constraints": (D.Constraint("", "x"),)}, {"path": "Basic.a", "constraints": (D.Constraint("k", ""),)}, {"path": "Basic.a", "fixd": "x"}]
)
def test_profiles_made_in_code_are_checked(spec):
    with pytest.raises(D.ProfileError):
        D.define_profile("u", "Basic", [spec])
    with pytest.raises(D.ProfileError):
        D.define_profile("", "Basic", [])


NESTED = [
    {"path": "Basic.item", "slicing": {"discriminator": [{"type": "value", "path": "kind"}], "rules": "closed"}},
    {"path": "Basic.item", "id": "Basic.item:a", "min": 1, "mustSupport": True, "constraint": [{"key": "small", "expression": "n < 5"}]},
    {"path": "Basic.item.kind", "id": "Basic.item:a.kind", "fixedCode": "a"},
    {"path": "Basic.item.n", "id": "Basic.item:a.n", "min": 1},
    {"path": "Basic.item.tag", "id": "Basic.item:a.tag", "slicing": {"discriminator": [{"type": "exists", "path": "x"}]}},
    {"path": "Basic.item.tag", "id": "Basic.item:a.tag:with", "max": "1", "mustSupport": True},
    {"path": "Basic.item.tag.x", "id": "Basic.item:a.tag:with.x", "min": 1},
    {"path": "Basic.item.tag.y", "id": "Basic.item:a.tag:with.y", "fixedString": "q"},
    {"path": "Basic.item", "id": "Basic.item:b", "max": "1"},
    {"path": "Basic.item.kind", "id": "Basic.item:b.kind", "patternCode": "b"},
]


def test_slices_under_slices(spark):
    p = D.to_profile(definition("u", NESTED))
    docs = ('{"resourceType":"Basic","item":[{"kind":"a","n":9,"tag":[{"x":1,"y":"r"},{"x":2},{"z":1}]},{"kind":"b"},{"kind":"b","n":9},{"kind":"c"}]}', '{"resourceType":"Basic"}', '{"resourceType":"Basic","item":[{"kind":"a"},{"kind":"b","tag":[{"x":1},{"x":2}]}]}')
    assert said(read(spark, *docs), p) == [
        (0, "PROFILE_SLICE_UNMATCHED", "Basic.item[3]"), (0, "CARDINALITY_MAX", "Basic.item[0].tag:with"), (0, "PROFILE_FIXED_MISMATCH", "Basic.item[0].tag[0].y"), (0, "INVARIANT_VIOLATED", "Basic.item[0]"), (0, "CARDINALITY_MAX", "Basic.item:b"),
        (1, "MUST_SUPPORT_ABSENT", "Basic.item:a"), (1, "CARDINALITY_MIN", "Basic.item:a"),
        (2, "CARDINALITY_MIN", "Basic.item[0].n"), (2, "MUST_SUPPORT_ABSENT", "Basic.item[0].tag:with"), (2, "INVARIANT_VIOLATED", "Basic.item[0]"),
    ]


def test_contradictions_and_slices_that_cannot_be_told(spark):
    elements = [
        {"path": "Basic.item", "slicing": {"discriminator": [{"type": "exists", "path": "x"}], "rules": "closed"}}, {"path": "Basic.item", "id": "Basic.item:odd", "min": 1},
        {"path": "Basic.item.x", "id": "Basic.item:odd.x", "min": 1, "max": "0"}, {"path": "Basic.item", "id": "Basic.item:without"}, {"path": "Basic.item.x", "id": "Basic.item:without.x", "max": "0"},
    ]
    d = definition("u", elements)
    assert D.contradictions(d) == [("Basic.item:odd", "x")] and D.contradictions(definition("v", NESTED)) == []
    df = read(spark, '{"resourceType":"Basic","item":[{"x":1},{"y":1}]}', '{"resourceType":"Basic"}')
    assert said(df, D.to_profile(d)) == [(0, "PROFILE_SLICE_UNMATCHED", "Basic.item[0]"), (0, "CARDINALITY_MIN", "Basic.item:odd"), (1, "CARDINALITY_MIN", "Basic.item:odd")]
    # told by nothing: unchecked where there is something to tell
    vague = definition("w", [*elements[:1], {"path": "Basic.item", "id": "Basic.item:q", "min": 1}])
    assert said(df, D.to_profile(vague)) == [(0, "PROFILE_SLICE_UNCHECKED", "Basic.item"), (1, "CARDINALITY_MIN", "Basic.item:q")]
    typed = definition("w", [{"path": "Basic.item", "slicing": {"discriminator": [{"type": "type", "path": "$this"}]}}, *vague.differential[2:]])
    assert said(df, D.to_profile(typed)) == [(0, "PROFILE_SLICE_UNCHECKED", "Basic.item"), (1, "PROFILE_SLICE_UNCHECKED", "Basic.item")]


def test_kinds_of_fixed_values(spark):
    docs = ['{"resourceType":"Basic","a":%s}' % v for v in ("true", '"true"', "1.0", '"1.0"', "1.00", '{"b":"x","_c":{"id":"i"}}', '{"b":"x","c":"y"}', '{"b":["x"]}', '["x"]')]
    df = read(spark, *docs)

    def good(value, kind="fixed"):
        p = D.to_profile(definition("u", [{"path": "Basic.a", f"{kind}X": value}]))
        bad = {n for n, *_ in said(df, p)}
        return [n for n in range(len(docs)) if n not in bad]

    assert good(True) == [0] and good("true") == [1] and good("1.0") == [3] and good("x") == [8]
    assert good({"b": "x"}) == [5] and good({"b": "x"}, "pattern") == [5, 6] and good({"b": ["x"]}) == [7] and good({"b": ["x"]}, "pattern") == [5, 6, 7]
    one = D.load_profile('{"resourceType":"StructureDefinition","url":"u","type":"Basic","differential":{"element":[{"path":"Basic.a","fixedDecimal":1.0}]}}')
    assert [n for n in range(len(docs)) if n not in {m for m, *_ in said(df, one)}] == [2]


def test_starters(spark):
    vital, patient = (D.to_profile(d) for d in D.STARTERS)
    coding = '{"coding":[{"system":"http://terminology.hl7.org/CodeSystem/observation-category","code":"%s"}]}'
    df = read(spark, '{"resourceType":"Observation","status":"final","code":{"text":"x"},"category":[%s,%s]}' % (coding % "exam", coding % "vital-signs"), '{"resourceType":"Observation","status":"final","code":{"text":"x"},"category":[%s]}' % (coding % "exam"))
    assert said(df, vital) == [(1, "MUST_SUPPORT_ABSENT", "Observation.category:VSCat"), (1, "CARDINALITY_MIN", "Observation.category:VSCat")]
    df = read(spark, '{"resourceType":"Patient","identifier":[{"system":"s","value":"v"},{"value":"w"}]}', '{"resourceType":"Patient"}')
    assert said(df, patient) == [(0, "CARDINALITY_MIN", "Patient.identifier[1].system"), (1, "MUST_SUPPORT_ABSENT", "Patient.identifier"), (1, "CARDINALITY_MIN", "Patient.identifier")]
    assert D.starter(D.STARTERS[0].url) is D.STARTERS[0] and D.starter("x") is None


def test_personal_elements(spark):
    docs = [
        '{"resourceType":"Patient","name":[{"family":"李","given":["J","Ann-Marie"],"suffix":["Quux"]}],"contact":[{"name":{"text":"Dr Émile"}}]}', '{"resourceType":"Group","name":"Plain String"}', '{"resourceType":"Patient","telecom":[{"value":"5551234567"},{"value":"(212) 867-1234"},{"value":"212 86 7123"},{"value":" a@b.org "}],"valueQuantity":{"value":"2128671234"}}',
        '{"resourceType":"Patient","address":[{"line":["7 Ölweg","Flat 7"],"text":"9 X"}],"birthDate":"1970-02-30","deceasedDateTime":"1971-02-03T10:00:00Z"}', '{"resourceType":"Basic","note":"x 123-45-6789 y b@c.org b@known.org","extension":[{"url":"u","valueString":"d@e.org"}],"_note":{"extension":[{"url":"v","valueString":"f@g.org"}]}}', "{",
    ]
    known = personal.allowed(spark, names=("ann",), addresses=("9 x",), domains=("known.org",))
    rows = personal.personal_elements(read(spark, *docs).withColumnRenamed("n", "doc"), known, "doc").collect()
    got = {(r.doc, r.kind, r.location): r.n for r in rows}
    assert got == {
        (0, "name", "Patient.name[0].family"): 1, (0, "name", "Patient.name[0].given[1]"): 1, (0, "name", "Patient.contact[0].name.text"): 1, (2, "phone", "Patient.telecom[1].value"): 1, (2, "ssn", "Patient.telecom[2].value"): 1, (2, "email", "Patient.telecom[3].value"): 1,
        (3, "address", "Patient.address[0].line[0]"): 1, (3, "birth-date", "Patient.birthDate"): 1, (3, "birth-date", "Patient.deceasedDateTime"): 1, (4, "text-ssn", "Basic.note"): 1, (4, "text-email", "Basic.note"): 1, (4, "text-email", "Basic.extension[0].valueString"): 1, (4, "text-email", "Basic.note.extension[0].valueString"): 1,
    }


def test_references_outside_bundles(spark):
    df = read(spark, '{"resourceType":"Basic","contained":[{"resourceType":"Group","id":"a"},{"resourceType":"Group","id":"b"}],"u":{"reference":"#b"},"v":{"reference":"#"},"w":{"reference":"#c"},"x":{"reference":"Group/1"},"y":{"reference":"http://h/Group/1"}}')
    got = {r.expression.split(".")[1]: (r.kind, r.status, r.contained) for r in B.resolve_alone(df, "n").collect()}
    assert got == {"u": ("fragment", "resolved", 1), "v": ("fragment", "resolved", None), "w": ("fragment", "unresolved", None), "x": ("relative", "unresolved", None), "y": ("absolute", "external", None)}


def test_members_looked_up_are_those_found(spark):
    """`kids` and `choice` in what `indexed` makes, of a document and of a resource cut out of one, against what a search of the nodes finds."""
    from pyspark.sql import functions as F

    from vitaframe.functions import nodes as N

    team = '{"resourceType":"Group","a":[{"b":1,"c":{"b":2}},{"b":[3,4],"b":5}],"_a":[],"valueRange":{"b":6},"_x":{"extension":[{"url":"u"}]}}'
    inside = '{"resourceType":"Bundle","entry":[{"resource":%s}]}' % team
    df = read(spark, team, inside)
    at = F.get(F.filter("nodes", lambda n: n["rtype"] == "Group"), F.lit(0))
    df = df.withColumn("nodes", F.slice("nodes", at["id"] + 1, at["last"] - at["id"] + 1))

    def asked():
        found = lambda name: N.each(N.top(name), lambda n: N.kids(n["id"], "b"))
        return F.struct(found("a").alias("a"), found("none").alias("none"), N.choice(0, "value").alias("value"), N.each(N.choice(0, "value"), lambda n: N.kids(n["id"], "b")).alias("under"), N.top("x").alias("x"), N.kids(F.lit(99), "b").alias("beyond"), N.each(N.top("a"), lambda n: N.kids(n["id"], "b", True)).alias("every"))

    rows = df.select(asked().alias("searched"), N.indexed(asked).alias("looked")).collect()
    assert [len(r.looked.a) for r in rows] == [3, 3] and all(r.searched == r.looked for r in rows)


def test_expressions_of_a_profile_share_members(spark):
    """Constraints at many foci: the plan gathers members twice for a row, for its rules and for its expressions, not once for each focus and constraint."""
    many = tuple((f"k{k}", "error", f"b.exists() or c = {k}", "a") for k in range(6))
    df = read(spark, '{"resourceType":"Basic","a":[{"b":1},{"c":2},{"c":7}]}')
    profile = P.Profile("u", "Basic", invariants=many)
    found = structure.explode_findings(df, P.profile_findings(profile), "n")
    searches = re.findall(r"\.parent = ", found._jdf.queryExecution().analyzed().toString())
    assert 2 <= len(searches) <= 4
    assert sorted((r.constraint, r.expression) for r in found.collect()) == sorted((f"k{k}", f"Basic.a[{i}]") for k in range(6) for i, c in ((1, 2), (2, 7)) if k != c)


def test_decimals_that_can_be_told_by_their_text(spark):
    from pyspark.sql import functions as F

    from vitaframe.functions import scalars as S

    pairs = [("1.0", "1.0", True), ("1.0", "1.00", False), ("0.0", "-0.0", True), ("10", "1e1", False), ("1e1", "1E+1", True), ("00.5", "0.5", True), ("17", "18", False)]
    rows = spark.createDataFrame(pairs, "a string, b string, want boolean").select(S.decimal_equals(F.col("a"), F.col("b")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in rows)


def test_bundles_are_cut_and_read_once(spark):
    """No filter by the size of what is exploded, as it would make the entries and what they say a second time; entries without references stay out."""
    docs = ['{"resourceType":"Bundle","entry":[{"fullUrl":"https://h.org/Patient/1","resource":{"resourceType":"Patient","id":"1","link":{"reference":"https://h.org/Patient/1/_history/2"}}},{"request":{"method":"GET"}},{"resource":{"resourceType":"List","subject":{"reference":"#"}}}]}', '{"resourceType":"Bundle"}', '{"resourceType":"Patient"}']
    found = B.resolve(read(spark, *docs), "n")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Filter" in line and "size(" in line]
    assert sorted((r.n, r.entry, r.kind, r.status, r.target) for r in found.collect()) == [(0, 0, "absolute", "resolved", 0), (0, 2, "fragment", "resolved", 2)]


def test_findings_are_worked_out_once(spark):
    df = read(spark, '{"resourceType":"Basic","a":1}', '{"resourceType":"Basic"}', '{"resourceType":"Other"}', '{"', None)
    found = structure.explode_findings(df, P.profile_findings(P.Profile("u", "Basic", rules=(P.Rule("a", min=1), P.Rule("b", min=1)))), "n")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Filter" in line and "size(" in line]
    assert sorted((r.n, r.ord, r.expression) for r in found.collect()) == [(0, 0, "Basic.b"), (1, 0, "Basic.a"), (1, 1, "Basic.b")]
