"""Registered queries of the clinical-resource engine, each with the DuckDB SQL that tells its rows from the tables alone."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import nodes as N
from .functions import scalars as S
from .operators import bundles as B
from .operators import expressions as E
from .operators import profiles as P
from .operators import personal, quantity, reports, safety, structure, terminology, validation
from .operators.definitions import load_definition, load_profile, to_profile
from .plans import fixtures as X
from .plans.fixtures import event_k, j, money, pick, table
from .sources import ndjson, resource_json, resource_xml

FLAGSHIP = "vital_unit_findings"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)"
CODE = "CASE event_type WHEN 'click' THEN '8867-4' WHEN 'view' THEN '29463-7' WHEN 'error' THEN '8310-5' WHEN 'purchase' THEN '8480-6' ELSE '1234-5' END"
UNIT = "CASE event_type WHEN 'click' THEN '/min' WHEN 'error' THEN 'Cel' WHEN 'purchase' THEN 'mm[Hg]' ELSE 'kg' END"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query(f"""
WITH e AS (SELECT {CODE} AS loinc, {K} % 4 AS m FROM events),
f AS (SELECT loinc, 'UCUM_UNIT_UNRECOGNIZED' AS code FROM e WHERE m = 2
  UNION ALL SELECT loinc, 'VITAL_SIGN_UNIT_NONCONFORMANT' FROM e WHERE m IN (1, 2) AND loinc <> '1234-5'
  UNION ALL SELECT loinc, 'VALUE_TYPE_UNEXPECTED' FROM e WHERE m = 3 AND loinc <> '1234-5')
SELECT loinc, code, count(*) AS n FROM f GROUP BY loinc, code""")
def vital_unit_findings(spark: SparkSession, sf: str) -> DataFrame:
    o = X.observations(spark, sf).withColumn("loinc", X.by_type(0))
    return structure.explode_findings(o, quantity.quantity_findings(), "loinc").groupBy("loinc", "code").agg(F.count("*").alias("n"))


@query(f"""
SELECT event_id, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS value,
  CASE {K} % 4 WHEN 1 THEN 'lb' WHEN 2 THEN 'mm Hg[' ELSE {UNIT} END AS unit_code
FROM events WHERE {K} % 4 <> 3""")
def obs_value_quantity(spark: SparkSession, sf: str) -> DataFrame:
    v = X.observations(spark, sf).withColumn("v", quantity.observation_value(0)).where("v.type = 'Quantity'")
    return v.select("event_id", F.col("v.quantity.value").alias("value"), F.col("v.quantity.code").alias("unit_code"))


@query("""
SELECT p_partkey, unit, CASE WHEN p_size % 5 IN (1, 3) THEN 'invalid' ELSE 'ok' END AS shape FROM (
SELECT p_partkey, p_size, CASE p_size % 5 WHEN 0 THEN 'mm[Hg]' WHEN 1 THEN 'mm Hg' WHEN 2 THEN '{' || p_type || '}/min' WHEN 3 THEN '[' || p_brand ELSE '(kg.m)/s2' END AS unit FROM part)""")
def ucum_shape(spark: SparkSession, sf: str) -> DataFrame:
    unit = pick(F.col("p_size"), 5, {0: "mm[Hg]", 1: "mm Hg", 2: j("{", F.col("p_type"), "}/min"), 3: j("[", F.col("p_brand"))}, "(kg.m)/s2")
    return table(spark, sf, "part").select("p_partkey", unit.alias("unit")).withColumn("shape", S.ucum_shape(F.col("unit")))


@query("""
SELECT l_orderkey, l_linenumber, false AS same, true AS same_value,
  CAST(l_discount AS DECIMAL(18,2)) = CAST(l_tax AS DECIMAL(18,2)) AS tax_same, CAST(l_discount AS DECIMAL(18,2)) = CAST(l_tax AS DECIMAL(18,2)) AS tax_value FROM lineitem""")
def decimal_equality(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", money("l_discount").alias("d"), money("l_tax").alias("t"))
    more = F.concat("d", F.lit("0"))
    return d.select("l_orderkey", "l_linenumber", S.decimal_equals(F.col("d"), more).alias("same"), S.decimal_equals_value(F.col("d"), more).alias("same_value"), S.decimal_equals(F.col("d"), F.col("t")).alias("tax_same"), S.decimal_equals_value(F.col("t"), F.col("d")).alias("tax_value"))


@query("""
SELECT l_returnflag, count(*) FILTER (WHERE CAST(CAST(l_discount AS DECIMAL(18,2)) AS VARCHAR) LIKE '%0') AS n_risk, count(*) AS n FROM lineitem GROUP BY l_returnflag""")
def decimal_precision_risk(spark: SparkSession, sf: str) -> DataFrame:
    r = resource_json.read_resources(table(spark, sf, "lineitem").select("l_returnflag", j('{"resourceType":"Basic","v":', money("l_discount"), "}").alias("raw")))
    risk = F.exists("read_issues", lambda i: i["code"] == "DECIMAL_PRECISION_AT_RISK")
    return r.groupBy("l_returnflag").agg(F.count_if(risk).alias("n_risk"), F.count("*").alias("n"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 'absolute' WHEN 2 THEN 'fragment' WHEN 3 THEN 'logical' ELSE 'relative' END AS kind,
  CASE WHEN o_orderkey % 5 IN (0, 1, 4) THEN 'Patient' END AS type,
  CASE WHEN o_orderkey % 5 = 2 THEN 'p' || o_custkey WHEN o_orderkey % 5 <> 3 THEN CAST(o_custkey AS VARCHAR) END AS id,
  CASE o_orderkey % 5 WHEN 1 THEN '2' WHEN 4 THEN '3' END AS version FROM orders""")
def reference_kinds(spark: SparkSession, sf: str) -> DataFrame:
    key, c = F.col("o_orderkey"), F.col("o_custkey")
    raw = pick(key, 5, {0: j("Patient/", c), 1: j("https://x.org/fhir/Patient/", c, "/_history/2"), 2: j("#p", c), 3: j("urn:uuid:", key)}, j("Patient/", c, "/_history/3"))
    return table(spark, sf, "orders").select("o_orderkey", S.parse_reference(raw).alias("r")).select("o_orderkey", "r.*")


@query("""
SELECT kind, status, count(*) AS n FROM (
  SELECT 'relative' AS kind, CASE WHEN o_custkey % 3 = 0 THEN 'unresolved' ELSE 'resolved' END AS status FROM orders
  UNION ALL SELECT 'absolute', 'external' FROM orders) GROUP BY kind, status""")
def bundle_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return B.resolve(X.bundles(spark, sf), "o_custkey").groupBy("kind", "status").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey")
def bundle_unresolved(spark: SparkSession, sf: str) -> DataFrame:
    return B.unresolved(X.bundles(spark, sf), "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT o_custkey, CASE o_custkey % 3 WHEN 0 THEN 'atomic' WHEN 1 THEN 'independent' ELSE 'none' END AS processing FROM orders")
def bundle_processing(spark: SparkSession, sf: str) -> DataFrame:
    return X.bundles(spark, sf).select("o_custkey", B.processing().alias("processing"))


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 7 = 0 GROUP BY o_custkey")
def fullurl_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    return B.full_url_mismatches(X.bundles(spark, sf), "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query(f"""
SELECT event_id, concat_ws(',', CASE WHEN k % 7 = 0 THEN 'do-not-perform' END, CASE WHEN k % 5 = 1 THEN 'entered-in-error' END, CASE WHEN k % 11 = 0 THEN 'refuted' END, CASE WHEN k % 5 = 2 THEN 'not-taken' END, CASE WHEN k % 5 = 3 THEN 'not-done' END) AS negations
FROM (SELECT event_id, {K} AS k FROM events)""")
def negations(spark: SparkSession, sf: str) -> DataFrame:
    return X.statements(spark, sf).select("event_id", F.array_join(safety.negations(), ",").alias("negations"))


@query(f"SELECT event_id FROM events WHERE {K} % 5 = 1")
def retracted(spark: SparkSession, sf: str) -> DataFrame:
    return X.statements(spark, sf).where(safety.retracted_at(F.get("nodes", F.lit(0)))).select("event_id")


@query(f"""
SELECT event_id, m NOT BETWEEN 1 AND 8 AS safe, CASE m WHEN 1 THEN 'modifier_extensions:MedicationStatement.modifierExtension[0]' WHEN 2 THEN 'modifier_elements:MedicationStatement.dosage[0].doseQuantity.comparator' WHEN 3 THEN 'shadowed_properties:MedicationStatement.status'
  WHEN 4 THEN 'array_wrapped:MedicationStatement.status' WHEN 5 THEN 'nested_arrays:MedicationStatement.note[0]' WHEN 6 THEN 'unreadable_booleans:MedicationStatement.doNotPerform' WHEN 7 THEN 'near_miss_codes:MedicationStatement.status' WHEN 8 THEN 'unreadable_codes:MedicationStatement.status' ELSE '' END AS channels
FROM (SELECT event_id, {K} % 10 AS m FROM events)""")
def safety_channels(spark: SparkSession, sf: str) -> DataFrame:
    s = safety.with_safety(X.odd_shapes(spark, sf))
    said = F.array_join(F.flatten(F.array(*(F.transform(F.col(c), lambda x: F.concat(F.lit(f"{c}:"), x)) for c in safety.CHANNELS))), ",")
    return s.select("event_id", F.col("safe_to_summarize").alias("safe"), said.alias("channels"))


@query(f"""
WITH e AS (SELECT event_id, {K} % 10 AS m FROM events)
SELECT event_id, CASE m WHEN 1 THEN 'UNHANDLED_MODIFIER_EXTENSION' WHEN 3 THEN 'DUPLICATE_PROPERTY' WHEN 4 THEN 'ARRAY_WRAPPED_SCALAR' ELSE 'NESTED_ARRAY' END AS code, 'error' AS severity FROM e WHERE m IN (1, 3, 4, 5)""")
def safety_shape_findings(spark: SparkSession, sf: str) -> DataFrame:
    return structure.explode_findings(X.odd_shapes(spark, sf), safety.safety_findings(), "event_id").select("event_id", "code", "severity")


@query(f"""
WITH e AS (SELECT event_id, {K} AS k FROM events)
SELECT event_id, 'ait-1' AS rule FROM e WHERE k % 3 <> 0 AND k % 2 <> 0 UNION ALL SELECT event_id, 'ait-2' FROM e WHERE k % 3 = 0 AND k % 2 = 0""")
def allergy_invariants(spark: SparkSession, sf: str) -> DataFrame:
    return structure.explode_findings(X.allergies(spark, sf), safety.safety_findings(), "event_id").where("code = 'INVARIANT_VIOLATED'").select("event_id", F.col("constraint").alias("rule"))


@query(f"SELECT event_id FROM events WHERE {K} % 5 = 0")
def no_known_allergy(spark: SparkSession, sf: str) -> DataFrame:
    return X.allergies(spark, sf).where(F.array_contains(safety.negations(), "no-known-allergy")).select("event_id")


@query(f"""
WITH e AS (SELECT event_id, {K} AS k FROM events)
SELECT event_id, 'con-3' AS rule, 'warning' AS severity FROM e WHERE k % 3 = 0 AND k % 5 <> 0 AND k % 7 = 0
UNION ALL SELECT event_id, 'con-4', 'error' FROM e WHERE k % 2 = 0 AND k % 3 <> 2
UNION ALL SELECT event_id, 'con-5', 'error' FROM e WHERE k % 5 = 0 AND k % 3 <> 0""")
def condition_invariants(spark: SparkSession, sf: str) -> DataFrame:
    return structure.explode_findings(X.conditions(spark, sf), safety.safety_findings(), "event_id").where("code = 'INVARIANT_VIOLATED'").select("event_id", F.col("constraint").alias("rule"), "severity")


@query(f"""
WITH e AS (SELECT event_id, {K} AS k FROM events)
SELECT event_id, 'obs-6' AS rule FROM e WHERE k % 2 = 0 AND k % 3 = 0 UNION ALL SELECT event_id, 'obs-7' FROM e WHERE k % 2 = 0 AND k % 5 = 0""")
def observation_invariants(spark: SparkSession, sf: str) -> DataFrame:
    return structure.explode_findings(X.measurements(spark, sf), safety.safety_findings(), "event_id").where("code = 'INVARIANT_VIOLATED'").select("event_id", F.col("constraint").alias("rule"))


PATIENT_FINDINGS = """
SELECT c_custkey, CASE c_custkey % 8 WHEN 1 THEN 'CODE_INVALID' WHEN 2 THEN 'PRIMITIVE_INVALID' WHEN 3 THEN 'TYPE_MISMATCH' WHEN 4 THEN 'UNKNOWN_ELEMENT' WHEN 5 THEN 'CARDINALITY_MAX' WHEN 6 THEN 'CHOICE_AMBIGUOUS' ELSE 'TYPE_MISMATCH' END AS code,
  CASE c_custkey % 8 WHEN 4 THEN 'warning' ELSE 'error' END AS severity,
  'Patient.' || CASE c_custkey % 8 WHEN 1 THEN 'gender' WHEN 2 THEN 'birthDate' WHEN 3 THEN 'active' WHEN 4 THEN 'foo' WHEN 5 THEN 'gender' WHEN 6 THEN 'deceased[x]' ELSE 'birthDate' END AS expression
FROM customer WHERE c_custkey % 8 <> 0"""


@query(PATIENT_FINDINGS)
def patient_schema_findings(spark: SparkSession, sf: str) -> DataFrame:
    return structure.explode_findings(X.patients(spark, sf), structure.structure_findings(), "c_custkey").select("c_custkey", "code", "severity", "expression")


def _said(code: str) -> str:
    return f"""WHEN '{code}' THEN '{reports.DIAGNOSTICS[code]}'"""


@query(f"""
WITH f AS ({PATIENT_FINDINGS})
SELECT c.c_custkey, CASE WHEN f.code IS NULL THEN '{{"resourceType":"OperationOutcome","issue":[{{"severity":"information","code":"informational","diagnostics":"No issues detected."}}]}}' ELSE
  '{{"resourceType":"OperationOutcome","issue":[{{"severity":"' || severity || '","code":"' || CASE f.code WHEN 'CODE_INVALID' THEN 'code-invalid' WHEN 'PRIMITIVE_INVALID' THEN 'value' ELSE 'structure' END ||
  '","diagnostics":"' || CASE f.code {" ".join(_said(c) for c in ("CODE_INVALID", "PRIMITIVE_INVALID", "TYPE_MISMATCH", "UNKNOWN_ELEMENT", "CARDINALITY_MAX", "CHOICE_AMBIGUOUS"))} END || '","expression":["' || expression || '"]}}]}}' END AS outcome
FROM customer c LEFT JOIN f ON c.c_custkey = f.c_custkey""")
def operation_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return X.patients(spark, sf).select("c_custkey", reports.operation_outcome(structure.structure_findings()).alias("outcome"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN 'invalid' WHEN 3 THEN 'invalid' ELSE 'ok' END AS as_date, CASE o_orderkey % 4 WHEN 2 THEN 'invalid' ELSE 'ok' END AS as_datetime, 'type-mismatch' AS as_integer FROM orders""")
def primitive_domain(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    lex = pick(F.col("o_orderkey"), 4, {0: day, 1: F.date_format("o_orderdate", "yyyy-MM"), 2: F.date_format("o_orderdate", "MM/dd/yyyy")}, F.concat(day, F.lit("T00:00:00Z")))
    verdict = lambda t: S.primitive_verdict(t, F.lit("string"), F.col("lex"))
    return table(spark, sf, "orders").select("o_orderkey", lex.alias("lex")).select("o_orderkey", verdict("date").alias("as_date"), verdict("dateTime").alias("as_datetime"), verdict("integer").alias("as_integer"))


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 1 THEN 'CODE_SYSTEM_UNEXPECTED' ELSE 'CODE_SYSTEM_UNKNOWN' END AS code, CASE p_size % 4 WHEN 1 THEN 'warning' ELSE 'information' END AS severity,
  'MedicationRequest.medicationCodeableConcept.coding[0].system' AS expression FROM part WHERE p_size % 4 IN (1, 2)""")
def terminology_findings(spark: SparkSession, sf: str) -> DataFrame:
    return structure.explode_findings(X.prescriptions(spark, sf), terminology.system_findings(), "p_partkey").select("p_partkey", "code", "severity", "expression")


@query("SELECT p_partkey, 'CODE_NOT_IN_VALUESET' AS code, 'error' AS severity FROM part WHERE p_size % 4 = 0 AND p_partkey % 5 = 0")
def membership(spark: SparkSession, sf: str) -> DataFrame:
    members = table(spark, sf, "part").select(F.lit(terminology.MEDICATIONS).alias("value_set"), F.lit(terminology.RXNORM).alias("system"), F.col("p_partkey").cast("string").alias("code"), pick(F.col("p_partkey"), 5, {0: "not-in", 1: "unknown"}, "in").alias("membership"))
    return terminology.membership_findings(X.prescriptions(spark, sf), members, "p_partkey").select("p_partkey", "code", "severity")


@query("""
SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned, bool_or(l_returnflag = 'R') AS any_returned, min(l_quantity) > 5 AS all_large, count(DISTINCT l_returnflag) AS flags,
  NOT bool_or(l_returnflag = 'R') OR bool_or(l_returnflag = 'A') AS r_implies_a FROM lineitem GROUP BY l_orderkey""")
def path_expressions(spark: SparkSession, sf: str) -> DataFrame:
    returned = lambda x, f="R": x.code.text.value() == f

    def told(c: P.Path):
        return F.struct(
            c.count().cast("long").alias("n"), c.where(returned).count().cast("long").alias("n_returned"), c.exists(returned).alias("any_returned"), c.all(lambda x: x.valueQuantity.child("value").number() > 5).alias("all_large"),
            F.size(c.code.text.distinct()).cast("long").alias("flags"), P.implies(c.exists(returned), c.exists(lambda x: returned(x, "A"))).alias("r_implies_a"),
        )

    # the components are found once, and the struct's fields read from it
    found = N.indexed(lambda: N.let(P.path().component.items, lambda c: told(P.Path(c))))
    return X.shipments(spark, sf).select("l_orderkey", found.alias("v")).select("l_orderkey", *(f"v.{c}" for c in ("n", "n_returned", "any_returned", "all_large", "flags", "r_implies_a")))


SHIPMENT = P.Profile(
    "http://x.org/p", "Observation", version="1.0",
    rules=(
        P.Rule("status", min=1, max=1, fixed="final"), P.Rule("device", must_support=True), P.Rule("component", min=2),
        P.Rule("component.code", min=1, slices=()), P.Rule("component.valueQuantity", pattern={"unit": "O"}),
    ),
    invariants=(("has-lines", "error", lambda r: r.component.exists()), ("unknowable", "error", None)),
)
SLICED = P.Profile("http://x.org/s", "Observation", rules=(P.Rule("component", closed=True, slices=(P.Slice("a", lambda c: c.code.text.value() == "A", max=1), P.Slice("r", lambda c: c.code.text.value() == "R", min=1))),))


@query("""
WITH g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_linestatus <> 'O') AS bad FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, 'PROFILE_FIXED_MISMATCH' AS code, CAST(1 AS BIGINT) AS n FROM g WHERE l_orderkey % 4 = 1
UNION ALL SELECT l_orderkey, 'MUST_SUPPORT_ABSENT', 1 FROM g UNION ALL SELECT l_orderkey, 'INVARIANT_UNCHECKED', 1 FROM g
UNION ALL SELECT l_orderkey, 'CARDINALITY_MIN', 1 FROM g WHERE n < 2
UNION ALL SELECT l_orderkey, 'PROFILE_PATTERN_MISMATCH', bad FROM g WHERE bad > 0""")
def profile_findings(spark: SparkSession, sf: str) -> DataFrame:
    return structure.explode_findings(X.shipments(spark, sf), P.profile_findings(SHIPMENT), "l_orderkey").groupBy("l_orderkey", "code").agg(F.count("*").alias("n"))


@query("""
WITH g AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'R') AS r, count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'R')) AS o FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, 'CARDINALITY_MAX' AS code, CAST(1 AS BIGINT) AS n FROM g WHERE a > 1 UNION ALL SELECT l_orderkey, 'CARDINALITY_MIN', 1 FROM g WHERE r < 1
UNION ALL SELECT l_orderkey, 'PROFILE_SLICE_UNMATCHED', o FROM g WHERE o > 0""")
def profile_slices(spark: SparkSession, sf: str) -> DataFrame:
    return structure.explode_findings(X.shipments(spark, sf), P.profile_findings(SLICED), "l_orderkey").groupBy("l_orderkey", "code").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT l_orderkey, 'PROFILE_VERSION_MISMATCH' AS code, 'Observation.meta.profile[0]' AS expression FROM lineitem WHERE l_orderkey % 5 = 2")
def profile_versions(spark: SparkSession, sf: str) -> DataFrame:
    return structure.explode_findings(X.shipments(spark, sf), P.version_findings(SHIPMENT), "l_orderkey").select("l_orderkey", "code", "expression")


@query("""
SELECT doc_id, CASE WHEN text IS NULL AND doc_id % 4 <> 3 THEN 'none' ELSE CASE doc_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'MALFORMED_JSON' ELSE 'NOT_A_RESOURCE' END END AS outcome FROM documents""")
def ndjson_errors(spark: SparkSession, sf: str) -> DataFrame:
    body = j('{"resourceType":"Basic","text":', F.to_json(F.array("text")), "}")
    raw = pick(F.col("doc_id"), 4, {0: body, 1: F.concat(body, F.lit("x")), 2: F.to_json(F.array("text"))}, '{"a":["x"],"_a":[{"id":"1"},null]}')
    d = table(spark, sf, "documents").select("doc_id", raw.alias("raw"), raw.isNull().alias("none"))
    return resource_json.ndjson_records(d).select("doc_id", F.when(F.col("none"), "none").otherwise(F.coalesce("error", F.lit("ok"))).alias("outcome"))


@query("""
SELECT o_orderkey % 4 AS file, row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) AS line, CASE WHEN o_orderkey % 31 = 0 THEN 'LINE_TOO_LONG' WHEN o_orderkey % 5 = 1 THEN 'MALFORMED_JSON' WHEN o_orderkey % 5 = 3 THEN 'NOT_A_RESOURCE' ELSE CAST(o_orderkey AS VARCHAR) END AS outcome
FROM orders QUALIFY o_orderkey % 5 > 0 OR o_orderkey % 31 = 0""")
def ndjson_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of files that the orders were written to, read back in ranges of 64 kB."""
    r = ndjson.read_ndjson(spark, X.export(spark, sf, 2000), max_bytes=2000, range_bytes=1 << 16)
    return r.select(F.regexp_extract("source", "f=([0-9]+)", 1).cast("long").alias("file"), "line", F.coalesce("error", N.text(0, "id")).alias("outcome"))


@query("SELECT page_id, CASE WHEN html LIKE '<!DOCTYPE%' THEN 'DTD_FORBIDDEN' WHEN html IS NOT NULL THEN 'MALFORMED_XML' END AS fatal FROM pages")
def xml_refusals(spark: SparkSession, sf: str) -> DataFrame:
    return resource_xml.read_xml(table(spark, sf, "pages").select("page_id", "html"), "html").select("page_id", "fatal")


@query("""
SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN '<Patient xmlns="http://hl7.org/fhir"><id value="' || c_custkey || '"/><name><family value="' || c_name || '"/></name></Patient>' END AS xml,
  CASE c_custkey % 9 WHEN 1 THEN 'UNSERIALIZABLE_ELEMENT_NAME Patient.<withheld>' WHEN 2 THEN 'UNSERIALIZABLE_DIV_MARKUP Patient.text.div' WHEN 3 THEN 'UNSERIALIZABLE_JSON_ONLY_SHAPE Patient.note[0],Patient.gone'
    WHEN 4 THEN 'UNSERIALIZABLE_ARRAY_WRAPPER Patient.verificationStatus.coding[0].system' WHEN 5 THEN 'UNSERIALIZABLE_SHADOWED_PROPERTY Patient.gender' WHEN 6 THEN 'UNSERIALIZABLE_RESOURCE_TYPE Patient.contained[0].resourceType'
    WHEN 7 THEN 'UNSERIALIZABLE_ELEMENT_NAME Patient.<withheld>,Patient.<withheld>.<withheld>' WHEN 8 THEN 'UNSERIALIZABLE_ELEMENT_NAME Patient.contained[0]' END AS xml_refusal,
  CASE WHEN c_custkey % 9 IN (5, 7) THEN 'UNSERIALIZABLE_SHADOWED_PROPERTY Patient.gender' END AS json_refusal
FROM customer""")
def write_refusals(spark: SparkSession, sf: str) -> DataFrame:
    """The XML of resources, or why and where they can't be written; and the same of JSON."""
    said = lambda: F.concat("refusal", F.lit(" "), F.array_join("refusal_locations", ","))
    x = resource_xml.write_xml(X.unwritable(spark, sf)).select("c_custkey", "nodes", "xml", said().alias("xml_refusal"))
    return resource_json.write_json(x).select("c_custkey", "xml", "xml_refusal", said().alias("json_refusal"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN 'comparator Observation.valueQuantity.comparator,comparator Observation.component[0].valueQuantity.comparator' WHEN 1 THEN 'use Practitioner.identifier[1].use' WHEN 2 THEN 'active Practitioner.active'
  WHEN 3 THEN 'implicitRules <withheld>.implicitRules' WHEN 4 THEN 'implicitRules $this.implicitRules' WHEN 6 THEN 'active Bundle.entry[0].resource.active' WHEN 7 THEN 'active Patient.active' WHEN 9 THEN 'use Practitioner.identifier.use' ELSE '' END AS reports
FROM orders""")
def modifier_reports(spark: SparkSession, sf: str) -> DataFrame:
    told = F.array_join(F.transform(safety.modifier_reports(), lambda r: F.concat(r["element"], F.lit(" "), r["location"])), ",")
    return X.modified(spark, sf).select("o_orderkey", told.alias("reports"))


@query("""
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Condition.status' WHEN 2 THEN 'Condition.code[0].coding[0].system,Condition.code[1].coding[0].code' WHEN 3 THEN 'Condition.contained[0].resourceType' WHEN 4 THEN 'Condition.status' ELSE '' END AS lost,
  CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 4 WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 0 END AS wrapped
FROM part""")
def xml_wrappers(spark: SparkSession, sf: str) -> DataFrame:
    """Arrays around single values, and those among them that XML can't say."""
    return X.wrapped(spark, sf).select("p_partkey", F.array_join(safety.unspellable_xml_wrappers(), ",").alias("lost"), F.size(safety.array_wrapped()).alias("wrapped"))


@query("SELECT c_custkey, c_custkey % 8 IN (0, 6) AS equivalent FROM customer")
def xml_json_equivalence(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that are alike, also where one item is a list of one, and pairs that differ in order, repeats, kind, value, metadata or nesting."""
    p = X.pairs(spark, sf)
    x = resource_json.read_resources(p.select("c_custkey", "b", F.col("a").alias("raw"))).select("c_custkey", "b", F.col("nodes").alias("x"))
    both = resource_xml.read_xml(x.withColumnRenamed("b", "raw"))
    return both.select("c_custkey", resource_xml.equivalent(F.col("x"), F.col("nodes")).alias("equivalent"))


#: Offsets of broken documents, by c_custkey % 8: what stands around the key in each.
@query("""
SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 6 THEN 'MAX_DEPTH_EXCEEDED' WHEN 7 THEN 'PRIMITIVE_EXTENSION_MISALIGNED' ELSE 'MALFORMED_JSON' END AS fatal,
  CASE c_custkey % 8 WHEN 1 THEN 6 + n WHEN 2 THEN 6 + n WHEN 3 THEN 8 + n WHEN 4 THEN 7 + n WHEN 5 THEN 7 + n WHEN 6 THEN 257 END AS at, CASE c_custkey % 8 WHEN 7 THEN '$this.a' END AS element
FROM (SELECT c_custkey, CAST(length(CAST(c_custkey AS VARCHAR)) AS BIGINT) AS n FROM customer)""")
def fatal_places(spark: SparkSession, sf: str) -> DataFrame:
    """Where documents can't be read: in UTF-16 units from the start, so that a character above U+FFFF counts two."""
    key = F.col("c_custkey")
    raw = pick(key, 8, {1: j('{"a":"', key), 2: j('{"a":"', key, "\n"), 3: j('{"a":"', key, '\\q"}'), 4: j('{"\U0001F600":', key, ",,}"), 5: j('{"a": ', key, ".}"), 6: "[" * 258 + "]" * 258, 7: '{"a":["x"],"_a":{}}'}, j('{"a":', key, "}"))
    r = resource_json.read_resources(table(spark, sf, "customer").select("c_custkey", raw.alias("raw")))
    return r.select("c_custkey", "fatal", F.col("fatal_offset").alias("at"), F.col("fatal_expression").alias("element"))


@query("""
SELECT c_custkey, true AS same, CAST(12 + CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 0 END AS INT) AS n_nodes, c_name AS family FROM customer""")
def built_resources(spark: SparkSession, sf: str) -> DataFrame:
    """Patients made in code from rows, against the same ones read from JSON."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", money("c_acctbal").alias("balance"))
    key, even = F.col("c_custkey"), F.col("c_custkey") % 2 == 0
    raw = j('{"resourceType":"Patient","id":"', key, '","active":true,"name":[{"family":"', F.col("c_name"), '","given":["A","B"]}],"value":', F.col("balance"), ',"birthDate":"2000"', F.when(even, ',"_birthDate":{"id":"d","extension":[{"url":"u","valueString":"v"}]}').otherwise(""), ',"contained":[{"resourceType":"Basic"}]}')

    def make(r: dict) -> dict:
        born = resource_json.Primitive("2000", "d", [{"url": "u", "valueString": "v"}]) if r["c_custkey"] % 2 == 0 else "2000"
        return {"resourceType": "Patient", "id": str(r["c_custkey"]), "active": True, "name": [{"family": r["c_name"], "given": ["A", "B"]}], "value": Decimal(r["balance"]), "birthDate": born, "contained": [{"resourceType": "Basic"}]}

    made = resource_json.build_resources(c, make).select("c_custkey", raw.alias("raw"), F.col("nodes").alias("made"), F.col("read_issues").alias("said"))
    both = resource_json.read_resources(made)
    family = F.get(F.filter("made", lambda n: n["name"] == "family"), F.lit(0))["lex"]
    return both.select("c_custkey", (F.col("made").eqNullSafe(F.col("nodes")) & F.col("said").eqNullSafe(F.col("read_issues"))).alias("same"), F.size("made").alias("n_nodes"), family.alias("family"))


@query("""
WITH c AS (SELECT c_custkey AS k, '25989' || c_custkey || '2988' AS d FROM customer),
h AS (SELECT k, 'name' AS kind, 'Patient.name[0].family' AS location, 3 AS n FROM c WHERE k % 3 = 1 UNION ALL SELECT k, 'name', 'Patient.name[0].family', 1 FROM c WHERE k % 3 = 2
UNION ALL SELECT k, CASE WHEN length(d) = 9 THEN 'ssn' ELSE 'phone' END, 'Patient.telecom[0].value', 1 FROM c WHERE k % 4 = 0 AND (length(d) = 9 OR length(d) >= 10 AND d NOT LIKE '%555%')
UNION ALL SELECT k, 'email', 'Patient.telecom[0].value', 1 FROM c WHERE k % 4 = 1
UNION ALL SELECT k, 'address', 'Patient.address[0].line[0]', 1 FROM c WHERE k % 5 = 0
UNION ALL SELECT k, 'birth-date', 'Patient.birthDate', 1 FROM c WHERE k % 4 IN (0, 3)
UNION ALL SELECT k, 'ssn', 'Patient.identifier[0].value', 1 FROM c WHERE k % 3 = 0
UNION ALL SELECT k, 'text-ssn', 'Patient.text.div', 1 FROM c WHERE k % 7 = 0 UNION ALL SELECT k, 'text-email', 'Patient.text.div', 1 FROM c WHERE k % 7 = 0)
SELECT k AS c_custkey, kind, location, CAST(n AS BIGINT) AS n FROM h""")
def personal_elements(spark: SparkSession, sf: str) -> DataFrame:
    known = personal.allowed(spark, names=("Testcase",), dates=("1999-01-01",), addresses=("1 Test Street",), ids=("000000000",), domains=("example.com",))
    return personal.personal_elements(X.people(spark, sf), known, "c_custkey")


@query("""
SELECT l_orderkey, l_linenumber, l_linenumber % 4 = 2 AS same, l_linenumber % 4 IN (0, 1, 2) AS same_value, CASE l_linenumber % 4 WHEN 2 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '0000000000' WHEN 3 THEN '0' END AS whole
FROM lineitem""")
def decimal_exponents(spark: SparkSession, sf: str) -> DataFrame:
    """Decimals whose exponents no number type holds."""
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("bigint")
    a = pick(n, 4, {0: j(q, "e99999999999"), 1: j(q, ".0e-99999999999"), 2: j(q, "e+10"), 3: "-0.0e2000000000"}, "")
    b = pick(n, 4, {0: j(q, "0e99999999998"), 1: j(q, "e-99999999999"), 2: j(q, "e10"), 3: j(q, "e77777777777777777777777777777777777777777777")}, "")
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"))
    whole = S.decimal_integer(F.col("a")).cast("string")
    return d.select("l_orderkey", "l_linenumber", S.decimal_equals(F.col("a"), F.col("b")).alias("same"), S.decimal_equals_value(F.col("a"), F.col("b")).alias("same_value"), whole.alias("whole"))


def _holds(expression: str):
    return E.invariant(expression)["satisfied"]


@query("""
SELECT n_nationkey, n_nationkey % 4 IN (1, 3) AS less, n_nationkey % 3 <> 1 AS fits, false AS far FROM nation""")
def utf16_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Order and length by UTF-16 units, and an index beyond any list."""
    k = F.col("n_nationkey")
    a = pick(k, 4, {0: "\uff5e", 1: "\U0001F600", 2: "b"}, "a")
    b = pick(k, 4, {0: "\U0001F600", 1: "\uff5e", 2: "a"}, "b")
    long = pick(k, 3, {0: F.repeat(F.lit("\U0001F600"), 524_288), 1: F.repeat(F.lit("\U0001F600"), 524_289)}, F.repeat(F.lit("x"), 1_048_576))
    r = resource_json.read_resources(table(spark, sf, "nation").select("n_nationkey", long.alias("long"), j('{"resourceType":"Basic","a":"', a, '","b":"', b, '"}').alias("raw")))
    return r.select("n_nationkey", _holds("a < b").alias("less"), (S.primitive_verdict("string", F.lit("string"), F.col("long")) == "ok").alias("fits"), _holds("a[10000000000].exists()").alias("far"))


@query("SELECT c_custkey, true AS same FROM customer")
def json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "customer").select("c_custkey", X.patient_json().alias("source"), X.patient_json().alias("raw"))
    return resource_json.write_json(resource_json.read_resources(p)).select("c_custkey", (F.col("json") == F.col("source")).alias("same"))


@query(r"""
SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')), 0) AS BIGINT) AS n_email, CAST(coalesce(len(regexp_extract_all(text, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b')), 0) AS BIGINT) AS n_ssn,
  CAST(coalesce(len(regexp_extract_all(text, '\b[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}\b')), 0) AS BIGINT) AS n_phone, CAST(coalesce(len(regexp_extract_all(text, '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b')), 0) AS BIGINT) AS n_ip FROM documents""")
def personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return reports.personal_data(table(spark, sf, "documents"), "doc_id")


@query("SELECT n_nationkey, n_nationkey % 3 = 0 AS cyclic FROM nation")
def contained_cycle(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("n_nationkey")
    back = F.when(key % 3 == 0, ',"partOf":{"reference":"#a"}').otherwise("")
    raw = j('{"resourceType":"Organization","partOf":{"reference":"#a"},"contained":[{"resourceType":"Organization","id":"a","partOf":{"reference":"#b"}},{"resourceType":"Organization","id":"b"', back, "}]}")
    r = resource_json.read_resources(table(spark, sf, "nation").select("n_nationkey", raw.alias("raw")))
    return r.select("n_nationkey", B.contained_cycle().alias("cyclic"))


@query("""
SELECT o_custkey, count(*) + CASE WHEN o_custkey % 3 <> 0 THEN 1 ELSE 0 END AS n_entries FROM orders GROUP BY o_custkey""")
def bundle_entries(spark: SparkSession, sf: str) -> DataFrame:
    return B.entries(X.bundles(spark, sf), "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n_entries"))


@query(f"SELECT event_id, CASE WHEN {K} % 4 = 1 THEN 'base' ELSE 'head' END AS side FROM events WHERE {K} % 4 IN (1, 2)")
def reading_differences(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "events").select("event_id", event_k().alias("k"))
    return reports.differences(o.where("k % 4 <> 2").select("event_id"), o.where("k % 4 <> 1").select("event_id"))


#: Expressions over an order's Observation, each with the SQL that tells it from the order's lines g.
PATHS = (
    ("component.count() >= 3", "n >= 3"), ("component.where(code.text = 'R').exists()", "r > 0"), ("component.exists(code.text = 'A')", "a > 0"), ("component.all(valueQuantity.value > 5)", "low > 5"), ("component.code.text.distinct().count() = 2", "flags = 2"),
    ("status = 'final'", "l_orderkey % 4 <> 1"), ("status != 'final' or component.count() > 1", "l_orderkey % 4 = 1 OR n > 1"), ("component.where(code.text = 'R').empty() implies component.where(code.text = 'A').exists()", "r > 0 OR a > 0"),
    ("component.first().code.text = 'N'", "first = 'N'"), ("component.last().code.text = 'R'", "last = 'R'"), ("component[1].exists()", "n > 1"), ("'A' in component.code.text", "a > 0"), ("component.code.text contains 'N'", "o > 0"),
    ("(component.code.text | component.valueQuantity.unit).count() = 4", "flags + units = 4"), ("component.select(valueQuantity.value).count() = component.count()", "true"), ("component.where(valueQuantity.unit = 'O').count() = 0", "open = 0"), ("meta.profile.exists()", "l_orderkey % 5 IN (1, 2)"),
    ("component.exists(code.text = 'R') xor component.exists(code.text = 'A')", "(r > 0) <> (a > 0)"), ("component.valueQuantity.value.where($this > 40).exists()", "high > 40"), ("component.code.text.ofType(String).count() = component.count()", "true"), ("component.valueQuantity.value.first() is Decimal", "true"),
    ("component.where(valueQuantity.value = 17).exists()", "seventeen > 0"), ("component.code.text.intersect('A' | 'N').count() = 2", "a > 0 AND o > 0"), ("status.hasValue() and component.hasValue().not()", "true"), ("%resource.component.where(code.text = %context.component.first().code.text).count() = component.count()", "flags = 1"),
    ("component.exists(code.text = 'R').not()", "r = 0"), ("children().count() > 2", "n + 1 + CAST(l_orderkey % 5 IN (1, 2) AS INTEGER) > 2"), ("-component.count() < -4", "n > 4"), ("component.code.text.first() <= 'N'", "first <= 'N'"), ("missing.exists() and status.exists()", "false"),
)
LINES = """SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'N') AS o, count(*) FILTER (WHERE l_linestatus = 'O') AS open, count(*) FILTER (WHERE l_quantity = 17) AS seventeen,
  min(l_quantity) AS low, max(l_quantity) AS high, count(DISTINCT l_returnflag) AS flags, count(DISTINCT l_linestatus) AS units, substr(min(lpad(CAST(l_linenumber AS VARCHAR), 9, '0') || l_returnflag), 10) AS first, substr(max(lpad(CAST(l_linenumber AS VARCHAR), 9, '0') || l_returnflag), 10) AS last FROM lineitem GROUP BY l_orderkey"""


def _paths(spark: SparkSession, sf: str, first: int, end: int) -> DataFrame:
    texts = {f"e{k}": text for k, (text, _) in enumerate(PATHS) if first <= k < end}
    return X.shipments(spark, sf).select("l_orderkey", E.invariants(texts).alias("v")).select("l_orderkey", *(F.col(f"v.{e}.satisfied").alias(e) for e in texts))


def _paths_sql(first: int, end: int) -> str:
    return f"WITH g AS ({LINES}) SELECT l_orderkey, {', '.join(f'({sql}) AS e{k}' for k, (_, sql) in enumerate(PATHS) if first <= k < end)} FROM g"


@query(_paths_sql(0, 20))
def path_text(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf, 0, 20)


@query(_paths_sql(20, 30))
def path_text_more(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf, 20, 30)


#: Expressions outside the language, or only for some orders, with the SQL of what is said of them.
UNCHECKED = (
    ("component.descendants().exists()", "'unchecked'"), ("(1 + 1) = 2", "'unchecked'"), ("component.where(matches('x')).exists()", "'unchecked'"), ("missing.where(matches('x')).empty()", "'true'"), ("component > 'x'", "'unchecked'"), ("component.code.text and true", "'unchecked'"),
    ("status is Quantity", "'false'"), ("component.first() is Quantity", "'unchecked'"), ("%ucum.exists()", "'unchecked'"), ("component[$index].exists()", "'unchecked'"), ("status.exists(", "'unchecked'"), ("component.where(code.text = 'R').all(descendants().exists())", "CASE WHEN r > 0 THEN 'unchecked' ELSE 'true' END"),
    ("component.code.text = 'N' and component.code.text in ('A' | 'R')", "CASE WHEN n > 1 THEN 'unchecked' ELSE 'false' END"),
)


@query(f"WITH g AS ({LINES}) SELECT l_orderkey, {', '.join(f'{sql} AS u{k}' for k, (_, sql) in enumerate(UNCHECKED))} FROM g")
def path_unchecked(spark: SparkSession, sf: str) -> DataFrame:
    o = X.shipments(spark, sf).select("l_orderkey", E.invariants({f"u{k}": text for k, (text, _) in enumerate(UNCHECKED)}).alias("v"))
    return o.select("l_orderkey", *(F.when(F.col(f"v.u{k}.unchecked"), "unchecked").otherwise(F.col(f"v.u{k}.satisfied").cast("string")).alias(f"u{k}") for k in range(len(UNCHECKED))))


#: A profile as the definition that users have: constraints as text, a fixed and a pattern value with members.
DEFINITION = """{"resourceType":"StructureDefinition","url":"http://x.org/d","type":"Observation","version":"1","differential":{"element":[
{"id":"Observation","path":"Observation","constraint":[{"key":"two-lines","severity":"warning","expression":"component.count() >= 2"},{"key":"odd","severity":"error","expression":"component.trace('x').exists()"},{"key":"obs-6","severity":"error","expression":"false"}]},
{"id":"Observation.component","path":"Observation.component","constraint":[{"key":"returned-small","severity":"error","expression":"code.text = 'R' implies valueQuantity.value <= 40"}]},
{"id":"Observation.component.code","path":"Observation.component.code","patternCodeableConcept":{"text":"N"}},
{"id":"Observation.component.valueQuantity","path":"Observation.component.valueQuantity","fixedQuantity":{"value":17.00,"unit":"O"}}]}}"""


@query("""
WITH g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 40) AS big, count(*) FILTER (WHERE l_returnflag <> 'N') AS other, count(*) FILTER (WHERE l_quantity <> 17 OR l_linestatus <> 'O') AS unlike FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, 'INVARIANT_VIOLATED' AS code, 'two-lines' AS rule, 'warning' AS severity, CAST(1 AS BIGINT) AS n FROM g WHERE n < 2
UNION ALL SELECT l_orderkey, 'INVARIANT_UNCHECKED', 'odd', 'information', 1 FROM g
UNION ALL SELECT l_orderkey, 'INVARIANT_VIOLATED', 'returned-small', 'error', big FROM g WHERE big > 0
UNION ALL SELECT l_orderkey, 'PROFILE_PATTERN_MISMATCH', NULL, 'error', other FROM g WHERE other > 0
UNION ALL SELECT l_orderkey, 'PROFILE_FIXED_MISMATCH', NULL, 'error', unlike FROM g WHERE unlike > 0""")
def definition_findings(spark: SparkSession, sf: str) -> DataFrame:
    f = structure.explode_findings(X.shipments(spark, sf), P.profile_findings(load_profile(DEFINITION)), "l_orderkey")
    return f.groupBy("l_orderkey", "code", F.col("constraint").alias("rule"), "severity").agg(F.count("*").alias("n"))


#: Three definitions, each the next one's base: bounds, then slices, then more about the slices.
CHAIN = (
    """{"resourceType":"StructureDefinition","url":"http://x.org/1","type":"Observation","snapshot":{"element":[{"path":"Observation"},
{"path":"Observation.component","min":1,"max":"*","constraint":[{"key":"small","severity":"warning","expression":"valueQuantity.value <= 45"}]},{"path":"Observation.component.code"},{"path":"Observation.note"}]}}""",
    """{"resourceType":"StructureDefinition","url":"http://x.org/2","type":"Observation","baseDefinition":"http://x.org/1","differential":{"element":[
{"path":"Observation.component","max":"9","slicing":{"discriminator":[{"type":"value","path":"code.text"}],"rules":"open"}},
{"id":"Observation.component:A","path":"Observation.component","sliceName":"A","min":1,"mustSupport":true},{"id":"Observation.component:A.code.text","path":"Observation.component.code.text","fixedString":"A"},
{"id":"Observation.component:R","path":"Observation.component","max":"1"},{"id":"Observation.component:R.code.text","path":"Observation.component.code.text","fixedString":"R"},
{"id":"Observation.component:N","path":"Observation.component"},{"id":"Observation.component:N.code.text","path":"Observation.component.code.text","fixedString":"N"}]}}""",
    """{"resourceType":"StructureDefinition","url":"http://x.org/3","type":"Observation","version":"1","baseDefinition":"http://x.org/2","differential":{"element":[
{"id":"Observation.component:R","path":"Observation.component","max":"2","constraint":[{"key":"open","severity":"error","expression":"valueQuantity.unit = 'O'"}]},
{"id":"Observation.component:N.valueQuantity.unit","path":"Observation.component.valueQuantity.unit","min":1,"patternString":"O"},
{"path":"Observation.component","min":0}]}}""",
)


@query("""
WITH g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'R') AS r, count(*) FILTER (WHERE l_quantity > 45) AS big,
  count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus <> 'O') AS shut, count(*) FILTER (WHERE l_returnflag = 'N' AND l_linestatus <> 'O') AS other FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, 'MUST_SUPPORT_ABSENT' AS code, CAST(NULL AS VARCHAR) AS rule, CAST(1 AS BIGINT) AS n FROM g WHERE a = 0 UNION ALL SELECT l_orderkey, 'CARDINALITY_MIN', NULL, 1 FROM g WHERE a = 0
UNION ALL SELECT l_orderkey, 'CARDINALITY_MAX', NULL, CAST(r > 2 AS BIGINT) + CAST(n > 9 AS BIGINT) FROM g WHERE r > 2 OR n > 9 UNION ALL SELECT l_orderkey, 'INVARIANT_VIOLATED', 'small', big FROM g WHERE big > 0
UNION ALL SELECT l_orderkey, 'INVARIANT_VIOLATED', 'open', shut FROM g WHERE shut > 0 UNION ALL SELECT l_orderkey, 'PROFILE_PATTERN_MISMATCH', NULL, other FROM g WHERE other > 0""")
def definition_chain(spark: SparkSession, sf: str) -> DataFrame:
    known = {d.url: d for d in map(load_definition, CHAIN)}
    f = structure.explode_findings(X.shipments(spark, sf), P.profile_findings(to_profile(known["http://x.org/3"], known.get)), "l_orderkey")
    return f.groupBy("l_orderkey", "code", F.col("constraint").alias("rule")).agg(F.count("*").alias("n"))


@query(f"""
WITH f AS ({PATIENT_FINDINGS})
SELECT c.c_custkey, coalesce(f.severity, '') <> 'error' AS valid, coalesce(f.code || '/' || f.severity || ' at ' || f.expression, '') AS findings FROM customer c LEFT JOIN f ON c.c_custkey = f.c_custkey""")
def validate_patients(spark: SparkSession, sf: str) -> DataFrame:
    v = validation.validate(X.patients(spark, sf), "c_custkey", bundles=False)
    said = F.array_join(F.transform("findings", lambda f: F.concat(f["code"], F.lit("/"), f["severity"], F.lit(" at "), f["expression"])), ", ")
    return v.select("c_custkey", "valid", said.alias("findings"))


@query("""
WITH g AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS wrong FROM orders GROUP BY o_custkey)
SELECT o_custkey, wrong = 0 AS valid, 'RESOURCE_NOT_MODELED' AS code, CAST(1 AS BIGINT) AS n FROM g
UNION ALL SELECT o_custkey, false, 'FULLURL_ID_MISMATCH', wrong FROM g WHERE wrong > 0
UNION ALL SELECT o_custkey, wrong = 0, 'REFERENCE_UNRESOLVED', n FROM g WHERE o_custkey % 3 = 0""")
def validate_bundles(spark: SparkSession, sf: str) -> DataFrame:
    v = validation.validate(X.bundles(spark, sf), "o_custkey")
    return v.select("o_custkey", "valid", F.explode("findings.code").alias("code")).groupBy("o_custkey", "valid", "code").agg(F.count("*").alias("n"))


@query("""
SELECT event_id, m NOT IN (0, 1) AS valid, CASE m WHEN 0 THEN 'RESOURCE_TYPE_UNKNOWN at $this, ARRAY_WRAPPED_SCALAR at $this.resourceType, ARRAY_WRAPPED_SCALAR at $this.status, RETRACTED_RESOURCE at Observation.status'
  WHEN 1 THEN 'RESOURCE_TYPE_UNKNOWN at $this, NESTED_ARRAY at $this.resourceType[0]' ELSE 'RESOURCE_NOT_MODELED at Observation' END AS findings
FROM (SELECT event_id, event_id % 3 AS m FROM events)""")
def validate_types(spark: SparkSession, sf: str) -> DataFrame:
    raw = pick(F.col("event_id"), 3, {0: '{"resourceType":["Observation"],"status":["entered-in-error"]}', 1: '{"resourceType":[["Observation"]]}'}, '{"resourceType":"Observation","status":"final"}')
    r = resource_json.read_resources(table(spark, sf, "events").select("event_id", raw.alias("raw")))
    said = F.array_join(F.transform("findings", lambda f: F.concat(f["code"], F.lit(" at "), f["expression"])), ", ")
    return validation.validate(r, "event_id", bundles=False).select("event_id", "valid", said.alias("findings"))


@query("""
SELECT o_custkey, kind, status, target, count(*) AS n FROM (
  SELECT o_custkey, 'relative' AS kind, CASE WHEN o_custkey % 3 = 0 THEN 'unresolved' ELSE 'resolved' END AS status, CASE WHEN o_custkey % 3 <> 0 THEN 0 END AS target FROM orders
  UNION ALL SELECT o_custkey, 'absolute', 'external', NULL FROM orders) GROUP BY o_custkey, kind, status, target""")
def bundle_targets(spark: SparkSession, sf: str) -> DataFrame:
    return B.resolve(X.bundles(spark, sf), "o_custkey").groupBy("o_custkey", "kind", "status", "target").agg(F.count("*").alias("n"))


def _searches(spark: SparkSession, sf: str) -> DataFrame:
    """A page of a search for every customer, and a deletion beside it."""
    key = F.col("c_custkey")
    raw = j('{"resourceType":"Bundle","type":"searchset","total":', key, '.0,"link":[{"relation":"self","url":"https://h.org/s"},{"relation":"next","url":"https://h.org/s?page=', key, '"}],"entry":[{"fullUrl":"https://h.org/Patient/', key, '","resource":{"resourceType":"Patient","id":"', key, '"},"search":{"mode":"match"}},{"request":{"method":"DELETE","url":"Patient/', key, '"}}]}')
    return resource_json.read_resources(table(spark, sf, "customer").select("c_custkey", raw.alias("raw")))


@query("SELECT c_custkey, 'searchset' AS type, 'none' AS processing, c_custkey || '.0' AS total, 'self https://h.org/s, next https://h.org/s?page=' || c_custkey AS links FROM customer")
def bundle_readout(spark: SparkSession, sf: str) -> DataFrame:
    links = F.array_join(F.transform("b.links", lambda x: F.concat_ws(" ", x["relation"], x["url"])), ", ")
    return _searches(spark, sf).select("c_custkey", B.readout().alias("b")).select("c_custkey", "b.type", "b.processing", "b.total", links.alias("links"))


@query("""
SELECT c_custkey, 0 AS entry, 'https://h.org/Patient/' || c_custkey AS full_url, 'Patient' AS type, CAST(c_custkey AS VARCHAR) AS id, 'match' AS search_mode, NULL AS request_method, NULL AS request_url FROM customer
UNION ALL SELECT c_custkey, 1, NULL, NULL, NULL, NULL, 'DELETE', 'Patient/' || c_custkey FROM customer""")
def bundle_entry_fields(spark: SparkSession, sf: str) -> DataFrame:
    return B.entries(_searches(spark, sf), "c_custkey").drop("first", "last")


@query("""
SELECT p_partkey, CAST(p_size AS VARCHAR) AS low, p_size || '.50' AS high, CASE WHEN p_size % 2 = 0 THEN 'H' ELSE '' END AS flags, CASE WHEN p_size % 3 = 0 THEN 'String' ELSE '' END AS ambiguous, 'Quantity' AS type FROM part""")
def reference_ranges(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    raw = j('{"resourceType":"Observation","valueQuantity":{"value":1}', F.when(size % 3 == 0, ',"valueString":"x"').otherwise(""), F.when(size % 2 == 0, ',"interpretation":[{"coding":[{"system":"s","code":"H"}]}]').otherwise(""), ',"referenceRange":[{"low":{"value":', size, '},"high":{"value":', size, ".50}}]}")
    o = resource_json.read_resources(table(spark, sf, "part").select("p_partkey", raw.alias("raw"))).select("p_partkey", F.get(quantity.reference_ranges(0), F.lit(0)).alias("r"), quantity.interpretations(0).alias("i"), quantity.observation_value(0).alias("v"))
    return o.select("p_partkey", F.col("r.low.value").alias("low"), F.col("r.high.value").alias("high"), F.array_join("i.code", ",").alias("flags"), F.array_join("v.ambiguous", ",").alias("ambiguous"), F.col("v.type").alias("type"))


@query("SELECT p_partkey, 'UCUM_UNIT_UNRECOGNIZED' AS code, 'warning' AS severity, 'MedicationRequest.dosageInstruction[0].doseAndRate[0].doseQuantity.code' AS expression FROM part WHERE p_size % 3 <> 0")
def dose_findings(spark: SparkSession, sf: str) -> DataFrame:
    unit = pick(F.col("p_size"), 3, {0: ',"code":"mg"', 1: ',"code":"m g"'}, "")
    raw = j('{"resourceType":"MedicationRequest","dosageInstruction":[{"doseAndRate":[{"doseQuantity":{"value":1,"system":"http://unitsofmeasure.org"', unit, "}}]}]}")
    r = resource_json.read_resources(table(spark, sf, "part").select("p_partkey", raw.alias("raw")))
    return structure.explode_findings(r, quantity.quantity_findings(), "p_partkey").select("p_partkey", "code", "severity", "expression")


@query(f"""
SELECT event_id, 'Condition' AS resource_type, CASE k % 3 WHEN 1 THEN 'active' WHEN 2 THEN 'resolved' END AS clinical_status, CASE WHEN k % 5 = 0 THEN 'entered-in-error' END AS verification_status, k % 5 = 0 AS retracted, false AS no_known_allergy, true AS safe
FROM (SELECT event_id, {K} AS k FROM events)""")
def safety_readout(spark: SparkSession, sf: str) -> DataFrame:
    s = safety.read_safety(X.conditions(spark, sf))
    return s.select("event_id", *(f"safety.{c}" for c in ("resource_type", "clinical_status", "verification_status", "retracted", "no_known_allergy")), F.col("safety.safe_to_summarize").alias("safe"))


#: Datatype, written type, text (with the nation's key as #), and the SQL of the verdict.
DOMAINS = (
    ("id", "string", "a-#.b", "'ok'"), ("id", "string", "a_#", "'invalid'"), ("oid", "string", "urn:oid:1.#", "'ok'"), ("oid", "string", "urn:oid:3.#", "'invalid'"), ("uuid", "string", "urn:uuid:00000000-0000-0000-0000-00000000000#", "CASE WHEN k < 10 THEN 'ok' ELSE 'invalid' END"), ("positiveInt", "decimal", "#", "CASE WHEN k > 0 THEN 'ok' ELSE 'invalid' END"),
    ("unsignedInt", "decimal", "#", "'ok'"), ("unsignedInt", "decimal", "-#", "'invalid'"), ("integer", "decimal", "-1#", "'ok'"), ("integer", "decimal", "1.#", "'invalid'"), ("integer64", "decimal", "1#", "'ok'"), ("decimal", "decimal", "-0.#e-#", "'ok'"), ("decimal", "string", "1.#", "'type-mismatch'"), ("boolean", "boolean", "true", "'ok'"), ("boolean", "string", "true", "'type-mismatch'"),
    ("code", "string", "a b#", "'ok'"), ("code", "string", " a#", "'invalid'"), ("uri", "string", "http://x/#", "'ok'"), ("url", "string", "http://x/ #", "'invalid'"), ("canonical", "string", "http://x|#", "'ok'"), ("base64Binary", "string", "QUJD", "'ok'"), ("base64Binary", "string", "QUJD#", "'invalid'"), ("instant", "string", "2020-01-01T00:00:#Z", "CASE WHEN k > 9 THEN 'ok' ELSE 'invalid' END"),
    ("date", "string", "2020-#", "CASE WHEN k IN (10, 11, 12) THEN 'ok' ELSE 'invalid' END"), ("dateTime", "string", "2020-01-01T00:00:00+#:00", "CASE WHEN k BETWEEN 10 AND 14 THEN 'ok' ELSE 'invalid' END"), ("time", "string", "#:00:00", "CASE WHEN k BETWEEN 10 AND 23 THEN 'ok' ELSE 'invalid' END"), ("markdown", "string", "# x", "'ok'"), ("string", "string", "", "'invalid'"), ("HumanName", "string", "#", "'ok'"),
)


@query("SELECT n_nationkey, d, verdict FROM (" + " UNION ALL ".join(f"SELECT n_nationkey, {d} AS d, {sql} AS verdict FROM (SELECT n_nationkey, n_nationkey AS k FROM nation)" for d, (*_, sql) in enumerate(DOMAINS)) + ")")
def primitive_types(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("n_nationkey").cast("string")
    verdicts = F.array(*(S.primitive_verdict(t, F.lit(v), F.replace(F.lit(text), F.lit("#"), key)) for t, v, text, _ in DOMAINS))
    return table(spark, sf, "nation").select("n_nationkey", F.posexplode(verdicts).alias("d", "verdict"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END AS wide, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderkey AS DECIMAL(38,0)) * 1000 WHEN 1 THEN CAST(o_orderkey AS DECIMAL(38,0)) END AS whole FROM orders""")
def integers(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    wide = pick(key, 3, {0: j("9223372036854775808", "")}, key.cast("string"))
    whole = pick(key, 3, {0: j(key, "e3"), 1: j(key, ".00")}, j(key, ".5"))
    return table(spark, sf, "orders").select("o_orderkey", S.integer64(wide).alias("wide"), S.decimal_integer(whole).alias("whole"))
