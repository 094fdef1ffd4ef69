"""Resources made from the driver's tables: JSON documents whose faults follow from their keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quantity import CATEGORY_SYSTEM, LOINC, UCUM
from ..operators.safety import ALLERGY_VERIFICATION, CONDITION_CATEGORY, CONDITION_CLINICAL, CONDITION_VERIFICATION, SNOMED
from ..operators.terminology import RXNORM
from ..sources.resource_json import read_resources

#: Event type -> LOINC code and its unit.
CODES = {"click": ("8867-4", "/min"), "view": ("29463-7", "kg"), "error": ("8310-5", "Cel"), "purchase": ("8480-6", "mm[Hg]"), "signup": ("1234-5", "kg")}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table, dealt over all cores where it is one small file that a single task would read; parsing costs far more than the exchange."""
    t = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return t.repartition(cores) if len(t.inputFiles()) < cores else t


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for files that Spark makes from the tables, where driver and executors share one; deleted when the driver ends."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='vitaframe-files-')}"
    path = f"{top.rstrip('/')}/vitaframe/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session has ended already
            pass

    atexit.register(drop)
    return path


def export(spark: SparkSession, sf: str, limit: int) -> str:
    """The orders as four NDJSON files in the order of their keys, and the folder of them: good lines, lines with CRLF, blank ones, broken ones, arrays, and some longer than `limit`."""
    key = F.col("o_orderkey")
    good = j('{"resourceType":"Basic","id":"', key, '"}')
    line = F.when(key % 31 == 0, j('{"resourceType":"Basic","x":"', F.rpad(F.lit(""), limit, "x"), '"}')).otherwise(pick(key, 5, {0: " \t", 1: j('{"resourceType":', key), 2: j(good, "\r"), 3: j("[", key, "]")}, good))
    path = folder(spark, "export")
    # keys alone are dealt and sorted; lines are made where they are written
    rows = spark.read.parquet(f"{sf}/orders.parquet").select((key % 4).alias("f"), "o_orderkey")
    rows.repartition(max(4, spark.sparkContext.defaultParallelism), "f").sortWithinPartitions("f", "o_orderkey").select("f", line.alias("value")).write.partitionBy("f").text(path, lineSep="\n")
    return path


def dealt(t: DataFrame, key: str) -> DataFrame:
    """Dealt by a key that the rows are about to be gathered by, over all cores: gathering needs no further exchange, and documents are parsed where they are made."""
    spark = t.sparkSession
    return t.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def j(*parts: Column | str) -> Column:
    """Text and columns, one after another."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def pick(key: Column, n: int, cases: dict[int, Column | str], default: Column | str) -> Column:
    out = F.lit(default) if isinstance(default, str) else default
    for k, v in cases.items():
        out = F.when(key % n == k, F.lit(v) if isinstance(v, str) else v).otherwise(out)
    return out


def by_type(what: int) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for k, v in CODES.items() for x in (k, v[what]))), F.col("event_type"))


def money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)").cast("string")


def event_k() -> Column:
    return F.regexp_extract("props", "([0-9]+)", 1).cast("int")


def coding(system: str | Column, code: str | Column) -> Column:
    return j('{"coding":[{"system":"', system, '","code":"', code, '"}]}')


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """event_id, event_type, k and an Observation: by k % 4 the right unit, a wrong one, a malformed one, or a string."""
    e = table(spark, sf, "events").select("event_id", "event_type", money("value").alias("value"), event_k().alias("k"))
    unit = pick(F.col("k"), 4, {1: "lb", 2: "mm Hg["}, by_type(1))
    value = F.when(F.col("k") % 4 == 3, j('"valueString":"', F.col("value"), '"')).otherwise(j('"valueQuantity":{"value":', F.col("value"), ',"unit":"u","system":"', UCUM, '","code":"', unit, '"}'))
    raw = j('{"resourceType":"Observation","id":"e', F.col("event_id"), '","status":"final","category":[', coding(CATEGORY_SYSTEM, "vital-signs"), '],"code":', coding(LOINC, by_type(0)), ",", value, "}")
    return read_resources(e.select("event_id", "event_type", "k", raw.alias("raw")))


def statements(spark: SparkSession, sf: str) -> DataFrame:
    """event_id, k and a MedicationStatement with a negation or a fault by k."""
    e = table(spark, sf, "events").select("event_id", event_k().alias("k"))
    k = F.col("k")
    status = pick(k, 5, {1: '"entered-in-error"', 2: '"not-taken"', 3: '"not-done"'}, '"active"')
    more = F.concat(F.when(k % 7 == 0, ',"doNotPerform":true').otherwise(""), F.when(k % 11 == 0, j(',"verificationStatus":', coding(CONDITION_VERIFICATION, "refuted"))).otherwise(""))
    return read_resources(e.select("event_id", "k", j('{"resourceType":"MedicationStatement","status":', status, more, "}").alias("raw")))


def odd_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """event_id, k and a MedicationStatement whose shape is odd in one of eight ways by k % 10."""
    e = table(spark, sf, "events").select("event_id", event_k().alias("k"))
    body = pick(
        F.col("k"), 10,
        {
            1: '"status":"active","modifierExtension":[{"url":"http://x.org/m"}]', 2: '"status":"active","dosage":[{"doseQuantity":{"comparator":"<","value":1}}]', 3: '"status":"active","status":"completed"', 4: '"status":["active"]',
            5: '"status":"active","note":[["x"]]', 6: '"status":"active","doNotPerform":"maybe"', 7: '"status":"NOT-DONE"', 8: '"status":{"value":"x"}',
        },
        '"status":"active"',
    )
    return read_resources(e.select("event_id", "k", j('{"resourceType":"MedicationStatement",', body, "}").alias("raw")))


def patient_json() -> Column:
    key = F.col("c_custkey")
    fault = pick(
        key, 8,
        {1: ',"gender":"M"', 2: ',"birthDate":"2020-13-01"', 3: ',"active":"true"', 4: ',"foo":1', 5: ',"gender":["male","female"]', 6: ',"deceasedBoolean":false,"deceasedDateTime":"2020"', 7: ',"birthDate":{"x":1}'}, ',"gender":"female"',
    )
    return j('{"resourceType":"Patient","id":"', key, '","name":[{"family":"', F.col("c_name"), '"}]', fault, "}")


def patients(spark: SparkSession, sf: str) -> DataFrame:
    return read_resources(table(spark, sf, "customer").select("c_custkey", patient_json().alias("raw")))


def bundles(spark: SparkSession, sf: str) -> DataFrame:
    """One Bundle per customer with orders: a MedicationRequest for each order, and the Patient unless the key divides by 3."""
    o = dealt(spark.read.parquet(f"{sf}/orders.parquet"), "o_custkey")
    request = j('{"fullUrl":"https://h.org/fhir/MedicationRequest/', F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderkey") + 1).otherwise(F.col("o_orderkey")), '","resource":{"resourceType":"MedicationRequest","id":"', F.col("o_orderkey"), '","subject":{"reference":"Patient/', F.col("o_custkey"), '"},"requester":{"reference":"https://else.org/fhir/Practitioner/', F.col("o_orderkey") % 10, '"}}}')
    listed = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", request.alias("r")))), lambda x: x["r"]), ",").alias("r"))
    key = F.col("o_custkey")
    patient = F.when(key % 3 != 0, j('{"fullUrl":"https://h.org/fhir/Patient/', key, '","resource":{"resourceType":"Patient","id":"', key, '"}},')).otherwise("")
    raw = j('{"resourceType":"Bundle","type":"', pick(key, 3, {0: "transaction", 1: "batch"}, "collection"), '","entry":[', patient, F.col("r"), "]}")
    return read_resources(listed.select("o_custkey", raw.alias("raw")))


def shipments(spark: SparkSession, sf: str) -> DataFrame:
    """One Observation per order, with a component for each line: its flag as code and its quantity as value."""
    line = dealt(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_orderkey")
    component = j('{"code":{"text":"', F.col("l_returnflag"), '"},"valueQuantity":{"value":', money("l_quantity"), ',"unit":"', F.col("l_linestatus"), '"}}')
    listed = line.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", component.alias("c")))), lambda x: x["c"]), ",").alias("c"))
    key = F.col("l_orderkey")
    status = pick(key, 4, {1: "preliminary"}, "final")
    profile = pick(key, 5, {1: '"meta":{"profile":["http://x.org/p|1.0"]},', 2: '"meta":{"profile":["http://x.org/p|2.0"]},'}, "")
    return read_resources(listed.select("l_orderkey", j('{"resourceType":"Observation",', profile, '"status":"', status, '","component":[', F.col("c"), "]}").alias("raw")))


def allergies(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", event_k().alias("k"))
    k = F.col("k")
    a = F.when(k % 2 == 0, j(',"clinicalStatus":', coding("http://terminology.hl7.org/CodeSystem/allergyintolerance-clinical", "active"))).otherwise("")
    b = F.when(k % 3 == 0, j(',"verificationStatus":', coding(ALLERGY_VERIFICATION, "entered-in-error"))).otherwise("")
    c = F.when(k % 5 == 0, j(',"code":', coding(SNOMED, "716186003"))).otherwise("")
    return read_resources(e.select("event_id", "k", j('{"resourceType":"AllergyIntolerance"', a, b, c, "}").alias("raw")))


def conditions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", event_k().alias("k"))
    k = F.col("k")
    a = F.when(k % 3 == 1, j(',"clinicalStatus":', coding(CONDITION_CLINICAL, "active"))).when(k % 3 == 2, j(',"clinicalStatus":', coding(CONDITION_CLINICAL, "resolved"))).otherwise("")
    b = F.when(k % 5 == 0, j(',"verificationStatus":', coding(CONDITION_VERIFICATION, "entered-in-error"))).otherwise("")
    c = F.when(k % 2 == 0, ',"abatementString":"x"').otherwise("")
    d = F.when(k % 7 == 0, j(',"category":[', coding(CONDITION_CATEGORY, "problem-list-item"), "]")).otherwise("")
    return read_resources(e.select("event_id", "k", j('{"resourceType":"Condition"', a, b, c, d, "}").alias("raw")))


def measurements(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", event_k().alias("k"))
    k = F.col("k")
    a = F.when(k % 2 == 0, ',"valueString":"x"').otherwise("")
    b = F.when(k % 3 == 0, j(',"dataAbsentReason":', coding("http://x.org", "unknown"))).otherwise("")
    c = F.when(k % 5 == 0, j(',"component":[{"code":', coding(LOINC, "8867-4"), "}]")).otherwise("")
    return read_resources(e.select("event_id", "k", j('{"resourceType":"Observation","code":', coding(LOINC, "8867-4"), a, b, c, "}").alias("raw")))


def prescriptions(spark: SparkSession, sf: str) -> DataFrame:
    """p_partkey and a MedicationRequest whose medication is coded in one of three systems, or in none, by p_size % 4."""
    p = table(spark, sf, "part")
    system = pick(F.col("p_size"), 4, {0: f'"system":"{RXNORM}",', 1: f'"system":"{SNOMED}",', 2: '"system":"http://x.org/local",'}, "")
    raw = j('{"resourceType":"MedicationRequest","status":"active","medicationCodeableConcept":{"coding":[{', system, '"code":"', F.col("p_partkey"), '"}]}}')
    return read_resources(p.select("p_partkey", "p_size", raw.alias("raw")))


def people(spark: SparkSession, sf: str) -> DataFrame:
    """c_custkey and a Patient with what may be personal, by the key: a name, a contact point, an address, a date of birth, an identifier, and a note."""
    key = F.col("c_custkey")
    family = pick(key, 3, {0: "Testcase", 1: "Quill van Moor"}, "Dr J Okonkwo")
    contact = pick(key, 4, {0: j('"25-989-', key, '-2988"'), 1: '"ann@clinic.org"', 2: '"ann@example.com"'}, '"555-010-1234"')
    line = pick(key, 5, {0: "12 Long Road", 1: "1 Test Street"}, "Rose Cottage")
    born = pick(key, 4, {0: "1970-02-03", 1: "1999-01-01", 2: "1970-13"}, "1970")
    number = pick(key, 3, {0: "123-45-6789", 1: "000000000"}, "A7")
    note = pick(key, 7, {0: "call 987-65-4321 or bo@mail.net", 1: "bo@example.com"}, "none")
    raw = j('{"resourceType":"Patient","name":[{"family":"', family, '","given":["Testcase"]}],"telecom":[{"value":', contact, '}],"address":[{"line":["', line, '"]}],"birthDate":"', born, '","identifier":[{"value":"', number, '"}],"text":{"div":"', note, '"}}')
    return read_resources(table(spark, sf, "customer").select("c_custkey", raw.alias("raw")))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """c_custkey, and a Patient in JSON and in XML that say the same or differ in one way by c_custkey % 8."""
    key, name = F.col("c_custkey"), F.col("c_name")
    given = pick(key, 8, {1: '"given":["B","A"]', 2: '"given":["A","B"],"given":["C"]', 3: '"given":[{"x":"A"},{"x":"B"}]', 6: '"given":["A"]', 7: '"given":["A",["B"]]'}, '"given":["A","B"]')
    a = j('{"resourceType":"Patient","id":"', key, '","active":', pick(key, 8, {4: "false"}, "true"), ',"name":[{"family":"', name, '",', given, '}],"birthDate":"2000-01-01"', pick(key, 8, {5: ',"_birthDate":{"id":"b"}'}, ""), "}")
    names = F.when(key % 8 == 6, '<given value="A"/>').otherwise('<given value="A"/><given value="B"/>')
    b = j('<Patient xmlns="http://hl7.org/fhir"><id value="', key, '"/><active value="true"/><name><family value="', name, '"/>', names, '</name><birthDate value="2000-01-01"/></Patient>')
    return table(spark, sf, "customer").select("c_custkey", a.alias("a"), b.alias("b"))


def unwritable(spark: SparkSession, sf: str) -> DataFrame:
    """c_custkey and a Patient that XML, JSON or both can't say, in one of eight ways by c_custkey % 9."""
    key = F.col("c_custkey")
    more = pick(
        key, 9,
        {
            1: ',"a b":1', 2: ',"text":{"div":"<p>x</p>"}', 3: ',"note":[["x"]],"gone":null', 4: ',"verificationStatus":{"coding":[{"system":["s"],"code":"c"}]}', 5: ',"gender":"x","gender":"y"', 6: ',"contained":[{"resourceType":7}]',
            7: ',"gender":"x","gender":"y","b/c":{"d>":1}', 8: ',"contained":[{"resourceType":"A B","x":1}]',
        },
        "",
    )
    return read_resources(table(spark, sf, "customer").select("c_custkey", j('{"resourceType":"Patient","id":"', key, '","name":[{"family":"', F.col("c_name"), '"}]', more, "}").alias("raw")))


def modified(spark: SparkSession, sf: str) -> DataFrame:
    """o_orderkey and a resource with a modifier element, or what is like one, by o_orderkey % 10."""
    key = F.col("o_orderkey")
    raw = pick(
        key, 10,
        {
            0: j('{"resourceType":"Observation","id":"', key, '","valueQuantity":{"comparator":"<"},"component":[{"valueQuantity":{"comparator":">"}}]}'), 1: '{"resourceType":"Practitioner","identifier":[{"value":"a"},{"use":"old"}]}',
            2: '{"resourceType":"Practitioner","resourceType":"Patient","active":true}', 3: '{"resourceType":"Basket","implicitRules":"u"}', 4: '{"implicitRules":"u"}',
            5: '{"resourceType":"Patient","gender":"x","_gender":{"extension":[{"url":"u","valueQuantity":{"comparator":"<"}}]}}', 6: '{"resourceType":"Bundle","entry":[{"resource":{"resourceType":"Patient","_active":{"id":"i"}}}]}',
            7: '{"resourceType":["Patient"],"active":false}', 8: '{"resourceType":"Encounter","active":true}',
        },
        '{"resourceType":"Practitioner","identifier":{"use":"old"}}',
    )
    return read_resources(table(spark, sf, "orders").select("o_orderkey", raw.alias("raw")))


def wrapped(spark: SparkSession, sf: str) -> DataFrame:
    """p_partkey and a Condition with single values in arrays by p_partkey % 6."""
    key = F.col("p_partkey")
    body = pick(
        key, 6,
        {
            0: '"status":["a"]', 1: '"status":["a","b"]', 2: '"code":[{"coding":[{"system":["s"],"code":["c","d"]}]},{"coding":[{"code":["e"]}]}]', 3: '"contained":[{"resourceType":["Basic","List"]}]', 4: '"status":["b","c"],"status":["a"]',
        },
        '"status":"a"',
    )
    return read_resources(table(spark, sf, "part").select("p_partkey", j('{"resourceType":"Condition","id":"', key, '",', body, "}").alias("raw")))
