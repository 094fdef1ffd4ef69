"""The safety readout: negations, retractions and everything that makes a record unfit to be summarised unread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nodes import at as node_at
from ..functions.nodes import at_each, below, choice, codings, each, element, finding, findings, has, has_coding, kids, locations, lone, metadata, nodes, outside, root, roots, strings, text, top

# Fixed values of the specification.
SNOMED = "http://snomed.info/sct"
NO_KNOWN_ALLERGY = "716186003"
ALLERGY_VERIFICATION = "http://terminology.hl7.org/CodeSystem/allergyintolerance-verification"
CONDITION_CLINICAL = "http://terminology.hl7.org/CodeSystem/condition-clinical"
CONDITION_VERIFICATION = "http://terminology.hl7.org/CodeSystem/condition-ver-status"
CONDITION_CATEGORY = "http://terminology.hl7.org/CodeSystem/condition-category"
SAFETY_TYPES = ("AllergyIntolerance", "Condition", "MedicationRequest", "MedicationStatement", "Observation", "Immunization", "DiagnosticReport")
SCALARS = ("status", "clinicalStatus", "verificationStatus", "doNotPerform", "code")
CODEABLES = ("clinicalStatus", "verificationStatus", "code")
CONCEPT_MEMBERS = ("coding", "text", "id", "extension")
STATUS_CODES = ("entered-in-error", "not-taken", "not-done")
VERIFICATION_CODES = ("entered-in-error", "refuted")
MODIFIER_ROOTS = ("AllergyIntolerance", "Bundle", "Condition", "DiagnosticReport", "Immunization", "MedicationRequest", "MedicationStatement", "Observation", "Patient", "Practitioner")
#: What stands for a name that may be text of the document.
WITHHELD = "<withheld>"
NEGATIONS = ("do-not-perform", "entered-in-error", "refuted", "not-taken", "not-done", "no-known-allergy")


def _at_roots(f) -> Column:
    """f of every resource root, arrays of locations joined and told once."""
    return F.array_distinct(each(roots(), f))


def _any_root(f) -> Column:
    return F.exists(roots(), f)


def status_is(n: Column, code: str) -> Column:
    return F.array_contains(strings(kids(n["id"], "status", True)), code)


def retracted_at(n: Column) -> Column:
    return status_is(n, "entered-in-error") | has_coding(kids(n["id"], "verificationStatus", True), None, "entered-in-error", True)


def _booleans(n: Column) -> Column:
    return kids(n["id"], "doNotPerform", True)


def negations() -> Column:
    """The negations that the document asserts, each once, in a fixed order."""
    yes = {
        "do-not-perform": _any_root(lambda n: F.exists(_booleans(n), lambda b: b["lex"] == "true")),
        "entered-in-error": _any_root(retracted_at),
        "refuted": _any_root(lambda n: has_coding(kids(n["id"], "verificationStatus", True), None, "refuted", True)),
        "not-taken": _any_root(lambda n: status_is(n, "not-taken")),
        "not-done": _any_root(lambda n: status_is(n, "not-done")),
        "no-known-allergy": (F.col("resource_type") == "AllergyIntolerance") & has_coding(top("code", True), SNOMED, NO_KNOWN_ALLERGY, True),
    }
    return F.filter(F.array(*(F.when(yes[k], k) for k in NEGATIONS)), lambda k: k.isNotNull())


def modifier_extensions() -> Column:
    """Every modifierExtension but those in the metadata of primitives."""
    return locations(outside(F.filter(nodes(), lambda n: (n["name"] == "modifierExtension") & ~n["meta"]), metadata()))


def modifier_reports() -> Column:
    """struct(element, location) of comparator and implicitRules anywhere, active of a Patient, use of a Practitioner's identifiers.

    A resource is of every type that it names. The metadata of primitives isn't looked at. A location begins with the document's type only if that is one of MODIFIER_ROOTS, so that no text of a document gets there.
    """
    typed = lambda n, name: F.array_contains(strings(kids(n["id"], "resourceType", True)), name)

    def modifies(n: Column) -> Column:
        owner = node_at(n["parent"])
        return ~n["meta"] & (n["name"].isin("comparator", "implicitRules") | (n["name"] == "active") & typed(owner, "Patient") | (n["name"] == "use") & (owner["name"] == "identifier") & typed(node_at(owner["parent"]), "Practitioner"))

    first = F.get(strings(top("resourceType", True)), F.lit(0))
    start = F.when(first.isNull(), root()["loc"]).when(first.isin(*MODIFIER_ROOTS), first).otherwise(WITHHELD)
    below_root = lambda loc: F.substring(loc, F.length(root()["loc"]) + 1, F.length(loc))
    told = lambda n: F.struct(n["name"].alias("element"), F.concat(start, below_root(element(n))).alias("location"))
    return F.array_distinct(F.transform(outside(F.filter(nodes(), modifies), metadata()), told))


def modifier_elements() -> Column:
    """The locations of `modifier_reports`."""
    return F.array_distinct(F.transform(modifier_reports(), lambda r: r["location"]))


def shadowed_properties() -> Column:
    return F.array_distinct(F.transform(F.filter(nodes(), lambda n: n["dup"] & ~n["meta"]), element))


def _wrapped(n: Column) -> Column:
    """The items of arrays that stand for single-valued elements of a resource root, and for codings' scalars under them."""
    # a document whose type stands in an odd shape is read as the type it names
    safe = F.coalesce(n["rtype"], F.when(n["id"] == 0, F.col("resource_type"))).isin(*SAFETY_TYPES)
    own = F.filter(below(n["id"]), lambda m: (m["parent"] == n["id"]) & ~m["meta"] & m["idx"].isNotNull() & ((m["name"] == "resourceType") | F.coalesce(safe, F.lit(False)) & m["name"].isin(*SCALARS)))
    concepts = F.filter(below(n["id"]), lambda m: (m["parent"] == n["id"]) & (m["kind"] == "complex") & ((m["name"] == "verificationStatus") | F.coalesce(safe, F.lit(False)) & m["name"].isin(*CODEABLES)))
    inner = each(concepts, lambda c: each(kids(c["id"], "coding", True), lambda d: F.filter(below(d["id"]), lambda m: (m["parent"] == d["id"]) & m["name"].isin("system", "code") & m["idx"].isNotNull())))
    return F.concat(own, inner)


def array_wrapped() -> Column:
    """Single-valued elements that stand in an array, at resource roots, and codings' scalars under them."""
    return _at_roots(lambda n: F.transform(_wrapped(n), element))


def unspellable_xml_wrappers() -> Column:
    """Those of `array_wrapped` that XML, where an array is a repeated element, can't say: an array of one, and any array of types."""
    lost = lambda m: (m["name"] == "resourceType") | lone(m)
    return _at_roots(lambda n: F.transform(F.filter(_wrapped(n), lost), element))


def nested_arrays() -> Column:
    return locations(F.filter(nodes(), lambda n: n["kind"] == "nested"))


def dropped_text() -> Column:
    return locations(F.filter(nodes(), lambda n: n["kind"] == "text"))


def unreadable_booleans() -> Column:
    """doNotPerform values that are neither true nor false, as a boolean or written out."""
    return _at_roots(lambda n: F.transform(F.filter(_booleans(n), lambda b: (b["kind"] != "primitive") | b["lex"].isNotNull() & ~b["lex"].isin("true", "false")), element))


def near_miss_codes() -> Column:
    """status and verificationStatus that differ from a negation code by case or outer white space only, the code itself absent."""

    def near(values: Column, codes: tuple[str, ...]) -> Column:
        fold = lambda v: F.lower(F.regexp_replace(v, r"\A[ \t\n\r]+|[ \t\n\r]+\z", ""))
        out = F.lit(False)
        for code in codes:
            out = out | ~F.array_contains(values, code) & F.exists(values, lambda v: (fold(v) == code) & (v != code))
        return out

    def at(n: Column) -> Column:
        verification = F.transform(F.filter(codings(kids(n["id"], "verificationStatus", True), True), lambda c: c["code"].isNotNull()), lambda c: c["code"])
        base = n["loc"]
        return F.filter(F.array(F.when(near(strings(kids(n["id"], "status", True)), STATUS_CODES), F.concat(base, F.lit(".status"))), F.when(near(verification, VERIFICATION_CODES), F.concat(base, F.lit(".verificationStatus")))), lambda x: x.isNotNull())

    return _at_roots(at)


def unreadable_codes() -> Column:
    """status values that are neither a code nor a codeable concept."""

    def odd(v: Column) -> Column:
        members = F.filter(below(v["id"]), lambda m: (m["parent"] == v["id"]) & ~m["meta"])
        return F.when(v["kind"] == "complex", (F.size(members) == 0) | F.exists(members, lambda m: ~m["name"].isin(*CONCEPT_MEMBERS))).when(v["kind"] == "primitive", v["vtype"].isNotNull() & (v["vtype"] != "string")).otherwise(True)

    return _at_roots(lambda n: F.transform(F.filter(kids(n["id"], "status", True), odd), element))


CHANNELS = {
    "modifier_extensions": modifier_extensions,
    "modifier_elements": modifier_elements,
    "shadowed_properties": shadowed_properties,
    "array_wrapped": array_wrapped,
    "nested_arrays": nested_arrays,
    "dropped_text": dropped_text,
    "unreadable_booleans": unreadable_booleans,
    "near_miss_codes": near_miss_codes,
    "unreadable_codes": unreadable_codes,
}


def with_safety(resources: DataFrame) -> DataFrame:
    """Adds the channels, the negations, retracted and safe_to_summarize; a document that wasn't read is not safe."""
    out = resources.withColumns({k: f() for k, f in CHANNELS.items()} | {"negations": negations(), "retracted": F.coalesce(retracted_at(root()), F.lit(False)), "status": text(0, "status")})
    clean = F.lit(True)
    for k in CHANNELS:
        clean = clean & (F.size(k) == 0)
    return out.withColumn("safe_to_summarize", F.coalesce(clean & F.col("fatal").isNull() & (F.size("nodes") > 0), F.lit(False)))


def _code(name: str, system: str | None) -> Column:
    """The code of a codeable concept: of the preferred system, or else the first."""
    found = F.filter(codings(top(name), True), lambda c: c["code"].isNotNull())
    return F.coalesce(F.get(F.filter(found, lambda c: c["system"] == system), F.lit(0))["code"], F.get(found, F.lit(0))["code"]) if system else F.get(found, F.lit(0))["code"]


def _by_type(allergy: str, condition: str, name: str) -> Column:
    t = F.col("resource_type")
    return F.when(t == "AllergyIntolerance", _code(name, allergy)).when(t == "Condition", _code(name, condition)).otherwise(_code(name, None))


def read_safety(resources: DataFrame, name: str = "safety") -> DataFrame:
    """`with_safety` as one struct: the convenience fields, the negations, and the locations of every channel."""
    s = with_safety(resources)
    readable = F.filter(top("doNotPerform"), lambda b: b["lex"].isin("true", "false"))
    fields = {
        "resource_type": F.coalesce(F.col("resource_type"), F.get(strings(top("resourceType", True)), F.lit(0))), "status": F.get(strings(top("status")), F.lit(0)),
        "clinical_status": _by_type("http://terminology.hl7.org/CodeSystem/allergyintolerance-clinical", CONDITION_CLINICAL, "clinicalStatus"), "verification_status": _by_type(ALLERGY_VERIFICATION, CONDITION_VERIFICATION, "verificationStatus"),
        "do_not_perform": F.get(readable, F.lit(0))["lex"].cast("boolean"), "retracted": F.col("retracted"), "no_known_allergy": F.array_contains("negations", "no-known-allergy"), "negations": F.col("negations"),
    } | {c: F.col(c) for c in (*CHANNELS, "safe_to_summarize")} | {"modifier_reports": modifier_reports()}
    return s.select(*resources.columns, F.struct(*(v.alias(k) for k, v in fields.items())).alias(name))


def assert_safe_to_summarize(resources: DataFrame) -> DataFrame:
    """The same rows; the job fails at the first that isn't safe to summarise, naming locations only, never a value."""
    s = with_safety(resources)
    where = F.concat_ws(", ", *CHANNELS)
    checked = F.when(F.col("safe_to_summarize"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not safe to summarise: "), F.coalesce(F.nullif(where, F.lit("")), F.col("fatal"), F.lit("no document")))).cast("boolean"))
    return s.where(checked).select(*resources.columns)


def safety_findings() -> Column:
    """The five fail-closed channels as errors, the retraction, and the invariants of the safety types."""
    t = F.col("resource_type")
    is_safety = F.coalesce(t.isin(*SAFETY_TYPES), F.lit(False))
    parts = [at_each(CHANNELS[c](), code, "error") for c, code in (("modifier_extensions", "UNHANDLED_MODIFIER_EXTENSION"), ("shadowed_properties", "DUPLICATE_PROPERTY"), ("array_wrapped", "ARRAY_WRAPPED_SCALAR"), ("nested_arrays", "NESTED_ARRAY"), ("dropped_text", "DROPPED_ELEMENT_TEXT"))]
    clinical = F.size(top("clinicalStatus")) > 0
    wrong = lambda system: has_coding(top("verificationStatus"), system, "entered-in-error", True)
    allergy, condition, observation = t == "AllergyIntolerance", t == "Condition", t == "Observation"
    a, c = wrong(ALLERGY_VERIFICATION), wrong(CONDITION_VERIFICATION)
    over = F.exists(codings(top("clinicalStatus"), True), lambda x: (x["system"] == CONDITION_CLINICAL) & x["code"].isin("resolved", "remission", "inactive"))
    value = F.size(choice(0, "value")) > 0
    own = codings(top("code"), True)
    clash = F.exists(top("component"), lambda p: F.exists(codings(kids(p["id"], "code")), lambda b: F.exists(own, lambda x: (x["system"] == b["system"]) & (x["code"] == b["code"]))))
    rule = lambda key, severity, at: finding("INVARIANT_VIOLATED", severity, F.lit(at), key)
    parts.append(
        findings(
            (is_safety & retracted_at(root()), finding("RETRACTED_RESOURCE", "information", F.concat(t, F.when(status_is(root(), "entered-in-error"), ".status").otherwise(".verificationStatus")))),
            (allergy & ~a & ~clinical, rule("ait-1", "error", "AllergyIntolerance.clinicalStatus")),
            (allergy & a & clinical, rule("ait-2", "error", "AllergyIntolerance.clinicalStatus")),
            (condition & ~clinical & ~c & has_coding(top("category"), CONDITION_CATEGORY, "problem-list-item"), rule("con-3", "warning", "Condition.clinicalStatus")),
            (condition & (F.size(choice(0, "abatement")) > 0) & ~over, rule("con-4", "error", "Condition.clinicalStatus")),
            (condition & c & clinical, rule("con-5", "error", "Condition.clinicalStatus")),
            (observation & has(0, "dataAbsentReason") & value, rule("obs-6", "error", "Observation.dataAbsentReason")),
            (observation & value & clash, rule("obs-7", "error", "Observation.component")),
        )
    )
    return F.concat(*parts)
