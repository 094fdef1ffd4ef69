"""Quantities: values as written, units by shape, and the units that vital signs require. Nothing is converted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.nodes import FINDINGS, at_each, below, codings, each, finding, has_coding, kids, let, strings, text, top
from ..functions.scalars import PATTERNS, ucum_shape, whole

# Fixed values of the specification.
UCUM = "http://unitsofmeasure.org"
LOINC = "http://loinc.org"
CATEGORY_SYSTEM = "http://terminology.hl7.org/CodeSystem/observation-category"
VITAL_SIGNS = "vital-signs"
VITAL_PROFILE = "http://hl7.org/fhir/StructureDefinition/vitalsigns"
VALUE_TYPES = ("Quantity", "CodeableConcept", "String", "Boolean", "Integer", "Range", "Ratio", "SampledData", "Time", "DateTime", "Period")
VITAL_UNITS = {
    "29463-7": ("g", "kg", "[lb_av]"),
    "8302-2": ("cm", "[in_i]"),
    "8306-3": ("cm", "[in_i]"),
    "8287-5": ("cm", "[in_i]"),
    "9843-4": ("cm", "[in_i]"),
    "8310-5": ("Cel", "[degF]"),
    "8867-4": ("/min",),
    "9279-1": ("/min",),
    "8480-6": ("mm[Hg]",),
    "8462-4": ("mm[Hg]",),
    "2708-6": ("%",),
    "59408-5": ("%",),
    "39156-5": ("kg/m2",),
}


QUANTITY = "struct<value:string,comparator:string,unit:string,system:string,code:string>"


def read_quantity(n: Column) -> Column:
    """struct(value, comparator, unit, system, code); the value is the written decimal, or a string of its form."""
    lex = F.filter(kids(n["id"], "value"), lambda v: (v["vtype"] == "decimal") | (v["vtype"] == "string") & v["lex"].rlike(whole(PATTERNS["decimal"])))
    return F.struct(F.get(lex, F.lit(0))["lex"].alias("value"), *(text(n["id"], k).alias(k) for k in ("comparator", "unit", "system", "code")))


def observation_value(parent: Column | int) -> Column:
    """struct(type, loc, quantity, ambiguous) of the first value variant in the fixed order, with the types of all further ones; null without one."""
    names = [f"value{t}" for t in VALUE_TYPES]
    at = F.lit(0) if isinstance(parent, int) else parent
    found = F.filter(below(parent), lambda n: (n["parent"] == at) & n["name"].isin(*names) & ~n["meta"] & ~n["dup"])
    order = F.create_map(*(x for k, t in enumerate(names) for x in (F.lit(t), F.lit(k))))
    sorted_ = F.array_sort(F.transform(found, lambda n: F.struct(F.try_element_at(order, n["name"]).alias("k"), n["id"].alias("id"), n.alias("n"))))
    none = F.lit(None).cast(QUANTITY)

    def read(every: Column) -> Column:
        first = F.get(every, F.lit(0))
        more = F.array_distinct(F.transform(F.filter(every, lambda x: x["k"] != first["k"]), lambda x: F.substring(x["n"]["name"], 6, 40)))
        return let(first["n"], lambda n: F.when(n["id"].isNotNull(), F.struct(F.substring(n["name"], 6, 40).alias("type"), n["loc"].alias("loc"), F.when(n["name"] == "valueQuantity", read_quantity(n)).otherwise(none).alias("quantity"), more.alias("ambiguous"))))

    return let(sorted_, read)


def reference_ranges(parent: Column | int) -> Column:
    """(loc, low, high, type, text) of each reference range as written; surfaced, never evaluated."""
    one = lambda n, name: let(F.get(kids(n["id"], name), F.lit(0)), lambda q: F.when(q["id"].isNotNull(), read_quantity(q)))
    return F.transform(F.filter(kids(parent, "referenceRange"), lambda n: n["kind"] == "complex"), lambda n: F.struct(n["loc"].alias("loc"), one(n, "low").alias("low"), one(n, "high").alias("high"), codings(kids(n["id"], "type")).alias("type"), text(n["id"], "text").alias("text")))


def interpretations(parent: Column | int) -> Column:
    """The codings of an Observation's or component's interpretation; surfaced, never evaluated."""
    return codings(kids(parent, "interpretation"))


def is_vital() -> Column:
    profiles = each(top("meta"), lambda m: strings(kids(m["id"], "profile")))
    return has_coding(top("category"), CATEGORY_SYSTEM, VITAL_SIGNS) | F.array_contains(profiles, VITAL_PROFILE)


def _bad_unit(q: Column) -> Column:
    return (q["system"] == UCUM) & (q["code"].isNull() | (ucum_shape(q["code"]) == "invalid"))


def _element(n: Column, vital: Column) -> Column:
    """Findings of one Observation or component."""
    listed = F.filter(codings(kids(n["id"], "code")), lambda c: (c["system"] == LOINC) & c["code"].isin(*VITAL_UNITS))
    units = F.create_map(*(x for k, v in VITAL_UNITS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    allowed = F.try_element_at(units, F.get(listed, F.lit(0))["code"])

    def judge(v: Column, allowed: Column) -> Column:
        q = v["quantity"]
        keyed = vital & allowed.isNotNull() & v.isNotNull()
        fits = F.coalesce((q["system"] == UCUM) & F.array_contains(allowed, q["code"]), F.lit(False))
        return F.filter(
            F.array(
                F.when((v["type"] == "Quantity") & _bad_unit(q), finding("UCUM_UNIT_UNRECOGNIZED", "warning", F.concat(v["loc"], F.lit(".code")))),
                F.when(keyed & (v["type"] != "Quantity"), finding("VALUE_TYPE_UNEXPECTED", "warning", v["loc"])),
                F.when(keyed & (v["type"] == "Quantity") & ~fits, finding("VITAL_SIGN_UNIT_NONCONFORMANT", "error", v["loc"])),
            ),
            lambda f: f.isNotNull(),
        ).cast(FINDINGS)

    return let(observation_value(n["id"]), lambda v: let(allowed, lambda a: judge(v, a)))


def dose_quantities() -> Column:
    """The dose quantities of a MedicationRequest's or MedicationStatement's dosage."""
    dosage = F.when(F.col("resource_type") == "MedicationRequest", top("dosageInstruction")).when(F.col("resource_type") == "MedicationStatement", top("dosage"))
    return each(dosage, lambda d: each(kids(d["id"], "doseAndRate"), lambda r: kids(r["id"], "doseQuantity")))


def quantity_findings() -> Column:
    own = F.filter(F.col("nodes"), lambda n: (n["id"] == 0) | (n["parent"] == 0) & (n["name"] == "component") & (n["kind"] == "complex") & ~n["dup"])
    doses = F.transform(F.filter(dose_quantities(), lambda n: _bad_unit(read_quantity(n))), lambda n: F.concat(n["loc"], F.lit(".code")))
    return F.when(F.col("resource_type") == "Observation", let(is_vital(), lambda vital: each(own, lambda n: _element(n, vital)))).otherwise(F.coalesce(at_each(doses, "UCUM_UNIT_UNRECOGNIZED", "warning"), F.array().cast(FINDINGS)))
