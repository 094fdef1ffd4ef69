"""Structural validation: known elements, cardinality, choices and the value domain of primitives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nodes import FINDINGS, element, finding, nodes
from ..functions.scalars import PRIMITIVES, primitive_verdict

MANY = 1 << 30


@dataclass(frozen=True)
class Element:
    types: tuple[str, ...]
    max: int = 1
    min: int = 0
    codes: tuple[str, ...] | None = None


# Fixed values of the specification: the elements of every resource, and those of Patient.
BASE = {
    "id": Element(("id",)),
    "meta": Element(("Meta",)),
    "implicitRules": Element(("uri",)),
    "language": Element(("code",)),
    "text": Element(("Narrative",)),
    "contained": Element(("Resource",), MANY),
    "extension": Element(("Extension",), MANY),
    "modifierExtension": Element(("Extension",), MANY),
}
PATIENT = {
    "identifier": Element(("Identifier",), MANY),
    "active": Element(("boolean",)),
    "name": Element(("HumanName",), MANY),
    "telecom": Element(("ContactPoint",), MANY),
    "gender": Element(("code",), codes=("male", "female", "other", "unknown")),
    "birthDate": Element(("date",)),
    "deceased": Element(("boolean", "dateTime")),
    "address": Element(("Address",), MANY),
    "maritalStatus": Element(("CodeableConcept",)),
    "multipleBirth": Element(("boolean", "integer")),
    "photo": Element(("Attachment",), MANY),
    "contact": Element(("BackboneElement",), MANY),
    "communication": Element(("BackboneElement",), MANY),
    "generalPractitioner": Element(("Reference",), MANY),
    "managingOrganization": Element(("Reference",)),
    "link": Element(("BackboneElement",), MANY),
}
SCHEMAS: dict[str, dict[str, Element]] = {"Patient": PATIENT}


def _properties(elements: dict[str, Element]) -> dict[str, tuple[str, str, Element]]:
    """Property name -> (element, datatype, element's rules); a choice has a property for each datatype."""
    return {(k + t[0].upper() + t[1:] if len(e.types) > 1 else k): (k, t, e) for k, e in (BASE | elements).items() for t in e.types}


def _leaf(n: Column, datatype: str, e: Element) -> Column:
    """Code of the finding of one value, or null."""
    primitive = datatype in PRIMITIVES
    if not primitive:
        return F.when(n["kind"].isin("primitive") & n["lex"].isNotNull(), "TYPE_MISMATCH")
    verdict = primitive_verdict(datatype, n["vtype"], n["lex"])
    code = F.when(n["kind"] == "complex", "TYPE_MISMATCH").when(n["lex"].isNull(), None).when(verdict == "type-mismatch", "TYPE_MISMATCH").when(verdict == "invalid", "PRIMITIVE_INVALID")
    return code.when(~n["lex"].isin(*e.codes), "CODE_INVALID") if e.codes else code


def structure_findings(schemas: dict[str, dict[str, Element]] | None = None, strict: bool = False) -> Column:
    """Findings of the first two layers, for the types of the schemas; others are reported as not modelled."""
    out = F.when(F.col("resource_type").isNull(), F.array(finding("RESOURCE_TYPE_UNKNOWN", "error", F.lit("$this"))).cast(FINDINGS))
    own = F.filter(nodes(), lambda n: (n["parent"] == 0) & ~n["meta"] & ~n["dup"] & (n["name"] != "resourceType"))
    for kind, elements in (SCHEMAS | (schemas or {})).items():
        props = _properties(elements)
        unknown = F.transform(F.array_distinct(F.transform(F.filter(own, lambda n: ~n["name"].isin(*props)), element)), lambda at: finding("UNKNOWN_ELEMENT", "error" if strict else "warning", at))

        def leaf(n: Column) -> Column:
            code = F.lit(None).cast("string")
            for name, (_, datatype, e) in props.items():
                code = F.when(n["name"] == name, _leaf(n, datatype, e)).otherwise(code)
            return F.struct(code.alias("code"), F.lit("error").alias("severity"), n["loc"].alias("expression"), F.lit(None).cast("string").alias("constraint"))

        values = F.filter(F.transform(own, leaf), lambda f: f["code"].isNotNull())
        counted = []
        for name, (_, _, e) in props.items():
            if e.max < MANY:
                found = F.filter(own, lambda n: n["name"] == name)
                counted.append(F.when(F.size(found) > e.max, finding("CARDINALITY_MAX", "error", F.lit(f"{kind}.{name}"))))
        for base, e in (BASE | elements).items():
            names = [p for p, (b, _, _) in props.items() if b == base]
            present = F.filter(F.array(*(F.when(F.exists(own, lambda n: n["name"] == p), p) for p in names)), lambda x: x.isNotNull())
            label = f"{kind}.{base}" + ("[x]" if len(names) > 1 else "")
            if len(names) > 1:
                counted.append(F.when(F.size(present) > 1, finding("CHOICE_AMBIGUOUS", "error", F.lit(label))))
            if e.min:
                counted.append(F.when(F.size(present) == 0, finding("CARDINALITY_MIN", "error", F.lit(label))))
        every = F.concat(unknown.cast(FINDINGS), values.cast(FINDINGS), F.filter(F.array(*counted), lambda f: f.isNotNull()).cast(FINDINGS))
        out = out.when(F.col("resource_type") == kind, every)
    return out.otherwise(F.array(finding("RESOURCE_NOT_MODELED", "information", F.col("resource_type"))).cast(FINDINGS))


def explode_findings(resources: DataFrame, findings: Column, *keys: str) -> DataFrame:
    """One row per finding, in order. A plain explode has Spark filter the rows by the number of findings before, for which they are all worked out a second time."""
    return resources.select(*keys, F.posexplode_outer(findings).alias("ord", "f")).where("ord is not null").select(*keys, "ord", "f.code", "f.severity", "f.expression", "f.constraint")
