"""Terminology: code systems by identity, and membership by a join with a table of value sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nodes import FINDINGS, finding, top, written_codings
from .quantity import LOINC, UCUM
from .safety import SNOMED

# Identities of code systems and of two value sets.
RXNORM = "http://www.nlm.nih.gov/research/umls/rxnorm"
KNOWN_SYSTEMS = {
    LOINC: "LOINC",
    SNOMED: "SNOMED CT",
    RXNORM: "RxNorm",
    "http://hl7.org/fhir/sid/icd-10-cm": "ICD-10-CM",
    "http://hl7.org/fhir/sid/icd-9-cm": "ICD-9-CM",
    "http://www.ama-assn.org/go/cpt": "CPT",
    UCUM: "UCUM",
    "http://hl7.org/fhir/sid/ndc": "NDC",
    "http://hl7.org/fhir/sid/cvx": "CVX",
}
ALLERGY_SUBSTANCES = "http://cts.nlm.nih.gov/fhir/ValueSet/2.16.840.1.113762.1.4.1186.8"
MEDICATIONS = "http://cts.nlm.nih.gov/fhir/ValueSet/2.16.840.1.113762.1.4.1010.4"
UNEXPECTED = {"required": "error", "extensible": "warning", "preferred": "warning", "example": None}
NOT_IN = {"required": "error", "extensible": "error", "preferred": "warning", "example": "information"}


@dataclass(frozen=True)
class Binding:
    type: str
    element: str
    value_set: str
    strength: str
    systems: tuple[str, ...] | None = None


BINDINGS = (
    Binding("AllergyIntolerance", "code", ALLERGY_SUBSTANCES, "extensible", (RXNORM, SNOMED)),
    Binding("MedicationRequest", "medicationCodeableConcept", MEDICATIONS, "extensible", (RXNORM,)),
    Binding("MedicationStatement", "medicationCodeableConcept", MEDICATIONS, "extensible", (RXNORM,)),
)


def system_findings(bindings: tuple[Binding, ...] = BINDINGS) -> Column:
    """What can be said from the system alone."""
    out = F.lit(None).cast(FINDINGS)
    for b in bindings:
        known, expected = (lambda c: c["system"].isin(*KNOWN_SYSTEMS)), (lambda c: c["system"].isin(*b.systems) if b.systems else c["system"].isin(*KNOWN_SYSTEMS))

        def judge(c: Column) -> Column:
            severity = UNEXPECTED[b.strength]
            at = F.concat(c["loc"], F.lit(".system"))
            odd = finding("CODE_SYSTEM_UNEXPECTED", severity, at) if severity else F.lit(None)
            return F.when(c["system"].isNull() | expected(c), None).when(known(c), odd).otherwise(finding("CODE_SYSTEM_UNKNOWN", "information", at))

        found = F.filter(F.transform(written_codings(top(b.element)), judge), lambda f: f.isNotNull()).cast(FINDINGS)
        out = F.when(F.col("resource_type") == b.type, found).otherwise(out)
    return F.coalesce(out, F.array().cast(FINDINGS))


def membership_findings(resources: DataFrame, members: DataFrame, *keys: str, bindings: tuple[Binding, ...] = BINDINGS) -> DataFrame:
    """Codings of an expected system that `members` (value_set, system, code, membership) says are not in the bound set.

    A code that the table doesn't know is `unknown` and gives nothing. The table is joined by its keys; Spark
    broadcasts it only while it is small.
    """
    table = F.array(*(F.struct(F.lit(b.type).alias("type"), F.lit(b.value_set).alias("value_set"), F.lit(NOT_IN[b.strength]).alias("severity"), F.transform(F.filter(written_codings(top(b.element)), lambda c: c["system"].isin(*(b.systems or KNOWN_SYSTEMS))), lambda c: F.struct(c["system"], c["code"], c["loc"])).alias("codings")) for b in bindings))
    bound = resources.select(*keys, "resource_type", F.explode(table).alias("b")).where("b.type = resource_type").select(*keys, "b.value_set", "b.severity", F.explode("b.codings").alias("c")).select(*keys, "value_set", "severity", F.col("c.system").alias("system"), F.col("c.code").alias("code"), F.col("c.loc").alias("expression"))
    out = members.where("membership = 'not-in'").select("value_set", "system", "code").distinct()
    return bound.join(out, ["value_set", "system", "code"]).select(*keys, F.lit("CODE_NOT_IN_VALUESET").alias("code"), "severity", "expression")
