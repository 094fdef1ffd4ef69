"""All layers over a resource in the engine's order: one array of findings, and whether any of them is an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nodes import FINDINGS, at_each, finding, strings, top
from .bundles import bundle_findings
from .profiles import Profile, profile_findings, version_findings
from .quantity import quantity_findings
from .safety import nested_arrays, safety_findings
from .structure import Element, structure_findings
from .terminology import membership_findings, system_findings


def validate(resources: DataFrame, *keys: str, profiles: tuple[Profile, ...] = (), schemas: dict[str, dict[str, Element]] | None = None, strict: bool = False, members: DataFrame | None = None, bundles: bool = True) -> DataFrame:
    """resources with `findings` and `valid`.

    Order: structure, safety, quantities, Bundle integrity, terminology, profiles with their invariants, profile
    versions. A document without a type has that finding, and the safety layer for the type that it names in an odd
    shape, or else its nested arrays. One that couldn't be read has no findings and isn't valid; a null text has
    neither. `keys` tell the rows apart: Bundle integrity (bundles=False leaves it out, and its joins) and the
    membership of codes (with `members`) are joined back by them.
    """
    none = F.array().cast(FINDINGS)
    typed = F.nullif(F.col("resource_type"), F.lit("")).isNotNull()
    named = F.get(strings(top("resourceType", True)), F.lit(0))
    r = resources.withColumn("_typed", typed).withColumn("_written", F.col("resource_type")).withColumn("resource_type", F.when(typed, F.col("resource_type")).otherwise(F.nullif(named, F.lit(""))))
    r = r.withColumn("_safety", F.when(F.col("resource_type").isNull(), at_each(nested_arrays(), "NESTED_ARRAY", "error")).otherwise(safety_findings())).withColumn("resource_type", F.col("_written"))
    parts = {"bundle": none, "membership": none}
    if bundles:
        r = r.join(bundle_findings(resources, *keys), list(keys), "left")
        parts["bundle"] = F.coalesce("bundle_findings", none)
    if members is not None:
        found = membership_findings(resources, members, *keys)
        f = F.struct("code", "severity", "expression", F.lit(None).cast("string").alias("constraint"))
        r = r.join(found.groupBy(*keys).agg(F.array_sort(F.collect_list(f)).cast(FINDINGS).alias("_membership")), list(keys), "left")
        parts["membership"] = F.coalesce("_membership", none)
    layers = [structure_findings(schemas, strict), F.col("_safety"), quantity_findings(), parts["bundle"], system_findings(), parts["membership"], *(profile_findings(p) for p in profiles)]
    if profiles:
        layers.append(version_findings(*profiles))
    lacking = F.concat(F.array(finding("RESOURCE_TYPE_UNKNOWN", "error", F.lit("$this"))).cast(FINDINGS), F.col("_safety"))
    every = F.when(F.size("nodes") <= 0, none).when(~F.col("_typed"), lacking).otherwise(F.concat(*layers))
    valid = F.when(F.col("fatal").isNotNull(), False).when(F.size("nodes") > 0, ~F.exists("findings", lambda f: f["severity"].isin("error", "fatal")))
    return r.withColumn("findings", F.coalesce(every, none)).withColumn("valid", valid).select(*resources.columns, "findings", "valid")
