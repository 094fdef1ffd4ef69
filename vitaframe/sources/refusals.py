"""Why a tree can't be written: the first reason that applies, and every location where it does; never a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.nodes import locations, nodes, outside
from ..operators.safety import dropped_text, shadowed_properties, unspellable_xml_wrappers
from .resource_json import META

# The reasons, in the order in which they are looked for.
JSON_REFUSALS = ("DROPPED_ELEMENT_TEXT", "UNSERIALIZABLE_SHADOWED_PROPERTY")
XML_REFUSALS = ("DROPPED_ELEMENT_TEXT", "UNSERIALIZABLE_ELEMENT_NAME", "UNSERIALIZABLE_DIV_MARKUP", "UNSERIALIZABLE_JSON_ONLY_SHAPE", "UNSERIALIZABLE_ARRAY_WRAPPER", "UNSERIALIZABLE_SHADOWED_PROPERTY", "UNSERIALIZABLE_RESOURCE_TYPE")


def _breaks(name: Column) -> Column:
    """Whether a name can't be a tag."""
    return name.rlike(r"[ \t\n\r/>=<]") | name.rlike(r"\A[!?]") | (name == "")


def _written(found: Column) -> Column:
    """Those that a writer comes to: later members of a repeated name aren't written."""
    return outside(found, F.filter(nodes(), lambda n: n["dup"]))


def _as_written(found: Column) -> Column:
    """Locations of a document without a type begin with the tag that it is written under."""
    return F.transform(found, lambda loc: F.regexp_replace(loc, r"\A\$this(?=\.|\z)", "Resource"))


def _names() -> Column:
    own = lambda n: (n["parent"] >= 0) & (n["kind"] != "text") & (n["name"] != "resourceType") & _breaks(n["name"])
    return locations(_written(F.filter(nodes(), lambda n: own(n) | n["rtype"].isNotNull() & _breaks(n["rtype"]))))


def _json_only() -> Column:
    """Arrays in arrays, items of another kind than the first, nulls, and metadata that isn't an object."""
    return locations(F.filter(nodes(), lambda n: n["kind"].isin("nested", "foreign") | (n["kind"] == "primitive") & ((n["src"] == "null") | n["src"].startswith(META))))


def _types() -> Column:
    return F.array_distinct(F.transform(F.filter(nodes(), lambda n: n["res"] & n["rtype"].isNull()), lambda n: F.concat(n["loc"], F.lit(".resourceType"))))


def json_reasons() -> Column:
    """struct of a location array for each of JSON_REFUSALS."""
    return F.struct(*(_as_written(f()).alias(c) for c, f in zip(JSON_REFUSALS, (dropped_text, shadowed_properties))))


def xml_reasons() -> Column:
    """struct of a location array for each of XML_REFUSALS but the markup of narratives, which needs a parser."""
    found = {
        "DROPPED_ELEMENT_TEXT": dropped_text(), "UNSERIALIZABLE_ELEMENT_NAME": _names(), "UNSERIALIZABLE_JSON_ONLY_SHAPE": _json_only(), "UNSERIALIZABLE_ARRAY_WRAPPER": unspellable_xml_wrappers(),
        "UNSERIALIZABLE_SHADOWED_PROPERTY": shadowed_properties(), "UNSERIALIZABLE_RESOURCE_TYPE": _types(),
    }
    return F.struct(*(_as_written(v).alias(k) for k, v in found.items()))


def narratives() -> Column:
    """struct(loc, lex) of what is written as markup."""
    found = _written(F.filter(nodes(), lambda n: (n["name"] == "div") & (n["kind"] == "primitive") & (n["vtype"] == "string")))
    return F.transform(found, lambda n: F.struct(F.regexp_replace(n["loc"], r"\A\$this(?=\.|\z)", "Resource").alias("loc"), n["lex"].alias("lex")))


def first_reason(order: tuple[str, ...], at) -> tuple[Column, Column]:
    """(code, locations) of the first reason that has any; `at` gives the locations of a code."""
    holds = [(c, at(c)) for c in order]
    return F.coalesce(*(F.when(F.size(x) > 0, c) for c, x in holds)), F.coalesce(*(F.when(F.size(x) > 0, x) for _, x in holds))
