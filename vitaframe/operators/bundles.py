"""Bundles: entries as rows, references resolved by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nodes import FINDINGS, finding, findings, kids, nodes, text, top
from ..functions.scalars import parse_reference

#: Steps of a path through contained resources before it counts as a cycle.
MAX_STEPS = 512


def processing() -> Column:
    """How a Bundle's entries hang together: atomic, independent or none."""
    kind = text(0, "type")
    return F.when(kind == "transaction", "atomic").when(kind == "batch", "independent").otherwise("none")


def one_by_one(rows: DataFrame, items: Column, name: str, *keys: str) -> DataFrame:
    """keys, and each item of an array of structs by itself, null items left out. A plain explode has Spark filter the rows by the array's size before, for which the array is made a second time."""
    return rows.select(*keys, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def _per_entry(bundles: DataFrame, *keys: str) -> DataFrame:
    """keys, entry and the nodes of that entry alone, so that what follows reads short arrays whatever a Bundle's length; a lone entry that isn't in an array is none."""
    listed = F.filter(top("entry"), lambda n: n["idx"].isNotNull() & (n["kind"] == "complex"))
    cut = F.transform(listed, lambda e: F.struct(e["idx"].alias("entry"), F.slice(nodes(), e["id"] + 1, e["last"] - e["id"] + 1).alias("nodes")))
    return one_by_one(bundles.where("resource_type = 'Bundle'"), cut, "e", *keys).select(*keys, "e.entry", "e.nodes").withColumn("own", F.get("nodes", F.lit(0))).withColumn("r", F.get(F.filter(kids(F.col("own.id"), "resource"), lambda n: n["kind"] == "complex"), F.lit(0)))


def readout() -> Column:
    """struct(type, processing, total, links): what a Bundle says of itself; the total as it is written."""
    total = F.get(F.filter(top("total"), lambda n: n["vtype"] == "decimal"), F.lit(0))["lex"]
    links = F.transform(F.filter(top("link"), lambda n: n["kind"] == "complex"), lambda n: F.struct(text(n["id"], "relation").alias("relation"), text(n["id"], "url").alias("url")))
    return F.struct(text(0, "type").alias("type"), processing().alias("processing"), total.alias("total"), links.alias("links"))


def entries(bundles: DataFrame, *keys: str) -> DataFrame:
    """keys, entry (index), full_url, type, id, first and last node of each entry's resource, search_mode, request_method and request_url."""
    part = lambda name, member: text(F.get(kids(F.col("own.id"), name), F.lit(0))["id"], member)
    return _per_entry(bundles, *keys).select(
        *keys, "entry", text(F.col("own.id"), "fullUrl").alias("full_url"), F.col("r.rtype").alias("type"), text(F.col("r.id"), "id").alias("id"), F.col("r.id").alias("first"), F.col("r.last").alias("last"),
        part("search", "mode").alias("search_mode"), part("request", "method").alias("request_method"), part("request", "url").alias("request_url"),
    )


def _references() -> Column:
    """The reference strings of an entry's resource."""
    return F.filter(nodes(), lambda n: (n["id"] > F.col("r.id")) & (n["name"] == "reference") & (n["vtype"] == "string") & ~n["dup"] & ~n["meta"])


def references(bundles: DataFrame, *keys: str) -> DataFrame:
    """keys, entry, expression, reference (parsed as `r`) and the ids contained beside it, for every reference of an entry's resource."""
    contained = F.transform(kids(F.col("r.id"), "contained"), lambda c: text(c["id"], "id"))
    rows = _per_entry(bundles, *keys).select(*keys, "entry", contained.alias("contained"), F.explode(_references()).alias("x"))
    return rows.select(*keys, "entry", F.col("x.loc").alias("expression"), F.col("x.lex").alias("reference"), "contained").withColumn("r", parse_reference(F.col("reference")))


#: A name that leads to an entry, or a reference that it makes.
_SAID = "struct<name:string,at:int,expression:string,reference:string>"


def _said(bundles: DataFrame, *keys: str) -> DataFrame:
    """keys, entry, held (the contained resources of the entry), own (its node and its resource's, r) and said: its names and references."""
    held = F.transform(F.filter(kids(F.col("r.id"), "contained"), lambda c: c["kind"] == "complex"), lambda c: F.struct(text(c["id"], "id").alias("id"), c["idx"].alias("idx")))
    e = _per_entry(bundles, *keys).withColumn("held", held).withColumn("full_url", text(F.col("own.id"), "fullUrl")).withColumn("rid", text(F.col("r.id"), "id"))
    url, e = F.col("url"), e.withColumn("url", parse_reference(F.col("full_url")))
    named = lambda kind, id_: F.concat(F.lit("n:"), kind, F.lit("/"), id_)
    names = F.array(F.concat(F.lit("u:"), "full_url"), named(url["type"], url["id"]), named(F.col("r.rtype"), F.col("rid")))
    none = F.lit(None).cast("string")
    told = F.transform(F.filter(names, lambda n: n.isNotNull() & F.col("r.id").isNotNull()), lambda n: F.struct(n.alias("name"), F.lit(None).cast("int").alias("at"), none.alias("expression"), none.alias("reference")))
    asked = F.transform(_references(), lambda n: F.struct(none.alias("name"), n["id"].alias("at"), n["loc"].alias("expression"), n["lex"].alias("reference")))
    return e.withColumn("said", F.concat(told.cast(f"array<{_SAID}>"), asked.cast(f"array<{_SAID}>")))


def _resolved(said: DataFrame, *keys: str) -> DataFrame:
    """Of (keys, entry, held, x): keys, entry, at, expression, reference, kind, status, target, contained of every reference. Names and references of a Bundle meet by name in one exchange, a reference by its url and by its type and id; then both answers meet."""
    r = F.col("r")
    asks = F.col("x.name").isNull()
    named = F.concat(F.lit("n:"), r["type"], F.lit("/"), r["id"])
    ways = F.when(asks, F.array(F.concat(F.lit("u:"), "x.reference"), F.coalesce(named, F.lit("-")))).otherwise(F.array("x.name"))
    inside = F.get(F.filter("held", lambda h: h["id"] == F.col("r.id")), F.lit(0))
    rows = said.withColumn("r", parse_reference(F.col("x.reference"))).select(*keys, "entry", "x", asks.alias("asks"), r["kind"].alias("kind"), F.when(r["kind"] == "fragment", inside["idx"]).alias("contained"), ((r["id"] == "") | inside["id"].isNotNull()).alias("inside"), F.posexplode(ways).alias("way", "name"))
    first = F.min(F.when(~F.col("asks"), F.col("entry"))).over(Window.partitionBy(*keys, "name"))
    asked = rows.withColumn("_first", first).where("asks")
    by = lambda way: F.min(F.when(F.col("way") == way, F.col("_first")))
    part = lambda c, name: F.first(c).alias(name)
    both = asked.groupBy(*keys, "entry", F.col("x.at").alias("at")).agg(by(0).alias("_url"), by(1).alias("_named"), part("x.expression", "expression"), part("x.reference", "reference"), part("kind", "kind"), part("inside", "inside"), part("contained", "contained"))
    kind, hit = F.col("kind"), F.col("_named").isNotNull()
    status = F.when(kind == "fragment", F.when(F.col("inside"), "resolved").otherwise("unresolved")).when(kind == "relative", F.when(hit, "resolved").otherwise("unresolved")).when(F.col("_url").isNotNull() | hit, "resolved").otherwise("external")
    target = F.when(kind == "fragment", F.col("entry")).when(kind == "relative", F.col("_named")).otherwise(F.coalesce("_url", "_named"))
    return both.withColumn("status", status).withColumn("target", F.when(status == "resolved", target))


def resolve(bundles: DataFrame, *keys: str) -> DataFrame:
    """keys, entry, expression, reference, kind, `status` (resolved, unresolved or external), `target`, the entry that a reference leads to, and `contained`.

    The target is the first of the entries that the reference's url or its type and id name. A fragment's target is its own entry, and `contained` the place of the resource there that it names (none for the resource itself). Documents are read once: names and references of a Bundle meet in one exchange.
    """
    rows = one_by_one(_said(bundles, *keys), F.col("said"), "x", *keys, "entry", "held")
    return _resolved(rows, *keys).select(*keys, "entry", "expression", "reference", "kind", "status", "target", F.when(F.col("status") == "resolved", F.col("contained")).alias("contained"))


def resolve_alone(resources: DataFrame, *keys: str) -> DataFrame:
    """keys, expression, reference, kind, status and contained of the references of resources that stand in no Bundle: only fragments lead anywhere; a relative one is unresolved, any other external."""
    held = F.filter(top("contained"), lambda c: c["kind"] == "complex")
    refs = F.filter(nodes(), lambda n: (n["name"] == "reference") & (n["vtype"] == "string") & ~n["dup"] & ~n["meta"])
    ids = F.transform(held, lambda c: F.struct(text(c["id"], "id").alias("id"), c["idx"].alias("idx")))
    both = resources.where("resource_type is not null and resource_type <> 'Bundle'").select(*keys, ids.alias("held"), refs.alias("refs"))
    rows = both.select(*keys, "held", F.explode("refs").alias("x")).withColumn("r", parse_reference(F.col("x.lex")))
    hit = F.get(F.filter("held", lambda h: h["id"] == F.col("r.id")), F.lit(0))
    kind = F.col("r.kind")
    status = F.when(kind == "fragment", F.when((F.col("r.id") == "") | hit["id"].isNotNull(), "resolved").otherwise("unresolved")).when(kind == "relative", "unresolved").otherwise("external")
    return rows.select(*keys, F.col("x.loc").alias("expression"), F.col("x.lex").alias("reference"), kind.alias("kind"), status.alias("status"), F.when(kind == "fragment", hit["idx"]).alias("contained"))


def unresolved(bundles: DataFrame, *keys: str) -> DataFrame:
    return resolve(bundles, *keys).where("status = 'unresolved'").select(*keys, "expression", F.lit("REFERENCE_UNRESOLVED").alias("code"), F.lit("warning").alias("severity"))


def full_url_mismatches(bundles: DataFrame, *keys: str) -> DataFrame:
    """Entries whose RESTful fullUrl names another id than their resource has."""
    url = parse_reference(F.col("full_url"))
    wrong = url["kind"].isin("relative", "absolute") & (url["id"] != F.col("id"))
    return entries(bundles, *keys).where(wrong).select(*keys, F.concat(F.lit("Bundle.entry["), "entry", F.lit("].fullUrl")).alias("expression"), F.lit("FULLURL_ID_MISMATCH").alias("code"), F.lit("error").alias("severity"))


def contained_links() -> Column:
    """(from, to) of the fragment references between a resource ("") and those it contains."""
    inside = F.filter(top("contained"), lambda n: n["kind"] == "complex")
    refs = F.filter(nodes(), lambda n: (n["name"] == "reference") & n["lex"].startswith("#") & ~n["meta"])

    def link(n: Column) -> Column:
        owner = F.get(F.filter(inside, lambda c: (n["id"] > c["id"]) & (n["id"] <= c["last"])), F.lit(0))
        return F.struct(F.when(owner["id"].isNull(), "").otherwise(F.coalesce(text(owner["id"], "id"), owner["loc"])).alias("a"), F.substring(n["lex"], 2, 1 << 20).alias("b"))

    ids = F.concat(F.array(F.lit("")), F.transform(inside, lambda c: text(c["id"], "id")))
    return F.filter(F.transform(refs, link), lambda x: F.array_contains(ids, x["b"]))


def contained_cycle() -> Column:
    """Whether contained resources lead back to themselves: links to what leads nowhere are taken away, round by round; what stays is a cycle."""
    links = contained_links()
    rounds = F.sequence(F.lit(1), F.least(F.size(links) + 1, F.lit(MAX_STEPS)))
    left = F.aggregate(rounds, links, lambda acc, _: F.filter(acc, lambda x: F.exists(acc, lambda y: y["a"] == x["b"])))
    return F.coalesce(F.size(left) > 0, F.lit(False))


def bundle_findings(bundles: DataFrame, *keys: str) -> DataFrame:
    """keys, and the findings of each Bundle in one array, entry by entry: fullUrl and id, contained cycles, unresolved references. Documents are read once."""
    url = parse_reference(F.col("full_url"))
    wrong = url["kind"].isin("relative", "absolute") & (url["id"] != F.col("rid"))
    at = lambda tail: F.concat(F.lit("Bundle.entry["), F.col("entry"), F.lit(tail))
    alone = F.slice("nodes", F.col("r.id") - F.col("own.id") + 1, F.col("r.last") - F.col("r.id") + 1)
    rows = _said(bundles, *keys).withColumn("wrong", F.coalesce(wrong, F.lit(False)))
    # from here on the nodes are the resource's alone
    rows = rows.withColumn("nodes", F.when(F.col("r.id").isNotNull(), alone)).withColumn("cyclic", F.coalesce(contained_cycle(), F.lit(False)))
    own = findings((F.col("wrong"), finding("FULLURL_ID_MISMATCH", "error", at("].fullUrl"))), (F.col("cyclic"), finding("CONTAINED_CYCLE", "error", at("].resource.contained"))))
    # an entry's own findings go through the same exchanges, as a reference of no name at its very beginning
    mark = F.when(F.size("own_findings") > 0, F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit(-1).alias("at"), F.to_json("own_findings").alias("expression"), F.lit(None).cast("string").alias("reference"))))
    x = F.concat(F.coalesce(mark, F.array()).cast(f"array<{_SAID}>"), "said")
    each = _resolved(one_by_one(rows.withColumn("own_findings", own), x, "x", *keys, "entry", "held"), *keys)
    loose = F.array(finding("REFERENCE_UNRESOLVED", "warning", F.col("expression"))).cast(FINDINGS)
    f = F.when(F.col("at") < 0, F.from_json("expression", FINDINGS)).when(F.col("status") == "unresolved", loose)
    rows = each.withColumn("f", f).where("size(f) > 0")
    ordered = F.array_sort(F.collect_list(F.struct("entry", "at", "expression", "f")))
    return rows.groupBy(*keys).agg(F.flatten(F.transform(ordered, lambda y: y["f"])).cast(FINDINGS).alias("bundle_findings"))
