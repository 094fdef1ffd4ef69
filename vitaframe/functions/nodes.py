"""Reading the flattened tree: everything here is a Column over the `nodes` array of a row."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column
from pyspark.sql import functions as F


def nodes() -> Column:
    return F.col("nodes")


def at(n: Column) -> Column:
    """The node of an id: by its place, counted from the array's first node, as an entry's nodes may be cut out of a Bundle's."""
    return F.get(nodes(), n - root()["id"])


def below(parent: Column | int) -> Column:
    """The nodes under a node: its own stretch of the array. 0 is the first node: the document, or the resource that was cut out of it."""
    if isinstance(parent, int):
        return nodes()
    # looking up a node by its place costs nothing, and each lambda less is a round less of Spark's analysis
    return F.slice(nodes(), parent - root()["id"] + 2, at(parent)["last"] - parent)


#: The members of every node, in what `indexed` makes.
_MEMBERS: ContextVar[Column | None] = ContextVar("_MEMBERS", default=None)


def indexed(f: Callable[[], Column]) -> Column:
    """The Column that f makes, in which `kids` and `choice` look the members of a node up: they are gathered once for a row, instead of searched in the node's stretch of the array at every step."""
    own = lambda n: F.filter(F.slice(nodes(), n["id"] - root()["id"] + 2, n["last"] - n["id"]), lambda m: (m["parent"] == n["id"]) & ~m["meta"] & ~m["dup"])
    every = F.transform(nodes(), lambda n: F.when(n["last"] > n["id"], own(n)).otherwise(F.slice(nodes(), 1, 0)))

    def bound(members: Column) -> Column:
        token = _MEMBERS.set(members)
        try:
            return f()
        finally:
            _MEMBERS.reset(token)

    return let(every, bound)


def _members(parent: Column | int) -> Column | None:
    if (members := _MEMBERS.get()) is None:
        return None
    return F.get(members, F.lit(0) if isinstance(parent, int) else parent - root()["id"])


def kids(parent: Column | int, name: str, repeats: bool = False) -> Column:
    """The values of a property, list items one by one; with repeats=True those of later members of the same name too."""
    if not repeats and (members := _members(parent)) is not None:
        return F.filter(members, lambda n: n["name"] == name)
    owner = root()["id"] if isinstance(parent, int) else parent

    def own(n: Column) -> Column:
        it = (n["parent"] == owner) & (n["name"] == name) & ~n["meta"]
        return it if repeats else it & ~n["dup"]

    return F.filter(below(parent), own)


def root() -> Column:
    return F.get(nodes(), F.lit(0))


def top(name: str, repeats: bool = False) -> Column:
    return kids(0, name, repeats)


def has(parent: Column | int, name: str, repeats: bool = False) -> Column:
    return F.size(kids(parent, name, repeats)) > 0


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once: lambda bodies have no common subexpressions."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def text(parent: Column | int, name: str) -> Column:
    """The string of a single-valued property; null if it is absent, an array or not a string."""
    owner = root()["id"] if isinstance(parent, int) else parent
    found = F.filter(below(parent), lambda n: (n["parent"] == owner) & (n["name"] == name) & ~n["meta"] & ~n["dup"] & n["idx"].isNull() & (n["vtype"] == "string"))
    return F.get(found, F.lit(0))["lex"]


def strings(found: Column) -> Column:
    return F.transform(F.filter(found, lambda n: n["vtype"] == "string"), lambda n: n["lex"])


def each(found: Column, f: Callable[[Column], Column]) -> Column:
    """f of every node, its arrays one after another."""
    return F.flatten(F.transform(found, f))


def written_codings(concepts: Column) -> Column:
    """(system, code, loc) of every coding of the concepts whose members are written once and as strings."""
    return each(concepts, lambda c: F.transform(F.filter(kids(c["id"], "coding"), lambda d: d["kind"] == "complex"), lambda d: F.struct(text(d["id"], "system").alias("system"), text(d["id"], "code").alias("code"), d["loc"].alias("loc"))))


def lone(n: Column) -> Column:
    """Whether a node is the only item of its array; the items of an array follow one another, nulls among them."""
    after = F.get(nodes(), n["last"] + 1 - root()["id"])
    second = (after["parent"] == n["parent"]) & (after["name"] == n["name"]) & (after["idx"] == 1)
    return (n["idx"] == 0) & ~F.coalesce(second, F.lit(False))


def codings(concepts: Column, unwrap: bool = False) -> Column:
    """(system, code, loc) of every coding of the concepts: each system that it names with each code, where a name is repeated.

    A member that isn't a string counts as one without a value. unwrap reads a string out of an array of one position; of a longer one never, as its values would make pairs that nobody wrote.
    """

    def members(coding: Column, name: str) -> Column:
        first = F.filter(kids(coding["id"], name, True), lambda n: n["idx"].isNull() | (n["idx"] == 0))
        bare = lambda n: n["idx"].isNull() | lone(n) if unwrap else n["idx"].isNull()
        return F.transform(first, lambda n: F.when((n["vtype"] == "string") & bare(n), n["lex"]))

    none = F.array(F.lit(None).cast("string"))
    some = lambda x: F.when(F.size(x) > 0, x).otherwise(none)

    def pairs(coding: Column) -> Column:
        both = F.struct(members(coding, "system").alias("systems"), members(coding, "code").alias("codes"), coding["loc"].alias("loc"))
        return let(both, lambda p: F.flatten(F.transform(some(p["systems"]), lambda s: F.transform(some(p["codes"]), lambda c: F.struct(s.alias("system"), c.alias("code"), p["loc"].alias("loc"))))))

    return each(concepts, lambda c: each(F.filter(kids(c["id"], "coding", True), lambda d: d["kind"] == "complex"), pairs))


def has_coding(concepts: Column, system: str | None, code: str, unwrap: bool = False) -> Column:
    return F.exists(codings(concepts, unwrap), lambda c: (c["code"] == code) & (c["system"] == system if system else F.lit(True)))


def choice(parent: Column | int, base: str) -> Column:
    """The values of any variant of a choice element."""
    if (members := _members(parent)) is not None:
        return F.filter(members, lambda n: n["name"].rlike(rf"\A{base}[A-Z]"))
    owner = root()["id"] if isinstance(parent, int) else parent
    return F.filter(below(parent), lambda n: (n["parent"] == owner) & n["name"].rlike(rf"\A{base}[A-Z]") & ~n["dup"] & ~n["meta"])


def locations(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda n: n["loc"]))


def roots() -> Column:
    """The document's root and every nested resource, as the readers mark them."""
    return F.filter(nodes(), lambda n: (n["id"] == 0) | n["res"])


def outside(found: Column, owners: Column) -> Column:
    """Those of the nodes found that are neither one of the owners nor under one."""
    return let(owners, lambda o: F.filter(found, lambda n: ~F.exists(o, lambda a: (n["id"] >= a["id"]) & (n["id"] <= a["last"]))))


def metadata() -> Column:
    """The extensions of primitives."""
    return F.filter(nodes(), lambda n: n["meta"])


def element(n: Column) -> Column:
    """A location without the item's own index."""
    return F.when(n["idx"].isNotNull(), F.regexp_replace(n["loc"], r"\[[0-9]+\]\z", "")).otherwise(n["loc"])


def finding(code: str, severity: str, at: Column, constraint: str | None = None) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), at.alias("expression"), F.lit(constraint).cast("string").alias("constraint"))


FINDINGS = "array<struct<code:string,severity:string,expression:string,constraint:string>>"


def findings(*parts: tuple[Column, Column]) -> Column:
    """The findings whose condition holds, in order: (condition, finding) pairs."""
    return F.filter(F.array(*(F.when(c, f) for c, f in parts)), lambda f: f.isNotNull()).cast(FINDINGS)


def at_each(found: Column, code: str, severity: str) -> Column:
    """A finding for every location."""
    return F.transform(found, lambda loc: finding(code, severity, loc)).cast(FINDINGS)
