"""XML resources as the same rows as JSON ones. A document type is refused; values are strings.

The parser keeps tags as they are written and namespaces are resolved here, with a
scope of prefixes for each element: an element of its parent's namespace goes by its
local name, any other by its tag, so that foreign content never passes for a FHIR
element of the same local name; a prefix that nothing binds is kept as text. Both
are reported. The narrative is the XHTML div in whatever spelling. It is written
anew from its elements, with the declarations that it took from around it, in the
order of their prefixes; comments and processing instructions go.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .refusals import XML_REFUSALS, first_reason, narratives, xml_reasons
from .resource_json import MAX_DEPTH, REASONS, WITHHELD, _ELEMENT, _TYPE, Fatal, _Tree, reader, utf16_units

FHIR = "http://hl7.org/fhir"
XHTML = "http://www.w3.org/1999/xhtml"
_DIVS, _BAD_DIVS = "_refusal_divs", "_refused_divs"
#: The one prefix that is bound without a declaration.
_XML = {"xml": "http://www.w3.org/XML/1998/namespace"}


class _Element:
    """A tag and attributes as they are written, and its content: elements and strings."""

    __slots__ = ("tag", "attributes", "content")

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes, self.content = tag, attributes, []

    def text(self) -> str:
        return "".join(c for c in self.content if isinstance(c, str))


class _Scoped(NamedTuple):
    element: _Element
    scope: dict[str, str]
    ns: str
    #: What it is called in the tree, and whether it is of another vocabulary than its parent.
    name: str
    foreign: bool
    narrative: bool


def _declared(attribute: str) -> str | None:
    """The prefix that an attribute declares, "" for the default namespace; None for any other attribute."""
    return "" if attribute == "xmlns" else attribute[6:] if attribute.startswith("xmlns:") else None


def _scoped(e: _Element, around: dict[str, str], ns: str) -> _Scoped:
    scope = around
    for k, v in e.attributes.items():
        prefix = _declared(k)
        if prefix is not None:
            scope = dict(scope) if scope is around else scope
            scope.pop(prefix, None)
            if v:
                scope[prefix] = v
    prefix, colon, local = e.tag.rpartition(":") if e.tag.count(":") < 2 else ("", ":", "")
    bound = scope.get(prefix) if prefix or not colon else None
    if colon and (bound is None or not local):
        return _Scoped(e, scope, "", e.tag, True, False)
    own = bound or ""
    narrative = local == "div" and own == XHTML
    return _Scoped(e, scope, own, local if own == ns or narrative else e.tag, own != ns, narrative)


def parse(text: str) -> _Element:
    """The element tree; DOCTYPE, CDATA, unknown entities and nesting beyond the bound are refused, at the place where they stand."""
    data = text.encode("utf-8", "surrogatepass")
    p = expat.ParserCreate("utf-8")
    stack: list[_Element] = []
    root: list[_Element] = []

    def place(at: int) -> int:
        return utf16_units(data[: max(at, 0)].decode("utf-8", "ignore"))

    def refuse(code: str):
        def handler(*_):
            raise Fatal(code, place(p.CurrentByteIndex))

        return handler

    def start(tag, attributes):
        if len(stack) >= MAX_DEPTH:
            raise Fatal("MAX_DEPTH_EXCEEDED", place(p.CurrentByteIndex))
        e = _Element(tag, attributes)
        if stack:
            stack[-1].content.append(e)
        else:
            root.append(e)
        stack.append(e)

    def chars(s):
        if stack:
            stack[-1].content.append(s)

    p.buffer_text = True
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, lambda _: stack.pop(), chars
    def doctype(*_):
        raise Fatal("DTD_FORBIDDEN", place(data.rfind(b"<!DOCTYPE", 0, p.CurrentByteIndex + 1)))

    p.StartDoctypeDeclHandler, p.StartCdataSectionHandler = doctype, refuse("MALFORMED_XML")
    try:
        p.Parse(data, True)
    except expat.ExpatError as e:
        code = expat.errors.codes.get(expat.errors.XML_ERROR_UNDEFINED_ENTITY)
        raise Fatal("UNDEFINED_ENTITY" if e.code == code else "MALFORMED_XML", place(p.ErrorByteIndex)) from None
    return root[0]


_IN_TEXT = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;"})
_IN_VALUE = str.maketrans({"&": "&amp;", "<": "&lt;", '"': "&quot;"})


def _open_tag(e: _Element, more: str = "") -> str:
    return f"<{e.tag}" + "".join(f' {k}="{v.translate(_IN_VALUE)}"' for k, v in e.attributes.items()) + more


def _needed(e: _Element) -> set[str]:
    """Prefixes that an element and what is in it use and don't declare; "" for the default namespace."""
    out: set[str] = set()
    todo = [(e, frozenset())]
    while todo:
        x, known = todo.pop()
        known = known | {d for k in x.attributes if (d := _declared(k)) is not None}
        used = {x.tag.partition(":")[0] if ":" in x.tag else ""}
        used |= {k.partition(":")[0] for k in x.attributes if ":" in k and _declared(k) is None}
        out |= used - known
        todo += [(c, known) for c in x.content if isinstance(c, _Element)]
    return out


def narrative(e: _Element, scope: dict[str, str]) -> str:
    """The markup of a narrative by itself."""
    fix = "".join(f' xmlns{":" if k else ""}{k}="{scope[k].translate(_IN_VALUE)}"' for k in sorted(_needed(e) & set(scope) - {"xml"}))
    out: list[str] = []
    # what is still to be written, from the end
    todo: list[tuple[_Element | str, str]] = [(e, fix)]
    while todo:
        x, more = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.content:
            out.append(f"{_open_tag(x, more)}/>")
        else:
            out.append(f"{_open_tag(x, more)}>")
            todo.append((f"</{x.tag}>", ""))
            todo += [(c if isinstance(c, _Element) else c.translate(_IN_TEXT), "") for c in reversed(x.content)]
    return "".join(out)


def _attribute_at(loc: str, name: str) -> str:
    return f"{loc}.@{name if _ELEMENT.match(name) else WITHHELD}"


def _children(s: _Scoped) -> list[_Scoped]:
    return [_scoped(c, s.scope, s.ns) for c in s.element.content if isinstance(c, _Element)]


def _complex(t: _Tree, s: _Scoped, parent: int, depth: int, name: str, idx, loc: str, resource: bool, meta: bool = False) -> None:
    e = s.element
    n = t.open(parent, depth, name, idx, loc, "complex", meta=meta)
    if resource:
        n["rtype"], n["res"] = s.name, True
        if parent < 0:
            loc = n["loc"] = s.name if _TYPE.match(s.name) else WITHHELD
        t.close(t.open(n["id"], depth + 1, "resourceType", None, f"{loc}.resourceType", "primitive", vtype="string", lex=s.name))
    for k, v in e.attributes.items():
        if k in ("id", "url"):
            t.open(n["id"], depth + 1, k, None, f"{loc}.{k}", "primitive", vtype="string", lex=v)
        elif _declared(k) is None:
            t.issue("UNKNOWN_PROPERTY", _attribute_at(loc, k))
    if e.text().strip():
        t.issue("UNEXPECTED_XML_CONTENT", loc)
        t.open(n["id"], depth + 1, "", None, loc, "text")
    groups: dict[str, list[_Scoped]] = {}
    for c in _children(s):
        groups.setdefault(c.name, []).append(c)
    places = {tag: f"{loc}.{tag if _ELEMENT.match(tag) else WITHHELD}" for tag in groups}
    for tag, items in groups.items():
        if len({(c.element.tag, c.ns) for c in items}) > 1:
            t.issue("MIXED_XML_SPELLING", places[tag])
    for tag, items in groups.items():
        many, at = len(items) > 1, places[tag]
        for i, c in enumerate(items):
            _child(t, c, n["id"], depth + 1, tag, i if many else None, f"{at}[{i}]" if many else at)
    t.close(n)


def _child(t: _Tree, c: _Scoped, parent: int, depth: int, name: str, idx, loc: str) -> None:
    if c.foreign and not c.narrative:
        t.issue("UNEXPECTED_XML_CONTENT", loc)
    if c.name == "div":
        t.open(parent, depth, name, idx, loc, "primitive", vtype="string", lex=narrative(c.element, c.scope))
        return
    e, below = c.element, _children(c)
    value = e.attributes.get("value")
    if value is None and len(below) == 1 and below[0].name[:1].isascii() and below[0].name[:1].isupper():
        before = len(t.issues)
        if below[0].foreign:
            t.issue("UNEXPECTED_XML_CONTENT", loc)
        mine = len(t.nodes)
        _complex(t, below[0], parent, depth, name, idx, loc, True)
        if e.text().strip():
            if not any(i["code"] == "UNEXPECTED_XML_CONTENT" and i["expression"] == loc for i in t.issues[before:]):
                t.issue("UNEXPECTED_XML_CONTENT", loc)
            t.open(mine, depth + 1, "", None, loc, "text")
            t.close(t.nodes[mine])
        return
    others = [x for x in below if x.name != "extension"]
    if value is None and others:
        _complex(t, c, parent, depth, name, idx, loc, False)
        return
    for x in others:
        t.issue("UNKNOWN_PROPERTY", f"{loc}.{x.name if _ELEMENT.match(x.name) else WITHHELD}")
    p = t.open(parent, depth, name, idx, loc, "primitive", vtype=None if value is None else "string", lex=value)
    p["elem_id"] = e.attributes.get("id")
    for i, x in enumerate(x for x in below if x.name == "extension"):
        at = f"{loc}.extension[{i}]"
        if x.foreign:
            t.issue("UNEXPECTED_XML_CONTENT", at)
        _complex(t, x, p["id"], depth + 1, "extension", i, at, False, meta=True)
    for k in e.attributes:
        if k not in ("id", "value") and _declared(k) is None:
            t.issue("UNKNOWN_PROPERTY", _attribute_at(loc, k))
    if e.text().strip():
        t.issue("UNEXPECTED_XML_CONTENT", loc)
        t.open(p["id"], depth + 1, "", None, loc, "text", meta=True)
    t.close(p)


def flatten(text: str | None) -> tuple:
    if text is None:
        return None, [], [], None, None, None
    try:
        s = _scoped(parse(text), _XML, FHIR)
        t = _Tree()
        if s.foreign and (s.ns or ":" in s.name):
            t.issue("UNEXPECTED_XML_CONTENT", s.name if _TYPE.match(s.name) else WITHHELD)
        _complex(t, s, -1, 0, "", None, "$this", True)
        return s.name, t.nodes, t.issues, None, None, None
    except Fatal as f:
        return None, [], [], f.code, f.offset, f.at


def read_xml(docs: DataFrame, text: str = "raw", mode: str = "PERMISSIVE") -> DataFrame:
    """docs with the XML of `text` replaced by resource_type, nodes, read_issues, fatal and its place; mode FAILFAST: such a document ends the job instead."""
    return reader(docs, text, flatten, mode)


def canonical(nodes: Column) -> Column:
    """What two spellings of a resource share, node by node in document order.

    A node is its depth, name and kind, its written value, its id, what could not be modelled, and whether it is a later member of a repeated name or metadata. An array's only item is its item; the type of a value isn't compared, as XML has none.
    """
    return F.transform(nodes, lambda n: F.struct(n["depth"].alias("depth"), n["name"].alias("name"), F.coalesce(n["idx"], F.lit(0)).alias("item"), n["kind"].alias("kind"), n["lex"].alias("lex"), n["elem_id"].alias("elem_id"), n["src"].alias("src"), n["dup"].alias("dup"), n["meta"].alias("meta")))


def equivalent(a: Column, b: Column) -> Column:
    """Whether two trees say the same: content, order, repeated members and marks; a list of one is its item at any depth."""
    return canonical(a).eqNullSafe(canonical(b))


_ESCAPES = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "\t": "&#9;", "\n": "&#10;", "\r": "&#13;"})


def _attribute(name: str, value: str | None) -> str:
    return "" if value is None else f' {name}="{value.translate(_ESCAPES)}"'


def _is_div(markup: str) -> bool:
    """Whether a narrative is one well-formed div element and nothing else."""
    try:
        s = _scoped(parse(markup), _XML, XHTML)
        return s.name == "div" and not (s.foreign and s.ns) and markup.startswith("<") and not markup.startswith(("<?", "<!")) and markup.endswith(">")
    except Fatal:
        return False


def render(nodes: list) -> str:
    """XML of a flattened tree, in one pass over its pre-order; a document without a type is a Resource."""
    out: list[str] = []
    open_: list[tuple[int, str]] = []  # last node of an element that is still open, and what closes it
    attributes = {}  # ids of a complex element, and urls of an extension, are written with its start tag
    for n in nodes:
        owner = nodes[n["parent"]] if n["parent"] >= 0 else None
        if n["name"] == "id" and n["kind"] == "primitive" and not n["meta"] and owner["rtype"] is None or n["name"] == "url" and n["kind"] == "primitive" and owner["name"] in ("extension", "modifierExtension"):
            attributes.setdefault(owner["id"], {})[n["name"]] = n["lex"]
    for n in nodes:
        while open_ and open_[-1][0] < n["id"]:
            out.append(open_.pop()[1])
        if n["name"] == "resourceType" or n["name"] in attributes.get(n["parent"], {}):
            continue
        name = n["name"]
        if n["kind"] == "primitive":
            if name == "div" and n["vtype"] == "string":
                out.append(n["lex"])
                continue
            start = f"<{name}{_attribute('id', n['elem_id'])}{_attribute('value', n['lex'])}"
            closing = f"</{name}>"
        elif n["rtype"] is not None:
            root = n["parent"] < 0
            start = f'<{n["rtype"]} xmlns="{FHIR}"' if root else f"<{name}><{n['rtype']}"
            closing = f"</{n['rtype']}>" + ("" if root else f"</{name}>")
        else:
            own = attributes.get(n["id"], {})
            name = name if n["parent"] >= 0 else "Resource"
            start = f"<{name}" + (f' xmlns="{FHIR}"' if n["parent"] < 0 else "") + f"{_attribute('id', own.get('id'))}{_attribute('url', own.get('url'))}"
            closing = f"</{name}>"
        if n["last"] == n["id"]:
            out.append(f"{start}/>" if n["rtype"] is None else f"{start}>{closing}")
        else:
            out.append(f"{start}>")
            open_.append((n["last"], closing))
    out += [c for _, c in reversed(open_)]
    return "".join(out)


def write_xml(resources: DataFrame, name: str = "xml") -> DataFrame:
    """Adds the XML of `nodes`; where XML can't say what the tree holds there is none, but `refusal`, the first of XML_REFUSALS that applies, and `refusal_locations`, where."""
    reasons = [c for c in XML_REFUSALS if c != "UNSERIALIZABLE_DIV_MARKUP"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trees, why, divs = (b.column(b.schema.get_field_index(c)) for c in ("nodes", REASONS, _DIVS))
            bad = [[d["loc"] for d in row or () if not _is_div(d["lex"])] for row in divs.to_pylist()]
            free = [not x and not any((r or {}).values()) for x, r in zip(bad, why.to_pylist())]
            out = [render(t) if ok and (t := trees[i].as_py()) else None for i, ok in enumerate(free)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bad, pa.list_(pa.string())), pa.array(out, pa.string())], names=[*b.schema.names, _BAD_DIVS, name])

    ready = resources.withColumns({REASONS: xml_reasons(), _DIVS: narratives()})
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema.fields)
    written = ready.mapInArrow(run, f"{ddl}, `{_BAD_DIVS}` array<string>, `{name}` string")
    code, where = first_reason(XML_REFUSALS, lambda c: F.col(REASONS)[c] if c in reasons else F.array_distinct(_BAD_DIVS))
    return written.withColumns({"refusal": code, "refusal_locations": where}).drop(REASONS, _DIVS, _BAD_DIVS)
