"""JSON resources as rows: one row per document with its loss-free, flattened tree.

Only the flattening is Python (an Arrow batch at a time); every later step is a
Column expression, a join or an aggregation over the `nodes` array. A node's
descendants are those with id in (id, last]; its children have parent = id.
Items of a JSON array are children with `idx`; a primitive's metadata (`_x`)
are `meta` children of it and its `elem_id`. Numbers keep their written form.
A node with a type of its own, the document's or a nested resource's, is marked
`res`. A string with a lone surrogate, which no column can hold, has U+FFFD in its
place and its JSON source in `src`; metadata that isn't an object is kept in `src`
of its primitive, behind `META`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import Decimal
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 256
#: Bytes of text after which the trees so far are handed to Spark.
BATCH_BYTES = 4 << 20
#: Bytes of text whose trees are turned into columns together, while they are in the CPU's cache.
_COLUMN_BYTES = 1 << 17
#: What stands before the source of metadata that could not be modelled.
META = "_:"
WITHHELD = "<withheld>"
#: A column of writers, gone when they are done.
REASONS = "_refusal_reasons"
NODE = "struct<id:int,last:int,parent:int,depth:int,name:string,idx:int,meta:boolean,dup:boolean,loc:string,kind:string,vtype:string,lex:string,elem_id:string,src:string,rtype:string,res:boolean>"
ISSUE = "struct<code:string,severity:string,expression:string>"
SCHEMA = f"resource_type string, nodes array<{NODE}>, read_issues array<{ISSUE}>, fatal string, fatal_offset long, fatal_expression string"
_ARROW_NODE = pa.struct([("id", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("name", pa.string()), ("idx", pa.int32()), ("meta", pa.bool_()), ("dup", pa.bool_()), ("loc", pa.string()), ("kind", pa.string()), ("vtype", pa.string()), ("lex", pa.string()), ("elem_id", pa.string()), ("src", pa.string()), ("rtype", pa.string()), ("res", pa.bool_())])
_ARROW_ISSUE = pa.struct([("code", pa.string()), ("severity", pa.string()), ("expression", pa.string())])
_FIELDS = tuple(f.name for f in _ARROW_NODE)
_ELEMENT = re.compile(r"[a-z][A-Za-z0-9]{0,63}\Z")
_TYPE = re.compile(r"[A-Z][A-Za-z]{0,63}\Z")


class Members(list):
    """An object's members in written order, repeats included."""


class Number(str):
    """A number as it was written."""


class Fatal(Exception):
    """A document that can't be read: its code and where, as an offset in UTF-16 units or the location of an element; never a value."""

    def __init__(self, code: str, offset: int | None = None, at: str | None = None) -> None:
        super().__init__(code)
        self.code, self.offset, self.at = code, offset, at


def _no_constant(_: str) -> None:
    raise ValueError


_SPACES = re.compile(r"[ \t\n\r]*")
_DECODER = json.JSONDecoder(object_pairs_hook=Members, parse_float=Number, parse_int=Number, parse_constant=_no_constant, strict=True)


def decode(text: str):
    """Strict JSON; a byte-order mark, other white space and trailing content are refused, at their place."""
    try:
        value, end = _DECODER.raw_decode(text, _SPACES.match(text).end())
    except (RecursionError, ValueError):
        raise fault(text) from None
    if text[end:].strip(" \t\n\r") or text.count("{") + text.count("[") > MAX_DEPTH and _deep(value):
        raise fault(text)
    return value


def utf16_units(s: str) -> int:
    return len(s) if s.isascii() else len(s) + sum(c > "\uffff" for c in s)


_PLAIN = re.compile(r'[^"\\\x00-\x1f]*')
_HEX = re.compile(r"[0-9a-fA-F]{4}")
_DIGITS = re.compile(r"[0-9]*")


def _string_end(text: str, i: int) -> tuple[int, bool]:
    """(place after the string whose quote is at i, True), or (place of its fault, False)."""
    i += 1
    while True:
        i = _PLAIN.match(text, i).end()
        c = text[i : i + 1]
        if c == '"':
            return i + 1, True
        if c != "\\":
            return i, False
        e = text[i + 1 : i + 2]
        if not e:
            return i + 1, False
        i += 2
        if e == "u":
            if not _HEX.match(text, i):
                return i, False
            i += 4
        elif e not in '"\\/bfnrt':
            return i, False


def _number_end(text: str, i: int) -> tuple[int, bool]:
    i += text[i] == "-"
    j = i + 1 if text[i : i + 1] == "0" else _DIGITS.match(text, i).end()
    if j == i:
        return i, False
    parts = [(".", "")] if text[j : j + 1] == "." else []
    if parts:
        i, j = j + 1, _DIGITS.match(text, j + 1).end()
        if j == i:
            return i, False
    if text[j : j + 1] in ("e", "E"):
        i = j + 1 + (text[j + 1 : j + 2] in ("+", "-"))
        j = _DIGITS.match(text, i).end()
        if j == i:
            return i, False
    return j, True


def fault(text: str) -> Fatal:
    """What is wrong with a text that isn't a document, and where: read again, token by token, as the decoder doesn't keep places."""
    at = lambda i: utf16_units(text[:i])
    skip = lambda i: _SPACES.match(text, i).end()
    malformed = lambda i: Fatal("MALFORMED_JSON", at(i))
    i, open_ = skip(0), []
    value = True  # whether a value is due, or else what follows one
    while True:
        c = text[i : i + 1]
        if value:
            if len(open_) > MAX_DEPTH:
                return Fatal("MAX_DEPTH_EXCEEDED", at(i))
            if c and c in "{[":
                open_.append(c)
                i = skip(i + 1)
                if text[i : i + 1] == ("}" if c == "{" else "]"):
                    open_.pop()
                    i, value = i + 1, False
                elif c == "[":
                    continue
            elif c == '"':
                i, good = _string_end(text, i)
                if not good:
                    return malformed(i)
                value = False
            elif c and c in "-0123456789":
                i, good = _number_end(text, i)
                if not good:
                    return malformed(i)
                value = False
            else:
                word = next((w for w in ("true", "false", "null") if text.startswith(w, i)), None)
                if word is None:
                    return malformed(i)
                i, value = i + len(word), False
        if not value:
            i = skip(i)
            if not open_:
                return malformed(i)  # what follows the document, or its end if nothing is wrong
            c = text[i : i + 1]
            if c == ("}" if open_[-1] == "{" else "]"):
                open_.pop()
                i += 1
                continue
            if c != ",":
                return malformed(i)
            i = skip(i + 1)
            value = True
            if open_[-1] == "[":
                continue
        # a member's name and colon
        if text[i : i + 1] != '"':
            return malformed(i)
        i, good = _string_end(text, i)
        if not good:
            return malformed(i)
        i = skip(i)
        if text[i : i + 1] != ":":
            return malformed(i)
        i = skip(i + 1)


def _deep(value) -> bool:
    """Whether objects and arrays are nested beyond the bound; scalars count as a level of their own."""
    level, depth = [value], 0
    while level:
        if depth > MAX_DEPTH:
            return True
        below: list = []
        for x in level:
            if isinstance(x, Members):
                below += [v for _, v in x]
            elif isinstance(x, list):
                below += x
        level, depth = below, depth + 1
    return False


_LONE = re.compile(r"[\ud800-\udfff]")


def whole(s: str) -> str:
    """The string with U+FFFD in the place of lone surrogates."""
    return _LONE.sub("\ufffd", s) if _LONE.search(s) else s


def at_risk(number: str) -> bool:
    """Whether a 64-bit double, written in its shortest form, has another value or scale."""
    try:
        f = float(number)
        d = Decimal(number)
        if f in (float("inf"), float("-inf")):
            return True
        short = Decimal(repr(f))
        scale = 0 if f == int(f) and abs(f) < 1e21 else short.as_tuple().exponent
        return short != d or scale != d.as_tuple().exponent
    except (ArithmeticError, ValueError, OverflowError):
        return True


def write(value) -> str:
    """Compact JSON of a decoded value, numbers as written."""
    if isinstance(value, Members):
        return "{" + ",".join(f"{_text(k)}:{write(v)}" for k, v in value) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(write, value)) + "]"
    if isinstance(value, Number):
        return str(value)
    return _text(value) if isinstance(value, str) else json.dumps(value)


def _text(s: str) -> str:
    out = json.dumps(s, ensure_ascii=False)
    return re.sub(r"[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", out)


@lru_cache(1 << 16)
def _short_at_risk(number: str) -> bool:
    return at_risk(number)


@lru_cache(1 << 12)
def _short_name(key: str) -> tuple[str, str, str]:
    key = whole(key)
    base, side = (key[1:], "_") if key.startswith("_") and len(key) > 1 else (key, "")
    return base, side, f".{base if _ELEMENT.match(base) else WITHHELD}"


def _name(key: str) -> tuple[str, str, str]:
    """A member's name, "_" where it has the name's metadata, and its step of a location. Few names are written over and over; only short ones are kept."""
    return _short_name(key) if len(key) <= 64 else _short_name.__wrapped__(key)


class _Tree:
    def __init__(self) -> None:
        #: Dicts of the fields, or tuples of them where nothing more will be said of a node.
        self.nodes: list[dict | tuple] = []
        self.issues: list[dict] = []

    def issue(self, code: str, at: str, severity: str = "warning") -> None:
        self.issues.append({"code": code, "severity": severity, "expression": at})

    def open(self, parent: int, depth: int, name: str, idx, loc: str, kind: str, meta=False, dup=False, vtype=None, lex=None, src=None) -> dict:
        if depth > MAX_DEPTH:
            raise Fatal("MAX_DEPTH_EXCEEDED")
        at = len(self.nodes)
        # the fields of every node in the order of NODE, as columns are made of their values
        n = {"id": at, "last": at, "parent": parent, "depth": depth, "name": name, "idx": idx, "meta": meta, "dup": dup, "loc": loc, "kind": kind, "vtype": vtype, "lex": lex, "elem_id": None, "src": src, "rtype": None, "res": False}
        self.nodes.append(n)
        return n

    def close(self, n: dict) -> None:
        n["last"] = len(self.nodes) - 1

    def complex(self, members: Members, parent: int, depth: int, name: str, idx, loc: str, meta=False, dup=False) -> dict:
        n = self.open(parent, depth, name, idx, loc, "complex", meta, dup)
        plain: dict | None = {}
        for k, v in members:
            base, side, step = _short_name(k) if len(k) <= 64 else _name(k)
            if side or base in plain:
                plain = None  # metadata or a repeated name: members have to be grouped
                break
            plain[base] = step, v
        groups: dict[str, dict[str, list]] = {}
        if plain is not None:
            n["res"] = "resourceType" in plain
            own = [plain["resourceType"][1]] if n["res"] else []
        else:
            for k, v in members:
                base, side, _ = _name(k)
                groups.setdefault(base, {"": [], "_": []})[side].append(v)
            own = groups.get("resourceType", {"": []})[""]
            n["res"] = "resourceType" in groups
        if own and isinstance(own[0], str) and not isinstance(own[0], Number):
            n["rtype"] = whole(own[0])
        if parent < 0:
            loc = n["loc"] = "$this" if n["rtype"] is None else n["rtype"] if _TYPE.match(n["rtype"]) else WITHHELD
        if plain is not None:
            own_id, under, nodes = n["id"], depth + 1, self.nodes
            for base, (step, v) in plain.items():
                if type(v) is str and v.isascii() and depth < MAX_DEPTH:  # most nodes of most documents, without a call
                    at = len(nodes)
                    nodes.append((at, at, own_id, under, base, None, False, False, loc + step, "primitive", "string", v, None, None, None, False))
                elif type(v) is str or type(v) is Number:
                    self.leaf(own_id, base, None, loc + step, v, under)
                elif type(v) is Members:
                    self.complex(v, own_id, under, base, None, loc + step)
                else:
                    self.member(n, base, loc + step, [v], [], False, depth)
            self.close(n)
            return n
        for base, sides in groups.items():
            at = f"{loc}.{base if _ELEMENT.match(base) else WITHHELD}"
            if len(sides[""]) > 1 or len(sides["_"]) > 1:
                self.issue("DUPLICATE_PROPERTY", at)
            for k in range(max(len(sides[""]), len(sides["_"]))):
                value = sides[""][k : k + 1]
                side = sides["_"][k : k + 1]
                self.member(n, base, at, value, side, k > 0, depth)
        self.close(n)
        return n

    def leaf(self, parent: int, name: str, idx, at: str, v: str, depth: int, dup: bool = False) -> None:
        """A string or a number without metadata."""
        if type(v) is Number:
            self.open(parent, depth, name, idx, at, "primitive", False, dup, "decimal", str(v))
            if _short_at_risk(v) if len(v) <= 64 else at_risk(v):
                self.issue("DECIMAL_PRECISION_AT_RISK", at, "information")
            return
        p = self.open(parent, depth, name, idx, at, "primitive", False, dup, "string", v)
        if not v.isascii() and _LONE.search(v):
            p["lex"], p["src"] = whole(v), _text(v)

    def member(self, n: dict, name: str, at: str, value: list, side: list, dup: bool, depth: int) -> None:
        v, m = (value or [None])[0], (side or [None])[0]
        many = isinstance(v, list) and not isinstance(v, Members) or not value and isinstance(m, list) and not isinstance(m, Members)
        if not many:
            if isinstance(v, Members):
                self.complex(v, n["id"], depth + 1, name, None, at, dup=dup)
                if side:
                    self.issue("MISPLACED_PRIMITIVE_EXTENSION", at)
                return
            if isinstance(m, list) and not isinstance(m, Members):
                raise Fatal("PRIMITIVE_EXTENSION_MISALIGNED", at=at)
            self.primitive(n, name, None, at, bool(value), v, bool(side), m, dup, depth, False)
            return
        items = v if value else []
        first = next((x for x in items if x is not None and x != []), None)
        scalars = not isinstance(first, (Members, list))
        if side and (not isinstance(m, list) or isinstance(m, Members)):
            if scalars:
                raise Fatal("PRIMITIVE_EXTENSION_MISALIGNED", at=at)
            self.issue("MISPLACED_PRIMITIVE_EXTENSION", at)
            m, side = None, []
        metas = m if side else []
        if scalars and value and side and len(items) != len(metas):
            raise Fatal("PRIMITIVE_EXTENSION_MISALIGNED", at=at)
        if not scalars and side:
            self.issue("MISPLACED_PRIMITIVE_EXTENSION", at)
        for i in range(max(len(items), len(metas) if scalars else 0)):
            x = items[i] if i < len(items) else None
            here = f"{at}[{i}]"
            if isinstance(x, list) and not isinstance(x, Members):
                self.issue("UNKNOWN_PROPERTY", here)
                self.issue("NESTED_ARRAY", here)
                self.open(n["id"], depth + 1, name, i, here, "nested", dup=dup, src=write(x))
            elif scalars and isinstance(x, Members):
                self.issue("UNKNOWN_PROPERTY", here)
                self.open(n["id"], depth + 1, name, i, here, "foreign", dup=dup, src=write(x))
            elif scalars and not side and (type(x) is str or type(x) is Number):
                self.leaf(n["id"], name, i, here, x, depth + 1, dup)
            elif scalars:
                y = metas[i] if i < len(metas) else None
                self.primitive(n, name, i, here, bool(value), x, bool(side), y, dup, depth, True)
            elif isinstance(x, Members):
                self.complex(x, n["id"], depth + 1, name, i, here, dup=dup)
            else:
                self.issue("UNKNOWN_PROPERTY", here)
                self.open(n["id"], depth + 1, name, i, here, "foreign", dup=dup, src=write(x))

    def primitive(self, n: dict, name: str, idx, at: str, has: bool, v, has_meta: bool, m, dup: bool, depth: int, listed: bool) -> None:
        vtype = None if v is None else "decimal" if isinstance(v, Number) else "boolean" if isinstance(v, bool) else "string"
        lex = None if v is None else json.dumps(v) if isinstance(v, bool) else str(v)
        p = self.open(n["id"], depth + 1, name, idx, at, "primitive", dup=dup, vtype=vtype, lex=lex)
        if vtype == "string" and _LONE.search(lex):
            p["lex"], p["src"] = whole(lex), _text(lex)
        if vtype == "decimal" and at_risk(v):
            self.issue("DECIMAL_PRECISION_AT_RISK", at, "information")
        carried = isinstance(m, Members)
        if has and v is None and not (listed and carried):
            self.issue("UNDEFINED_JSON_NULL", at)
            p["src"] = "null"
        if has_meta and not carried and not (m is None and listed):
            self.issue("UNKNOWN_PROPERTY", at)
            if p["src"] is None:
                p["src"] = META + write(m)
        if carried:
            seen = set()
            for k, x in m:
                if k in seen:
                    self.issue("DUPLICATE_PROPERTY", at)
                elif k == "id" and isinstance(x, str) and not isinstance(x, Number):
                    p["elem_id"] = whole(x)
                elif k == "extension" and isinstance(x, list) and not isinstance(x, Members):
                    for i, e in enumerate(x):
                        if isinstance(e, Members):
                            self.complex(e, p["id"], depth + 2, "extension", i, f"{at}.extension[{i}]", meta=True)
                        else:
                            self.issue("UNKNOWN_PROPERTY", f"{at}.extension[{i}]")
                else:
                    self.issue("UNKNOWN_PROPERTY", at)
                seen.add(k)
        self.close(p)


def _as_dicts(tree: tuple) -> tuple:
    return tree[0], [x if type(x) is dict else dict(zip(_FIELDS, x, strict=True)) for x in tree[1]], *tree[2:]


def flatten(text: str | None) -> tuple:
    """(type, nodes, issues, fatal code, its offset, its location) of one document; a null text is a null row, without nodes and without a fault."""
    return _as_dicts(_flat(text))


def _flat(text: str | None) -> tuple:
    """As `flatten`, with nodes as the tree has them."""
    if text is None:
        return None, [], [], None, None, None
    try:
        value = decode(text)
        if not isinstance(value, Members):
            raise Fatal("NOT_AN_OBJECT", utf16_units(text[: _SPACES.match(text).end()]))
        t = _Tree()
        root = t.complex(value, -1, 0, "", None, "$this")
        return root["rtype"], t.nodes, t.issues, None, None, None
    except Fatal as e:
        return None, [], [], e.code, e.offset, e.at


class Unreadable(ValueError):
    """Ends a job in FAILFAST mode; says the code and the place, and nothing of the document."""


_COLUMNS = (pa.string(), pa.list_(_ARROW_NODE), pa.list_(_ARROW_ISSUE), pa.string(), pa.int64(), pa.string())
_NAMES = ("resource_type", "nodes", "read_issues", "fatal", "fatal_offset", "fatal_expression")


def _columns(rows: list) -> Iterator[pa.Array]:
    """The trees of some documents as columns: each field of all their nodes as one array, which takes a fraction of the time that rows of rows take."""
    for i, t in enumerate(_COLUMNS):
        if not pa.types.is_list(t):
            yield pa.array([r[i] for r in rows], t)
            continue
        offsets = [0]
        for r in rows:
            offsets.append(offsets[-1] + len(r[i]))
        fields = list(t.value_type)
        values = list(zip(*(x if type(x) is tuple else x.values() for x in chain.from_iterable(r[i] for r in rows)), strict=True)) or [()] * len(fields)
        items = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(values, fields, strict=True)], fields=fields)
        yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)


def parsed(batches: Iterator[pa.RecordBatch], flatten, strict: bool = False) -> Iterator[pa.RecordBatch]:
    """The last column's texts as trees, BATCH_BYTES of text at a time."""
    for b in batches:
        texts = b.column(b.num_columns - 1)
        names = [*b.schema.names[:-1], *_NAMES]
        rows: list = []
        parts: list = []
        first = size = held = 0
        for k in range(b.num_rows + 1):
            if k == b.num_rows or held >= _COLUMN_BYTES:
                parts.append(tuple(_columns(rows)))
                rows, size, held = [], size + held, 0
            if k == b.num_rows or size >= BATCH_BYTES:
                if k > first or not b.num_rows:
                    own = b.slice(first, k - first)
                    yield pa.RecordBatch.from_arrays([*own.columns[:-1], *map(pa.concat_arrays, zip(*parts, strict=True))], names=names)
                parts, first, size = [], k, 0
            if k < b.num_rows:
                text = texts[k].as_py()
                r = flatten(text)
                if strict and r[3]:
                    raise Unreadable(f"{r[3]} at {r[5] or f'offset {r[4]}'}")
                rows.append(r)
                held += len(text or "")


def reader(docs: DataFrame, text: str, flatten, mode: str) -> DataFrame:
    if mode not in ("PERMISSIVE", "FAILFAST"):
        raise ValueError("mode is PERMISSIVE or FAILFAST")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return parsed(batches, flatten, mode == "FAILFAST")

    keys = [c for c in docs.columns if c != text]
    ddl = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys)
    return docs.select(*keys, F.col(text).cast("string").alias(text)).mapInArrow(run, f"{ddl}, {SCHEMA}" if ddl else SCHEMA)


def read_resources(docs: DataFrame, text: str = "raw", mode: str = "PERMISSIVE") -> DataFrame:
    """docs with the JSON of `text` replaced by resource_type, nodes, read_issues, fatal and its place; other columns stay.

    `fatal_offset` counts UTF-16 units of the text, `fatal_expression` is the location of an element. Mode FAILFAST: a document that can't be read ends the job instead.
    """
    return reader(docs, text, _flat, mode)


class Primitive:
    """A value made in code with metadata of its own: an id and extensions (dicts)."""

    def __init__(self, value=None, id: str | None = None, extension: tuple | list = ()) -> None:  # noqa: A002
        self.value, self.id, self.extension = value, id, list(extension)


class Repeated(dict):
    """A dict whose members have several values, one after another, as a document that repeats a name has them: {name: [value, value]}."""


def _raw(value):
    """A value made in code, as the decoder gives it."""
    if isinstance(value, dict):
        out = Members()
        for k, v in value.items():
            if not isinstance(k, str):
                raise TypeError("names of members are strings")
            for x in v if isinstance(value, Repeated) else (v,):
                _members(out, k, x)
        return out
    if isinstance(value, (list, tuple)):
        return [_raw(v) for v in value]
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, (int, Decimal)):
        if isinstance(value, Decimal) and not value.is_finite():
            raise ValueError("a number has to be finite")
        return Number(str(value))
    raise TypeError(f"no node can be made of {type(value).__name__}")


def _side(p: Primitive) -> Members | None:
    out = Members([("id", p.id)] if p.id is not None else [])
    if p.extension:
        out.append(("extension", _raw(p.extension)))
    return out or None


def _members(out: Members, name: str, value) -> None:
    """A member, and the metadata beside it."""
    if isinstance(value, Primitive):
        if value.value is not None:
            out.append((name, _raw(value.value)))
        if (side := _side(value)) is not None:
            out.append((f"_{name}", side))
    elif isinstance(value, (list, tuple)) and any(isinstance(v, Primitive) for v in value):
        values = [v.value if isinstance(v, Primitive) else v for v in value]
        if any(v is not None for v in values):
            out.append((name, [_raw(v) for v in values]))
        sides = [_side(v) if isinstance(v, Primitive) else None for v in value]
        if any(sides):
            out.append((f"_{name}", sides))
    else:
        out.append((name, _raw(value)))


def tree(value: dict) -> tuple:
    """(type, nodes, issues, None, None, None) of a resource made in code: dicts, lists, strings, booleans, whole numbers and Decimals, and Primitive for values with metadata. As `flatten` gives it for the document that says the same."""
    return _as_dicts(_made(value))


def _made(value: dict) -> tuple:
    t = _Tree()
    root = t.complex(_raw(value), -1, 0, "", None, "$this")
    return root["rtype"], t.nodes, t.issues, None, None, None


def build_resources(rows: DataFrame, make) -> DataFrame:
    """rows with the resource that `make` gives for each of them (a dict by column name) as a tree, in tasks; make may give None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_made(v) if (v := make(r)) is not None else (None, [], [], None, None, None) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *_columns(made)], names=[*b.schema.names, *_NAMES])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{ddl}, {SCHEMA}")


def ndjson_records(lines: DataFrame, max_bytes: int = 16 << 20) -> DataFrame:
    """lines(raw, ...) -> one record each: the resource, or an error code; a bad line never stops the others. A line whose text its reader has left out says so in `too_long`."""
    long = F.coalesce(F.octet_length("raw") > max_bytes, F.lit(False))
    if "too_long" in lines.columns:
        long = long | F.coalesce("too_long", F.lit(False))
    read = read_resources(lines.withColumn("too_long", long).withColumn("raw", F.when(~long, F.col("raw"))))
    code = F.when(F.col("too_long"), "LINE_TOO_LONG").when(F.col("fatal").isin("MALFORMED_JSON", "MAX_DEPTH_EXCEEDED"), "MALFORMED_JSON").when(F.col("fatal").isNotNull(), "NOT_A_RESOURCE")
    return read.withColumn("error", code).drop("too_long")


def _render(nodes: list, n) -> str:
    """One node, from the nodes after it; what could not be modelled is written as its source."""
    if n["kind"] in ("nested", "foreign"):
        return n["src"]
    if n["kind"] == "primitive":
        if n["lex"] is None:
            return "null"
        if n["vtype"] != "string":
            return n["lex"]
        return n["src"] if n["src"] and not n["src"].startswith(META) else _text(n["lex"])
    groups: dict[tuple, list] = {}
    k = n["id"] + 1
    while k <= n["last"]:
        c = nodes[k]
        groups.setdefault((c["name"], c["dup"]), []).append(c)
        k = c["last"] + 1
    out = []
    for name, _ in sorted(groups, key=lambda g: g[0] != "resourceType"):
        items = groups[name, _]
        listed = items[0]["idx"] is not None
        if not listed:
            c = items[0]
            if c["kind"] != "primitive" or c["lex"] is not None or c["src"] == "null":
                out.append(f"{_text(name)}:{_render(nodes, c)}")
        elif any(c["kind"] != "primitive" or c["lex"] is not None for c in items):
            out.append(f"{_text(name)}:[{','.join(_render(nodes, c) for c in items)}]")
        metas = [_meta(nodes, c) for c in items if c["kind"] == "primitive"]
        if any(metas):
            out.append(f"{_text('_' + name)}:" + (f"[{','.join(m or 'null' for m in metas)}]" if listed else metas[0]))
    return "{" + ",".join(out) + "}"


def _meta(nodes: list, n) -> str | None:
    parts = [f'"id":{_text(n["elem_id"])}'] if n["elem_id"] is not None else []
    own, k = [], n["id"] + 1
    while k <= n["last"]:
        own.append(nodes[k])
        k = nodes[k]["last"] + 1
    if not parts and not own and n["src"] and n["src"].startswith(META):
        return n["src"].removeprefix(META)
    if own:
        parts.append(f'"extension":[{",".join(_render(nodes, c) for c in own)}]')
    return "{" + ",".join(parts) + "}" if parts else None


def write_json(resources: DataFrame, name: str = "json") -> DataFrame:
    """Adds the compact JSON of `nodes`; where writing would lose content (dropped text, repeated properties) there is none, but `refusal` and `refusal_locations`."""
    from .refusals import JSON_REFUSALS, first_reason, json_reasons

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("nodes")
            out = [_render(x, x[0]) if x else None for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, name])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in resources.schema.fields)
    written = resources.mapInArrow(run, f"{ddl}, `{name}` string").withColumn(REASONS, json_reasons())
    code, where = first_reason(JSON_REFUSALS, lambda c: F.col(REASONS)[c])
    return written.withColumns({"refusal": code, "refusal_locations": where, name: F.when(code.isNull(), F.col(name))}).drop(REASONS)
