"""Scalar rules of the resource model as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nodes import let

#: White space of the specification's patterns: JavaScript's \s, spelt out.
SPACE = r"\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
#: Lexical patterns of the R4 primitive datatypes; fixed values of the specification.
_YEAR = r"([0-9]([0-9]([0-9][1-9]|[1-9]0)|[1-9]00)|[1-9]000)"
_DAY = r"(0[1-9]|1[0-2])-(0[1-9]|[1-2][0-9]|3[0-1])"
_TIME = r"([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)(\.[0-9]+)?"
_ZONE = r"(Z|[+-]((0[0-9]|1[0-3]):[0-5][0-9]|14:00))"
PATTERNS = {
    "integer": r"([0]|[-+]?[1-9][0-9]*)",
    "integer64": r"([0]|[-+]?[1-9][0-9]*)",
    "unsignedInt": r"([0]|[1-9][0-9]*)",
    "positiveInt": r"[1-9][0-9]*",
    "decimal": r"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?",
    "code": rf"[^{SPACE}]+([{SPACE}][^{SPACE}]+)*",
    "id": r"[A-Za-z0-9\-.]{1,64}",
    "uri": rf"[^{SPACE}]*",
    "url": rf"[^{SPACE}]*",
    "canonical": rf"[^{SPACE}]*",
    "oid": r"urn:oid:[0-2](\.(0|[1-9][0-9]*))+",
    "uuid": r"urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    "base64Binary": rf"([{SPACE}]*([0-9a-zA-Z+/=]){{4}}[{SPACE}]*)+",
    "instant": rf"{_YEAR}-{_DAY}T{_TIME}{_ZONE}",
    "date": rf"{_YEAR}(-(0[1-9]|1[0-2])(-(0[1-9]|[1-2][0-9]|3[0-1]))?)?",
    "dateTime": rf"{_YEAR}(-(0[1-9]|1[0-2])(-(0[1-9]|[1-2][0-9]|3[0-1])(T{_TIME}{_ZONE})?)?)?",
    "time": _TIME,
}
NUMERIC = ("integer", "integer64", "unsignedInt", "positiveInt", "decimal")
PRIMITIVES = ("boolean", "string", "markdown", *PATTERNS)
#: In UTF-16 units.
STRING_MAX = 1_048_576


def whole(pattern: str) -> str:
    return rf"\A(?:{pattern})\z"


def primitive_verdict(datatype: str, vtype: Column, lex: Column) -> Column:
    """ok, type-mismatch or invalid for a value of the written type `vtype`."""
    if datatype not in PRIMITIVES:
        return F.lit("ok")
    kind = "boolean" if datatype == "boolean" else "decimal" if datatype in NUMERIC else "string"
    if datatype == "boolean":
        good = F.lit(True)
    elif datatype in ("string", "markdown"):
        good = lex.rlike(rf"(?s)\A[ \r\n\t[^{SPACE}]]+\z") & (utf16_length(lex) <= STRING_MAX)
    else:
        good = lex.rlike(whole(PATTERNS[datatype]))
    return F.when(vtype != kind, "type-mismatch").when(good, "ok").otherwise("invalid")


def integer64(lex: Column) -> Column:
    """A written integer of 64 bits; null where it is none or beyond the range."""
    return F.when(lex.rlike(whole(PATTERNS["integer64"])), F.regexp_replace(lex, r"\A\+", "").try_cast("bigint"))


#: Exponents of more digits are compared as they are written.
_FAR = 36


def decimal_key(lex: Column) -> Column:
    """struct(digits, scale, far) of a written decimal, whatever its exponent: sign and coefficient without leading zeros, and its scale.

    `far` is empty, but for an exponent of more than 36 digits: then it is that
    exponent, without leading zeros, and the scale is that of the coefficient.
    """
    frac = F.regexp_extract(lex, r"\.([0-9]+)", 1)
    minus = F.when(lex.rlike(r"[eE]-"), "-").otherwise("")
    power = F.regexp_extract(lex, r"[eE][+-]?0*([0-9]*)", 1)
    far = F.length(power) > _FAR
    exponent = F.when(far | (power == ""), F.lit("0")).otherwise(F.concat(minus, power)).try_cast("decimal(38,0)")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(lex, r"[eE].*", ""), r"[-.]", ""), r"^0+(?=[0-9])", "")
    sign = F.when(lex.startswith("-") & ~digits.rlike(r"\A0+\z"), "-").otherwise("")
    scale = (F.length(frac).cast("decimal(38,0)") - exponent).cast("decimal(38,0)")
    return F.struct(F.concat(sign, digits).alias("digits"), scale.alias("scale"), F.when(far, F.concat(minus, power)).otherwise("").alias("far"))


def decimal_integer(lex: Column) -> Column:
    """The integer that a written decimal is, whatever its exponent, as decimal(38,0); null where it has a fraction or doesn't fit."""
    k = decimal_key(F.when(lex.rlike(whole(PATTERNS["decimal"])), lex))
    digits = F.regexp_replace(k["digits"], r"\A-", "")
    zeros = F.length(digits) - F.length(F.regexp_replace(digits, r"0+\z", ""))
    # as long as the integer would be: decided before anything of that length is made
    length = F.length(digits) - k["scale"]
    fits = (length > 0) & (length <= 38) & (k["far"] == "") & (zeros >= k["scale"])
    n = F.when(fits, length).otherwise(1).cast("int")
    shorter = F.when(digits.rlike(r"\A0+\z"), "0").when(fits, F.rpad(F.substring(digits, F.lit(1), n), n, "0"))
    return F.concat(F.when(k["digits"].startswith("-"), "-").otherwise(""), shorter).try_cast("decimal(38,0)")


def decimal_equals(a: Column, b: Column) -> Column:
    """Same value and same scale."""
    x, y = decimal_key(a), decimal_key(b)
    # without a sign, an exponent and leading zeros there is one way to write each
    bare = lambda lex: lex.rlike(r"\A(0|[1-9][0-9]*)(\.[0-9]+)?\z")
    return F.when(bare(a) & bare(b), a == b).otherwise((x["digits"] == y["digits"]) & (x["scale"] == y["scale"]) & (x["far"] == y["far"]))


def decimal_value_key(lex: Column) -> Column:
    """struct(digits, scale, far) that two decimals share if their values are equal: trailing zeros of the coefficient are moved into the scale."""
    k = decimal_key(lex)
    bare = F.regexp_replace(k["digits"], r"(?<=[1-9])0+\z", "")
    zero = k["digits"].rlike(r"\A-?0+\z")
    scale = (k["scale"] - (F.length(k["digits"]) - F.length(bare))).cast("decimal(38,0)")
    return F.struct(F.when(zero, "0").otherwise(bare).alias("digits"), F.when(zero, F.lit(0).cast("decimal(38,0)")).otherwise(scale).alias("scale"), F.when(zero, "").otherwise(k["far"]).alias("far"))


def decimal_equals_value(a: Column, b: Column) -> Column:
    """Same value, whatever the scale."""
    x, y = decimal_value_key(a), decimal_value_key(b)
    return (x["digits"] == y["digits"]) & (x["scale"] == y["scale"]) & (x["far"] == y["far"])


def utf16(s: Column) -> Column:
    """A sort key: strings in the order of their UTF-16 units, where characters above U+FFFF come before U+E000."""
    return F.encode(s, "UTF-16BE")


def utf16_length(s: Column) -> Column:
    """The number of UTF-16 units."""
    return F.octet_length(utf16(s)) / 2


_RELATIVE = r"\A([A-Za-z][A-Za-z0-9]*)/([A-Za-z0-9\-.]{1,64})(?:/_history/([A-Za-z0-9\-.]{1,64}))?\z"


def parse_reference(raw: Column) -> Column:
    """struct(kind, type, id, version) of a literal reference: fragment, absolute, relative or logical."""
    absolute = raw.rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*://")

    def tail(parts: Column) -> Column:
        n = F.size(parts)
        history = (n >= 4) & (F.try_element_at(parts, F.lit(-2)) == "_history")
        return F.when(history, F.array_join(F.slice(parts, -4, 4), "/")).when(n >= 2, F.array_join(F.slice(parts, -2, 2), "/")).otherwise(raw)

    path = F.when(absolute, let(F.filter(F.split(raw, "/"), lambda s: s != ""), tail)).otherwise(raw)
    # each part is worked out once, also where this stands in a lambda
    known = lambda p: F.struct(p.alias("path"), p.rlike(_RELATIVE).alias("fits"), absolute.alias("absolute"))

    def told(x: Column) -> Column:
        kind = F.when(raw.startswith("#"), "fragment").when(x["absolute"], "absolute").when(x["fits"], "relative").otherwise("logical")
        part = lambda k: F.when(x["fits"] & ~raw.startswith("#"), F.nullif(F.regexp_extract(x["path"], _RELATIVE, k), F.lit("")))
        return F.struct(kind.alias("kind"), part(1).alias("type"), F.when(raw.startswith("#"), F.substring(raw, 2, STRING_MAX)).otherwise(part(2)).alias("id"), part(3).alias("version"))

    return F.when(raw.isNotNull(), let(let(path, known), told))


def ucum_shape(code: Column) -> Column:
    """ok or invalid: annotations dropped, then no braces, no white space, and balanced brackets."""
    bare = F.regexp_replace(code, r"\{[^{}]*\}", "")
    marks = F.regexp_replace(bare, r"[^\[\]()]", "")
    # innermost pairs vanish step by step; what can't vanish is out of balance
    left = F.aggregate(F.sequence(F.lit(0), F.length(marks)), marks, lambda acc, _: F.regexp_replace(acc, r"\[\]|\(\)", ""))
    bad = (code == "") | bare.rlike(r"[{}]") | bare.rlike(f"[{SPACE}]") | (left != "")
    return F.when(bad, "invalid").otherwise("ok")
