"""Typed scan for personal data: every node of a tree is looked at by its name and its owner's.

Names of people are split into tokens (letters of any script; one letter counts
only where a script writes names so), contact points and identifiers are told by
the shape of their value, addresses by a house number, dates of birth by their
digits; texts of all kinds are searched for numbers and addresses of fixed shape.
What is known to be made up is a table of (list, value) that the hits are joined
with, so it may be long. Hits say where and what kind, never the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nodes import at, nodes

#: Honorifics, degrees and suffixes: no names; fixed values, upper case.
NOISE = ("MD", "DO", "DR", "MR", "MRS", "MS", "MISS", "JR", "SR", "II", "III", "IV", "RN", "NP", "PA", "PHD", "DDS", "DMD", "ESQ", "PROF", "FNP", "APRN")
#: Scripts in which one character is a name.
_ALONE = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]"
_EMAIL = r"\A[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\z"
_EMAILS = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
_SSNS = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
#: Lists of what is known to be made up: tokens of names (upper case), dates (digits), address lines (lower case), numbers (digits), domains (lower case).
LISTS = ("name", "date", "address", "id", "domain")
_HITS = "array<struct<kind:string,list:string,key:string>>"


def allowed(spark: SparkSession, names: tuple = (), dates: tuple = (), addresses: tuple = (), ids: tuple = (), domains: tuple = ()) -> DataFrame:
    """The table of allow-lists, in the form in which hits are looked up."""
    rows = [("name", v.upper()) for v in names] + [("date", "".join(c for c in v if c.isdigit())[:8]) for v in dates] + [("address", v.strip().lower()) for v in addresses] + [("id", "".join(c for c in v if c.isdigit())) for v in ids] + [("domain", v.lower()) for v in domains]
    return spark.createDataFrame(rows, "list string, key string")


def _hit(kind: str, list_: str | None, key: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(list_).cast("string").alias("list"), key.alias("key"))


def _names(lex: Column) -> Column:
    tokens = F.filter(F.split(lex, r"[^\p{L}]+"), lambda t: (F.length(t) > 1) | t.rlike(rf"\A{_ALONE}\z"))
    upper = F.filter(F.transform(tokens, lambda t: F.upper(t)), lambda t: ~t.isin(*NOISE))
    return F.transform(upper, lambda t: _hit("name", "name", t)).cast(_HITS)


def _digits(lex: Column) -> Column:
    return F.regexp_replace(lex, "[^0-9]", "")


def _when(condition: Column, hit: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(hit)).otherwise(F.array()).cast(_HITS)


def _date(lex: Column) -> Column:
    d = _digits(lex)
    month, day = F.substring(d, 5, 2), F.substring(d, 7, 2)
    good = F.when(F.length(d) >= 8, month.between("01", "12") & day.between("01", "31")).when(F.length(d) == 6, month.between("01", "12")).otherwise(F.length(d) == 4)
    return _when(good, _hit("birth-date", "date", F.substring(d, 1, 8)))


def _address(lex: Column) -> Column:
    street = F.trim(lex)
    return _when(street.rlike(r"\A[0-9]+\s+\p{L}"), _hit("address", "address", F.lower(street)))


def _contact(lex: Column) -> Column:
    """An e-mail address, or a number of nine digits, or one of ten and more that isn't of the exchange 555, which is no one's."""
    v = F.trim(lex)
    d, mail = _digits(v), v.rlike(_EMAIL)
    number = F.when(F.length(d) == 9, _when(F.lit(True), _hit("ssn", "id", d))).otherwise(_when((F.length(d) >= 10) & ~d.contains("555"), _hit("phone", "id", d)))
    return F.when(mail, _when(mail, _hit("email", "domain", F.lower(F.element_at(F.split(v, "@"), -1))))).otherwise(number)


def _shapes(lex: Column) -> Column:
    """What any text may hold."""
    mails = F.transform(F.regexp_extract_all(lex, F.lit(_EMAILS), F.lit(0)), lambda m: _hit("text-email", "domain", F.lower(F.element_at(F.split(m, "@"), -1))))
    numbers = F.transform(F.regexp_extract_all(lex, F.lit(_SSNS), F.lit(0)), lambda m: _hit("text-ssn", None, F.lit(None).cast("string")))
    return F.concat(mails.cast(_HITS), numbers.cast(_HITS))


def personal_elements(resources: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """keys, kind, location and n: how many hits of a kind an element's value has that the lists of `known` (list, key) don't hold.

    Looked at are strings under `name` (family, given, text), `telecom` and `identifier` (value), `address` (line, text), birthDate and deceasedDateTime, and for fixed shapes every other string; metadata, too. A name that is a plain string names no one. Of several members of one name each counts. Documents that can't be read have no rows.
    """
    strings = F.filter(nodes(), lambda n: (n["kind"] == "primitive") & (n["vtype"] == "string"))
    owned = F.transform(strings, lambda n: F.struct(n["name"].alias("name"), F.when(n["parent"] >= 0, at(n["parent"])["name"]).alias("owner"), n["loc"].alias("location"), n["lex"].alias("lex")))
    rows = resources.select(*keys, F.explode(owned).alias("x")).select(*keys, "x.*")
    name, owner, lex = F.col("name"), F.col("owner"), F.col("lex")
    person = (owner == "name") & name.isin("family", "given", "text")
    contact = owner.isin("telecom", "identifier") & (name == "value")
    street = (owner == "address") & name.isin("line", "text")
    born = name.isin("birthDate", "deceasedDateTime")
    found = F.when(contact, _contact(lex)).when(person, F.concat(_names(lex), _shapes(lex))).when(street, F.concat(_address(lex), _shapes(lex))).when(born, _date(lex)).otherwise(_shapes(lex))
    hits = rows.select(*keys, "location", F.explode(found).alias("h")).select(*keys, "location", "h.*")
    # counted first, so that the lists meet each value of a place once
    counted = hits.groupBy(*keys, "location", "kind", "list", "key").agg(F.count("*").alias("n"))
    return counted.join(known, ["list", "key"], "left_anti").groupBy(*keys, "kind", "location").agg(F.sum("n").alias("n"))
