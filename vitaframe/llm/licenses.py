"""Operator 6, licence scans: Aho-Corasick for tags and notices, a shunting-yard parser for expressions.

One automaton over a text's words, joined by single spaces, finds notice
phrases and the tag words of licence identifiers in one pass. After a tag the
raw line is read as an expression of listed identifiers with and/or/with and
parentheses, up to the first word that is none; its postfix form is walked once, which gives the identifiers that
it names (`with` binds an exception to its licence) and the expression written
anew, with no more parentheses than it needs. Both are linear in its length.

Defined results: a null or empty text has no words, no labels and score 0; ids,
null or repeated, pass through row by row; an expression that doesn't parse
gives its leading part up to the fault; `with` between compound sides names
their identifiers one by one; texts are taken whole; an empty table gives an
empty one; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ALNUM, LOWER, tune

#: Fixed values of the contract: phrase and label.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notice phrases of the method's own: label and weight.
NOTICES = {
    "permission is hereby granted free of charge": ("mit", 1.0),
    "mit license": ("mit", 0.7),
    "licensed under the apache license": ("apache-2", 1.0),
    "apache license 2 0": ("apache-2", 0.9),
    "gnu general public license": ("gpl", 0.9),
    "gnu general public license version 2": ("gpl-2", 1.0),
    "gnu general public license version 3": ("gpl-3", 1.0),
    "gnu lesser general public license": ("lgpl", 1.0),
    "gnu affero general public license": ("agpl", 1.0),
    "mozilla public license": ("mpl", 1.0),
    "redistribution and use in source and binary forms": ("bsd", 1.0),
    "bsd license": ("bsd", 0.7),
    "permission to use copy modify and or distribute this software": ("isc", 1.0),
    "creative commons attribution": ("cc-by", 0.9),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "all rights reserved": ("proprietary", 0.4),
    "public domain": ("public-domain", 0.5),
    "the unlicense": ("unlicense", 0.9),
}
BASE_WEIGHT = 0.9
TAGS = ("spdx license identifier",)
#: A tag has its colon, and ends with its line or with the comment that it stands in.
TAG = re.compile(r"spdx[^0-9a-z\x80-\U0010ffff]+license[^0-9a-z\x80-\U0010ffff]+identifier[ \t]*:[ \t]*((?:(?!\*/|-->|#\}|%>|\*\)|\?>)[^\r\n])*)", re.I)
#: Identifiers of the public licence list, by family, and references to licences of a document's own; fixed values.
IDENTIFIER = re.compile(
    r"(?:[AL]?GPL-[1-3]\.[0-9](?:-only|-or-later)?|GFDL-1\.[1-3](?:-invariants|-no-invariants)?(?:-only|-or-later)?|Apache-(?:1\.[01]|2\.0)|0BSD|BSD-[1-4]-Clause(?:-[A-Za-z0-9.]+)*|BSD-(?:Protection|Source-Code)|MIT(?:-[A-Za-z]+|-0)*"
    r"|CC-BY(?:-NC)?(?:-SA|-ND)?-[1-4]\.[05](?:-[A-Z]{2,3})?|CC0-1\.0|CC-PDDC|(?:MPL|EPL|CDDL|EUPL|AFL|OSL|ECL|LPL|CPL|IPL|NPL|APSL|RPL|SPL|ZPL|AGPL|LAL|OLDAP|CPAL|QPL|OFL|UPL|MulanPSL|NPOSL|Artistic|Python|PSF|PHP|BSL|Zend|LiLiQ|CERN-OHL|SSPL|BUSL|Elastic|BlueOak|PolyForm|ODbL|ODC-By|PDDL|OGL|Unicode|Unicode-DFS|libpng|libselinux|OpenPBS|EFL|CNRI|MirOS|Sendmail|SGI-B|W3C|X11|Xerox|HPND|NCSA|CECILL|DRL|EPICS|NetCDF|Watcom|YPL|Spencer|Latex2e|LPPL|TCP-wrappers|NIST-PD)"
    r"(?:-[A-Za-z]*[0-9][A-Za-z0-9.]*|-[A-Za-z]+)*|ISC(?:-Veillard)?|Zlib|zlib-acknowledgement|Unlicense|WTFPL|PostgreSQL|Ruby|OpenSSL|curl|JSON|libtiff|FTL|ICU|IJG|Info-ZIP|Intel|MS-[PR]L|Vim|Xnet|NTP|Beerware|Sleepycat|TCL|Fair|Naumen|Nokia|Motosoto|Multics|NGPL|NLPL|Entessa|ImageMagick|Plexus|bzip2-1\.0\.[56]|mpich2|psutils|xpp"
    r"|(?:DocumentRef-[A-Za-z0-9.\-]+:)?LicenseRef-[A-Za-z0-9.\-]+|NONE|NOASSERTION)\+?",
    re.I,
)
#: What may follow `with`.
EXCEPTION = re.compile(r"[A-Za-z0-9.\-]*exception[A-Za-z0-9.\-]*|Linux-syscall-note|(?:DocumentRef-[A-Za-z0-9.\-]+:)?AdditionRef-[A-Za-z0-9.\-]+", re.I)
TOKEN = re.compile(r"\s*(?:([()])|([A-Za-z0-9][A-Za-z0-9.\-+:]*))")
LEVEL = {"or": 1, "and": 2, "with": 3}
_TABLE = bytes(int(LOWER[i]) if ALNUM[i] else 0x20 for i in range(256))


def listed(word: str, bound: bool) -> bool:
    """Whether a word is an identifier of the public list or a reference, or where it is bound by `with`, an exception."""
    return bool((EXCEPTION if bound else IDENTIFIER).fullmatch(word))


def parse_expression(text: str, known=None) -> list[str]:
    """An expression in reverse Polish order by the shunting-yard rule; stops before the first token that doesn't fit, or that `known` (word, whether it follows `with`) doesn't know."""
    out: list[str] = []
    held: list[str] = []
    at, operand = 0, True
    while m := TOKEN.match(text, at):
        mark, word = m.groups()
        low = word.lower() if word else mark
        if low in LEVEL:
            if operand:
                break
            while held and held[-1] != "(" and LEVEL[held[-1]] >= LEVEL[low]:
                out.append(held.pop())
            held.append(low)
            operand = True
        elif low == "(":
            if not operand:
                break
            held.append(low)
        elif low == ")":
            if operand or "(" not in held:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        else:
            if not operand or known is not None and not known(word, bool(held) and held[-1] == "with"):
                break
            out.append(word)
            operand = False
        at = m.end()
    if operand and held:  # a last operator without its right side
        while held and held[-1] == "(":
            held.pop()
        if held:
            held.pop()
    out += [h for h in reversed(held) if h != "("]
    return out


def evaluate(rpn: list[str]) -> tuple[list[str], str]:
    """The identifiers that an expression names, sorted, and the expression written anew; empty for an empty one."""
    names: set[str] = set()
    stack: list[tuple] = []  # (level, identifier) or (level, operator, left, right)
    for token in rpn:
        if token not in LEVEL:
            stack.append((4, token.lower()))
        elif len(stack) >= 2:
            b, a = stack.pop(), stack.pop()
            if token == "with" and a[0] == b[0] == 4:
                stack.append((4, f"{a[1]} with {b[1]}"))
            else:
                stack.append((LEVEL[token], token, a, b))
    if not stack:
        return [], ""
    out: list[str] = []
    todo: list = [stack[-1]]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
        elif node[0] == 4:
            names.add(node[1])
            out.append(node[1])
        else:
            level, word, a, b = node
            part = lambda x: (x,) if x[0] >= level else (")", x, "(")  # noqa: B023, E731
            todo += [*part(b), f" {word} ", *part(a)]
    return sorted(names), "".join(out)


def automaton(phrases: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for p in phrases:
        out.add_word(f" {p} ", p)
    out.make_automaton()
    return out


def scan(text: str | None, machine: ahocorasick.Automaton) -> tuple[int, list[tuple[int, str]], list[tuple[list[str], str]]]:
    """Number of words, (word place, phrase) of every phrase, and the identifiers and expressions of tags."""
    if not text:
        return 0, [], []
    words = text.encode("utf-8", "surrogatepass").translate(_TABLE).split()
    if not words:
        return 0, [], []
    line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    found, at, place = [], 0, 0
    for end, phrase in machine.iter(line):
        start = end - len(phrase) - 1
        if start >= at:
            place += line.count(" ", at, start)
        else:
            place -= line.count(" ", start, at)
        at = start
        found.append((place, phrase))
    tags = []
    if any(p in TAGS for _, p in found):
        tags = [got for m in TAG.finditer(text) if (got := evaluate(parse_expression(m[1], listed)))[0]]
    return len(words), found, tags


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, expressions, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton([*BASE, *NOTICES, *TAGS])
        for batch in batches:
            rows = []
            for text in batch.column(1):
                n, found, tags = scan(text.as_py(), machine)
                base = [(w, p) for w, p in found if p in BASE]
                starts = [w for w, _ in base]
                labels = {BASE[p] for _, p in base}
                own = set(labels) | {NOTICES[p][0] for _, p in found if p in NOTICES}
                own |= {name for names, _ in tags for name in names}
                doubt = 1.0
                for p in {p for _, p in found}:
                    doubt *= 1 - (BASE_WEIGHT if p in BASE else NOTICES[p][1] if p in NOTICES else 0)
                score = 1.0 if tags else 1 - doubt
                rows.append((n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(own)), [e for _, e in tags], score))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.float64())
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "expressions", "score"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=names)

    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expressions array<string>, score double"
    return docs.selectExpr("doc_id", "cast(text as string) text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
