"""Operator 3, secret scans: candidates by shape, false positives removed by a random forest.

Candidates are tokens that look like keys: long runs of key characters, values
of assignments to secret-sounding names, and marked key blocks. The forest
judges each by its length, its character transitions, how far words of a
dictionary (the whole words of a public vocabulary file) cover it, whether it
stands in a path or URL, and its neighbouring words. It is
trained in numpy on labelled findings; `labelled_findings` makes a set of them
from a seed: secrets of public formats, and hashes, identifiers, paths, words,
placeholders and repeated characters as false positives. A caller's own
findings can be given instead.

Defined results: a null or empty text has no findings and stays as it is; ids,
null or repeated, pass through row by row; equal findings at different places
are each reported; candidates and masks have no longest length; texts are taken
whole; an empty table gives an empty one; extra columns pass through `redact`.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import lean, tune
from .wordbpe import default_path, vocabulary

CUT = 0.5
MASK = "[SECRET]"
NEAR = 60
#: Prefixes of public key formats; fixed values.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "AIza", "glpat-", "eyJ", "npm_", "SG.")
#: Candidates, of any length: a value assigned to a secret-sounding name, or a run of key characters with or before a digit, of mixed case or with a known prefix.
ASSIGNED = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)s?[\"']?[ \t]{0,3}(?:=|:|=>)[ \t]{0,3}[\"']?"
#: A key block up to its END line, or where that is missing its header and base64 lines.
BLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]|-(?!----(?:BEGIN|END) ))*+-----END [A-Z ]*PRIVATE KEY-----|(?:\r?\n[A-Za-z][A-Za-z0-9-]*+: [^\r\n]*+)*+(?:\s*[A-Za-z0-9+/=]{16,}+)*+(?:\r?\n[A-Za-z0-9+/=]{1,15}(?=\r?\n|\Z))?)"
DIGIT = r"(?=[^\s]{0,80}[0-9]|[A-Za-z_+/=\-]*+[0-9])"
NO_DIGIT = rf"(?:(?=[A-Z_+/=\-]*+[a-z])(?=[a-z_+/=\-]*+[A-Z])|(?={'|'.join(map(re.escape, PREFIXES))}))(?![A-Za-z0-9_+/=\-]*(?i:{ASSIGNED}))"
CANDIDATE = re.compile(rf"(?P<block>{BLOCK})|(?i:(?P<name>{ASSIGNED}))(?P<value>[^\s\"'<>,;]{{6,}})|(?<![A-Za-z0-9_+/=\-])(?P<run>(?:{DIGIT}|{NO_DIGIT})[A-Za-z0-9_+/=\-]{{16,}}+)")
KEYWORDS = re.compile(r"(?i)pass|pwd|secret|token|key|auth|credential|bearer|private")
BENIGN = re.compile(r"(?i)sha\d*|md5|digest|checksum|commit|uuid|guid|example|etag|hash|revision|build|base64|id\b")
PLACEHOLDER = re.compile(r"(?i)x{4,}|example|changeme|placeholder|your|dummy|test|sample|0{6,}|1234567|abcdef")
WORDS = tuple("the and for that with this from have not are was you all can use get set new old file path name user data list item page home index main test value string number type class function return import public static void config server client request response error message log debug build release version module package library source target output input image video audio text document report table column row field key map array object node tree graph time date year month day hour minute second start stop end first last next previous open close read write create update delete insert select where order group join left right inner outer pass word secret token".split())
FEATURES = 22


class Dictionary:
    """Words of four letters and more of a public vocabulary file, and the log-frequencies of their letter pairs, smoothed: low for random strings."""

    def __init__(self, path: str) -> None:
        known = vocabulary(path)
        self.words = {w for w in known.whole() if len(w) >= 4 and w.isascii() and w.isalpha()}
        self.machine = ahocorasick.Automaton()
        for w in self.words:
            self.machine.add_word(w, len(w))
        self.machine.make_automaton()
        n = np.ones((27, 27))
        for w in self.words:
            codes = [26, *(ord(c) - 97 for c in w), 26]
            for a, b in zip(codes, codes[1:]):
                n[a, b] += 1
        self.pairs = np.log(n / n.sum(axis=1, keepdims=True))

    def covered(self, low: str) -> int:
        """The most letters that words side by side can cover."""
        total = 0
        for run in _LETTER_RUNS.findall(low):
            best, done = [0] * (len(run) + 1), 0
            for end, n in self.machine.iter(run):
                end += 1
                for k in range(done + 1, end + 1):  # up to here nothing ended
                    if best[k - 1] > best[k]:
                        best[k] = best[k - 1]
                done = end
                best[end] = max(best[end], best[end - 1], best[end - n] + n)
            total += max(best[done], 0)
        return total


_LETTER_RUNS = re.compile("[a-z]{4,}")
#: Kinds of characters: small and capital letters, digits, all else.
_KINDS = np.full(128, 3, np.int64)
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58] = 0, 1, 2


@lru_cache(maxsize=2)
def dictionary(path: str | None = None) -> Dictionary:
    return Dictionary(path or default_path())


def features(value: str, name: str, before: str, after: str, path: str | None = None) -> list[float]:
    known = dictionary(path)
    n = len(value)
    points = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = np.where(points < 128, _KINDS[np.minimum(points, 127)], 3)
    share = (np.bincount(kinds, minlength=4) / n).tolist()
    change = np.count_nonzero(kinds[1:] != kinds[:-1]) / max(n - 1, 1)
    counts = np.unique(points, return_counts=True)[1] / n
    low = value.lower()
    small = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    codes = np.where((small >= 97) & (small <= 122), small - 97, 26)
    pairs = float(known.pairs[codes[:-1], codes[1:]].mean()) if n > 1 else 0.0
    turns = np.flatnonzero(np.r_[True, points[1:] != points[:-1], True])
    near = f"{before} {after}"
    return [
        n, *share, change, float(-(counts * np.log2(counts)).sum()), pairs, known.covered(low) / n,
        float(np.diff(turns).max()) / n,
        value.count("/") + value.count("\\"), value.count("-"), value.count("_"), float(bool(re.fullmatch(r"[0-9a-fA-F]+", value))),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value))), float(value.startswith(PREFIXES)), float(bool(PLACEHOLDER.search(value))),
        float(bool(name)), float(bool(KEYWORDS.search(near))), float(bool(BENIGN.search(near))), float(before.rstrip().endswith(("/", "\\", "://", "@"))), float("://" in before[-20:]),
    ]


def candidates(text: str, path: str | None = None) -> Iterator[tuple[int, int, str, list[float] | None]]:
    """(start, end, kind, features) of every candidate; a private-key block needs no judgement."""
    for m in CANDIDATE.finditer(text):
        if m["block"]:
            yield m.start(), m.end(), "private-key", None
            continue
        kind = "value" if m["value"] else "run"
        s, e = m.span(kind)
        name = m["name"] or ""
        yield s, e, "assigned" if name else "key", features(m[kind], name, text[max(0, m.start() - NEAR) : m.start()], text[e : e + NEAR], path)


class Forest:
    """A random forest of axis-parallel trees on bootstrap samples, grown to purity by Gini impurity."""

    def __init__(self, trees: int = 40, depth: int = 10, seed: int = 3, path: str | None = None) -> None:
        self.n, self.depth, self.rng, self.trees = trees, depth, np.random.default_rng(seed), []
        #: The dictionary's vocabulary file, None for the default one.
        self.path = path

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        for _ in range(self.n):
            rows = self.rng.integers(0, len(y), len(y))
            nodes: list[tuple[int, float, int, int, float]] = []
            self._grow(x[rows], y[rows], 0, nodes)
            self.trees.append(tuple(np.array([n[i] for n in nodes]) for i in range(5)))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, nodes: list) -> int:
        me, share = len(nodes), float(y.mean())
        nodes.append((-1, 0.0, -1, -1, share))
        if depth >= self.depth or share in (0.0, 1.0) or len(y) < 4:
            return me
        best = (share * (1 - share) - 1e-9, -1, 0.0)
        for f in self.rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5)), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, c = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            left = cut + 1
            p, q = c[cut] / left, (c[-1] - c[cut]) / (len(y) - left)
            gini = (left * p * (1 - p) + (len(y) - left) * q * (1 - q)) / len(y)
            k = int(gini.argmin())
            if gini[k] < best[0]:
                best = (float(gini[k]), int(f), float(v[cut[k]] + v[cut[k] + 1]) / 2)
        if best[1] < 0:
            return me
        go = x[:, best[1]] <= best[2]
        left = self._grow(x[go], y[go], depth + 1, nodes)
        right = self._grow(x[~go], y[~go], depth + 1, nodes)
        nodes[me] = (best[1], best[2], left, right, share)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while (go := feature[at] >= 0).any():
                f = feature[at[go]]
                at[go] = np.where(x[go, f] <= cut[at[go]], left[at[go]], right[at[go]])
            out += share[at]
        return out / max(len(self.trees), 1)


def labelled_findings(n: int = 3000, seed: int = 5) -> tuple[list[str], list[int]]:
    """Texts with one candidate each, and whether it is a secret."""
    rng = np.random.default_rng(seed)
    hexes, b64, upper, alnum = "0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits
    take = lambda cs, k: "".join(cs[i] for i in rng.integers(0, len(cs), k))
    word = lambda: WORDS[rng.integers(0, len(WORDS))]
    prose = lambda k: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) if rng.random() < 0.6 else word() for _ in range(k))
    made = lambda: word() if rng.random() < 0.5 else "".join(("bdfglmnprst"[rng.integers(0, 11)] + "aeiou"[rng.integers(0, 5)]) for _ in range(int(rng.integers(2, 5))))
    names = ("password", "passwd", "secret", "token", "api_key", "access_key", "auth", "pwd")
    assign = lambda v: f"{names[rng.integers(0, len(names))]}{('=', ' = ', ': ')[rng.integers(0, 3)]}{('', chr(34))[(q := int(rng.integers(0, 2)))]}{v}{('', chr(34))[q]}"
    good = (
        lambda: "AKIA" + take(upper, 16), lambda: ("ghp_", "gho_", "ghs_")[rng.integers(0, 3)] + take(alnum, 36), lambda: "xoxb-" + take(string.digits, 11) + "-" + take(alnum, 24),
        lambda: "sk_live_" + take(alnum, 24), lambda: "AIza" + take(alnum + "_-", 35), lambda: "glpat-" + take(alnum, 20), lambda: "eyJ" + take(alnum, int(rng.integers(30, 90))),
        lambda: assign(take(hexes, int(rng.integers(12, 65)))), lambda: assign(take(alnum + "!@#$%^&*", int(rng.integers(8, 33)))), lambda: assign(take(b64, int(rng.integers(20, 64)))),
        lambda: f"bearer token {take(alnum, int(rng.integers(24, 60)))}", lambda: f"aws secret key {take(b64, 40)}",
        lambda: "AKIA" + take(string.ascii_uppercase, 16), lambda: f"{('api key', 'token', 'secret', 'bearer')[rng.integers(0, 4)]} {take(string.ascii_letters, int(rng.integers(16, 33)))}", lambda: take(string.ascii_letters, int(rng.integers(16, 41))),
        lambda: "eyJ" + take(alnum + "_-", int(rng.integers(90, 3000))), lambda: assign(take(b64, int(rng.integers(64, 3000)))),
    )
    bad = (
        lambda: f"sha256 {take(hexes, 64)}", lambda: f"md5 digest {take(hexes, 32)}", lambda: f"commit {take(hexes, 40)}", lambda: f"uuid {take(hexes, 8)}-{take(hexes, 4)}-{take(hexes, 4)}-{take(hexes, 4)}-{take(hexes, 12)}",
        lambda: f"https://www.example.org/{word()}/{word()}-{word()}-{take(string.digits, 8)}", lambda: f"/{word()}/{word()}/{word()}_{word()}_{take(string.digits, 4)}", lambda: take(string.digits, int(rng.integers(16, 30))),
        lambda: f"{word()}_{word()}_{word()}_{word()}_{int(rng.integers(0, 99))}", lambda: f"{word()}-{word()}-{word()}-{word()}-{int(rng.integers(1990, 2030))}", lambda: assign(("changeme123", "xxxxxxxxxxxx", "your_password_here", "example_token_123", "00000000000000", "placeholder1234567")[rng.integers(0, 6)]),
        lambda: assign(f"{word()}_{word()}"), lambda: assign(f"get{word().title()}{word().title()}()"), lambda: "=" * int(rng.integers(16, 60)) + "1", lambda: f"{int(rng.integers(1990, 2030))}-{int(rng.integers(10, 12))}-{int(rng.integers(10, 28))}T{int(rng.integers(10, 23))}-{int(rng.integers(10, 59))}-{int(rng.integers(10, 59))}",
        lambda: f"{prose(1)}{take(string.digits, 1)}{''.join(word() for _ in range(4))}",
        lambda: "".join(made().title() for _ in range(int(rng.integers(4, 8)))), lambda: made() + "".join(made().title() for _ in range(int(rng.integers(4, 8)))), lambda: ("-", "_", "/")[rng.integers(0, 3)].join(made().title() for _ in range(int(rng.integers(4, 8)))),
        lambda: f"data:image/png;base64,{take(b64, int(rng.integers(90, 3000)))}", lambda: f"https://www.example.org/{made().title()}/{made().title()}{made().title()}-{made()}",
    )
    texts, labels = [], []
    for k in range(n):
        y = int(k % 2)
        pool = good if y else bad
        texts.append(f"{prose(int(rng.integers(0, 12)))} {pool[rng.integers(0, len(pool))]()} {prose(int(rng.integers(0, 12)))}")
        labels.append(y)
    return texts, labels


def train(texts: list[str], labels: list[int], path: str | None = None) -> Forest:
    """A forest from texts of which each holds one labelled candidate; texts without a candidate are left out."""
    x, y = [], []
    for t, label in zip(texts, labels):
        found = [c[3] for c in candidates(t, path) if c[3] is not None]
        if found:
            x.append(max(found, key=lambda f: (f[17], f[0])))
            y.append(label)
    return Forest(path=path).fit(np.array(x, float), np.array(y, float))


def find(texts: list[str | None], forest: Forest, cut: float = CUT) -> list[list[tuple[int, int, str, float]]]:
    """(start, end, kind, score) of the findings of each text."""
    got = [(i, s, e, kind, f) for i, t in enumerate(texts) if t for s, e, kind, f in candidates(t, forest.path)]
    out: list[list] = [[] for _ in texts]
    judged = [g for g in got if g[4] is not None]
    p = iter(forest.predict(np.array([g[4] for g in judged], float)) if judged else [])
    for i, s, e, kind, f in got:
        score = 1.0 if f is None else float(next(p))
        if score >= cut:
            out[i].append((s, e, kind, score))
    return out


_FINDING = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))


def _scan(docs: DataFrame, forest: Forest, schema, row) -> DataFrame:
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            yield row(batch, at, texts, find(texts, shared.value))

    return docs.mapInArrow(lean(run), schema)


def scan(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id and its findings: places in characters, kinds and scores."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def row(batch, at, texts, found):
        rows = [[{"start": s, "end": e, "kind": k, "score": p} for s, e, k, p in f] for f in found]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _FINDING)], names=["doc_id", "findings"])

    return _scan(docs.selectExpr("doc_id", "cast(text as string) text"), forest, f"doc_id {kind}, findings array<struct<start:long,end:long,kind:string,score:double>>", row)


def redact(docs: DataFrame, forest: Forest) -> DataFrame:
    """docs with every finding in `text` replaced by MASK; all other columns stay."""

    names = docs.columns

    def row(batch, at, texts, found):
        out = []
        for t, spans in zip(texts, found):
            for s, e, _, _ in reversed(spans):
                t = t[:s] + MASK + t[e:]
            out.append(t)
        return pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=names)

    return _scan(docs, forest, docs.schema, row)


def default_forest() -> Forest:
    return train(*labelled_findings())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the findings of every document: their number, kinds, places and scores."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_forest())
    return found.selectExpr("doc_id", "cast(size(findings) as long) n_secrets", "array_join(array_sort(array_distinct(findings.kind)), ',') kinds", "array_join(transform(findings, f -> concat(f.start, '-', f.end)), ',') spans", "coalesce(array_max(findings.score), 0D) score")
