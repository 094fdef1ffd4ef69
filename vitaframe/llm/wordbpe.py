"""Pre-tokens and merges of a BPE vocabulary with word ends, as the tokenizers library has them.

The file must have the steps that `Vocabulary` knows: NFC, white space, lower
case; one split pattern; bytes as letters; merges with an end-of-word suffix.
Texts of a proven alphabet are split by an equal pattern for Python's `re`;
all others go through the library's own normaliser and splitter.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

from tokenizers import Regex, Tokenizer, pre_tokenizers


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: its own where printable, else the next from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in own}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return out


#: Characters whose NFC form, class and white-space class are the same for Python and the library: Latin, general punctuation, currency.
SIMPLE_RANGES = ((0x0, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF))
SIMPLE = re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in SIMPLE_RANGES) + r"]*\Z")


def _class(kind: str) -> str:
    # two capitals below U+0250 have their small letters far above
    points = [c for a, b in SIMPLE_RANGES for c in range(a, b + 1) if unicodedata.category(chr(c))[0] == kind] + ([0x2C65, 0x2C66] if kind == "L" else [])
    return "".join(f"\\U{c:08x}" for c in points)


_SPACE = "\\t-\\r \\x85\\xa0"
WORDS = re.compile(f"[{_class('L')}]+|'(?:s|t|re|ve|m|ll|d)|[{_class('N')}]|[^{_SPACE}{_class('L')}{_class('N')}]+")


class Vocabulary:
    """A loaded tokenizer file; made once in each worker."""

    def __init__(self, path: str) -> None:
        spec = json.loads(open(path, encoding="utf-8").read())
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]], [s["type"] for s in spec["pre_tokenizer"]["pretokenizers"]]
        if steps != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or spec["model"]["type"] != "BPE" or spec.get("post_processor") or spec.get("decoder"):
            raise ValueError(f"{path} has other steps than {type(self).__name__} knows")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if pattern != r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
            raise ValueError(f"{path} splits by another pattern")
        self.tokenizer = Tokenizer.from_file(path)
        self.split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.suffix = spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.hint = next(iter(self.special))[:2]
        self.model = self.tokenizer.model
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})

    def lettered(self, word: str) -> str:
        return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)

    def ids(self, word: str) -> list[int]:
        """Merges one pre-token; a special token's string stands for itself only if it is marked as such."""
        return [t.id for t in self.model.tokenize(self.lettered(word))]

    def plain(self, text: str) -> list[str]:
        if SIMPLE.match(text):
            return WORDS.findall(text.lower())
        text = self.tokenizer.normalizer.normalize_str(text)
        return [w for w, _ in self.split.pre_tokenize_str(text)] if text else []

    def pretokens(self, text: str) -> list[str]:
        """All pre-tokens; a special token's string comes as NUL and its content, which no pre-token can be."""
        if self.hint not in text:
            return self.plain(text)
        out: list[str] = []
        for part in self.marks.split(text):
            if part in self.special:
                out.append("\0 " + part)
            elif part:
                out += self.plain(part)
        return out

    def encode(self, word: str) -> list[int]:
        return [self.special[word[2:]]] if word.startswith("\0 ") else self.ids(word)

    def whole(self) -> set[str]:
        """The pre-tokens that the vocabulary holds whole: each is proved by encoding it alone to one token."""
        back = {c: b for b, c in byte_letters().items()}
        out = set()
        for token in self.tokenizer.get_vocab(with_added_tokens=False):
            if not token.endswith(self.suffix):
                continue
            try:
                word = bytes(back[c] for c in token.removesuffix(self.suffix)).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if word and self.plain(word) == [word] and len(self.ids(word)) == 1:
                out.add(word)
        return out

    def pieces(self) -> list[str]:
        """The string of every id."""
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        return [self.tokenizer.id_to_token(i) or "" for i in range(n)]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
