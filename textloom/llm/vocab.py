"""A word-level view of the public vocabulary: which strings are whole tokens, and what a run of non-blank characters encodes to.

White space separates pre-tokens and is dropped by the tokenizer, so a text's tokens are those of its
white-space separated runs, one after the other. Pre-tokens repeat often and are remembered in a bounded table.
"""

from __future__ import annotations

import json
import re

import regex
from tokenizers import Tokenizer

#: Unicode white space, as the tokenizer has it.
BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_ODD = re.compile("[\x1c-\x1f]")
_BLANKS = re.compile(BLANK)
#: Runs, and pre-tokens, that each of a worker's two generations remembers, and the longest in characters; characters looked at at once.
REMEMBERED, LONGEST_REMEMBERED, SLICE = 200_000, 64, 1 << 20


def runs(text: str) -> list[str]:
    """The non-blank runs of a text; str.split also cuts at U+001C to U+001F, which are no white space here."""
    if _ODD.search(text):
        return [x for x in _BLANKS.split(text) if x]
    return text.split()


def slices(text: str):
    """The text in slices of about SLICE characters, cut at white space, so that a long text's pre-tokens are never held at once."""
    at = 0
    while len(text) - at > SLICE:
        blank = _BLANKS.search(text, at + SLICE)
        if blank is None:
            break
        yield text[at : blank.start()]
        at = blank.end()
    yield text[at:]


def is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Byte-pair merging: the lowest-ranked adjacent pair first, leftmost first."""
    while len(symbols) > 1:
        best = min(range(len(symbols) - 1), key=lambda i: ranks.get((symbols[i], symbols[i + 1]), 1 << 60))
        if (symbols[best], symbols[best + 1]) not in ranks:
            break
        symbols = [*symbols[:best], symbols[best] + symbols[best + 1], *symbols[best + 2 :]]
    return symbols


def prove_whole(spec: str) -> set[str]:
    """The pre-tokens that encode alone as one token, proven by merging every vocabulary string that ends a word.

    Only strings whose bytes are valid UTF-8 can be a pre-token; the others are left to the merges.
    """
    model = json.loads(spec)["model"]
    end = model.get("end_of_word_suffix") or ""
    ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
    back = {c: b for b, c in byte_alphabet().items()}
    whole = set()
    for entry in model["vocab"]:
        if not entry.endswith(end) or len(entry) == len(end):
            continue
        letters = entry[: len(entry) - len(end)] if end else entry
        if not all(c in back for c in letters):
            continue
        if merged([*letters[:-1], letters[-1] + end], ranks) == [entry]:
            try:
                whole.add(bytes(back[c] for c in letters).decode())
            except UnicodeDecodeError:
                continue
    return whole


#: The pre-token pattern within lower-case Latin-1, where letters and digits can be listed.
_LETTERS, _DIGITS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_LETTERS}{_DIGITS}\\t-\\r \\x85\\xa0]+")
_WIDE = re.compile("[^\x00-\xff]")


class Memo(dict):
    """What was computed before. Two generations of at most REMEMBERED keys: what is used again moves to the newer one.

    Keys over LONGEST_REMEMBERED characters are computed each time, so a worker's memory has a bound in bytes.
    """

    def __init__(self, compute):
        super().__init__()
        self.compute, self.older = compute, {}

    def __missing__(self, key: str):
        value = self.older.pop(key, None)
        if value is None:
            value = self.compute(key)
        if len(key) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Words:
    """The tokenizer's view of a text: special strings, then pre-tokens; what a pre-token gives is remembered.

    A Latin-1 text is cut into pre-tokens at once. Other texts go run by run, for most of their runs are Latin-1 or known.
    """

    def __init__(self, spec: str):
        fixed = json.loads(spec)
        self.tokenizer = Tokenizer.from_str(spec)
        self.pattern = regex.compile(fixed["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in fixed["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")" if self.special else "(?!)")
        self.letters = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})
        self.pieces, self.runs = Memo(self.piece), Memo(self.run)

    def merge(self, pretoken: str) -> list:
        return self.tokenizer.model.tokenize(pretoken.encode().decode("latin-1").translate(self.letters))

    def run(self, run: str):
        """Latin-1 needs no normal form and lowers letter by letter; anything else goes through the library's normaliser."""
        if not _WIDE.search(run):
            return self.joined(map(self.pieces.__getitem__, _LATIN.findall(run.lower())))
        return self.joined(map(self.pieces.__getitem__, self.pattern.findall(self.tokenizer.normalizer.normalize_str(run))))

    def parts(self, text: str):
        """What the text's pre-tokens, runs and special strings give, in order."""
        for slice_ in slices(text):
            for i, part in enumerate(self.specials.split(slice_) if any(x in slice_ for x in self.special) else (slice_,)):
                if i % 2:
                    yield self.found(part)
                elif is_latin(part):
                    yield self.joined(map(self.pieces.__getitem__, _LATIN.findall(part.lower())))
                else:
                    yield self.joined(map(self.runs.__getitem__, runs(part)))


class Counter(Words):
    """Text -> number of tokens. A pre-token that is a proven whole token counts one; only the rest are merged."""

    joined = staticmethod(sum)

    def __init__(self, spec: str, whole: set[str]):
        super().__init__(spec)
        self.whole = whole

    def found(self, special: str) -> int:
        return 1

    def piece(self, pretoken: str) -> int:
        return 1 if pretoken in self.whole else len(self.merge(pretoken))

    def count(self, text: str) -> int:
        return sum(self.parts(text))


class Encoder(Words):
    """Text -> its token ids, as the library gives them, packed little-endian in `width` bytes each."""

    joined = b"".join

    def __init__(self, spec: str):
        super().__init__(spec)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4

    def found(self, special: str) -> bytes:
        return self.special[special].to_bytes(self.width, "little")

    def piece(self, pretoken: str) -> bytes:
        return b"".join([t.id.to_bytes(self.width, "little") for t in self.merge(pretoken)])

    def encode(self, text: str) -> bytes:
        return b"".join(self.parts(text))


_worker: dict = {}


def worker(kind: type[Words], *args) -> Words:
    """The worker process's own table, kept from task to task."""
    key = (kind, hash(args[0]))
    if key not in _worker:
        _worker[key] = kind(*args)
    return _worker[key]
