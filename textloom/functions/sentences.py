"""The sentence steps of text.py over whole Arrow batches: the same results for a fraction of the work.

As expressions, each step is interpreted sentence by sentence, and each pattern turns the text into a Java string anew. Here a text is
decoded once. Java and Python know different versions of Unicode, so texts with characters that have changed their category since
version 3.2, or of the higher planes, are left to the expressions, as are bytes that are not UTF-8.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import charclass as C


def _body(chars) -> str:
    """A class body of code points in ascending order, as ranges."""
    runs = [[x for _, x in g] for _, g in groupby(enumerate(chars), lambda p: p[1] - p[0])]
    return "".join(f"\\u{r[0]:04x}-\\u{r[-1]:04x}" for r in runs)


_OLD = unicodedata.ucd_3_2_0
_KINDS = {i: unicodedata.category(chr(i)) for i in range(0x10000)}
KNOWN = [i for i, kind in _KINDS.items() if kind not in ("Cn", "Cs") and _OLD.category(chr(i)) == kind]
SYMBOLS = [i for i in KNOWN if _KINDS[i][0] not in "LMNP" and chr(i) not in "\r\n\t "]
LETTERS = [i for i in KNOWN if _KINDS[i][0] == "L" or _KINDS[i] in ("Nl", "No")]

_PUNCTUATION = ",.;:!?"
_WS_BODY = _body(sorted(map(ord, C.WS_CHARS)))
_WS, _WS_NOT_SPACE, _LETTER = f"[{_WS_BODY}]", f"[{_body(sorted(ord(x) for x in C.WS_CHARS if x != ' '))}]", f"[{_body(LETTERS)}]"
_CJK_BODY = re.sub(r"\\x\{(\w{4})\}", r"\\u\1", C.CJK[1:-1])
_AFTER = rf"(?=[^{_WS_BODY}\"'”’)\]}}])"
_CHANGED = rf"(?<= [{_PUNCTUATION}])|(?<=[{_PUNCTUATION}]){_AFTER}|(?<={_WS_NOT_SPACE})"
_FIRST = f"{_PUNCTUATION}{_WS_NOT_SPACE[1:-1]}"

UNKNOWN = re.compile(f"[^{_body(KNOWN)}]")
SYMBOL = re.compile(f"[{_body(SYMBOLS)}]")
NOT_NORMAL = re.compile(f"[{_FIRST}](?:{_CHANGED})")
DOTS = re.compile(rf"\.{_WS}*(?:\.{_WS}*){{2,}}")
GAP = re.compile(rf"{_WS_NOT_SPACE}{_WS}*| {_WS}+")
BEFORE = re.compile(rf"  *([{_PUNCTUATION}])")
AFTER = re.compile(rf"([{_PUNCTUATION}]){_AFTER}")
DIALOGUE = re.compile(rf"((?<![{C.TERMINATORS}])[{C.TERMINATORS}]+[{C.CLOSERS}]*){_WS}*-{_WS}+(?=[\"'«A-ZА-ЯЁ0-9])")
DASH = re.compile(rf"\A{_WS}*-{_WS}*")
CHUNK = re.compile(rf"[^\n\r\x85\u2028\u2029][^{C.TERMINATORS}]*+(?:[{C.TERMINATORS}]++[{C.CLOSERS}]*+|\Z)")
LEADING = "»”’\"')]}"
WORD = re.compile(rf"{_LETTER}++(?:[-']{_LETTER}++)*+")
SUSPECT = re.compile(rf"[{_FIRST}{_CJK_BODY}](?:{_CHANGED}|(?<=[{_CJK_BODY}])|(?<=[wW]{{3}}\.)(?=[^{_WS_BODY}]))")
CJK = re.compile(f"[{_CJK_BODY}]")
SPACES, TERMINATOR = re.compile(f"{_WS}+"), re.compile(f"[{C.TERMINATORS}]")
URL = re.compile(rf"(?:[hH][tT]{{2}}[pP][sS]?://|[wW]{{3}}\.)[^{_WS_BODY}]")
COMMUNITY = re.compile("[ruRU]/[A-Za-z0-9_][A-Za-z0-9_-]{1,31}")
WEEKLY = re.compile(f"{_WS}+".join("".join(f"[{x}{x.upper()}]" for x in w) for w in ("опубликованных", "материалов", "за", "неделю")))


def is_normal(x: str) -> bool:
    return "  " not in x and not NOT_NORMAL.search(x)


def normalize_line(x: str) -> str:
    """STR7."""
    x = x.strip(" ")
    if is_normal(x):
        return x
    x = GAP.sub(" ", DOTS.sub(". ", x)).strip(" ")
    return GAP.sub(" ", AFTER.sub(r"\1 ", BEFORE.sub(r"\1", x))).strip(" ")


def _dialogue(x: str) -> list[str]:
    """STR8, STR9, GEN2: chunks of a line that is not plain."""
    marked = DIALOGUE.sub(r"\1\n", x) if "-" in x else x
    chunks = (CHUNK.findall(normalize_line(DASH.sub("", y) if "-" in y else y)) for y in marked.split("\n"))
    return [normalize_line(s) for found in chunks for s in found]


def _split_line(x: str) -> tuple[list[str], bool]:
    """GEN3 of a trimmed line, and whether its sentences are normal as the line was."""
    plain = "-" not in x and is_normal(x)
    if not plain:
        x = normalize_line(x)
        if "-" in x or not is_normal(x):
            return [s for s in _dialogue(x) if s.strip(C.TERMINATORS)], False
    return [s for s in [y.strip(" ") for y in CHUNK.findall(x)] if s.strip(C.TERMINATORS)], True


def _rebalance(own: list[str]) -> list[str]:
    """FOLD2 where something moves."""
    rests, closers = own[:1], [""]
    for x in own[1:]:
        rest = x.lstrip(LEADING)
        closers.append(x[: len(x) - len(rest)])
        rests.append(normalize_line(rest) if closers[-1] else x)
    out: list[list[str]] = []
    for i, rest in enumerate(rests):
        if i == 0 or rest:
            out.append([rest])
            if i:
                out[-2].append(closers[i])
        else:
            out[-1].append(closers[i])
    return ["".join(x) for x in out]


def _split(x: str) -> tuple[list[str], bool]:
    """GEN4, and whether all sentences are normal."""
    own: list[str] = []
    normal = True
    for line in x.splitlines():
        if line := line.strip(C.WS_CHARS):
            found, plain = _split_line(line)
            own += found
            normal &= plain
    for s in own[1:]:
        if s[0] in LEADING:
            return _rebalance(own), False
    return own, normal


def casefold(x: str) -> str:
    """STR21."""
    return x.lower().replace("ß", "ss")


def _significant(w: str) -> bool:
    return len(w) >= 4 or (y := casefold(w)) in C.SHORT_WORDS or len(y) >= 4


def significant_words(x: str) -> int:
    """FN1."""
    return sum(map(_significant, WORD.findall(x)))


def _has_words(x: str, least: int) -> bool:
    """FLT10."""
    words = WORD.findall(x)
    return len(words) >= least and (sum([len(w) >= 4 for w in words]) >= least or sum(map(_significant, words)) >= least)


@cache
def _enough(n: int) -> re.Pattern:
    """Words of four letters, each after a space: seen in nearly every sentence that has n significant words."""
    return re.compile(rf"(?s){_LETTER}{{4}}(?:[^ ]*+ .*?{_LETTER}{{4}}){{{n - 1}}}" if n > 0 else "")


def _whole(n: str) -> bool:
    """The rules for a whole line."""
    return not n or (len(n) == len(C.MODERATORS) and casefold(n) == C.MODERATORS) or (n[0] in "оО" and bool(WEEKLY.fullmatch(n))) or (n[1:2] == "/" and bool(COMMUNITY.fullmatch(n)))


def should_drop(x: str) -> bool:
    """FLT9."""
    x = x.strip(" ")
    if "  " not in x and not SUSPECT.search(x):
        return _whole(x)
    n = normalize_line(x)
    return _whole(n) or bool(URL.search(n)) or bool(CJK.search(n))


def decoded(raw: bytes | None, symbols: bool = False) -> str | None:
    """A text, its symbols stripped (STR4) if asked; None where the expressions are to do it."""
    try:
        x = None if raw is None else raw.decode()
    except UnicodeDecodeError:
        return None
    if x is None or not (x.isascii() or UNKNOWN.search(x) is None):
        return None
    return SYMBOL.sub(" ", x) if symbols else x


def _judge(x: str, normal: bool):
    """FLT9, for the sentences of x. In normal sentences only these two make the rules for any place matter."""
    return _whole if normal and "www." not in x.lower() and (x.isascii() or not CJK.search(x)) else should_drop


def _kept(x: str, own: list[str], normal: bool, min_words: int) -> list[str]:
    drop, enough = _judge(x, normal), _enough(min_words).search
    # looked for in the first 200 characters, as a long run without spaces would be read from each of its places
    return [s for s in own if not drop(s) and (enough(s, 0, 200) or _has_words(s, min_words))]


def good(x: str, min_words: int) -> list[str]:
    """FLT9, FLT10: the sentences of a text that stay."""
    return _kept(x, *_split(x), min_words)


def counted(x: str, min_words: int) -> list[tuple[int, str, int]]:
    """The same with their place and their significant words."""
    own, normal = _split(x)
    drop = _judge(x, normal)
    return [(i, s, n) for i, s in enumerate(own) if (n := significant_words(s)) >= min_words and not drop(s)]


def filtered(x: str, min_words: int) -> tuple[str | None, str]:
    """ORC9 of a text that is not blank: error and text."""
    own, normal = _split(x)
    found = _kept(x, own, normal, min_words)
    return (None, "\n".join(found)) if found else ("all_filtered" if own else "no_sentences", "")


def starts(lengths: list[int], max_items: int, max_chars: int) -> list[int]:
    """Where parts begin, as pack.greedy_starts says; items over max_chars stand for themselves."""
    out, items, chars = [], 0, 0
    for i, n in enumerate(lengths):
        big = n > max_chars
        if items == 0 or big or items == max_items or chars + n + 1 > max_chars:
            out.append(i)
            items, chars = 0, n
        else:
            chars += n + 1
        items = 0 if big else items + 1
    return out


def grouped(values: list[str], at: list[int], sep: str) -> list[str]:
    return [sep.join(values[i:j]) for i, j in zip(at, [*at[1:], len(values)], strict=True)]


def pack_chars(x: str, max_chars: int) -> list[str]:
    """FOLD5, GEN8."""
    flat = SPACES.sub(" ", x).strip(C.WS_CHARS)
    if len(flat) <= max_chars:
        return [flat] if flat else []
    pieces, lengths = [], []
    for t in flat.split(" "):
        cut = [t[i : i + max_chars] for i in range(0, len(t), max_chars)] if len(t) > max_chars else [t]
        pieces += cut
        lengths += [max_chars + 1] * len(cut) if len(t) > max_chars else [len(t)]
    return grouped(pieces, starts(lengths, 1 << 30, max_chars), " ")


def pack_lines(own: list[str], max_lines: int, max_chars: int, max_plain: int) -> list[str]:
    """FOLD4, FLT14."""
    lengths = [len(x) for x in own]
    if not any(TERMINATOR.search(x) for x in own) or (len(own) <= 3 and max(lengths) > max_plain):
        return pack_chars(" ".join(own), max_plain)
    return grouped(own, starts(lengths, max_lines, max_chars), "\n")


def _by_batches(c: Column, symbols: bool, body, kind: str = "array<string>", arrow: pa.DataType = pa.list_(pa.string())) -> Column:  # noqa: B008
    """body of each text of a column of a frame (not within a lambda), symbols stripped first if asked; null where the expressions are to do it."""

    @F.arrow_udf(kind)
    def run(raw: pa.Array) -> pa.Array:
        texts = (decoded(x.as_py(), symbols) for x in raw)
        return pa.array([None if x is None else body(x) for x in texts], arrow)

    return run(c.cast("binary"))


def split_sentences(c: Column, symbols: bool = False) -> Column:
    return _by_batches(c, symbols, lambda x: _split(x)[0])


def word_counts(c: Column, symbols: bool = False) -> Column:
    """The significant words of each sentence."""
    return _by_batches(c, symbols, lambda x: [significant_words(s) for s in _split(x)[0]], "array<int>", pa.list_(pa.int32()))


def good_sentences(c: Column, min_words: int, symbols: bool = False) -> Column:
    return _by_batches(c, symbols, lambda x: good(x, min_words))


def counted_sentences(c: Column, min_words: int, symbols: bool = False) -> Column:
    arrow = pa.list_(pa.struct([("sent_no", pa.int32()), ("sentence", pa.string()), ("n_sig", pa.int32())]))
    return _by_batches(c, symbols, lambda x: counted(x, min_words), "array<struct<sent_no:int,sentence:string,n_sig:int>>", arrow)


def filtered_text(c: Column, min_words: int) -> Column:
    return _by_batches(c, False, lambda x: filtered(x, min_words), "struct<error:string,text:string>", pa.struct([("error", pa.string()), ("text", pa.string())]))


def good_parts(c: Column, min_words: int, max_lines: int, max_chars: int, max_plain: int, symbols: bool = False) -> Column:
    return _by_batches(c, symbols, lambda x: pack_lines(good(x, min_words), max_lines, max_chars, max_plain))
