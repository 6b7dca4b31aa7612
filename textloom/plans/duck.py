"""SQL text for DuckDB (RE2 has no lookahead): builders that the oracle queries are put together from."""

from __future__ import annotations

from ..functions import charclass as C


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def trim(x: str) -> str:
    return sub(x, rf"\A{C.WS}+|{C.WS}+\z", "")


def full(x: str, pattern: str) -> str:
    return f"regexp_full_match({x}, {q(pattern)})"


def strip_symbols(x: str) -> str:
    return sub(x, C.SYMBOL, " ")


def normalize(x: str) -> str:
    spaced = sub(f"trim({sub(sub(x, rf'(?:\.{C.WS}*){{3,}}', '. '), C.WS + '+', ' ')})", r" +([,.;:!?])", r"\1")
    pair = rf"([,.;:!?])([^{C.WS_BODY}\"'”’)\]}}])"
    for _ in range(2):
        spaced = sub(spaced, pair, r"\1 \2")
    return f"trim({sub(spaced, C.WS + '+', ' ')})"


def dialogue(x: str) -> str:
    pattern = rf"([{C.TERMINATORS}]+[{C.CLOSERS}]*){C.WS}*-{C.WS}+([\"'«A-ZА-ЯЁ0-9])"
    return f"replace({sub(x, pattern, chr(92) + '1' + chr(1) + chr(92) + '2')}, chr(1), chr(10))"


def lines(x: str) -> str:
    """Of text whose only line ends are CR and LF."""
    return f"string_split(regexp_replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '\\n\\z', ''), chr(10))"


def split_line(x: str) -> str:
    chunks = f"string_split({dialogue(normalize(x))}, chr(10))"
    stripped = normalize(sub("c", rf"\A{C.WS}*-{C.WS}*", ""))
    found = f"list_transform({chunks}, lambda c: regexp_extract_all({stripped}, {q(rf'.+?(?:[{C.TERMINATORS}]+[{C.CLOSERS}]*|$)')}))"
    return f"list_filter(list_transform(flatten({found}), lambda s: {normalize('s')}), lambda s: s <> '' and not {full('s', f'[{C.TERMINATORS}]+')})"


def sentences(table: str, key: str, text: str) -> str:
    """key, sents: the rebalanced sentences of each text."""
    lead = rf"\A[»”’\"'\)\]\}}]+"
    return f"""
    raw as (select {key}, flatten(list_transform(list_filter(list_transform({lines(text)}, lambda l: {trim('l')}), lambda l: l <> ''), lambda l: {split_line('l')})) s from {table}),
    parted as (select {key}, s, list_transform(s, lambda x, i: case when i = 1 then '' else regexp_extract(x, {q(lead)}) end) cl,
        list_transform(s, lambda x, i: case when i = 1 then x when regexp_matches(x, {q(lead)}) then {normalize(f"regexp_replace(x, {q(lead)}, '')")} else x end) rest from raw),
    living as (select *, list_filter(range(1, len(s) + 1), lambda i: i = 1 or rest[i] <> '') alive from parted),
    balanced as (select {key}, list_transform(alive, lambda k, j: rest[k] || coalesce(array_to_string(cl[k + 1 : coalesce(alive[j + 1], len(s))], ''), '')) sents from living)"""


def n_sig(x: str) -> str:
    fold = "replace(lower(w), 'ß', 'ss')"
    return f"len(list_filter(regexp_extract_all({x}, {q(C.WORD)}), lambda w: {fold} in ({', '.join(map(q, C.SHORT_WORDS))}) or length({fold}) >= 4))"


def n_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, {q(C.WORD_RUN)}))"


def drop_flags(x: str) -> dict[str, str]:
    n = normalize(x)
    return {
        "is_empty": f"{n} = ''",
        "is_moderators": f"replace(lower({n}), 'ß', 'ss') = {q(C.MODERATORS)}",
        "is_weekly": full(f"lower({n})", C.WEEKLY.replace("(?iu)", "")),
        "is_community": full(n, C.COMMUNITY),
        "has_url": f"regexp_matches({n}, {q(C.URL)})",
        "has_cjk": f"regexp_matches({n}, {q(C.CJK)})",
    }


def wrapped(x: str) -> str:
    y = trim(sub(x, C.WS + "+", " "))
    y = sub(sub(y, r" +([,.;:!?])", r"\1"), r"(?:\. *){2,}", ". ")
    return f"trim({sub(sub(y, r'\. +([a-z])', r' \1'), ' +', ' ')})"


def clean_list(x: str) -> str:
    one = sub(sub(trim(sub("z", C.WS + "+", " ")), r" +([,.;:!?])", r"\1"), r"(?:\. *){2,}", ".")
    return f"list_filter(list_transform({x}, lambda z: {one}), lambda z: z <> '' and not {full('z', f'[{C.TERMINATORS}]+')})"


def quality(x: str) -> str:
    count = lambda p: f"(length({x}) - length({sub(x, p, '')}))"
    russian, ln, marks = count("[А-яЁё]"), count(r"[\p{L}\p{N}]"), count(rf"[\p{{P}}{C.WS_BODY}]")
    hints, control = count("[╨╤]"), f"({count(rf'[\p{{C}}{C.WS_BODY}]')} - {count(C.WS)})"
    return f"4 * {russian} + 2 * ({ln} - {russian}) + {marks} - 6 * {hints} - 4 * {control} - 2 * (length({x}) - {ln} - {marks} - {hints} - {control})"


def escape(x: str, quote: bool) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")) + ((('"', "&quot;"), ("'", "&#x27;")) if quote else ()):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x
