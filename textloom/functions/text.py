"""String functions and predicates as Column expressions: JVM-side, no Python workers.

"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import charclass as C


def replace(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: lambda bodies know no common subexpressions, a lambda's variable is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def full(c: Column, pattern: str) -> Column:
    """The whole string matches."""
    return F.regexp_like(c, F.lit(rf"\A(?:{pattern})\z"))


def trim(c: Column) -> Column:
    """White space of all kinds off both ends."""
    return F.btrim(c, F.lit(C.WS_CHARS))


def is_blank(c: Column) -> Column:
    """FLT12."""
    return ~F.regexp_like(c, F.lit(C.FAST_NOT_WS))


def fold_newlines(c: Column) -> Column:
    """What reading in text mode does: CRLF and CR become LF."""
    return replace(c, "\r\n?", "\n")


def lines(c: Column) -> Column:
    """GEN1: an array of lines; a final line end adds no empty line."""
    last = lambda own: F.slice(own, 1, F.size(own) - F.when((F.size(own) > 1) & (F.element_at(own, -1) == ""), 1).otherwise(0))
    return let(_lines(c), last)


def _lines(c: Column) -> Column:
    """Lines, and an empty one after a final line end. Most texts know LF alone, which needs no pattern."""
    other = lambda x: reduce(or_, [F.contains(x, F.lit(e)) for e in C.OTHER_LINE_ENDS])
    return let(c, lambda x: F.when(other(x), F.split(x, C.FAST_LINE_END)).otherwise(F.split(x, "\n")))


def strip_symbols(c: Column) -> Column:
    """STR4: every character but letters, marks, numbers, punctuation, CR, LF and tab becomes a space."""
    return replace(c, C.SYMBOL_NOT_SPACE, " ")


def quality_score(c: Column) -> Column:
    """STR2: weights by character class, the first class that fits."""
    count = lambda pattern: F.length(c) - F.length(replace(c, pattern, ""))
    russian, letters = count("[А-яЁё]"), count(r"[\p{L}\p{N}&&[^А-яЁё]]")
    marks, hints, control = count(rf"[\p{{P}}{C.WS_BODY}]"), count("[╨╤]"), count(rf"[\p{{C}}&&{C.NOT_WS}]")
    rest = F.length(c) - russian - letters - marks - hints - control
    return 4 * russian + 2 * letters + marks - 6 * hints - 4 * control - 2 * rest


def remove_brackets(c: Column, depth: int = 12) -> Column:
    """STR5: text in square brackets goes, nested too; an unmatched opening one takes all that follows, an unmatched closing one stays.

    `depth` innermost levels are removed by expression; deeper nesting (rare) is folded over brackets and what lies between them.
    """
    inner = c
    for _ in range(depth):
        inner = replace(inner, r"\[[^\[\]]*\]", "")
    pieces = F.regexp_extract_all(c, F.lit(r"[\[\]]|[^\[\]]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("d"), F.lit("").alias("out"))

    def step(a, x):
        opens, closes = x == "[", (x == "]") & (a["d"] > 0)
        d = a["d"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        return F.struct(d.alias("d"), F.concat(a["out"], F.when(~opens & ~closes & (a["d"] == 0), x).otherwise("")).alias("out"))

    folded = F.aggregate(pieces, start, step, lambda a: a["out"])
    return let(inner, lambda flat: F.when(F.regexp_like(flat, F.lit(r"\[[^\[\]]*\]")), folded).otherwise(replace(flat, r"(?s)\[.*", "")))


def preprocess(c: Column) -> Column:
    """STR6."""
    return strip_symbols(remove_brackets(c))


def normalize_line(c: Column) -> Column:
    """STR7: spaced dots become one stop, white space collapses, punctuation is set tight before and spaced after.

    One look tells whether any of these steps has something to do; most lines and nearly all sentences have nothing.
    """
    return let(F.trim(c), lambda x: F.when(is_normal(x), x).otherwise(_normalize_line(x)))


#: A place that a step of normalize_line would change, in a text without spaces around it or double ones; three spaced dots always hold one.
_PUNCTUATION = ",.;:!?"
_CHANGED = rf"(?<= [{_PUNCTUATION}])|(?<=[{_PUNCTUATION}])(?=[^{C.FAST_WS_BODY}\"'”’)\]}}])|(?<={C.FAST_WS_NOT_SPACE})"
NOT_NORMAL = rf"[{_PUNCTUATION}{C.FAST_WS_NOT_SPACE}](?:{_CHANGED})"


def is_normal(c: Column) -> Column:
    """normalize_line leaves the text, which has no spaces around it, as it is; so it would any part of it, trimmed."""
    return ~F.contains(c, F.lit("  ")) & ~F.regexp_like(c, F.lit(NOT_NORMAL))


def _normalize_line(c: Column) -> Column:
    collapse = lambda x: F.trim(replace(x, rf"{C.FAST_WS_NOT_SPACE}{C.FAST_WS}*| {C.FAST_WS}+", " "))
    c = collapse(replace(c, rf"\.{C.FAST_WS}*(?:\.{C.FAST_WS}*){{2,}}", ". "))
    c = replace(c, r" +([,.;:!?])", "$1")
    c = replace(c, rf"([,.;:!?])(?=[^{C.FAST_WS_BODY}\"'”’)\]}}])", "$1 ")
    return collapse(c)


def mark_dialogue(c: Column) -> Column:
    """STR8: a dash between a sentence's end and the next speaker becomes a line end."""
    marked = replace(c, rf"([{C.TERMINATORS}]+[{C.CLOSERS}]*){C.FAST_WS}*-{C.FAST_WS}+(?=[\"'«A-ZА-ЯЁ0-9])", "$1\n")
    return F.when(F.contains(c, F.lit("-")), marked).otherwise(c)


def strip_dash(c: Column) -> Column:
    """STR9."""
    return normalize_line(F.when(F.contains(c, F.lit("-")), replace(c, rf"\A{C.FAST_WS}*-{C.FAST_WS}*", "")).otherwise(c))


def split_chunk(c: Column) -> Column:
    """GEN2: every run of terminators with its closers ends a sentence. Of one line."""
    return F.regexp_extract_all(c, F.lit(rf".[^{C.TERMINATORS}]*+(?:[{C.TERMINATORS}]++[{C.CLOSERS}]*+|\z)"), F.lit(0))


def split_line(c: Column) -> Column:
    """GEN3: sentences of a line.

    A normal line without dashes is one chunk, and its sentences need trimming only.
    """
    plain = lambda x: is_normal(x) & ~F.contains(x, F.lit("-"))
    simple = lambda x: F.transform(split_chunk(x), lambda y: F.trim(y))  # noqa: E731 (trim's second parameter is not the index)
    other = lambda x: F.transform(F.flatten(F.transform(F.split(mark_dialogue(x), "\n"), lambda y: split_chunk(strip_dash(y)))), normalize_line)
    again = lambda n: F.when(plain(n), simple(n)).otherwise(other(n))
    found = let(F.trim(c), lambda x: F.when(plain(x), simple(x)).otherwise(let(normalize_line(x), again)))
    return F.filter(found, lambda x: (x != "") & ~(first(x).isin(*C.TERMINATORS) & full(x, f"[{C.TERMINATORS}]+")))


def first(c: Column) -> Column:
    """The first character: a cheap test before a pattern."""
    return F.substring(c, 1, 1)


def rebalance(c: Column) -> Column:
    """FOLD2: leading closers of a sentence go to the one before; what is left empty vanishes.

    The first sentence always stays. Closers between a survivor and the next one all end up at the survivor.
    """
    pattern = f"\\A[{C.LEADING_CLOSERS}]+"

    leading = lambda x: first(x).isin(*C.LEADING_CLOSERS.replace("\\", ""))

    def part(x, i):
        leads = (i > 0) & leading(x)
        closers = F.when(leads, F.regexp_extract(x, pattern, 0)).otherwise("")
        return F.struct(closers.alias("closers"), F.when(leads, normalize_line(replace(x, pattern, ""))).otherwise(x).alias("rest"))

    def join(parts):
        alive = F.filter(F.transform(parts, lambda x, i: F.when((i == 0) | (x["rest"] != ""), i)), lambda i: i.isNotNull())
        return let(alive, lambda alive: F.transform(alive, lambda at, j: joined(parts, alive, at, j)))

    def joined(parts, alive, at, j):
        until = F.coalesce(F.get(alive, j + 1), F.size(parts) - 1)
        moved = F.slice(parts, at + 2, F.greatest(until - at, F.lit(0)))
        return F.concat(F.get(parts, at)["rest"], F.array_join(F.transform(moved, lambda x: x["closers"]), ""))

    # most texts have nothing to move
    moves = lambda own: F.exists(F.slice(own, 2, F.size(own)), lambda x: x.isNull() | (x == "") | leading(x))
    return let(c, lambda own: F.when(moves(own), let(F.transform(own, part), join)).otherwise(own))


def split_sentences(c: Column) -> Column:
    """GEN4: sentences of a text, row-local: no shuffle, order kept by the array."""
    kept = F.filter(F.transform(_lines(c), trim), lambda x: x != "")
    return rebalance(F.flatten(F.transform(kept, split_line)))


def casefold(c: Column) -> Column:
    """STR21."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def significant_words(c: Column) -> Column:
    """FN1."""
    words = F.regexp_extract_all(c, F.lit(C.FAST_WORD), F.lit(0))
    # folding never shortens a word
    return F.size(F.filter(words, lambda w: (F.length(w) >= 4) | casefold(w).isin(*C.SHORT_WORDS) | (F.length(casefold(w)) >= 4)))


def word_count(c: Column) -> Column:
    """FN2."""
    return F.regexp_count(c, F.lit(C.WORD_RUN))


def non_blank_size(c: Column) -> Column:
    """AG1."""
    return F.length(replace(c, C.WS, "")).cast("long")


def contains_cjk(c: Column) -> Column:
    """FLT8."""
    return F.regexp_like(c, F.lit(C.FAST_CJK))


def drop_flags(c: Column) -> dict[str, Column]:
    """FLT9, a flag for each rule; c is normalised first."""
    return rules(normalize_line(c))


def rules(n: Column) -> dict[str, Column]:
    return {
        "is_empty": n == "",
        "is_moderators": (F.length(n) == len(C.MODERATORS)) & (casefold(n) == C.MODERATORS),
        "is_weekly": full(n, C.WEEKLY),
        "is_community": full(n, C.COMMUNITY),
        "has_url": F.regexp_like(n, F.lit(C.FAST_URL)),
        "has_cjk": contains_cjk(n),
    }


def should_drop(c: Column) -> Column:
    """FLT9: any of the rules. One pattern tells whether normalising or the two rules for any place matter; seldom either does."""
    # a URL in a normal text is www. before a closer
    suspect = rf"[{_PUNCTUATION}{C.FAST_WS_NOT_SPACE}{C.FAST_CJK}](?:{_CHANGED}|(?<={C.FAST_CJK})|(?<=[wW]{{3}}\.)(?={C.FAST_NOT_WS}))"
    plain = lambda x: ~F.contains(x, F.lit("  ")) & ~F.regexp_like(x, F.lit(suspect))

    def whole(n):
        flags = rules(n)
        weekly = first(n).isin("о", "О", "ᲂ") & flags["is_weekly"]  # the third (U+1C82) folds to the others
        community = (F.substring(n, 2, 1) == "/") & flags["is_community"]
        return flags["is_empty"] | flags["is_moderators"] | weekly | community

    every = lambda x: let(normalize_line(x), lambda n: reduce(or_, rules(n).values()))
    return let(F.trim(c), lambda x: F.when(plain(x), whole(x)).otherwise(every(x)))


def is_timing_line(c: Column) -> Column:
    """FLT1."""
    return full(trim(c), C.TIMING_LINE)


def is_index_line(c: Column) -> Column:
    """FLT2."""
    return full(trim(c), C.INDEX_LINE)


def looks_like_subtitle(c: Column) -> Column:
    """FLT3."""
    return F.contains(c, F.lit("-->")) & F.exists(lines(c), is_timing_line)


def strip_subtitles(c: Column) -> Column:
    """STR23: index and timing lines and blank ones go; the others are trimmed."""
    kept = F.filter(F.transform(lines(c), trim), lambda x: (x != "") & ~full(x, C.INDEX_LINE) & ~full(x, C.TIMING_LINE))
    return F.array_join(kept, "\n")


def strip_subtitles_if_needed(c: Column) -> Column:
    """STR24."""
    return F.when(looks_like_subtitle(c), strip_subtitles(c)).otherwise(c)


def strip_forum(c: Column) -> Column:
    """FOLD1: comment headers, interface lines and vote counts go; the others are trimmed, blank ones dropped.

    Texts without any such line (most) take the plain path; only the others are folded line by line.
    """
    return let(F.transform(lines(c), trim), _strip_forum)


def _strip_forum(own: Column) -> Column:
    ui = lambda x: x.isin(*C.UI_LINES) | (x == "•") | full(x, C.REPLIES_LINE) | full(x, C.BADGE_LINE)
    marks = F.transform(own, lambda x: F.struct(x.alias("t"), full(x, C.AVATAR_LINE).alias("avatar"), full(x, C.USER_LINE).alias("user"), (x == "•").alias("dot"), full(x, C.AGO_LINE).alias("ago"), ui(x).alias("ui"), x.isin(*C.UI_LINES[:2]).alias("vote"), full(x, C.INDEX_LINE).alias("digits")))
    plain = F.array_join(F.filter(own, lambda x: x != ""), "\n")
    begins = {line[0] for line in (*C.UI_LINES, C.AVATAR_LINE, C.REPLIES_LINE, "•", "Значок", "Комментатор")}
    return F.when(F.exists(own, lambda x: first(x).isin(*sorted(begins)) & (ui(x) | full(x, C.AVATAR_LINE))), let(marks, _fold_forum)).otherwise(plain)


def _fold_forum(marks: Column) -> Column:
    at = lambda i, field: F.coalesce(F.get(marks, i)[field], F.lit(False))
    one = lambda b: F.when(b, 1).otherwise(0)

    def header(i):
        user = one(at(i + 1, "user"))
        dot = one(at(i + 1 + user, "dot"))
        ago = one(at(i + 1 + user + dot, "ago"))
        plain = at(i, "user") & at(i + 1, "dot") & at(i + 2, "ago")
        return F.when(at(i, "avatar"), 1 + user + dot + ago).when(plain, 3).otherwise(0)

    start = F.struct(F.lit(0).alias("skip"), F.lit(False).alias("vote"), F.array().cast("array<string>").alias("out"))

    def step(a, i):
        line, head = F.get(marks, i), header(i)
        skipped = F.struct((a["skip"] - 1).alias("skip"), a["vote"].alias("vote"), a["out"].alias("out"))
        same = F.struct(F.lit(0).alias("skip"), a["vote"].alias("vote"), a["out"].alias("out"))
        headed = F.struct((head - 1).alias("skip"), F.lit(False).alias("vote"), a["out"].alias("out"))
        chrome = F.struct(F.lit(0).alias("skip"), line["vote"].alias("vote"), a["out"].alias("out"))
        kept = F.struct(F.lit(0).alias("skip"), F.lit(False).alias("vote"), F.concat(a["out"], F.array(line["t"])).alias("out"))
        return F.when(a["skip"] > 0, skipped).when(line["t"] == "", same).when(head > 0, headed).when(line["ui"], chrome).when(a["vote"] & line["digits"], same).otherwise(kept)

    return F.aggregate(F.sequence(F.lit(0), F.size(marks) - 1), start, step, lambda a: F.array_join(a["out"], "\n"))


def normalize_wrapped(c: Column) -> Column:
    """STR10."""
    c = trim(replace(c, f"{C.WS}+", " "))
    c = replace(c, r" +([,.;:!?])", "$1")
    c = replace(c, r"(?:\. *){2,}", ". ")
    c = replace(c, r"\. +(?=[a-z])", " ")
    return F.trim(replace(c, " +", " "))


def clean_sentences(c: Column) -> Column:
    """STR11, on an array."""

    def one(x):
        x = trim(replace(x, f"{C.WS}+", " "))
        return replace(replace(x, r" +([,.;:!?])", "$1"), r"(?:\. *){2,}", ".")

    return F.filter(F.transform(c, one), lambda x: (x != "") & ~full(x, f"[{C.TERMINATORS}]+"))


def has_terminator(c: Column) -> Column:
    """FLT13."""
    return F.regexp_like(c, F.lit(f"[{C.TERMINATORS}]"))


def remove_blank_lines(c: Column) -> Column:
    """STR12."""
    return F.array_join(F.filter(lines(c), lambda x: ~is_blank(x)), "\n")


def split_unpunctuated(c: Column) -> Column:
    """GEN6."""
    starts = "|".join(C.SENTENCE_STARTS)
    return F.filter(F.transform(F.split(c, rf"{C.WS}+(?=(?:{starts})(?![\p{{L}}\p{{N}}_]))"), trim), lambda x: x != "")


def html_escape(c: Column, quote: bool) -> Column:
    """STR14."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")) + ((('"', "&quot;"), ("'", "&#x27;")) if quote else ()):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def posix_path(c: Column) -> Column:
    """STR13."""
    return F.replace(c, F.lit("\\"), F.lit("/"))


def part_path(source: Column, number: Column) -> Column:
    """STR15: number 0 is the source; others get S and at least three digits before the suffix."""
    digits = F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string"))
    stem, suffix = F.regexp_extract(source, r"\A(.*?)(\.[^./]*)?\z", 1), F.regexp_extract(source, r"\A(.*?)(\.[^./]*)?\z", 2)
    return F.when(number == 0, source).otherwise(F.concat(stem, F.lit("S"), digits, suffix))


def format_seconds(c: Column) -> Column:
    """STR17."""
    whole = F.greatest(F.lit(1).cast("long"), F.ceil(c))
    minutes, seconds = F.floor(whole / 60), whole % 60
    text = F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m "), F.lpad(seconds.cast("string"), 2, "0"), F.lit("s"))).otherwise(F.concat(seconds.cast("string"), F.lit("s")))
    return F.when(c <= 0, F.lit("0s")).otherwise(text)


#: The heads of a prompt.
PROMPT_HEAD = (
    "# Story Context\n\nUse this context for every part before translating. It is authoritative for character names, genders, relationships, "
    "narrator point of view, and consistent pronouns. Do not translate this context as output.\n\n"
)
PROMPT_BODY = "\n\n# Translation Instructions\n\n"


#: The request around a part's path.
USER_HEAD, USER_TAIL = "\n\n---\nОбработай файл на диске: ", "\nПереведи его содержимое на русский и упрости согласно инструкции выше.\nПерезапиши этот же файл результатом."


def system_prompt(context: Column, template: str) -> tuple[Column, Column]:
    """STR18: the prompt (null on error), and the error: empty_context, non_ascii_context or null."""
    if not template.strip():
        raise ValueError("the prompt template is empty")
    own = trim(context)
    error = F.when(own == "", "empty_context").when(F.regexp_like(own, F.lit(r"[^\x00-\x7F]")), "non_ascii_context")
    return F.when(error.isNull(), F.concat(F.lit(PROMPT_HEAD), own, F.lit(PROMPT_BODY), F.lit(template))), error


def fingerprint(content: Column) -> Column:
    """STR20."""
    return F.sha2(content.cast("binary"), 256)


def user_message(path: Column, prompt: Column) -> Column:
    """STR19: the request for one part: the instructions, a rule, where the part lies and what to do with it."""
    return F.concat(trim(prompt), F.lit(USER_HEAD), path, F.lit(USER_TAIL))
