"""Secret scans by a trigram inverted index; DataFrame and SQL functions only.

Each rule's regular expression yields a Boolean trigram query. Postings (trigram, doc_id) are kept for the
trigrams that any query names; intersecting them gives each rule's candidates, and only these are verified
with the expression. A rule without mandatory trigrams (hex) scans every text. Candidates are written, and
counted before they are joined back: broadcast up to BROADCAST_ROWS, by a sort-merge join beyond.

Defined results: null text is empty; a null doc_id is a candidate of every rule; rows with equal doc_ids
share postings, which only widens their candidates; every row is returned once; a text of any length is scanned whole,
in one task; overlapping spans of several rules are all kept, ordered by start and rule; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from re import _constants as C
from re import _parser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1  # shorter ones are dropped after matching
    base: bool = False


#: The rules, in the order of their kinds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
)
#: Candidate ids (8 bytes and a mask) that are broadcast at most.
BROADCAST_ROWS = 500_000
#: Matches of a text whose places are summed up together.
CHUNK = 128
#: Alternatives of one literal stretch that are followed at most; beyond, the stretch gives no trigrams.
MOST_STRINGS = 64

Query = list[list[frozenset[str]]]  # all of (any of (all of trigrams))


def trigram_query(pattern: str) -> Query:
    """Trigrams, in lower case, that every match must hold: for each literal stretch, its possible strings, each as a set of trigrams."""
    clauses: Query = []

    def close(strings: set[str]) -> None:
        if strings and all(len(s) >= 3 for s in strings):
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
            clauses.append(sorted((x for x in sets if not any(y < x for y in sets)), key=sorted))

    def exact(nodes) -> set[str] | None:
        """All strings of the nodes, or None where they are too many."""
        out = {""}
        for op, arg in nodes:
            one = single(op, arg)
            if one is None or len(out) * len(one) > MOST_STRINGS:
                return None
            out = {a + b for a in out for b in one}
        return out

    def single(op, arg) -> set[str] | None:
        if op is C.LITERAL:
            return {chr(arg).lower()}
        if op is C.SUBPATTERN:
            return exact(arg[3])
        if op is C.BRANCH:
            found = [exact(x) for x in arg[1]]
            return None if None in found else set().union(*found)
        if op is C.IN and all(o in (C.LITERAL, C.RANGE) for o, _ in arg):
            chars = {chr(c).lower() for o, a in arg for c in ([a] if o is C.LITERAL else range(a[0], a[1] + 1))}
            return chars if len(chars) <= 8 else None
        if op is C.MAX_REPEAT and arg[1] <= 2:
            one = exact(arg[2])
            return None if one is None else set().union(*({a * n for a in one} for n in range(arg[0], int(arg[1]) + 1)))
        return None

    at = {""}
    for op, arg in _parser.parse(pattern):
        one = single(op, arg)
        if one is not None and len(at) * len(one) <= MOST_STRINGS:
            at = {a + b for a in at for b in one}
        else:
            close(at)
            at = one if one is not None else {""}
    close(at)
    return clauses


def trigrams(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for clause in trigram_query(r.pattern) for option in clause for t in option})


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index (trigram, doc_id), for the trigrams of the rules' queries. One pass, no shuffle."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text")).alias("low"))
    found = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in trigrams(rules)]))
    return named.where("doc_id is not null and low is not null").select(F.explode(found).alias("trigram"), "doc_id")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and a bit for each rule whose query its postings fulfil; documents that fulfil none are left out."""
    known = trigrams(rules)
    if not known:
        return index.select("doc_id", F.lit(0).cast("long").alias("rules")).where("false")
    place = {t: divmod(i, 62) for i, t in enumerate(known)}
    masks = []
    for word in range(place[known[-1]][0] + 1):
        bits = F.create_map(*[x for t, (w, b) in place.items() if w == word for x in (F.lit(t), F.lit(1 << b).cast("long"))])
        masks.append(F.coalesce(F.bit_or(bits[F.col("trigram")]), F.lit(0).cast("long")).alias(f"mask{word}"))
    rule_bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        if query := trigram_query(rule.pattern):
            fulfilled = F.lit(True)
            for clause in query:
                fulfilled = fulfilled & reduce(or_, [reduce(and_, [_has(place, word, option) for word in range(len(masks))]) for option in clause])
            rule_bits = rule_bits.bitwiseOR(F.when(fulfilled, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return index.groupBy("doc_id").agg(*masks).select("doc_id", rule_bits.alias("rules")).where("rules <> 0")


def _has(place: dict[str, tuple[int, int]], word: int, option: frozenset[str]):
    wanted = sum(1 << place[t][1] for t in option if place[t][0] == word)
    return F.col(f"mask{word}").bitwiseAND(F.lit(wanted).cast("long")) == wanted


def _literal(pattern: str) -> str:
    """The pattern as a SQL string, for both regular expression and string escapes."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


NONE = "cast(array() as array<struct<s:int,k:int,e:int>>)"


def spans_of(rule: Rule, number: int, text: str = "text") -> str:
    """SQL for a rule's spans in a text: structs of start, kind number and end, in code points.

    Matches and the pieces between them alternate, so running sums of their lengths give the places. Appending copies
    an array, so sums run within stretches of CHUNK matches, and over stretches: work is far from quadratic.
    """
    p = _literal(rule.pattern)
    lengths = f"""transform(arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {rule.group})),
        x -> named_struct('before', length(x.`0`), 'own', coalesce(length(x.`1`), 0), 'counted', length(x.`2`)))"""
    stretches = f"transform(sequence(0, cast((size(l) - 1) div {CHUNK} as int)), i -> slice(l, i * {CHUNK} + 1, {CHUNK}))"
    begins = """aggregate(stretches, named_struct('at', 0, 'out', cast(array() as array<int>)),
        (a, c) -> named_struct('at', a.at + aggregate(c, 0, (t, x) -> t + x.before + x.own), 'out', concat(a.out, array(a.at))), a -> a.out)"""
    own = f"""aggregate(c, named_struct('at', b, 'out', {NONE}), (a, x) -> named_struct('at', a.at + x.before + x.own, 'out', case when x.counted >= {rule.least}
        then concat(a.out, array(named_struct('s', a.at + x.before, 'k', {number}, 'e', a.at + x.before + x.own))) else a.out end), a -> a.out)"""
    bound = f"transform(transform(array({lengths}), l -> {stretches}), stretches -> flatten(zip_with(stretches, {begins}, (c, b) -> {own})))[0]"
    return f"case when rlike({text}, {p}) then {bound} else {NONE} end"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, and spans: an array of (s, k, e) with k the number of the rule, in order of start and rule; base: the same of base rules."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = common.Scratch(docs.sparkSession, "secrets").table(candidates(postings(docs, rules), rules), "candidates")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    every = F.when(F.col("doc_id").isNull(), -1).otherwise(0).cast("long")
    joined = docs.join(found, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("rules", every).alias("rules"))
    each = [f"case when (rules & {1 << i}L) <> 0 then {spans_of(r, i)} else {NONE} end" if trigram_query(r.pattern) else spans_of(r, i) for i, r in enumerate(rules)]
    spans = joined.select("doc_id", F.array_sort(F.expr(f"concat({', '.join(each)})")).alias("spans"))
    base = ", ".join(str(i) for i, r in enumerate(rules) if r.base)
    return spans.select("doc_id", "spans", F.expr(f"filter(spans, x -> x.k in ({base or -1}))").alias("base"))


def report(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    names = "array(" + ", ".join(f"'{r.kind}'" for r in rules) + ")"
    joined = lambda c: f"array_join(transform({c}, x -> concat(element_at({names}, x.k + 1), ':', x.s, ':', x.e)), ',')"
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) as bigint)").alias(f"n_{r.kind}") for i, r in enumerate(rules) if r.base]
    return scanned.select("doc_id", *counts, F.sha2(F.expr(joined("base")).cast("binary"), 256).alias("base_sha256"), F.expr(joined("spans")).alias("spans"))
