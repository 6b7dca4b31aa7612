"""SQL for DuckDB, where it can express an operator's whole result."""

from __future__ import annotations

from .secrets import RULES


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _spans(number: int) -> str:
    rule = RULES[number]
    p = _q(rule.pattern)
    return f"""select k, {number} kind, unnest(list_filter(list_transform(regexp_extract_all(t, {p}), lambda m, i:
        struct_pack(s := list_sum(list_transform(string_split_regex(t, {p})[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, {p})[1:i-1], lambda x: length(x))), 0),
                    n := length(m), g := length(regexp_extract_all(t, {p}, {rule.group})[i]))), lambda x: x.g >= {rule.least})) x from d where regexp_matches(t, {p})"""


_NAMES = "[" + ", ".join(_q(r.kind) for r in RULES) + "]"
_BASE = ", ".join(str(i) for i, r in enumerate(RULES) if r.base)
SECRETS = f"""with d as (select row_number() over () k, doc_id, coalesce(text, '') t from documents),
found as ({' union all '.join(_spans(i) for i in range(len(RULES)))}),
named as (select k, kind, x.s::bigint s, {_NAMES}[kind + 1] || ':' || x.s::bigint || ':' || (x.s + x.n)::bigint span from found),
summed as (select k, count(*) filter (where kind = 0) n_assign, count(*) filter (where kind = 1) n_access, count(*) filter (where kind = 2) n_hex,
    string_agg(span, ',' order by s, kind) filter (where kind in ({_BASE})) base, string_agg(span, ',' order by s, kind) spans from named group by k)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join summed using (k)"""

NEAR_DUPS = r"""with recursive d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, case when w is null or len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end g from d),
n as (select doc_id, len(g) n, md5(array_to_string(list_sort(g), chr(10))) sig from s),
rep as (select min(doc_id) r, any_value(n) n, sig from n where n > 0 group by sig),
e as (select r, unnest(g) x from rep join s on s.doc_id = rep.r),
f as (select x, count(*) c from e group by x having c > 1),
p as (select a.r a, b.r b, count(*) c from e a join f using (x) join e b on a.x = b.x and a.r < b.r group by 1, 2),
l as (select a, b from p join rep ra on ra.r = a join rep rb on rb.r = b where 100 * c >= 85 * (ra.n + rb.n - c)),
both_ways as (select a, b from l union all select b, a from l),
reach as (select r a, r b from rep union select reach.a, both_ways.b from reach join both_ways on reach.b = both_ways.a),
comp as (select a r, min(b) c from reach group by a)
select n.doc_id, n.n n_shingles, coalesce(comp.c, n.doc_id) component_id, n.doc_id = coalesce(comp.c, n.doc_id) kept from n left join rep using (sig) left join comp on comp.r = rep.r and n.n > 0"""

#: Bytes as two hexadecimal digits each; strings are cut from pieces of 256 starts, for a cut deep in a text counts its way there.
SUBSTRINGS = """with d as (select row_number() over () k, doc_id, hex(encode(coalesce(text, ''))) h from documents),
blocks as (select k, unnest(range(0, greatest(len(h) // 2 - 199, 0), 256)) b, len(h) // 2 n, h from d),
cut as (select k, b, n, substr(h, 2 * b + 1, 910) piece from blocks),
placed as (select k, b, piece, unnest(range(0, least(256, n - 199 - b))) o from cut),
starts as (select k, b + o s, md5(substr(piece, 2 * o + 1, 400)) x from placed),
again as (select x from starts group by x having count(*) > 1),
hit as (select k, s, lag(s) over (partition by k order by s) p from starts semi join again using (x)),
run as (select k, s, sum(case when p is null or s > p + 200 then 1 else 0 end) over (partition by k order by s) r from hit),
span as (select k, r, min(s) a, max(s) + 200 z from run group by k, r),
gap as (select k, r, a, z, coalesce(lag(z) over (partition by k order by r), 0) f from span),
kept as (select k, sum(gap.z - gap.a)::bigint n_removed, count(*) n_spans, max(gap.z) last, string_agg(substr(h, (2 * f + 1)::bigint, (2 * (a - f))::bigint), '' order by r) parts from gap join d using (k) group by k)
select doc_id, (len(h) // 2)::bigint n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans,
    sha256(unhex(coalesce(parts, '') || substr(h, (2 * coalesce(last, 0) + 1)::bigint))) kept_sha256 from d left join kept using (k)"""

ORACLE_SQL = {"op4_near_dups": NEAR_DUPS, "op5_secrets": SECRETS, "op8_substrings": SUBSTRINGS}
