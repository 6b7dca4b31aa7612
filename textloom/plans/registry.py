"""Queries over the driver's tables, each with the SQL that DuckDB runs over the same tables.

Where the tables lack what an operator looks for, the query makes it from the rows themselves (a wrapping,
a replacement), the same way in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import charclass as C
from ..functions import codec
from ..functions import sentences as S
from ..functions import text as T
from ..operators import catalog, clean, pack, part_files, regroup, transform, validate
from . import duck as D

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return clean.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def c(name: str):
    return F.col(name)


_SENTENCES = f"with base as (select doc_id, {D.strip_symbols('text')} t from documents), {D.sentences('base', 'doc_id', 't')}, each as (select doc_id, unnest(sents) sentence, unnest(range(0, len(sents))) sent_no from balanced)"
_DROP = " or ".join(f"({x})" for x in D.drop_flags("sentence").values())


@query(f"{_SENTENCES} select doc_id, sent_no::int sent_no, sentence, {D.n_sig('sentence')}::int n_sig from each where {D.n_sig('sentence')} >= 3 and not ({_DROP})")
def clean_sentences(spark, sf_dir):
    """STR4, GEN1 to GEN4, FOLD2, FLT9, FLT10, FN1."""
    return clean.clean_sentences(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"{_SENTENCES} select doc_id, count(*)::bigint n_sentences, count(*) filter (where {D.n_sig('sentence')} >= 1)::bigint k1, count(*) filter (where {D.n_sig('sentence')} >= 3)::bigint k3, count(*) filter (where {D.n_sig('sentence')} >= 5)::bigint k5 from each group by doc_id")
def filter_min_words(spark, sf_dir):
    """FLT10 at three thresholds. Counted within the row: no shuffle."""
    n = F.coalesce(S.word_counts(c("text"), symbols=True), F.transform(T.split_sentences(T.strip_symbols(c("text"))), T.significant_words))
    at = lambda n, k: F.size(F.filter(n, lambda x: x >= k)).cast("long").alias(f"k{k}")
    counts = T.let(n, lambda n: F.struct(F.size(n).cast("long").alias("n_sentences"), at(n, 1), at(n, 3), at(n, 5)))
    return clean.kept_rows(table(spark, sf_dir, "documents"), ["doc_id"], counts, lambda x: x["n_sentences"] > 0)


@query(f"select page_id, md5({D.strip_symbols('html')}) stripped from pages")
def strip_symbols(spark, sf_dir):
    """STR4 over raw pages."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_symbols(c("html")).cast("binary")).alias("stripped"))


@query(f"select doc_id, (i - 1)::int line_no, {D.normalize('ls[i]')} line from (select doc_id, ls, unnest(range(1, len(ls) + 1)) i from (select doc_id, {D.lines('text')} ls from documents))")
def normalize_line(spark, sf_dir):
    """GEN1, STR7."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(c("text"))).alias("line_no", "line")).withColumn("line", T.normalize_line(c("line")))


@query(f"select doc_id, {D.dialogue('replace(text, chr(46) || chr(32), chr(46) || chr(32) || chr(45) || chr(32))')} marked from documents")
def dialogue_boundaries(spark, sf_dir):
    """STR8, with dashes put after full stops."""
    return table(spark, sf_dir, "documents").select("doc_id", T.mark_dialogue(F.replace(c("text"), F.lit(". "), F.lit(". - "))).alias("marked"))


_QUOTED = "replace(replace(text, '. ', '. \"'), ', ', '»). ')"


@query(f"with base as (select doc_id, {_QUOTED} t from documents), {D.sentences('base', 'doc_id', 't')} select doc_id, array_to_string(sents, chr(10)) sentences, len(sents)::int n from balanced where len(sents) > 0")
def rebalance_closers(spark, sf_dir):
    """GEN2, GEN3, FOLD2, with quotes and closers put in."""
    quoted = F.replace(F.replace(c("text"), F.lit(". "), F.lit('. "')), F.lit(", "), F.lit("»). "))
    joined = T.let(clean.split_sentences(quoted), lambda s: F.struct(F.array_join(s, "\n").alias("sentences"), F.size(s).alias("n")))
    return clean.kept_rows(table(spark, sf_dir, "documents"), ["doc_id"], joined, lambda x: x["n"] > 0)


@query(f"select doc_id, {D.n_sig('text')}::int n_sig, {D.n_words('text')}::int n_words, length({D.sub('text', C.WS, '')})::bigint n_visible from documents")
def word_counts(spark, sf_dir):
    """FN1, FN2, AG1."""
    return table(spark, sf_dir, "documents").select("doc_id", T.significant_words(c("text")).alias("n_sig"), T.word_count(c("text")).alias("n_words"), T.non_blank_size(c("text")).alias("n_visible"))


_MADE = "case doc_id % 8 when 0 then 'Посмотреть ВСЕХ модераторов' when 1 then 'Опубликованных  материалов за НЕДЕЛЮ' when 2 then 'R/' || source when 3 then 'see www.'')' || lang when 4 then lang || '漢字' when 5 then '  ' when 6 then 'u/x' else text end"


@query(f"""with lines as (select doc_id, (i - 1)::int line_no, ls[i] line from (select doc_id, ls, unnest(range(1, len(ls) + 1)) i from (select doc_id, {D.lines('text')} ls from documents)) union all select doc_id, -1, {_MADE} from documents)
select doc_id, line_no, {', '.join(f'{x} {k}' for k, x in D.drop_flags('line').items())} from lines""")
def drop_rules(spark, sf_dir):
    """FLT8, FLT9, a flag for each rule, on every line of every document, and beside them, as line -1, a made line or the whole text as one."""
    docs = table(spark, sf_dir, "documents")
    own = docs.select("doc_id", F.posexplode(T.lines(c("text"))).alias("line_no", "line"))
    made = docs.select("doc_id", F.lit(-1).alias("line_no"), F.expr(_MADE.replace("''", "\\'")).alias("line"))
    return own.unionByName(made).select("doc_id", "line_no", *[f.alias(k) for k, f in T.drop_flags(c("line")).items()])


_CUES = "(turn + 1) || chr(10) || '00:0' || (turn % 10) || ':01,5' || case when turn % 3 = 0 then '00' else '' end || ' --> 00:0' || (turn % 10) || ':04.250' || case when turn % 2 = 0 then ' align:start' else '' end || chr(10) || text || chr(10) || '  ' || chr(10)"


@query(f"select conv_id, turn, array_to_string(list_filter(list_transform({D.lines('t')}, lambda l: {D.trim('l')}), lambda l: l <> '' and not {D.full('l', C.INDEX_LINE)} and not {D.full('l', C.TIMING_LINE)}), chr(10)) stripped, len(list_filter({D.lines('t')}, lambda l: {D.full('l', C.TIMING_LINE)})) > 0 is_subtitle from (select conv_id, turn, {_CUES} t from conversations)")
def strip_subtitles(spark, sf_dir):
    """FLT1 to FLT3, STR23, STR24, on turns dressed as cues."""
    made = table(spark, sf_dir, "conversations").withColumn("t", F.expr(_CUES))
    return made.select("conv_id", "turn", T.strip_subtitles_if_needed(c("t")).alias("stripped"), T.looks_like_subtitle(c("t")).alias("is_subtitle"))


_POST = """case turn % 5 when 0 then 'Аватар u/' || role || chr(10) || role || chr(10) || '•' || chr(10) || '3 ч. назад' || chr(10) when 1 then role || chr(10) || '•' || chr(10) || '12 дн. назад' || chr(10)
 when 2 then 'Аватар u/x_1' || chr(10) || '•' || chr(10) when 3 then role || chr(10) || '•' || chr(10) || 'soon' || chr(10) else 'Значок профиля за достижение Комментатор из топ-1%' || chr(10) end || text || chr(10)
 || 'Нравится' || chr(10) || chr(10) || '42' || chr(10) || '7' || chr(10) || case when turn % 2 = 0 then 'Ответить' || chr(10) || '9' || chr(10) else 'Еще 3 ответа' || chr(10) end || '  tail ' || turn"""
_m = {"avatar": D.full("l", C.AVATAR_LINE), "usr": D.full("l", C.USER_LINE), "dot": "l = '•'", "ago": D.full("l", C.AGO_LINE), "ui": f"(l in ({', '.join(map(D.q, C.UI_LINES))}) or l = '•' or {D.full('l', C.REPLIES_LINE)} or {D.full('l', C.BADGE_LINE)})", "vote": "l in ('Нравится', 'Не нравится')", "digits": D.full("l", C.INDEX_LINE)}
_ix = lambda f, at: f"coalesce((m[{at}]).{f}, false)"
_FORUM = f"""with base as (select conv_id, turn, {_POST} t from conversations),
marked as (select conv_id, turn, list_transform({D.lines('t')}, lambda r: {D.trim('r')}) ls from base),
m1 as (select conv_id, turn, list_transform(ls, lambda l: struct_pack(t := l, {', '.join(f'{k} := {v}' for k, v in _m.items())})) m from marked),
m2 as (select conv_id, turn, m, unnest(range(1, len(m) + 1)) i from m1),
m3 as (select conv_id, turn, i, m[i] x, case when {_ix('avatar', 'i')} then
   1 + {_ix('usr', 'i + 1')}::int + {_ix('dot', f"i + 1 + {_ix('usr', 'i + 1')}::int")}::int + {_ix('ago', f"i + 1 + {_ix('usr', 'i + 1')}::int + {_ix('dot', 'i + 1 + ' + _ix('usr', 'i + 1') + '::int')}::int")}::int
   when {_ix('usr', 'i')} and {_ix('dot', 'i + 1')} and {_ix('ago', 'i + 2')} then 3 else 0 end head from m2),
m4 as (select conv_id, turn, list(struct_pack(skip := 0, vote := false, o := [x.t], head := head, ui := x.ui, v := x.vote, d := x.digits) order by i) f from m3 group by conv_id, turn),
m5 as (select conv_id, turn, list_reduce(f, lambda a, x: case
   when a.skip > 0 then struct_pack(skip := a.skip - 1, vote := a.vote, o := a.o, head := 0, ui := false, v := false, d := false)
   when x.o[1] = '' then struct_pack(skip := 0, vote := a.vote, o := a.o, head := 0, ui := false, v := false, d := false)
   when x.head > 0 then struct_pack(skip := x.head - 1, vote := false, o := a.o, head := 0, ui := false, v := false, d := false)
   when x.ui then struct_pack(skip := 0, vote := x.v, o := a.o, head := 0, ui := false, v := false, d := false)
   when a.vote and x.d then struct_pack(skip := 0, vote := a.vote, o := a.o, head := 0, ui := false, v := false, d := false)
   else struct_pack(skip := 0, vote := false, o := list_concat(a.o, x.o), head := 0, ui := false, v := false, d := false) end,
   struct_pack(skip := 0, vote := false, o := []::varchar[], head := 0, ui := false, v := false, d := false)) r from m4)
select conv_id, turn, array_to_string(r.o, chr(10)) stripped from m5"""


@query(_FORUM)
def strip_forum(spark, sf_dir):
    """FLT4 to FLT7, FOLD1, on turns dressed as comments."""
    return table(spark, sf_dir, "conversations").withColumn("t", F.expr(_POST)).select("conv_id", "turn", T.strip_forum(c("t")).alias("stripped"))


_BRACKETED = "case doc_id % 4 when 0 then replace(replace(t, ', ', ' [a [b '), '. ', ' ] c] ') when 1 then replace(t, ', ', ' [x] ') when 2 then replace(t, '. ', ' ] ') else t || ' [ ' || t end"


@query(f"""with base as (select doc_id, regexp_extract_all({_BRACKETED}, '[\\[\\]]|[^\\[\\]]+') ch from (select doc_id, text t from documents)),
e as (select doc_id, ch[i] x, i from (select doc_id, ch, unnest(range(1, len(ch) + 1)) i from base)),
d as (select *, sum(case x when '[' then 1 when ']' then -1 else 0 end) over (partition by doc_id order by i) s from e),
m as (select *, s - least(0, min(s) over (partition by doc_id order by i)) depth, lag(s, 1, 0) over (partition by doc_id order by i) - least(0, coalesce(min(s) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)) was from d),
u as (select doc_id, coalesce(string_agg(x, '' order by i) filter (where (x <> '[' and x <> ']' and depth = 0) or (x = ']' and was = 0)), '') cleaned from m group by doc_id)
select b.doc_id, case when ch is null then null else coalesce(cleaned, '') end cleaned from base b left join u using (doc_id)""")
def strip_brackets(spark, sf_dir):
    """STR5, FOLD6 over whole texts, with brackets put in, matched and not. The SQL goes by brackets and what lies between."""
    made = table(spark, sf_dir, "documents").select("doc_id", c("text").alias("t"))
    return made.select("doc_id", T.remove_brackets(F.expr(_BRACKETED)).alias("cleaned"))


@query()
def repair_mojibake(spark, sf_dir):
    """STR1, AG4, TOP1: texts misread as Latin-1. No SQL for the codecs; the tests hold it against Python's own."""
    made = table(spark, sf_dir, "documents").select("doc_id", F.decode(F.encode(c("text"), "UTF-8"), "ISO-8859-1").alias("text"))
    return codec.repair_mojibake(made, "text")


_APART = "replace(replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776)), 'ñ', 'n' || chr(771))"


@query(f"select doc_id, nfc_normalize({_APART}) composed from documents")
def nfc(spark, sf_dir):
    """STR3, on texts taken apart."""
    apart = c("text")
    for whole, base, mark in (("é", "e", "́"), ("ü", "u", "̈"), ("ñ", "n", "̃")):
        apart = F.replace(apart, F.lit(whole), F.lit(base + mark))
    return table(spark, sf_dir, "documents").select("doc_id", codec.nfc(apart).alias("composed"))


@query(f"select page_id, ({D.quality('html')})::bigint score from pages")
def quality_score(spark, sf_dir):
    """STR2."""
    return table(spark, sf_dir, "pages").select("page_id", T.quality_score(c("html")).cast("long").alias("score"))


def _packed_sql(lines: int, chars: int, plain: int) -> str:
    empty = "struct_pack(part := 0, items := 0, chars := 0, ids := []::int[], n := 0)"
    def new(part, items, n):
        return f"struct_pack(part := {part}, items := {items}, chars := {n}, ids := list_concat(a.ids, [{part}]), n := 0)"
    fold = f"""list_reduce(list_transform(sents, lambda s: struct_pack(part := 0, items := 0, chars := 0, ids := []::int[], n := length(s)::int)), lambda a, x: case
      when x.n > {chars} then struct_pack(part := a.part + (a.items > 0)::int + 1, items := 0, chars := 0, ids := list_concat(a.ids, [a.part + (a.items > 0)::int]), n := 0)
      when a.items > 0 and (a.items + 1 > {lines} or a.chars + x.n + 1 > {chars}) then {new('a.part + 1', '1', 'x.n')}
      when a.items = 0 then {new('a.part', '1', 'x.n')} else {new('a.part', 'a.items + 1', 'a.chars + x.n + 1')} end, {empty})"""
    lined = f"regexp_matches(array_to_string(sents, ' '), '[.!?…]') and not (len(sents) <= 3 and list_max(list_transform(sents, lambda z: length(z))) > {plain})"
    return f"""{_SENTENCES}, lists as (select doc_id, list(sentence order by sent_no) sents from each where {D.n_sig('sentence')} >= 3 and not ({_DROP}) group by doc_id),
    ids as (select doc_id, sents, ({fold}).ids ids from lists where {lined}),
    flat as (select doc_id, unnest(sents) s, unnest(ids) part, unnest(range(0, len(sents))) i from ids),
    lined as (select doc_id, (part + 1)::int part_no, string_agg(s, chr(10) order by i) part_text, count(*)::int n_lines from flat group by doc_id, part),
    plain as (select doc_id, trim(regexp_replace(array_to_string(sents, ' '), '\\s+', ' ', 'g')) t from lists where not ({lined})),
    {_packed_chars_sql(plain)}
    select * from lined union all select doc_id, part_no, part_text, 1 n_lines from packed_chars"""


def _packed_chars_sql(limit: int) -> str:
    """FOLD5 of plain(doc_id, t), where no token is longer than a part: packed_chars(doc_id, part_no, part_text)."""
    return f"""tok as (select doc_id, t, list_transform(string_split(t, ' '), lambda w: struct_pack(part := 0, chars := 0, ids := []::int[], n := length(w)::int)) ws from plain where length(t) > {limit}),
    cids as (select doc_id, t, (list_reduce(ws, lambda a, x: case when a.chars = 0 then struct_pack(part := a.part, chars := x.n, ids := list_concat(a.ids, [a.part]), n := 0)
      when a.chars + 1 + x.n > {limit} then struct_pack(part := a.part + 1, chars := x.n, ids := list_concat(a.ids, [a.part + 1]), n := 0)
      else struct_pack(part := a.part, chars := a.chars + 1 + x.n, ids := list_concat(a.ids, [a.part]), n := 0) end, struct_pack(part := 0, chars := 0, ids := []::int[], n := 0))).ids ids from tok),
    cflat as (select doc_id, unnest(string_split(t, ' ')) w, unnest(ids) part, unnest(range(0, len(ids))) i from cids),
    packed_chars as (select doc_id, (part + 1)::int part_no, string_agg(w, ' ' order by i) part_text from cflat group by doc_id, part union all select doc_id, 1, t from plain where length(t) between 1 and {limit})"""


def _packed(spark, sf_dir, **limits):
    return pack.sentence_parts(table(spark, sf_dir, "documents").select("doc_id", "text"), **limits).select("doc_id", "part_no", "part_text", "n_lines")


@query(_packed_sql(300, 10_000, 12_000))
def pack_parts(spark, sf_dir):
    """FOLD4, FLT14, FOLD5: lines, or characters where a text has no terminator."""
    return _packed(spark, sf_dir)


@query(_packed_sql(6, 400, 60))
def pack_parts_small(spark, sf_dir):
    """FOLD4, FLT14, AG3, FOLD5 with limits at which lines, characters and the plain limit all bind."""
    return _packed(spark, sf_dir, max_lines=6, max_chars=400, max_plain=60)


@query("""with base as (select doc_id, trim(regexp_replace(regexp_replace(text, '[.!?…]', ' ', 'g'), '\\s+', ' ', 'g')) t from documents),
tok as (select doc_id, t, list_transform(string_split(t, ' '), lambda w: struct_pack(part := 0, chars := 0, ids := []::int[], n := length(w)::int)) ws from base where length(t) > 2000),
ids as (select doc_id, t, (list_reduce(ws, lambda a, x: case when a.chars = 0 then struct_pack(part := a.part, chars := x.n, ids := list_concat(a.ids, [a.part]), n := 0)
  when a.chars + 1 + x.n > 2000 then struct_pack(part := a.part + 1, chars := x.n, ids := list_concat(a.ids, [a.part + 1]), n := 0)
  else struct_pack(part := a.part, chars := a.chars + 1 + x.n, ids := list_concat(a.ids, [a.part]), n := 0) end, struct_pack(part := 0, chars := 0, ids := []::int[], n := 0))).ids ids from tok),
flat as (select doc_id, unnest(string_split(t, ' ')) w, unnest(ids) part, unnest(range(0, len(ids))) i from ids)
select doc_id, (part + 1)::int part_no, string_agg(w, ' ' order by i) part_text from flat group by doc_id, part
union all select doc_id, 1, t from base where length(t) between 1 and 2000""")
def pack_chars(spark, sf_dir):
    """FOLD5, GEN9, on texts without terminators (no token is longer than a part here; the tests have such)."""
    plain = T.replace(c("text"), "[.!?…]", " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pack.pack_chars(plain, 2000)).alias("part_no", "part_text")).withColumn("part_no", c("part_no") + 1)


@query(f"""with p as (select a.conv_id, a.turn, length({D.sub('a.text', C.WS, '')})::bigint source_size, length({D.sub('b.text', C.WS, '')})::bigint translated_size from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.role = 'user' and b.role = 'assistant')
select conv_id, turn, source_size, translated_size, case when source_size > 0 then translated_size / source_size end ratio, case when source_size = 0 then 'zero_source' when translated_size / source_size < 0.6 then 'too_short' when translated_size / source_size > 1.4 then 'too_long' else 'ok' end status from p""")
def validate_ratio(spark, sf_dir):
    """AG2, FLT15, JN1, JN5: a user's turn against the answer."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", c("text").alias("source"))
    told = turns.where("role = 'assistant'").select("conv_id", (c("turn") - 1).alias("turn"), c("text").alias("translated"))
    return validate.validate(asked.join(told, ["conv_id", "turn"]), "source", "translated").drop("source", "translated")


_PIECES = rf"regexp_extract_all(flat, {D.q(rf'[^{C.TERMINATORS}]+(?:[{C.TERMINATORS}]+[' + chr(34) + chr(39) + '”’)]*|$)')})"


@query(f"""with j as (select conv_id, count(*)::int n_parts, string_agg(text, chr(10) || chr(10) order by turn) t from conversations group by conv_id),
f as (select conv_id, n_parts, {D.wrapped('t')} flat from j),
s as (select conv_id, n_parts, case when regexp_matches(flat, '[.!?…]') then {D.clean_list(_PIECES)} else [flat] end sents from f where flat <> ''),
g as (select conv_id, n_parts, sents, (list_reduce(list_transform(sents, lambda z: struct_pack(g := 0, held := 0, words := 0, ids := []::int[], w := {D.n_words('z')}::int)), lambda a, x: case
  when (case when a.held = 0 then x.w >= 8 else a.words + x.w >= 8 or a.held + 1 >= 4 end) then struct_pack(g := a.g + 1, held := 0, words := 0, ids := list_concat(a.ids, [a.g]), w := 0)
  else struct_pack(g := a.g, held := a.held + 1, words := a.words + x.w, ids := list_concat(a.ids, [a.g]), w := 0) end, struct_pack(g := 0, held := 0, words := 0, ids := []::int[], w := 0))).ids ids from s),
u as (select conv_id, n_parts, unnest(sents) z, unnest(ids) g, unnest(range(0, len(ids))) i from g),
l as (select conv_id, n_parts, g, string_agg(z, ' ' order by i) line from u group by all)
select f.conv_id, f.n_parts, (select string_agg(line, chr(10) order by g) from l where l.conv_id = f.conv_id) merged from f""")
def merge_regroup(spark, sf_dir):
    """STR10, STR11, GEN5, FOLD3, ORC7, AG5: turns merged as parts."""
    return regroup.merge_parts(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("""with p as (select distinct 'd' || (doc_id // 40) stem, (doc_id % 40)::int + 1 n from labels),
r as (select stem, n, row_number() over (partition by stem order by n) k from p)
select stem, count(*) filter (where n = k) run_length, count(*) filter (where n > k) n_orphans, coalesce(string_agg(lpad(n::varchar, 3, '0'), ',' order by n) filter (where n > k), '') orphans from r group by stem""")
def part_numbering(spark, sf_dir):
    """SRC4, SRC5, FLT16, FOLD7: the ids of all labels as part numbers from 1."""
    own = table(spark, sf_dir, "labels").selectExpr("concat('d', cast(doc_id div 40 as string)) stem", "cast(doc_id % 40 as int) + 1 n").distinct()
    named = own.withColumn("name", F.concat("stem", F.lit("S"), F.lpad(c("n").cast("string"), 3, "0"), F.lit(".txt"))).withColumn("n", part_files.part_number(c("name"), c("stem"), F.lit(".txt")))
    return part_files.run_summary(named, "stem", "n")


@query("select stem, n from (select 'd' || (doc_id // 40) stem, (doc_id % 40)::int n from labels) left join (select 'd' || (doc_id // 40) stem, count(*) c from labels where toxic = 1 group by 1) using (stem) where n > coalesce(c, 0)")
def part_conflicts(spark, sf_dir):
    """FLT17, SET2."""
    own = table(spark, sf_dir, "labels").selectExpr("concat('d', cast(doc_id div 40 as string)) stem", "cast(doc_id % 40 as int) n", "toxic")
    return part_files.conflicts(own.drop("toxic"), own.where("toxic = 1").groupBy("stem").agg(F.count("*").alias("expected")), "stem", "n", "expected")


@query("""select source, part_count, part_count - 1 launch_pause_count, (part_count - 1) * 2.2::double launch_pause_seconds, 156::double sample_part_seconds, 156::double + (part_count - 1) * 2.2::double estimated_wall_seconds,
case when w >= 60 then (w // 60) || 'm ' || lpad((w % 60)::varchar, 2, '0') || 's' else w || 's' end estimate_text
from (select source, count(*) part_count, greatest(1, ceil(156::double + (count(*) - 1) * 2.2::double)::bigint) w from documents group by source)""")
def estimate(spark, sf_dir):
    """AG12, STR17, FOLD8."""
    return validate.estimate(table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("part_count")))


@query("""select 'g' || (doc_id % 7) grp, count(*) total, count(*) filter (where toxic = 0) n_ok, count(*) filter (where toxic = 1) n_failed, bool_and(toxic = 0) all_ok,
coalesce(string_agg(doc_id || ': quality ' || quality, '; ' order by doc_id) filter (where toxic = 1), '') failures from labels group by 1""")
def outcome_summary(spark, sf_dir):
    """AG8 to AG11, SRT4: labels as outcomes."""
    made = table(spark, sf_dir, "labels").select(F.concat(F.lit("g"), (c("doc_id") % 7).cast("string")).alias("grp"), c("doc_id").alias("part_number"), (c("toxic") == 0).alias("ok"), F.concat(F.lit("quality "), c("quality").cast("string")).alias("reason"))
    return validate.outcome_summary(made, "grp")


_PATH = "'sources\\\\' || split_part(url, '/', 4) || case when page_id % 5 = 0 then '' else '/' || split_part(url, '/', 3) end || '/p' || page_id || case page_id % 4 when 0 then '.TXT' when 1 then '.html' else '.txt' end"
_ITEMS = f"""paths as (select replace({_PATH.replace(chr(92) * 2, chr(92))}, chr(92), '/') href from pages),
items as (select coalesce(nullif(regexp_extract(substr(href, 9), '^(?:(.*)/)?([^/]*)$', 1), ''), 'root') group_name, href, regexp_replace(regexp_extract(substr(href, 9), '^(?:(.*)/)?([^/]*)$', 2), '(?i)\\.txt$', '') title from paths where lower(href) like '%.txt')"""


def _items(spark, sf_dir):
    return catalog.items(table(spark, sf_dir, "pages").select(F.expr(_PATH).alias("path")))


@query(f"with {_ITEMS} select * from items")
def catalog_items(spark, sf_dir):
    """SRC3, STR13, STR16."""
    return _items(spark, sf_dir)


_LI = "'        <li><a href=\"' || " + D.escape("'../' || href", True) + " || '\">' || " + D.escape("title", False) + " || '</a></li>' || chr(10)"


@query(f"with {_ITEMS} select group_name, 'Pages/' || group_name || '.html' page_path, count(*)::int n_items, {D.q(catalog.HEAD)} || {D.escape('group_name', True)} || {D.q(catalog.STYLED)} || {D.escape('group_name', False)} || {D.q(catalog.OPEN)} || string_agg({_LI}, '' order by title, href) || {D.q(catalog.CLOSE)} html from items where group_name <> 'root' group by group_name")
def catalog_pages(spark, sf_dir):
    """SNK5, SRT2, FLT21, AG6, STR14."""
    return catalog.pages(_items(spark, sf_dir))


@query(f"""with {_ITEMS}, g as (select group_name, count(*) n from items group by 1)
select '    <ul>' || chr(10) || coalesce(string_agg('        <li><a href="Pages/' || {D.escape('group_name', True)} || '.html">' || {D.escape('group_name', False)} || '</a></li>' || chr(10), '' order by group_name) filter (where group_name <> 'root'), '') || '    </ul>' list_html, count(*) groups, coalesce(sum(n), 0)::bigint items from g""")
def catalog_index(spark, sf_dir):
    """SNK6, SRT3, AG7."""
    return catalog.index_list(_items(spark, sf_dir))


@query("select distinct source || case when doc_id % 3 = 0 then 'x' else '' end stem from documents where source || case when doc_id % 3 = 0 then 'x' else '' end not in (select source from documents where source is not null)")
def obsolete_pages(spark, sf_dir):
    """JN3, SNK7."""
    docs = table(spark, sf_dir, "documents")
    stems = docs.select(F.concat("source", F.when(c("doc_id") % 3 == 0, "x").otherwise("")).alias("stem")).distinct()
    return catalog.obsolete(stems, docs.select(c("source").alias("name")).where("name is not null").distinct())


_TEMPLATE = "Keep one sentence on each line."


@query(f"select doc_id, case when e is null then {D.q(T.PROMPT_HEAD)} || t || {D.q(T.PROMPT_BODY + _TEMPLATE)} end prompt, e error from (select doc_id, t, case when t = '' then 'empty_context' when regexp_matches(t, '[^\\x00-\\x7F]') then 'non_ascii_context' end e from (select doc_id, {D.trim('text')} t from documents))")
def prompt_build(spark, sf_dir):
    """STR18: whole texts as contexts, of every document."""
    prompt, error = T.system_prompt(c("text"), _TEMPLATE)
    return table(spark, sf_dir, "documents").select("doc_id", prompt.alias("prompt"), error.alias("error"))


@query(f"select doc_id, sha256(text) sha256, sha256(text) <> sha256({D.strip_symbols('text')}) changed from documents")
def fingerprints(spark, sf_dir):
    """STR20, FLT18, SNK1's test of change."""
    after = T.fingerprint(T.strip_symbols(c("text")))
    return table(spark, sf_dir, "documents").select("doc_id", T.fingerprint(c("text")).alias("sha256"), validate.changed(T.fingerprint(c("text")), after).alias("changed"))


@query(f"select page_id, md5({D.escape('html', True)}) attribute, md5({D.escape('html', False)}) body from pages")
def html_escape(spark, sf_dir):
    """STR14."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.html_escape(c("html"), True).cast("binary")).alias("attribute"), F.md5(T.html_escape(c("html"), False).cast("binary")).alias("body"))


@query(f"""{_SENTENCES}, good as (select doc_id, string_agg(sentence, chr(10) order by sent_no) text from each where {D.n_sig('sentence')} >= 3 and not ({_DROP}) group by doc_id)
select d.doc_id, g.text, case when {D.trim("coalesce(d.text, '')")} = '' then 'empty_input' when len(b.sents) = 0 or b.sents is null then 'no_sentences' when g.text is null then 'all_filtered' end error
from documents d left join balanced b on d.doc_id = b.doc_id left join good g on d.doc_id = g.doc_id""")
def clean_corpus(spark, sf_dir):
    """ORC8 with all its steps (these texts need no repair and hold no forum lines), STR22."""
    return clean.clean_text(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "error")


def _stand_in(path: str, text: str) -> str:
    """A deterministic transform: echoes, doubles or fails by the path."""
    kind = sum(map(ord, path)) % 4
    if kind == 3:
        raise RuntimeError("boom")
    return text + "\n\n" if kind < 2 else f"{text}\n{text}"


@query()
def transform_parts(spark, sf_dir):
    """ORC1 to ORC4: clean, split, transform with retries; the tests hold outcomes against the plain loop."""
    own = clean.filter_normalized(table(spark, sf_dir, "documents").select("doc_id", T.strip_symbols(c("text")).alias("text")))  # a text with an error is null, which has no parts
    parts = pack.parts(own.select("doc_id", "text"), path=F.concat(F.lit("d"), c("doc_id").cast("string"), F.lit(".txt")))
    return transform.transform_parts(parts.select(c("part_no").alias("part_number"), c("part_path").alias("path"), c("part_text").alias("text")), _stand_in).drop("text")
