"""The queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwell.llm import hard_negatives, language_id, lexical_search, mixing, multiset_hash, nearest, packing, preference, secret_scan, simhash, suffix_dedup, tokenizing, toxicity
from trackwell.llm.common import table


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.formatted(preference.swapped_reply_pairs(table(spark, sf_dir, "conversations")))


def op2_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The realised mix, a row for each use of a document: at most 2 epochs of any source, as many tokens as the corpus."""
    rows, _ = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), entropy=None, repeats=2.0)
    return rows.drop("text")


def op3_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.fingerprinted(table(spark, sf_dir, "documents"))


def op6_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op8_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizing.token_counts(table(spark, sf_dir, "documents"))


def op10_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_residue_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op12_fp_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_preference_format, op2_temperature_mix, op3_projected_neighbours, op4_language_mixture, op5_multiset_hash,
        op6_simhash_ball, op7_pattern_packing, op8_randomness_battery, op9_token_counts, op10_compression_toxicity, op11_residue_negatives, op12_fp_tree_search,
        op13_suffix_dedup,
    )
    return {f.__name__: f for f in own}


OP1_SQL = """
with t as (
  select conv_id, replace(coalesce(role, ''), '<|', '< |') as role, replace(coalesce(text, ''), '<|', '< |') as text,
         row_number() over (partition by conv_id order by turn nulls first, replace(coalesce(role, ''), '<|', '< |'), replace(coalesce(text, ''), '<|', '< |')) as pos
  from conversations where conv_id is not null),
last as (select conv_id, max(pos) as n, max(case when role = 'assistant' then pos end) as at from t group by conv_id),
reply as (select t.conv_id, t.role, t.text from t join last l on t.conv_id = l.conv_id and t.pos = l.at),
rejected as (
  select t.conv_id, t.pos, t.role, t.text from t join last l using (conv_id) where l.at is null or t.pos < l.at
  union all
  select l.conv_id, l.at, r.role, r.text from last l join reply r on r.conv_id = xor(l.conv_id, 1) where l.at is not null),
sides as (
  select coalesce(c.conv_id, r.conv_id) as id, coalesce(c.pos, r.pos) as pos, c.role is not null and r.role is not null and c.role = r.role and c.text = r.text as same
  from t c full outer join rejected r on c.conv_id = r.conv_id and c.pos = r.pos),
cut as (select id, coalesce(min(case when not same then pos end) - 1, max(pos)) as n from sides group by id),
parts as (
  select 'c' as side, t.conv_id, t.pos, t.role, '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10) as piece, length(t.role) as rl from t
  union all
  select 'r', conv_id, pos, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), length(role) from rejected),
placed as (
  select p.*, c.n, sum(length(piece)) over (partition by side, conv_id, pos > c.n order by pos) as stop from parts p join cut c on c.id = p.conv_id),
made as (
  select conv_id,
    coalesce(string_agg(piece, '' order by pos) filter (where side = 'c' and pos <= n), '') as prompt,
    coalesce(string_agg(piece, '' order by pos) filter (where side = 'c' and pos > n), '') as chosen,
    coalesce(string_agg(piece, '' order by pos) filter (where side = 'r' and pos > n), '') as rejected,
    coalesce(string_agg((stop - length(piece) + 13 + rl)::bigint::varchar || ':' || (stop - 0)::bigint::varchar, ',' order by pos) filter (where side = 'c' and pos > n and role = 'assistant'), '') as chosen_spans,
    coalesce(string_agg((stop - length(piece) + 13 + rl)::bigint::varchar || ':' || (stop - 0)::bigint::varchar, ',' order by pos) filter (where side = 'r' and pos > n and role = 'assistant'), '') as rejected_spans,
    count(*) filter (where side = 'r') as nr
  from placed group by conv_id)
select m.conv_id as pair_id,
  case when nr = 0 then 'empty' when chosen = '' and rejected = '' then 'equal' when chosen_spans = '' and rejected_spans = '' then 'unmasked' else 'pair' end as status,
  c.n::bigint as prompt_turns, prompt, chosen, chosen_spans, rejected, rejected_spans
from made m join cut c on c.id = m.conv_id
"""


OP2_SQL = r"""
with recursive base as (
  select doc_id, source,
    md5(coalesce(doc_id::varchar, '') || '|' || coalesce(length(source)::varchar, '') || '|' || coalesce(source, '') || '|' || case when text is null then 'n' else 't' || text end) as h,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as words
  from documents),
units as (select h, any_value(source) as source, sum(words)::bigint as tokens from base group by h),
sources as (select source, sum(tokens)::bigint as tokens from units group by source having sum(tokens) > 0),
total as (select sum(tokens)::double as every, count(*) as n from sources),
halving as (
  select 0 as i, 0.0::double as low, 1.0::double as high
  union all
  select i + 1, case when within then low else mid end, case when within then mid else high end from (
    select i, low, high, (low + high) / 2 as mid,
      max(exp((low + high) / 2 * ln(tokens / every)) / tokens) / sum(exp((low + high) / 2 * ln(tokens / every))) * every <= 2.0 as within
    from halving, sources, total where i < 32 group by i, low, high, every)),
exponent as (select case when n < 2 then 1.0 else high end as a from halving, total where i = 32),
scale as (select sum(pow(tokens::double, a)) as z from sources, exponent),
weights as (
  select source, tokens as total, pow(tokens::double, a) / z * every as budget, pow(tokens::double, a) / z * every / tokens as epochs,
    ceil(tokens / 1000000.0)::bigint as blocks
  from sources, exponent, scale, total),
blocked as (
  select u.h, u.tokens, w.*, ('0x' || substr(md5(u.h || ':17'), 1, 15))::bigint % w.blocks as block
  from units u join weights w on u.source is not distinct from w.source),
per_block as (
  select source, block, epoch, sum(tokens)::bigint as tokens, any_value(budget) - epoch * any_value(total) as mark,
    ('0x' || substr(md5(block::varchar || ':' || epoch::varchar || ':17'), 1, 15))::bigint as pos
  from (select *, unnest(range(0, greatest(ceil(epochs)::bigint, 1))) as epoch from blocked) group by source, block, epoch),
ranked as (
  select *, row_number() over w - 1 as block_rank, coalesce(sum(tokens) over (w rows between unbounded preceding and 1 preceding), 0) as start
  from per_block window w as (partition by source, epoch order by pos, block)),
dealt as (
  select b.h, b.tokens, r.epoch, r.block_rank, r.mark, row_number() over w - 1 as place,
    r.start + coalesce(sum(b.tokens) over (w rows between unbounded preceding and 1 preceding), 0) as start
  from blocked b join ranked r on b.source is not distinct from r.source and b.block = r.block where r.start < r.mark
  window w as (partition by b.source, r.epoch, b.block order by ('0x' || substr(md5(b.h || ':' || r.epoch::varchar || ':17'), 1, 15))::bigint, b.h))
select t.doc_id, t.source, d.epoch::int as epoch, d.block_rank::bigint as block_rank, d.place::int as place, d.tokens as mix_tokens
from base t join dealt d on t.h = d.h where d.start < d.mark
"""


OP11_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
a as (select distinct * from v where vec_id % 50 = 0),
s as (
  select a.vec_id as anchor_id, a.label = v.label as same, a.label as al, a.v as av, v.vec_id as other, list_inner_product(a.v, v.v)::bigint as score
  from a join v on len(a.v) = len(v.v) and v.vec_id is distinct from a.vec_id),
p as (
  select anchor_id, al, av, other as positive_id, score as positive_score, row_number() over (partition by anchor_id, al, av order by score desc, other) as nth
  from s where same qualify nth <= 5),
n as (
  select p.anchor_id, p.al, p.av, p.nth, positive_id, positive_score, s.other as negative_id, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.al, p.av, p.nth order by s.score desc, s.other)::int as rank
  from p join s on s.anchor_id = p.anchor_id and s.al = p.al and s.av = p.av and not s.same
  where 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3
"""


OP12_SQL = r"""
with words as (
  select doc_id, row_number() over () as row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents where text is not null),
docs as (select doc_id, row, w, len(w)::bigint as n from words where len(w) > 0),
every as (select count(*)::bigint as nd, sum(n)::bigint as l from docs),
tfs as (select row, t, count(*)::bigint as tf from (select row, unnest(w) as t from docs) group by row, t),
items as (
  select item, any_value(item_id) as item_id, t, count(*)::bigint as reps from (
    select item_id, dense_rank() over (order by item_id, text) as item, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t
    from (select distinct item_id, text from benchmark where text is not null)) group by item, t),
weights as (
  select t, floor(1000 * ln((2 * nd + 2)::double / (2 * df + 1)::double))::bigint as w
  from (select t, count(*)::bigint as df from tfs group by t), every),
scored as (
  select i.item, any_value(i.item_id) as item_id, d.row, any_value(d.doc_id) as doc_id, sum(i.reps * weights.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l))))::bigint as score
  from items i join weights using (t) join tfs using (t) join docs d on d.row = tfs.row, every group by i.item, d.row),
r as (select *, row_number() over (partition by item order by score desc, doc_id nulls last)::int as rank from scored where score > 0)
select item_id, rank, doc_id, score from r where rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_preference_format": OP1_SQL, "op2_temperature_mix": OP2_SQL, "op11_residue_negatives": OP11_SQL, "op12_fp_tree_search": OP12_SQL}
