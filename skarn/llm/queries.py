"""The queries of this package over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, lm, mixing, neardup, pages, pu, rules, tokenstore

TOKENIZER, END_ID = "word_bpe_49k.json", 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.language_model(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.jaccard_join(table(spark, sf_dir, "documents")).drop("text_hash")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *rules.BASE, "base_failed", "kept", "anomaly")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "<|im_end|><|im_start|>assistant ok"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return chat.digest(chat.format_turn_rows(rows.unionByName(more)))


def chat_record_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as JSON records of three layouts in turn, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    other = F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"))
    messages = F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"), F.lit("x").alias("output"))
    values = F.struct(F.transform("t", lambda x: F.struct(F.coalesce(F.element_at(other, x["role"]), x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations"))
    parts = F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), x["text"].alias("text"))).alias("content"))).alias("messages"))
    kind = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(3))
    records = turns.select("conv_id", F.when(kind == 0, F.to_json(messages)).when(kind == 1, F.to_json(values)).otherwise(F.to_json(parts)).alias("record"))
    return chat.digest(chat.format_records(records, "record", "conv_id"), "id").withColumnRenamed("id", "conv_id")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenstore.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)
    return tokenstore.read_tokens(files)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_html_extraction, op3_quality_classifier, op4_ngram_jaccard_join, op5_decontamination, op6_quality_rules, op7_chat_formatting, op8_lm_scoring, op9_toxicity, op10_token_output)
}
QUERIES["chat_record_layouts"] = chat_record_layouts

OP1_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, coalesce(md5(doc_id::varchar), '') as o
  from documents),
sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as s, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w
  from sized group by source),
ranked as (
  select *, row_number() over (order by source_size / w, s) as k,
    (sum(w) over () - coalesce(sum(w) over (order by source_size / w, s rows between unbounded preceding and 1 preceding), 0))::double as left_w,
    (sum(source_size) over () - coalesce(sum(3 * source_size) over (order by source_size / w, s rows between unbounded preceding and 1 preceding), 0))::double as left_size
  from sources),
opened as (select min(k) as k0 from ranked where left_size / left_w * w <= 3 * source_size),
targets as (
  select s, source, source_size,
    case when k < k0 then (3 * source_size)::double else (select left_size / left_w from ranked r, opened o where r.k = o.k0) * w end as target
  from ranked, opened),
placed as (
  select d.doc_id, d.size, t.source_size, t.target, floor(t.target)::bigint as wanted,
    (sum(d.size) over (partition by t.s order by d.o, d.doc_id, d.size rows unbounded preceding) - d.size)::bigint as start
  from sized d join targets t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  case when source_size = 0 then 0
    else wanted // source_size * size + greatest(0, least(start + size, wanted % source_size) - start) end::bigint as taken
from placed
"""

OP7_SQL = r"""
with all_rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')))::bigint as formatted_chars
from all_rows group by conv_id
"""

CHAT_RECORDS_SQL = OP7_SQL.replace("  union all values (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))", ")")

_UNIT_LIST = ", ".join(f"'{u}'" for u in decontam.UNITS)
_FORMS = rf"""select *, list_transform(range(1, len(w) + 1), lambda i: case when i > 1 and k[i - 1] = chr(1) || 'n' and rtrim(l[i], '.,;:!?)') in ({_UNIT_LIST}) then chr(1) || 'u' else k[i] end) as t
  from (select *, list_transform(w, lambda x: lower(x)) as l, list_transform(w, lambda x: case when regexp_matches(x, '[0-9]') then chr(1) || 'n' when x <> lower(x) and regexp_matches(x, '^[^\p{{L}}]*\p{{Lu}}') then chr(1) || 'x' else lower(x) end) as k
  from (select *, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from"""
_SLOTS = "len(list_filter({}, lambda x: starts_with(x, chr(1))))"
OP5_SQL = rf"""
with items as (select *, len(w) as n, least(len(w), 8) as span, len(w) - least(len(w), 8) + 1 as windows from ({_FORMS} (select distinct item_id, text from benchmark)))) where len(w) > 0),
docs as ({_FORMS} (select distinct doc_id, text from documents)))),
at_place as (select *, unnest(range(0, windows)) as covers from items),
counted as (select *, {_SLOTS.format("t[covers + 1:covers + span]")} as s, least(covers, n - 16) as wide_at, case when n >= 16 then {_SLOTS.format("t[least(covers, n - 16) + 1:least(covers, n - 16) + 16]")} end as wide_s from at_place),
known as (
  select item_id, text as item, windows, covers, covers as pos, span, 'l' as form, array_to_string(l[covers + 1:covers + span], ' ') as window from counted union all
  select item_id, text, windows, covers, covers, span, 't', array_to_string(t[covers + 1:covers + span], ' ') from counted where s > 0 and 2 * s <= span union all
  select item_id, text, windows, covers, wide_at, 16, 't', array_to_string(t[wide_at + 1:wide_at + 16], ' ') from counted where 2 * s > span and 2 * wide_s <= 16),
spans as (select distinct span, form from known),
placed as (select doc_id, text as doc, span, form, case form when 'l' then l else t end as f, unnest(range(0, len(w) - span + 1)) as place from docs, spans where len(w) >= span),
hits as (select distinct doc_id, doc, item_id, item, windows, covers, pos, k.span, k.form, place - pos as shift from placed p join known k on k.span = p.span and k.form = p.form and k.window = array_to_string(f[place + 1:place + p.span], ' ')),
aligned as (select distinct doc_id, doc, item_id, item, shift, unnest(range(pos, pos + span)) as i from hits where form = 't'),
met as (
  select a.*, m.t[i + 1] = chr(1) || 'x' as name, lower(regexp_replace(m.w[i + 1], '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')) as ours, lower(regexp_replace(d.w[i + shift + 1], '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')) as theirs
  from aligned a join items m on m.item_id is not distinct from a.item_id and m.text = a.item join docs d on d.doc_id is not distinct from a.doc_id and d.text = a.doc where starts_with(m.t[i + 1], chr(1))),
wrong as (
  select doc_id, doc, item_id, item, shift from met group by doc_id, doc, item_id, item, shift, ours having count(distinct theirs) > 1 union
  select doc_id, doc, item_id, item, shift from met where name group by doc_id, doc, item_id, item, shift, theirs having count(distinct ours) > 1),
sound as (select * from hits h where form = 'l' or not exists (select 1 from wrong x where x.doc_id is not distinct from h.doc_id and x.doc = h.doc and x.item_id is not distinct from h.item_id and x.item = h.item and x.shift = h.shift))
select doc_id, item_id, count(distinct covers)::bigint as matched, windows::int as windows from sound group by doc_id, doc, item_id, item, windows having count(distinct covers) >= 0.5 * windows
"""

OP4_SQL = r"""
with recursive w as (select row_number() over () as r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sets as (select r, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) when len(w) > 0 then [w] else [] end) as s from w),
shingles as (select r, array_to_string(unnest(s), ' ') as x, len(s) as n from sets),
links as (select a.r as a, b.r as b from shingles a join shingles b on a.x = b.x and a.r <> b.r group by a.r, b.r having count(*) >= 0.8 * (max(a.n) + max(b.n) - count(*)) - 1e-9),
reach as (select r, r as m from w union select reach.r, links.b from reach join links on links.a = reach.m)
select w.doc_id, (select min(o.doc_id) from reach join w o on o.r = reach.m where reach.r = w.r) as class_id, (select count(*) from links where links.a = w.r)::bigint as n_links, len(sets.s)::bigint as n_shingles
from w join sets using (r)
"""

ORACLE_SQL: dict[str, str] = {"op4_ngram_jaccard_join": OP4_SQL, "op5_decontamination": OP5_SQL, "op1_mixing": OP1_SQL, "op7_chat_formatting": OP7_SQL, "chat_record_layouts": CHAT_RECORDS_SQL}
