"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, lines, mixing, ngrams, phrases, quality, rules, simhash, spelling, substring, toxicity, warc
from .common import remainder, stored, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), changed_only=True)
    return cut.select(
        "doc_id",
        F.array_sort(F.array_distinct(F.col("spans.of_doc"))).alias("of_docs"),
        "n_sentences",
        "n_removed",
        F.col("n_words").alias("n_removed_words"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held = remainder("doc_id", 5) == 0
    predicted = (F.col("score") >= 0.5).cast("int")
    return out.select("doc_id", held.alias("held_out"), "score", predicted.alias("predicted"), "votes", "weak_label")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.digests(warc.read_archives(spark, folder)).drop("url")


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "mix_weight", "mix_period", "mix_block", "mix_slot", "mix_position")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat.read_back(stored(chat.segments(turns.unionByName(extra)), "formatted"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    held = remainder("doc_id", 3) == 1
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.col("fps")[0])), 16, "0").alias("fingerprint"), "component_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.perplexities(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_substring_dedup,
        op3_toxicity,
        op4_warc,
        op5_mix,
        op6_chat,
        op7_quality_rules,
        op8_quality,
        op9_simhash,
        op10_line_dedup,
        op11_phrases,
        op12_spelling,
        op13_lm_score,
        pipeline,
    )
}

OP4 = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as payload_bytes, sha1(html) as payload_digest from p),
h as (select payload_digest as of, max(page_id) as head from d where payload_bytes >= 1000 group by 1)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when head is null or head = page_id then 'response' else 'revisit' end as record_type,
       case when head is null or head = page_id then null else head end as refers_to
from d left join h on of = payload_digest and payload_bytes >= 1000
"""

OP5 = f"""
with recursive
n as (select source, floor(sqrt(cast(count(*) as double)) * 16)::bigint as root from documents group by 1),
s as (select source, greatest(1, ({mixing.SLOTS} * root) // (sum(root) over ())::bigint)::bigint as w from n),
i as (select source, w, row_number() over (order by w desc, coalesce(source, '')) as i, (sum(w) over ())::bigint as period from s),
a as (select list(w order by i) as ws, any_value(period) as period from i),
step(t, done, pick) as (
  select 0::bigint, list_transform(ws, lambda x: 0::bigint), 0::bigint from a
  union all
  select t + 1, list_transform(done, lambda d, k: case when k = p then d + 1 else d end), p
  from (select t, done, ws, period,
          list_aggregate(list_transform(range(1, len(ws) + 1), lambda k: case
            when done[k] < ws[k] and (done[k] * period) // ws[k] <= t
            then ((done[k] + 1) * period + ws[k] - 1) // ws[k] * 100000 + k else null end), 'min') % 100000 as p
        from step, a where t < period)),
plan as (select t - 1 as slot, pick, row_number() over (partition by pick order by t) - 1 as nth from step where t > 0),
r as (select doc_id, source, row_number() over (partition by source order by ('0x' || substr(md5(cast(doc_id as varchar)), 1, 8))::bigint % {mixing.BUCKETS}, doc_id) - 1 as r
      from documents)
select r.doc_id, r.source, i.w as mix_weight, i.period as mix_period, r // {mixing.BLOCK} as mix_block,
       (r // {mixing.BLOCK}) // i.w * i.period + slot as mix_slot,
       ((r // {mixing.BLOCK}) // i.w * i.period + slot) * {mixing.BLOCK} + r % {mixing.BLOCK} as mix_position
from r join i on r.source is not distinct from i.source
join plan on plan.pick = i.i and plan.nth = (r // {mixing.BLOCK}) % i.w
"""

OP6 = """
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t as (select *, replace(replace(text, '\\', '\\\\'), '<|', '<\\|') as esc,
        coalesce(lag(role) over (partition by conv_id order by turn, role, text), 'start') as prior,
        lead(role) over (partition by conv_id order by turn, role, text) is null as final from c)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(12 + length(role) + 1 + length(esc) + 11)::bigint as formatted_chars,
       bool_and(prior || '>' || role in ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user',
         'assistant>tool', 'tool>assistant', 'tool>tool')) and bool_or(final and role = 'assistant') as valid
from t group by conv_id
"""

OP10 = """
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i from documents),
k as (select doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
c as (select key, max(doc_id) as last_doc from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5)
select doc_id, count(*) as n_lines, count(*) filter (last_doc is not null and doc_id <> last_doc) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (last_doc is null or doc_id = last_doc), '')) as kept_sha256
from k left join c using (key) group by doc_id
"""

OP11 = """
with t as (select coalesce(lang, 'und') as lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') as pieces from documents),
p as (select lang, unnest(pieces) as piece from t),
w as (select lang, list_filter(string_split_regex(piece, '[ \\x09]+'), lambda x: x <> '') as ws from p),
one as (select lang, phrase, count(*) as a from (select lang, unnest(ws) as phrase from w) group by all),
two as (select lang, w1, w2, w1 || ' ' || w2 as phrase, count(*) as a
        from (select lang, unnest(ws[:-2]) as w1, unnest(ws[2:]) as w2 from w) group by all having count(*) >= 10),
three as (select lang, w1, w2, w3, w1 || ' ' || w2 || ' ' || w3 as phrase, count(*) as a
          from (select lang, unnest(ws[:-3]) as w1, unnest(ws[2:-2]) as w2, unnest(ws[3:]) as w3 from w) group by all having count(*) >= 10),
cuts as (
  select two.lang, two.phrase, two.a, 1 as k, x.a as l, y.a as r from two
  join one x on x.lang = two.lang and x.phrase = w1 join one y on y.lang = two.lang and y.phrase = w2
  union all
  select t.lang, t.phrase, t.a, 1, x.a, y.a from three t
  join one x on x.lang = t.lang and x.phrase = t.w1 join two y on y.lang = t.lang and y.w1 = t.w2 and y.w2 = t.w3
  union all
  select t.lang, t.phrase, t.a, 2, x.a, y.a from three t
  join two x on x.lang = t.lang and x.w1 = t.w1 and x.w2 = t.w2 join one y on y.lang = t.lang and y.phrase = t.w3),
s as (select *, ((1000000::hugeint * a * a) // (l::hugeint * r))::bigint as score from cuts),
best as (select *, row_number() over (partition by lang, phrase order by score, k) as nth from s),
inside as (select lang, phrase, max(a) as inside from (
  select lang, w1 || ' ' || w2 as phrase, a from three union all select lang, w2 || ' ' || w3, a from three) group by all),
ranked as (select b.*, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank
           from best b left join inside i on i.lang = b.lang and i.phrase = b.phrase
           where nth = 1 and (inside is null or 100 * inside < 50 * a)),
n as (select lang, sum(a)::bigint as n from one group by lang)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000
"""

SQL: dict[str, str] = {"op11_phrases": OP11, "op4_warc": OP4, "op5_mix": OP5, "op6_chat": OP6, "op10_line_dedup": OP10}
