"""The queries that apply each operator, with production parameters, to its whole table, and their SQL.

Each op*_ function derives the contract's digest columns from its operator's real outputs.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import bpe, chat, divergence, filter_audit, html_text, media, packing, quality, simhash, token_count, toxicity, warc, window_packing
from emberline.llm.common import table, written


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.probe(media.store(table(spark, sf_dir, "documents")))
    feature = F.to_json(F.struct("codec", "width", "height", "n_samples", "timescale", "duration", "keyframes"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archives(warc.stored(table(spark, sf_dir, "pages")))
    return records.select(
        F.nullif("id", F.lit("null")).cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = packing.tokenized(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pieces(tokens).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.packed(written(rows), order=("doc_id", "piece", "start", "ids_crc32"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.learn(quality.labelled(docs, table(spark, sf_dir, "labels")))
    stats = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality.judged(docs, rules).select("doc_id", *stats, "base_failed", "kept", "rule")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)
    out = chat.formatted(rows).select("conv_id", "formatted", chat.parsed(F.col("formatted")).alias("turns"), F.array_join(chat.under_mask(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = written(simhash.fingerprints(table(spark, sf_dir, "documents")))
    return simhash.clustered(prints).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"))


def op12_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = window_packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return window_packing.packed(rows, value=F.crc32).withColumnsRenamed({"id": "doc_id", "value": "ids_crc32"})


def op13_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_media_columns": op2_media_columns,
    "op3_warc": op3_warc,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_html_extraction": op6_html_extraction,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_bpe": op8_bpe,
    "op9_simhash": op9_simhash,
    "op10_token_counts": op10_token_counts,
    "op11_source_divergence": op11_source_divergence,
    "op12_window_packing": op12_window_packing,
    "op13_filter_interaction": op13_filter_interaction,
}

OP7_SQL = """
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked as (
  select *, lag(role) over w is distinct from role as opens,
    regexp_replace(text, '([\\[<])(~*)(/?(?:s>|INST\\]|SEP\\]))', '\\1~\\2\\3', 'g') as escaped
  from rows window w as (partition by conv_id order by turn, role, text)
), loss as (
  select conv_id, coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss from rows group by conv_id
)
select r.conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  any_value(length(loss)) as loss_chars, any_value(sha256(loss)) as loss_sha256,
  cast(sum(length(escaped) + case when opens then 10 + length(role) + 1 + 12 else 5 end) as bigint) as formatted_chars
from marked r join loss l on r.conv_id is not distinct from l.conv_id group by r.conv_id
"""

OP3_SQL = """
with d as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as x from pages),
b as (
  select *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast((cast('0x' || substr(x, cast(1 + 5 * (i // 4) as bigint), 5) as bigint) >> cast(15 - 5 * (i % 4) as bigint)) & 31 as bigint) + 1, 1)), '') as payload_digest,
    min(page_id) over (partition by x) as first_id
  from d
)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from b
"""

OP11_SQL = """
with docs as (select coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text, row_number() over () as id from documents),
words as (select lang, source, id, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from docs),
vocabulary as (select lang, term from words group by all having count(distinct id) >= 10),
sizes as (select l.lang, count(v.term)::hugeint as v from (select distinct lang from docs) l left join vocabulary v using (lang) group by all),
counts as (select lang, source, term, count(*)::hugeint as n from words join vocabulary using (lang, term) group by all),
groups as (select d.lang, d.source, coalesce((select sum(n) from counts c where c.lang = d.lang and c.source = d.source), 0)::hugeint as total from (select distinct lang, source from docs) d),
dense as (
  select g.lang, g.source, w.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (g.total + 2 * s.v) as p
  from groups g join sizes s using (lang) join vocabulary w using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = w.term
),
whole as (
  select w.lang, w.term, 1 + (1000000000::hugeint * (sum(d.n) + 2)) // (any_value(t.total) + 2 * any_value(s.v)) as q
  from vocabulary w join dense d using (lang, term) join (select lang, sum(total) as total from groups group by all) t using (lang) join sizes s using (lang) group by all
),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(s.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join (
    select x.lang, x.source, y.source as item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) as value
    from dense x join dense y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all
  ) s on s.lang = a.lang and s.source = a.source and s.item = b.source
),
terms as (select lang, source, term as item, ((p - q) * (p - q)) // (p + q) as value from dense join whole using (lang, term) where n > 0 and p > q)
select lang, source, 'pair' as part, item, value::bigint as value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from pairs
union all
select * from (select lang, source, 'term', item, value::bigint, (row_number() over (partition by lang, source order by value desc, item))::int as rank from terms) where rank <= 10
"""

OP13_SQL = """
with docs as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words from documents
), firsts as (select text, min(doc_id) as first_id from docs group by all),
known as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels where doc_id is not null group by all),
flags as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, map {
    'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(d.doc_id > first_id, false)} as fails
  from docs d join firsts using (text) left join known k on k.doc_id = d.doc_id
), letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select [a.x, b.x, c.x, d.x, e.x] as o from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps as (select array_to_string(o, '') as filter_order, step, o[step] as letter, o[1:step - 1] as before from orders, (select unnest([1, 2, 3, 4, 5]) as step)),
kinds as (select part, good, toxic, fails, count(*) as n from flags group by all),
told as (
  select part, filter_order, step, letter,
    sum(n) filter (where not fails[letter] and not gone) as kept, sum(n) filter (where fails[letter] and not gone) as removed,
    sum(n) filter (where fails[letter] and gone) as redundant,
    sum(n) filter (where fails[letter] and len(list_filter(map_values(fails), lambda f: f)) = 1) as unique_fails,
    sum(n) filter (where fails[letter] and not gone and good) as good_lost, sum(n) filter (where fails[letter] and not gone and toxic) as toxic_lost
  from (select *, len(list_filter(before, lambda x: fails[x])) > 0 as gone from kinds, steps) group by all
)
select part, filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
  coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
  (sum(coalesce(removed, 0)) over (partition by part, letter))::bigint as shapley
from told
"""

SQL: dict[str, str] = {"op3_warc": OP3_SQL, "op7_chat_formatting": OP7_SQL, "op11_source_divergence": OP11_SQL, "op13_filter_interaction": OP13_SQL}
