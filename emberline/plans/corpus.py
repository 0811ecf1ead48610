"""Queries over texts: exact dedup, exclusion, static funnel, hash splits, difficulty filters."""

from __future__ import annotations

from emberline.plans.dialects import Catalogue, Spark

CATALOGUE = Catalogue()


def normal(d: Spark, text: str) -> str:
    """Lower-cased text with white space squeezed."""
    return f"trim({d.sub(f'lower({text})', '[ \\\\t\\\\n]+' if d.name == 'spark' else '[ \\t\\n]+', ' ')})"


def keyed(d: Spark) -> str:
    return f"keyed as (select doc_id, source, lang, text, length(text) as n, sha1({normal(d, 'text')}) as k from {d.t('documents')})"


CATALOGUE.add("q_exact_dedup", "documents", lambda d: f"""with {keyed(d)} select min(doc_id) as doc_id, k as content_key, cast(count(*) as bigint) as copies from keyed group by k""")
CATALOGUE.add("q_dedup_funnel", "documents", lambda d: f"""with {keyed(d)} select cast(count(*) as bigint) as n_files, cast(count(distinct k) as bigint) as n_unique, cast(count(*) - count(distinct k) as bigint) as n_dup from keyed""")
CATALOGUE.add("q_exclude_known", "documents benchmark", lambda d: f"""with {keyed(d)}, ex as (select distinct sha1({normal(d, 'text')}) as k from {d.t('benchmark')})
select doc_id, k as content_key from keyed where not exists (select 1 from ex where ex.k = keyed.k)""")
CATALOGUE.add("q_static_funnel", "documents", lambda d: f"""with {keyed(d)}, f as (select *, {d.size("string_split(text, chr(10))" if d.name == "duckdb" else "split(text, '\\\\n')")} as n_lines from keyed),
r as (select *, case when n > 1500 then 'too_long' when n_lines < 2 then 'too_few_lines' when n_lines > 40 then 'too_many_lines' else 'accepted' end as reason from f)
select reason, cast(count(*) as bigint) as n, cast(count(distinct source) as bigint) as sources from r group by reason""")


def split_case(d: Spark) -> str:
    """The order of rules is the contract: function hash, held-out family, depth, then chain hash."""
    chain = "concat(source, chr(10), '---', chr(10), lang, chr(10), '---', chr(10), cast(n % 6 as varchar(10)))"
    return f"""case when {d.unit("concat('seed|', source)")} < 0.15 then 'test_seeds' when lang = 'es' then 'test_heldout' when n % 6 = 5 then 'test_compositional'
    when {d.unit(chain)} < 0.8 then 'train' when {d.unit(chain)} < 0.9 then 'val' else 'test_iid' end"""


CATALOGUE.add("q_dataset_split", "documents", lambda d: f"with {keyed(d)} select doc_id, {split_case(d)} as split from keyed")
CATALOGUE.add("q_split_stats", "documents", lambda d: f"""with {keyed(d)}, s as (select *, {split_case(d)} as split from keyed)
select split, cast(count(*) as bigint) as tasks, cast(count(distinct source) as bigint) as functions, cast(count(distinct concat(source, '|', lang)) as bigint) as chains from s group by split""")
CATALOGUE.add("q_group_split", "documents", lambda d: f"""with g as (select source, {d.unit("concat('rl|', source)")} < 0.4 as rl, count(*) as n from {d.t('documents')} group by source) select source, rl, cast(n as bigint) as n from g""")
CATALOGUE.add("q_family_histogram", "documents", lambda d: f"""select lang as family, cast(count(*) as bigint) as chains from {d.t('documents')} group by lang order by chains desc, family""")
CATALOGUE.add("q_filter_stats", "documents labels", lambda d: f"""with p as (select source, lang, quality from {d.t('documents')} d join {d.t('labels')} l on d.doc_id = l.doc_id),
rates as (select source, lang, avg(case when quality = 1 then 1e0 else 0e0 end) as rate, count(*) as n from p group by source, lang),
decided as (select source, lang, case when n < 4 then 'unprobed' when rate > 0.95 then 'too_easy' when rate < 0.2 then 'too_hard' else 'keep' end as decision from rates),
t as (select d.doc_id, d.source, d.lang, coalesce(decision, 'unprobed') as decision from {d.t('documents')} d left join decided x on d.source = x.source and d.lang = x.lang)
select decision, cast(count(*) as bigint) as tasks, cast(count(distinct source) as bigint) as functions, cast(count(distinct concat(source, '|', lang)) as bigint) as chains from t group by decision""")
CATALOGUE.add("q_candidate_sample", "documents", lambda d: f"""select doc_id, {d.unit("concat('sample|', cast(doc_id as varchar(20)))")} as draw from {d.t('documents')} order by draw, doc_id limit 100""")
CATALOGUE.add("q_token_offsets", "documents", lambda d: f"""with {d.ranked("o", f"""select doc_id, {d.unit("concat('order|', cast(doc_id as varchar(20)))")} as draw, length(text) + 1 as n from {d.t('documents')}""", "draw, doc_id", upto="n")}
select doc_id, cast(upto - n as bigint) as start, cast(upto as bigint) as stop, upto - n < greatest(0.02 * (select sum(n) from o), 8 * 257) as val from o""")
CATALOGUE.add("q_doc_windows", "documents", lambda d: f"""with {d.ranked("o", f"select doc_id, length(text) + 1 as n from {d.t('documents')}", "doc_id", upto="n")},
w as (select i, {d.draw("concat('window|', cast(i as varchar(10)))", "(select sum(n) from o)")} as pos from {d.series(64, "i")})
select i as window_id, doc_id, cast(pos - (upto - n) as bigint) as doc_offset from w join o on pos >= upto - n and pos < upto""")
CATALOGUE.add("q_mixture", "conversations documents", lambda d: f"""with {d.ranked("ranked", f"""select 'doc' as kind, doc_id as id, {d.unit("concat('mix|d', cast(doc_id as varchar(20)))")} as draw from {d.t('documents')}""", "draw, id")},
{d.ranked("m", f"""select kind, id, draw from (select 'chat' as kind, conv_id as id, {d.unit("concat('mix|c', cast(conv_id as varchar(20)))")} as draw from {d.t('conversations')} where turn = 0) y union all select kind, id, draw from {"{ranked}" if d.name == "spark" else "ranked"} where r <= 0.5 * (select count(*) from {d.t('conversations')} where turn = 0)""", "draw, kind, id", "position")}
select kind, id, cast(position as bigint) as position from m""")
CATALOGUE.add("q_difference", "documents benchmark", lambda d: f"""select source from {d.t('documents')} where lang = 'en' except select source from {d.t('documents')} where lang = 'es' and n_chars > 15000""")
