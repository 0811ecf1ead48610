"""Queries that shape, select and join records: codecs, demuxes, trajectory filters, lookups, small statistics."""

from __future__ import annotations

from emberline.plans import episodes, training
from emberline.plans.dialects import Catalogue, Spark

CATALOGUE = Catalogue()
NEWLINES = "^\n+|\n+$"


def ev(name: str, text) -> None:
    CATALOGUE.add(name, "events", text)


def records(d: Spark) -> str:
    return episodes.records(d)


# sources and sinks
CATALOGUE.add("q_corpus_union", "documents benchmark conversations", lambda d: f"""select 1 as part, doc_id as id, length(text) as n from {d.t('documents')} union all select 2, item_id, length(text) from {d.t('benchmark')} union all select 3, conv_id, length(text) from {d.t('conversations')} where turn = 0""")
ev("q_grouping_scan", lambda d: f"""with {records(d)} select arm, task_id, cast(count(*) as bigint) as n, round(sum(-ln(greatest(best_ratio, 1e-9))), 6) as log_sum, min(seed_name) as cluster from records group by arm, task_id""")
CATALOGUE.add("q_mined_seeds", "part", lambda d: f"""with base as (select p_partkey, p_name, p_size % 3 as n_natural from {d.t('part')}), n as (select i from {d.series(3, "i")}),
u as (select p_partkey as seed_group, p_name as seed_name, false as only_slow from base union all select p_partkey, concat(p_name, '_nat', cast(i as varchar(5))), true from base join n on i < n_natural) select * from u""")
CATALOGUE.add("q_token_cache_window", "documents", lambda d: f"""with {d.ranked("o", f"select doc_id, length(text) + 1 as n from {d.t('documents')}", "doc_id", upto="n")} select doc_id, cast(upto - n as bigint) as start, n from o where upto - n < 40000 and upto > 10000""")
CATALOGUE.add("q_demux_sides", "documents", lambda d: f"""with {d.ranked("o", f"select doc_id, case when {d.unit("concat('rl|', source)")} < 0.4 then 'rl' else 'sft' end as side, case when {d.unit("concat('rl|', source)")} < 0.4 then 1 else 0 end as rl from {d.t('documents')}", "doc_id", "r", rl_upto="rl")} select side, doc_id, cast(case when rl = 1 then rl_upto else r - rl_upto end as bigint) as place from o""")
CATALOGUE.add("q_first_replies", "conversations", lambda d: f"""with {training.marked(d)}, r as (select conv_id, turn, reply from replies order by conv_id, turn limit 200) select conv_id, turn, reply from r""")

# projections
ev("q_episode_struct", lambda d: f"""with {episodes.lists(d)} select episode_id, {d.size("steps")} as n_turns, {d.join(d.map_("steps", "s", "s.kind"), ",")} as actions, {d.size(d.keep("steps", "s", "s.status = 'malformed'"))} as n_malformed from lists""")
ev("q_chain_key", lambda d: f"""with {records(d)} select distinct seed_name, family, concat(cast(seed_name as varchar(10)), '+', cast(family as varchar(10))) as chain_key, substring(sha1(concat(cast(seed_name as varchar(10)), chr(10), '---', chr(10), cast(family as varchar(10)))), 1, 16) as canonical from records""")
ev("q_zip_turns", lambda d: f"""with {episodes.lists(d)} select episode_id, {d.size("steps")} as n, {d.join(d.map_("steps", "s", "concat(s.kind, ':', s.status)"), "|")} as zipped from lists""")
CATALOGUE.add("q_code_from_obs", "conversations", lambda d: f"""with o as (select conv_id, turn, case turn % 3 when 0 then concat('<CODE>', chr(10), text, chr(10), '</CODE>') when 1 then concat('x<CODE>', text, '</CODE> y') else text end as obs from {d.t('conversations')}),
p as (select *, instr(obs, '<CODE>') as a, instr(obs, '</CODE>') as b from o) select conv_id, turn, case when a > 0 and b > a then {d.sub('substr(obs, a + 6, b - a - 6)', NEWLINES, '')} else '' end as code from p""")
CATALOGUE.add("q_render_no_feedback", "conversations", lambda d: f"""select conv_id, turn, case when turn % 2 = 0 then concat('step=', cast(turn as varchar(9))) else concat('best=', cast(length(text) as varchar(9)), ' step=', cast(turn as varchar(9))) end as obs from {d.t('conversations')} where role = 'user'""")
CATALOGUE.add("q_completion_prompt", "conversations", lambda d: f"""with shots as (select {d.join(d.array("text", "turn"), "||")} as shot from {d.t('conversations')} where conv_id = 0 and turn < 2) select conv_id, concat(shot, '||', text) as prompt from {d.t('conversations')} cross join shots where turn = 0 and conv_id > 0""")
CATALOGUE.add("q_prompt_tail", "documents", lambda d: f"""select doc_id, substr(text, greatest(length(text) - 239, 1)) as tail, length(text) > 240 as cut from {d.t('documents')}""")
CATALOGUE.add("q_short_repr", "documents", lambda d: f"""select doc_id, case when length(text) > 80 then concat(substr(text, 1, 77), '...') else text end as shown from {d.t('documents')}""")
CATALOGUE.add("q_make_driver", "lineitem", lambda d: f"""select l_orderkey, concat('def run(k):', chr(10), '    return [', {d.join(d.array("concat('f', cast(l_partkey as varchar(10)))", "l_linenumber * 100000000 + l_partkey"), ", ")}, '][k]') as driver from {d.t('lineitem')} group by l_orderkey""")

# filters
ev("q_verified_steps", lambda d: f"""with {episodes.steps(d)} select episode_id, step, ratio from steps where status = 'ok' and ratio >= 1.1""")
ev("q_slow_chains", lambda d: f"""with {episodes.steps(d)}, c as (select episode_id, exp(sum(ln(greatest(ratio, 1e-9)))) as ratio_to_fast, count(*) as depth from steps where status = 'ok' group by episode_id) select episode_id, cast(depth as bigint) as depth, round(ln(ratio_to_fast), 6) as log_ratio from c where ratio_to_fast >= 1.3""")
CATALOGUE.add("q_task_filter", "documents", lambda d: f"""select doc_id from {d.t('documents')} where n_chars / 100e0 >= 1.3 and length(text) <= 1500""")
ev("q_improving_only", lambda d: f"""with {records(d)} select episode_id, best_ratio from records where best_ratio < 1""")
ev("q_min_speedup", lambda d: f"""with {records(d)} select episode_id from records where speedup >= 1.5""")
ev("q_masked_actions", lambda d: f"""with {episodes.steps(d)} select episode_id, step, status in ('ok', 'stop') as learn, step = 1 as first_step from steps""")
ev("q_nonzero_advantages", lambda d: f"""with {records(d)}, g as (select episode_id, n_edits, log_speedup - avg(log_speedup) over (partition by task_id) as a from records) select episode_id from g where abs(a) >= 1e-12 and n_edits > 0""")
ev("q_hint_eligible", lambda d: f"""with {records(d)} select episode_id from records where n_invalid = 0 and n_improved > 0 and n_edits <= 6""")
CATALOGUE.add("q_worked_example", "documents", lambda d: f"""select doc_id from {d.t('documents')} order by case when lang = 'en' then 0 else 1 end, length(text), doc_id limit 20""")

# joins and aggregates
ev("q_known_tasks", lambda d: f"""with {records(d)}, train as (select distinct task_id from records where arm = 0 and seed_name < 10) select r.episode_id from records r join train t on r.task_id = t.task_id where r.arm = 1""")
ev("q_common_tasks", lambda d: f"""with {records(d)} select task_id from records group by task_id having count(distinct arm) = 2""")
ev("q_display_lookup", lambda d: f"""with {records(d)}, slow as (select task_id, count(*) as n_slow from records where best_ratio >= 1 group by task_id) select r.episode_id, coalesce(n_slow, 0) as n_slow from records r left join slow s on r.task_id = s.task_id""")
CATALOGUE.add("q_axes", "region nation", lambda d: f"""select a.r_name as checkpoint_name, b.n_name as split_name, h as horizon, f as feedback from {d.t('region')} a cross join {d.t('nation')} b cross join (select 1 as h union all select 3 union all select 6) hs cross join (select 'full' as f union all select 'none') fs""")
ev("q_horizon_curve", lambda d: f"""with {episodes.lists(d)}, f as (select budget, {episodes.best(d, "budget")} as f from lists cross join {episodes.BUDGETS}) select round(avg(case when budget = 1 then ln(1 / greatest(f.best, 1e-9)) end), 6) as h1, round(avg(case when budget = 3 then ln(1 / greatest(f.best, 1e-9)) end), 6) as h3, round(avg(case when budget = 6 then ln(1 / greatest(f.best, 1e-9)) end), 6) as h6 from f""")
ev("q_sidecar_stats", lambda d: f"""with {records(d)} select cast(count(*) as bigint) as episodes, cast(sum(case when speedup >= 1.5 then 1 else 0 end) as bigint) as successes, cast(count(distinct task_id) as bigint) as tasks, cast(sum(n_edits) as bigint) as edits from records""")
ev("q_timing_medians", lambda d: f"""with {d.medians("m", f"with {episodes.steps(d)} select concat(cast(family as varchar(10)), '|', cast(step as varchar(10))) as k, ratio from steps", "k", "ratio")} select k, cast(n as bigint) as n, round(median, 6) as median_ratio from m""")
ev("q_group_profile", lambda d: f"""with {episodes.steps(d)}, m as (select task_id, step, avg(ratio) as v from steps where ratio is not null group by task_id, step), k as (select distinct task_id, step from steps) select k.task_id, k.step, round(coalesce(v, 0), 6) as share from k left join m on m.task_id = k.task_id and m.step = k.step""")
CATALOGUE.add("q_ordered_limit", "orders", lambda d: f"""with j as (select o_orderkey, o_totalprice from {d.t('orders')} order by o_orderkey limit 1150) select o_orderkey from j where o_totalprice > 100000 order by o_orderkey limit 400""")
CATALOGUE.add("q_counts_descending", "part", lambda d: f"""with {d.ranked("c", f"select p_type, count(*) as n from {d.t('part')} group by p_type", "-n, p_type", "place")} select p_type, cast(n as bigint) as n, place from c""")
ev("q_distinct_lists", lambda d: f"""with {episodes.lists(d)}, k as (select episode_id, {d.join(d.map_("steps", "s", "s.status"), ">")} as path from lists) select path, min(episode_id) as first_seen, cast(count(*) as bigint) as n from k group by path""")
CATALOGUE.add("q_sample_tasks", "customer", lambda d: f"""with {d.ranked("t", f"""select c_custkey, {d.unit("concat('s|', cast(c_custkey as varchar(20)))")} as draw from {d.t('customer')}""", "draw, c_custkey", "pos")}, picks as (select i, i % (select count(*) from {d.t('customer')}) + 1 as of from {d.series(64, "i")}) select i as pick, c_custkey from picks join t on pos = of""")
ev("q_left_pad", lambda d: f"""with {records(d)}, w as (select family, max(n_steps) as width from records group by family) select episode_id, width - n_steps as pad, greatest(n_steps - 1, 0) as last_position from records r join w on w.family = r.family""")
ev("q_lockstep_turns", lambda d: f"""with {episodes.steps(d)} select step as turn, cast(count(*) as bigint) as active, cast(sum(case when kind = 'stop' then 1 else 0 end) as bigint) as stopped from steps group by step""")
ev("q_beam", lambda d: f"""with {episodes.steps(d)}, r as (select task_id, episode_id, step, ratio, row_number() over (partition by task_id, step order by ratio, episode_id) as r from steps where status = 'ok' and ratio is not null) select task_id, episode_id, step, r as place from r where r <= 4""")
