"""Queries that prepare training examples: masks, buckets, epochs, schedules, protocol texts, combinations."""

from __future__ import annotations

from emberline.plans.dialects import Catalogue, Spark

CATALOGUE = Catalogue()


def examples(d: Spark) -> str:
    """User turn as observation, next assistant turn as action; the prompt's part of the text is masked."""
    return f"""turns as (select conv_id, turn, role, text, lead(role) over (partition by conv_id order by turn) as next_role, lead(text) over (partition by conv_id order by turn) as action from {d.t('conversations')}),
examples as (select conv_id, turn, length(text) as n_prompt, length(text) + length(action) as n from turns where role = 'user' and next_role = 'assistant')"""


CATALOGUE.add("q_sft_examples", "conversations", lambda d: f"with {examples(d)} select conv_id, turn, n_prompt, n, n - n_prompt as n_loss, n > 600 as too_long from examples")
CATALOGUE.add("q_sft_stats", "conversations", lambda d: f"with {examples(d)} select cast(count(*) as bigint) as n, cast(sum(case when n > 600 then 1 else 0 end) as bigint) as too_long, cast(count(distinct conv_id) as bigint) as tasks from examples")
CATALOGUE.add("q_val_split_by_task", "conversations", lambda d: f"""with {d.ranked("ranked", f"""with {examples(d)} select distinct conv_id, {d.unit("concat('val|', cast(conv_id as varchar(20)))")} as draw from examples""", "draw, conv_id")}, size as (select count(*) as n from ranked)
select conv_id, r <= case when n > 1 then greatest(1, floor(n * 0.05)) else 0 end as val from ranked cross join size""")
CATALOGUE.add("q_length_buckets", "conversations", lambda d: f"""with {d.ranked("shuffled", f"""with {examples(d)} select conv_id, turn, n, {d.unit("concat('b|', cast(conv_id as varchar(20)), '|', cast(turn as varchar(20)))")} as draw from examples""", "draw, conv_id, turn", "pos")},
chunks as (select *, floor((pos - 1) / 400) as chunk from shuffled), sorted as (select *, row_number() over (partition by chunk order by n, conv_id, turn) - 1 as r from chunks)
select conv_id, turn, cast(chunk as bigint) as chunk, cast(floor(r / 8) as bigint) as batch, n from sorted""")
CATALOGUE.add("q_pad_mask", "conversations", lambda d: f"""with {d.ranked("o", f"with {examples(d)} select conv_id, turn, n, n_prompt from examples", "n, conv_id, turn")}, b as (select *, floor((r - 1) / 8) as batch from o)
select conv_id, turn, cast(batch as bigint) as batch, cast(max(n) over (partition by batch) - 1 as int) as width, n_prompt - 1 as masked, cast(max(n) over (partition by batch) - n as int) as pad from b""")
CATALOGUE.add("q_lr_schedule", "conversations", lambda d: f"""with {d.ranked("o", f"select conv_id, turn, role, text from {d.t('conversations')}", "conv_id, turn, role, text", "r")}, s as (select distinct cast(floor((r - 1) / 8) as bigint) as step, 100 as warm, 1000 as last, 3e-4 as lr, 3e-5 as low from o)
select step, round(case when step < warm then lr * (step + 1) / warm when step >= last then low else low + 0.5 * (1 + cos(pi() * cast(step - warm as double) / (last - warm))) * (lr - low) end, 10) as lr from s""")
CATALOGUE.add("q_oversample", "documents", lambda d: f"""with {d.ranked("pool", f"select doc_id from {d.t('documents')} where lang = 'es'", "doc_id", "pos")},
jobs as (select job, job % (select count(*) from pool) + 1 as of from {d.series(500, "job")}) select job, doc_id, {d.unit("concat('rename|', cast(job as varchar(10)))")} < 0.5 as renamed from jobs join pool on pos = of""")


#: White space before and after a code.
HEAD, TAIL = "^[ \t\r\n]+", "[ \t\r\n]+$"


def marked(d: Spark) -> str:
    """Conversation texts dressed as protocol replies of every kind."""
    return f"""replies as (select conv_id, turn, case (conv_id + turn) % 5 when 0 then concat('<EDIT>', chr(10), text, chr(10), '</EDIT>') when 1 then concat(text, '<STOP>') when 2 then concat('<EDIT>', text)
  when 3 then concat('<STOP> <EDIT>', text, '</EDIT>') else text end as reply from {d.t('conversations')})"""


def find(d: Spark, text: str, what: str) -> str:
    return f"instr({text}, '{what}')"


def action(d: Spark) -> str:
    """First protocol token wins; an unclosed edit runs to the end; an edit without code is malformed."""
    body = f"substr(reply, {find(d, 'reply', '<EDIT>')} + 6)"
    return f"""parts as (select *, {find(d, 'reply', '<STOP>')} as s, {find(d, 'reply', '<EDIT>')} as e, {body} as body from replies),
bodies as (select *, case when {find(d, 'body', '</EDIT>')} > 0 then substr(body, 1, {find(d, 'body', '</EDIT>')} - 1) else body end as code from parts),
actions as (select conv_id, turn, reply, case when s > 0 and (e = 0 or s < e) then 'stop' when e > 0 and length(trim(replace(code, chr(10), ' '))) > 0 then 'edit' else 'malformed' end as kind,
  case when e > 0 and not (s > 0 and s < e) and length(trim(replace(code, chr(10), ' '))) > 0 then {d.sub('code', HEAD + '|' + TAIL, '')} end as code from bodies)"""


CATALOGUE.add("q_parse_action", "conversations", lambda d: f"with {marked(d)}, {action(d)} select conv_id, turn, kind, code from actions")
CATALOGUE.add("q_format_action", "conversations", lambda d: f"with {marked(d)}, {action(d)} select conv_id, turn, case when kind = 'stop' then '<STOP>' else concat('<EDIT>', chr(10), code, chr(10), '</EDIT>') end as text from actions where kind <> 'malformed'")
CATALOGUE.add("q_reply_histogram", "conversations", lambda d: f"with {marked(d)}, {action(d)} select kind, cast(count(*) as bigint) as n, round(cast(count(*) as double) / (select count(*) from actions), 6) as share from actions group by kind")
CATALOGUE.add("q_format_observation", "conversations", lambda d: f"""select conv_id, turn, concat('<CODE>', chr(10), {d.sub('text', TAIL, '')}, chr(10), '</CODE>', chr(10), '<STATE>', chr(10), 'step=', cast(turn as varchar(10)), chr(10), 'remaining=', cast(6 - turn as varchar(10)), chr(10), '</STATE>', chr(10)) as obs from {d.t('conversations')} where role = 'user'""")
CATALOGUE.add("q_add_hint", "conversations", lambda d: f"""with o as (select conv_id, turn, concat('<STATE>', text, case when turn % 2 = 0 then '</STATE> tail' else '' end) as obs from {d.t('conversations')}),
p as (select *, case when instr(obs, '</STATE>') > 0 then length(obs) - instr(reverse(obs), reverse('</STATE>')) - 6 else 0 end as cut_at from o)
select conv_id, turn, case when cut_at > 0 then concat(substr(obs, 1, cut_at - 1), 'hint=go', chr(10), substr(obs, cut_at)) else concat(obs, chr(10), 'hint=go') end as hinted from p""")
CATALOGUE.add("q_profile_shares", "lineitem", lambda d: f"""with g as (select l_orderkey, l_linenumber, l_extendedprice as ns from {d.t('lineitem')})
select l_orderkey, l_linenumber, round(ns / case when sum(ns) over (partition by l_orderkey) = 0 then 1 else sum(ns) over (partition by l_orderkey) end, 6) as share from g""")
CATALOGUE.add("q_hottest", "lineitem", lambda d: f"""with r as (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as r from {d.t('lineitem')}) select l_orderkey, l_linenumber as hottest from r where r = 1""")
CATALOGUE.add("q_top_guesses", "part", lambda d: f"""with s as (select p_brand, p_type, sum(p_size) as score, min(p_partkey) as first_seen from {d.t('part')} group by p_brand, p_type), r as (select *, row_number() over (partition by p_brand order by score desc, first_seen) as r from s)
select p_brand, p_type, cast(score as bigint) as score, r as place from r where r <= 4""")
CATALOGUE.add("q_ranked_combos", "part", lambda d: f"""with s as (select p_brand, p_type, sum(p_size) as score, min(p_partkey) as first_seen from {d.t('part')} group by p_brand, p_type), g as (select p_brand, p_type, row_number() over (partition by p_brand order by score desc, first_seen) - 1 as r from s),
c as (select a.p_brand, a.p_type as t1, b.p_type as t2, a.r as r1, b.r as r2 from g a join g b on a.p_brand = b.p_brand where a.r < 5 and b.r < 5), k as (select *, row_number() over (partition by p_brand order by r1 + r2, r1, r2) as place from c)
select p_brand, t1, t2, place from k where place <= 16""")
CATALOGUE.add("q_spliced_driver", "lineitem", lambda d: f"""select l_orderkey, concat('run(', {d.join(d.array("concat('f', cast(l_partkey as varchar(10)))", "l_linenumber * 100000000 + l_partkey"), ",")}, ')') as driver from {d.t('lineitem')} group by l_orderkey""")
CATALOGUE.add("q_nucleus_filter", "embeddings", lambda d: f"""with e as (select vec_id, pos, cast(x as double) as x from {f"(select vec_id, pos, x from {{embeddings}} lateral view posexplode(embedding) _x as pos, x)" if d.name == "spark" else "(select vec_id, unnest(embedding) as x, cast(generate_subscripts(embedding, 1) - 1 as int) as pos from embeddings)"} v),
p as (select *, exp(x) / sum(exp(x)) over (partition by vec_id) as p from e), o as (select *, row_number() over (partition by vec_id order by p desc, pos) as r from p),
c as (select *, coalesce(sum(p) over (partition by vec_id order by r rows between unbounded preceding and 1 preceding), 0) as before from o)
select vec_id, cast(sum(case when r <= 20 and (before <= 0.5 or r = 1) then 1 else 0 end) as bigint) as kept from c group by vec_id""")
