"""Queries over rollouts and model outputs: episode records with tokens, task data, turn selection, losses, byte tokens, token caches.

Where the model would give a number, a stand-in does: a turn's response length and whether it ended come from its place, logits are the
rows of `embeddings`, a task's data are those of the customer of its number.
"""

from __future__ import annotations

from emberline.plans import episodes
from emberline.plans.dialects import Catalogue, Spark

CATALOGUE = Catalogue()
#: Longest sequence of a turn, shortest prompt worth keeping, most turns chosen, temperature of both distributions.
MAX_SEQ, LEAST_PROMPT, MOST_ITEMS, TEMPERATURE = 160, 16, 2_000, 0.7
#: Masked places in targets; ids before those of bytes: padding, begin, end.
MASKED, SPECIALS = -100, 3
#: Share of documents held out of a token cache, and least tokens of that side.
VAL_FRAC, LEAST_VAL = 0.02, 1_024


def turns(d: Spark, start: str = "") -> str:
    """Steps with the length of the response and whether it ended by itself; start: table expressions that hold those of the episodes."""
    return f"""{episodes.judged(d, start)}, lengths as (select e.*, l.task_id, (step * 37 + l.task_id * 11) % 200 as n_response, n_steps from each e join lists l on e.episode_id = l.episode_id),
turns as (select *, n_response % 9 <> 0 as finished, kind <> 'stop' and status = 'ok' and coalesce(ratio < 0.97 * best, false) as improved from lengths)"""


CATALOGUE.add("q_rollout_records", "events", lambda d: f"""with {turns(d)}, r as (select task_id, episode_id, cast(count(*) as bigint) as n_turns, cast(sum(n_response) as bigint) as response_tokens,
  cast(sum(case when finished then 0 else 1 end) as bigint) as truncated_turns, {d.join(d.array("kind", "step"), ",")} as actions from turns group by task_id, episode_id)
select *, row_number() over (partition by task_id order by episode_id) - 1 as place_in_group from r""")
CATALOGUE.add("q_turn_selection", "events", lambda d: f"""with {turns(d)}, wanted as (select episode_id, step, kind, n_response, {MAX_SEQ} - n_response - 1 as room from turns where n_response > 0 and finished
  and case when kind = 'stop' then best > 0.5 else status <> 'ok' or not improved end), items as (select *, {d.unit("concat('turn|', episode_id, '|', cast(step as varchar(10)))")} as draw from wanted where room >= {LEAST_PROMPT})
select episode_id, step, kind, n_response, room from items order by draw, episode_id, step limit {MOST_ITEMS}""")
CATALOGUE.add("q_task_diagnostics", "events customer", lambda d: f"""with {episodes.records(d)}, tasks as (select c_custkey as task_id, c_nationkey % 3 + 1 as n_slow from {d.t('customer')}),
met as (select r.*, case when t.task_id is null then {d.fail("concat('no task ', cast(r.task_id as varchar(20)))")} else n_slow end as n_slow from records r left join tasks t on r.task_id = t.task_id)
select n_slow, cast(count(*) as bigint) as n, round(avg(case when speedup >= 1.5 then 1e0 else 0e0 end), 6) as success_rate, round(avg(case when speedup >= 0.8 * reference_speedup then 1e0 else 0e0 end), 6) as complete_rate from met group by n_slow""")
CATALOGUE.add("q_seqkd_stats", "events", lambda d: f"""with {turns(d, episodes.records(d))}, kept as (select episode_id, speedup >= 1.5 as kept, speedup, n_edits from records),
s as (select episode_id, count(*) as n, sum(case when status in ('ok', 'stop') then 1 else 0 end) as imitable, sum(case when finished then 0 else 1 end) as truncated from turns group by episode_id)
select cast(count(*) as bigint) as episodes, cast(sum(case when kept then 1 else 0 end) as bigint) as kept, cast(sum(case when kept then n else 0 end) as bigint) as steps, cast(sum(case when kept then imitable else 0 end) as bigint) as imitable_steps,
  cast(sum(case when kept then truncated else 0 end) as bigint) as truncated_steps, round(avg(case when speedup >= 1.05 then 1e0 else 0e0 end), 6) as success_105, round(avg(case when speedup >= 1.5 then 1e0 else 0e0 end), 6) as success_15,
  round(avg(cast(n_edits as double)), 6) as mean_edits from kept join s on kept.episode_id = s.episode_id""")


def log_sum_exp(d: Spark, logits: str, scale: str) -> str:
    """ln of the sum of exp(x / scale), about the largest."""
    total = d.fold(logits, {"s": "cast(0 as double)"}, lambda a, x: {"s": f"{a}.s + exp((cast({x} as double) - cast({d.top(logits)} as double)) / {scale})"})
    return f"cast({d.top(logits)} as double) / {scale} + ln({total}.s)"


def reverse_kl(d: Spark) -> str:
    """KL(student || teacher) over the vocabulary, for each row against the next."""
    value = lambda logits, i: f"cast({d.at(logits, i)} as double) / {TEMPERATURE}"
    student = lambda i: f"({value('student', i)} - student_norm)"
    teacher = lambda i: f"({value('teacher', i)} - teacher_norm)"
    kl = d.fold(d.places("student"), {"s": "cast(0 as double)"}, lambda a, i: {"s": f"{a}.s + exp({student(i)}) * ({student(i)} - {teacher(i)})"})
    return f"""with n as (select vec_id, embedding, {log_sum_exp(d, "embedding", str(TEMPERATURE))} as norm from {d.t('embeddings')} where {d.size("embedding")} > 0),
p as (select a.vec_id, a.embedding as student, a.norm as student_norm, b.embedding as teacher, b.norm as teacher_norm from n a join n b on b.vec_id = a.vec_id + 1)
select vec_id, round({kl}.s, 6) as kl from p"""


CATALOGUE.add("q_reverse_kl", "embeddings", reverse_kl)
CATALOGUE.add("q_action_loss", "embeddings", lambda d: f"""with t as (select embedding, {log_sum_exp(d, "embedding", "1")} as norm, case when vec_id % 5 = 0 then {MASKED} else cast(vec_id * 7 % {d.size("embedding")} as int) end as target from {d.t('embeddings')} where {d.size("embedding")} > 0),
m as (select norm - cast({d.at("embedding", "target")} as double) as loss, array_position(embedding, {d.top("embedding")}) - 1 = target as hit from t where target <> {MASKED})
select cast(count(*) as bigint) as n, round(avg(loss), 6) as loss, round(sum(case when hit then 1e0 else 0e0 end) / greatest(count(*), 1), 6) as accuracy from m""")


def byte_ids(d: Spark, text: str) -> str:
    """Byte tokens of a text between begin and end."""
    return d.cat(d.one("1"), d.map_(d.bytes_of(text), "h", f"{d.number('h')} + {SPECIALS}"), d.one("2"))


def byte_text(d: Spark, ids: str) -> str:
    """The text of byte tokens; special ones give nothing."""
    return d.text_of(d.join(d.map_(d.keep(ids, "i", f"i >= {SPECIALS}"), "i", f"lpad(hex(i - {SPECIALS}), 2, '0')"), ""))


CATALOGUE.add("q_byte_tokens", "documents", lambda d: f"""with e as (select doc_id, {byte_ids(d, "coalesce(text, '')")} as ids from {d.t('documents')})
select doc_id, {d.size("ids")} as n_ids, sha1({d.join(d.map_("ids", "i", "cast(i as varchar(10))"), " ")}) as ids_sha1, sha1({byte_text(d, "ids")}) as decoded_sha1 from e""")
CATALOGUE.add("q_token_cache_split", "documents", lambda d: f"""with {d.ranked("o", f"""select doc_id, length(text) + 1 as n, {d.unit("concat('cache|', cast(doc_id as varchar(20)))")} as draw from {d.t('documents')} where text is not null""", "draw, doc_id", "r", upto="n")},
size as (select count(*) as n_docs from o), cut as (select min(r) as n_val from o cross join size where r >= greatest(1, floor(n_docs * {VAL_FRAC})) and (upto >= {LEAST_VAL} or r >= n_docs - 1)),
val as (select max(upto) as n_tokens from o cross join cut where r <= n_val)
select doc_id, case when r <= n_val then 'val' else 'train' end as side, cast(upto - n - case when r <= n_val then 0 else n_tokens end as bigint) as start, n from o cross join cut cross join val""")
