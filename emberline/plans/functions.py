"""The workload library's small computations, as queries over one array per order, user, part or document.

Arrays keep their order; ties go to the first; empty inputs give nulls where the plain function would raise.
"""

from __future__ import annotations

from emberline.plans.dialects import Catalogue, Spark

CATALOGUE = Catalogue()


def arrays(d: Spark) -> str:
    """xs: a user's values in whole numbers, in time order."""
    return f"a as (select user_id as id, {d.array('cast(floor(value) as bigint) % 50', 'ts_key')} as xs from (select user_id, value, concat(cast(ts as varchar(30)), '|', lpad(cast(event_id as varchar(20)), 12, '0')) as ts_key from {d.t('events')}) e group by user_id)"


def long(d: Spark) -> str:
    return f"e as (select user_id as id, cast(floor(value) as bigint) % 50 as x, row_number() over (partition by user_id order by ts, event_id) - 1 as pos from {d.t('events')})"


def add(name: str, tables: str, text) -> None:
    CATALOGUE.add(f"q_fn_{name}", tables, text)


add("array_basics", "events", lambda d: f"""with {arrays(d)} select id, {d.size("xs")} as n, {d.size("xs")} <> {d.size(d.distinct("xs"))} as contains_duplicate, {d.size(d.distinct("xs"))} as n_distinct, {d.size(d.keep("xs", "v", "v % 2 = 0"))} as n_even,
  {d.size(d.keep("xs", "v", "v between 10 and 20"))} as n_in_range, {d.join(d.map_("xs", "v", "cast(v as varchar(20))"), ",")} as csv_line from a""")
add("folds", "events", lambda d: f"""with {arrays(d)}, f as (select id, {d.fold("xs", {"best": "cast(-1000 as bigint)", "cur": "cast(0 as bigint)"}, lambda a, x: {"best": f"greatest({a}.best, greatest({a}.cur, 0) + {x} - 25)", "cur": f"greatest({a}.cur, 0) + {x} - 25"})} as k,
  {d.fold("xs", {"run": "cast(0 as bigint)", "top": "cast(0 as bigint)", "last": "cast(-1 as bigint)"}, lambda a, x: {"run": f"case when {x} > {a}.last then {a}.run + 1 else cast(1 as bigint) end", "top": f"greatest({a}.top, case when {x} > {a}.last then {a}.run + 1 else cast(1 as bigint) end)", "last": x})} as r from a)
select id, k.best as max_subarray, r.top as longest_increasing_run from f""")
add("windows", "events", lambda d: f"""with {long(d)} select id, pos, x, cast(sum(x) over w as bigint) as prefix_sum, min(x) over w as running_min, max(x) over w as running_max, case when pos >= 2 then round(avg(cast(x as double)) over (partition by id order by pos rows between 2 preceding and current row), 6) end as moving_average,
  cast(rank() over (partition by id order by x) - 1 as bigint) as rank_by_sorted_position, x - lag(x) over (partition by id order by pos) as diff from e window w as (partition by id order by pos rows between unbounded preceding and current row)""")
add("aggregates", "events", lambda d: f"""with {long(d)}, m as (select *, avg(cast(x as double)) over (partition by id) as mean, sum(cast(x as double)) over (partition by id) as total, max(x) over (partition by id) as top from e)
select id, cast(sum(case when x > mean then 1 else 0 end) as bigint) as count_above_mean, max(x) - min(x) as value_range, cast(sum(x * x) as bigint) as squares_sum, round(max(cast(x as double) / greatest(total, 1)), 6) as top_share, round(avg(abs(x - mean)), 6) as mean_deviation from m group by id""")
add("most_frequent", "events", lambda d: f"""with {long(d)}, c as (select id, x, count(*) as n, min(pos) as first_pos from e group by id, x), r as (select *, row_number() over (partition by id order by n desc, first_pos) as r from c) select id, x as most_frequent, cast(n as bigint) as n from r where r = 1""")
def word_frequencies(d: Spark) -> str:
    """Each word's occurrences and documents. Spark lists both kinds of rows of a document in one array, so words are shuffled once, by themselves, after they were added up in each task."""
    if d.name == "spark":
        return f"""with t as (select {d.words("text")} as ws from {d.t('documents')}),
e as (select inline(concat(transform(ws, w -> named_struct('word', w, 'n', 1L, 'documents', 0L)), transform(array_distinct(ws), w -> named_struct('word', w, 'n', 0L, 'documents', 1L)))) from t)
select word, sum(n) as n, sum(documents) as documents from e group by word"""
    return f"""with w as (select row_number() over () as id, {d.words("text")} as ws from documents), e as (select id, unnest(ws) as word from w)
select word, count(*) as n, count(distinct id) as documents from e group by word"""


add("word_frequencies", "documents", word_frequencies)
# members are rows and no lists: a bucket may hold any number of them
add("bucket_by_length", "documents", lambda d: f"""with b as (select length(text) % 97 as bucket, cast(count(*) as bigint) as n from {d.t('documents')} group by length(text) % 97)
select t.doc_id, b.bucket, b.n from {d.t('documents')} t join b on length(t.text) % 97 = b.bucket""")
add("reverse_words", "benchmark", lambda d: f"""select item_id, {d.join("reverse(" + d.words("text") + ")" if d.name == "spark" else "list_reverse(" + d.words("text") + ")", " ")} as reversed, text = reverse(text) as is_palindrome, {d.size(d.words("text"))} as n_words from {d.t('benchmark')}""")
add("longest_token", "benchmark", lambda d: f"""with w as ({"select item_id, pos, w from (select item_id, " + d.words("text") + " as ws from {benchmark}) t lateral view posexplode(ws) _x as pos, w" if d.name == "spark" else "select item_id, unnest(ws) as w, cast(generate_subscripts(ws, 1) - 1 as int) as pos from (select item_id, " + d.words("text") + " as ws from benchmark) t"}),
r as (select *, row_number() over (partition by item_id order by length(w) desc, pos) as r from w) select item_id, w as longest_token, length(w) as n from r where r = 1""")
add("anagram_groups", "part", lambda d: f"""with g as (select p_type, min(p_partkey) as first_seen, count(*) as n from {d.t('part')} group by p_type) select length(p_type) as n_chars, cast(count(*) as bigint) as types, cast(sum(n) as bigint) as parts, min(first_seen) as first_seen from g group by length(p_type)""")
add("semi_anti", "orders customer", lambda d: f"""select c_mktsegment, cast(count(*) as bigint) as customers, cast(sum(case when exists_order then 1 else 0 end) as bigint) as count_common, cast(sum(case when exists_order then 0 else 1 end) as bigint) as without from (
  select c_mktsegment, c_custkey in (select o_custkey from {d.t('orders')}) as exists_order from {d.t('customer')}) x group by c_mktsegment""")
add("group_by_key", "lineitem", lambda d: f"""select l_orderkey, {d.join(d.array("cast(l_linenumber as varchar(10))", "l_linenumber"), ",")} as lines, cast(count(*) as bigint) as n, cast(round(sum(l_extendedprice * (1 - l_discount)) / 1000, 0) as bigint) as revenue_thousands from {d.t('lineitem')} group by l_orderkey""")
add("pairs_with_sum", "lineitem", lambda d: f"""select a.l_orderkey, cast(count(*) as bigint) as pairs from {d.t('lineitem')} a join {d.t('lineitem')} b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber and a.l_quantity + b.l_quantity = 50 group by a.l_orderkey""")
add("inversions", "lineitem", lambda d: f"""select a.l_orderkey, cast(sum(case when a.l_extendedprice > b.l_extendedprice then 1 else 0 end) as bigint) as inversions from {d.t('lineitem')} a join {d.t('lineitem')} b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber group by a.l_orderkey""")
add("top_k", "orders", lambda d: f"""with r as (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from {d.t('orders')}) select o_custkey, o_orderkey, r as place from r where r <= 3""")
add("gaps_islands", "events", lambda d: f"""with {long(d)}, f as (select *, case when lag(x % 2) over (partition by id order by pos) = x % 2 then 0 else 1 end as new from e), g as (select *, sum(new) over (partition by id order by pos rows unbounded preceding) as island from f)
select id, cast(count(*) as bigint) as longest, cast(island as bigint) as island from g group by id, island""")
add("clip_normalize", "part", lambda d: f"""select p_partkey, least(greatest(p_size, 10), 40) as clipped, round(p_retailprice / (select max(p_retailprice) from {d.t('part')}), 6) as scaled, cast(p_size as bigint) * p_size as square, cast(floor(p_size / 7e0) as bigint) as bucket from {d.t('part')}""")
