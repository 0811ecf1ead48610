"""Every catalogue query against its DuckDB twin on the smallest tables, and golden cases of the folds."""

import datetime
import math

import duckdb
import pytest

from emberline import plans
from emberline.plans import episodes
from emberline.plans.dialects import Duck, Spark

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def told(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_twins(spark, duck, name):
    ours = plans.QUERIES[name](spark, SF)
    theirs = duck.sql(plans.SQL[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in columns]
    assert sorted(tuple(map(told, r)) for r in ours.select(columns).collect()) == sorted(tuple(told(r[i]) for i in at) for r in theirs.fetchall())


@pytest.mark.parametrize("name", ["q_localization", "q_group_advantages", "q_records_from_lines"])
def test_twins_where_ratios_are_zero_or_below(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"copy (select * from '{SF}/lineitem.parquet') to '{tmp_path}/lineitem.parquet'")
    con.execute(f"create table more as select row_number() over (order by l_orderkey) as k, l_orderkey as u from (select distinct l_orderkey from '{SF}/lineitem.parquet' where l_orderkey > (select max(user_id) from '{SF}/events.parquet')) order by u limit 4")
    # of one episode each but the last two: zero; below zero; zero twice; zero and a half
    con.execute("create table odd(k int, day int, value double)")
    con.execute("insert into odd values (1, 1, 0), (2, 1, -5), (3, 1, 0), (3, 20, 0), (4, 1, 0), (4, 20, 25)")
    con.execute(f"""copy (select * from '{SF}/events.parquet' union all by name
      select 10000000 + k * 100 + day as event_id, make_timestamp(2024, 1, day, 1, 0, 0) as ts, u as user_id, 'click' as event_type, value, null as props from odd join more using (k)) to '{tmp_path}/events.parquet'""")
    for t in ("events", "lineitem"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    ours, theirs = plans.QUERIES[name](spark, str(tmp_path)), con.sql(plans.SQL[name])
    columns = sorted(ours.columns)
    at = [theirs.columns.index(c) for c in columns]
    assert sorted(tuple(map(told, r)) for r in ours.select(columns).collect()) == sorted(tuple(told(r[i]) for i in at) for r in theirs.fetchall())


@pytest.mark.parametrize(("budget", "best", "used"), [(1, 1.0, 1), (2, 0.5, 2), (3, 0.5, 3), (6, 0.2, 4)])
def test_truncated_best(spark, budget, best, used):
    d = Spark()
    rows = [(1, "edit", "incorrect", None), (2, "edit", "ok", 0.5), (3, "edit", "ok", 0.49), (4, "edit", "ok", 0.2), (5, "stop", "stop", None)]
    df = spark.createDataFrame([(rows,)], "steps array<struct<step:int,kind:string,status:string,ratio:double>>")
    f = df.selectExpr(f"{episodes.best(d, str(budget))} as f").first().f
    assert (f.best, f.used) == (best, used)


def test_best_of_k_is_the_mean_over_subsets(spark):
    from itertools import combinations

    values = [1.0, 1.0, 2.0, 4.0, 7.0, 7.5]
    for n in range(1, 7):
        for k in range(1, n + 1):
            brute = sum(max(c) for c in combinations(values[:n], k)) / math.comb(n, k)
            w = [k / n * (1 if k == 1 else duckdb.sql(f"select {episodes.product(str(i), str(n), str(k))} as x").fetchall()[0][0]) if i >= k - 1 else 0 for i in range(n)]
            assert math.isclose(sum(a * b for a, b in zip(w, values, strict=False)), brute)
    for k, reached, expected in [(1, 2, 0.5), (2, 2, 1 - 1 / 6)]:
        assert math.isclose(duckdb.sql(f"select {episodes.p_reach('4', str(reached), str(k))} as x").fetchall()[0][0], expected)


def test_dialects_agree_on_draws(spark, duck):
    for d, run in ((Spark(), lambda q: spark.sql(q).first()[0]), (Duck(), lambda q: duck.sql(q).fetchall()[0][0])):
        assert abs(run(f"select {d.unit(chr(39) + 'abc' + chr(39))} as x") - 0xA9993E364706816 / 16**15) < 1e-15


def test_mined_seeds_cover_every_part(spark, tmp_path):
    rows = [(k, f"part {k}", k) for k in (1, 500, 501, 900_002)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    out = plans.QUERIES["q_mined_seeds"](spark, str(tmp_path)).collect()
    assert sorted((r.seed_group, r.only_slow) for r in out) == sorted((k, slow) for k, _, size in rows for slow in [False] + [True] * (size % 3))


def test_protocol_texts_stay_whole(spark, tmp_path):
    code = "def f():\n" + "\n".join(f"    line_{k} = {k}" for k in range(40))
    spark.createDataFrame([(c, t, "user", code) for c in range(5) for t in range(3)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name: plans.QUERIES[name](spark, str(tmp_path)).collect()
    edits = [r.code for r in run("q_parse_action") if r.kind == "edit"]
    assert edits and all(x == code for x in edits)
    assert all(r.text in ("<STOP>", f"<EDIT>\n{code}\n</EDIT>") for r in run("q_format_action"))
    assert all(f"<CODE>\n{code}\n</CODE>" in r.obs for r in run("q_format_observation"))
    assert all(code in r.hinted for r in run("q_add_hint"))
    assert {r.code for r in run("q_code_from_obs")} == {code, ""}
    assert {r.prompt for r in run("q_completion_prompt")} == {"||".join([code] * 3)}
    assert all(code in r.reply for r in run("q_first_replies"))
    assert {r.kind: r.n for r in run("q_reply_histogram")} == {"edit": 6, "stop": 6, "malformed": 3}


def test_rare_words_are_counted(spark, tmp_path):
    spark.createDataFrame([(1, "a b b"), (2, "b c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = plans.QUERIES["q_fn_word_frequencies"](spark, str(tmp_path)).collect()
    assert sorted((r.word, r.n, r.documents) for r in out) == [("a", 1, 1), ("b", 3, 2), ("c", 1, 1)]


def test_corpus_union_takes_every_document(spark, tmp_path):
    spark.range(20_010).selectExpr("id as doc_id", "'x' as text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0, "c")], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert plans.QUERIES["q_corpus_union"](spark, str(tmp_path)).count() == 20_012


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(plans.SQL) <= set(__spark_entry__.queries())
