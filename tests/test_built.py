"""The token store, permutations, localisation, sinks, line numbers, variants, SQL functions, exact quantiles: against plain Python and brute force."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from emberline.functions import permutation, tokens
from emberline.functions import sql as sql_functions
from emberline.operators import distill, exact_quantile, localize
from emberline.sources import files, task_meta, token_store

TEXTS = ["", "abc", "é𝄞 \x00\x7f", "x" * 5000, None, "y" * 70_000, *(f"text number {k} " * (k % 40) for k in range(200))]


@pytest.mark.parametrize("page", [64, 1 << 14])
def test_token_store_windows_are_those_of_the_concatenation(spark, monkeypatch, page):
    monkeypatch.setattr(token_store, "PAGE", page)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(5)
    store = token_store.written(docs, token_store.packed_bytes(F.coalesce("text", F.lit(""))))
    whole = [i for t in TEXTS for i in [*(b + tokens.FIRST_BYTE for b in (t or "").encode()), tokens.END]]
    assert store.total == len(whole)
    starts = [0, 1, page - 1, page, len(whole) - 300, *random.Random(4).sample(range(len(whole) - 300), 20)]
    for length in (1, 300):
        for r in store.windows(starts, length).collect():
            assert [int.from_bytes(r.ids[2 * k : 2 * k + 2]) for k in range(length)] == whole[r.start : r.start + length]
    same = docs.select(token_store.packed(tokens.byte_ids("text", end=True)).alias("a"), token_store.packed_bytes(F.col("text")).alias("b"))
    assert same.where("a <> b").count() == 0
    plan = store.windows([page * 3], 5)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(page)" in plan and "EqualTo(page,3)" in plan.replace("In(page, [3])", "EqualTo(page,3)")
    for bad in ([-1], [len(whole)]):
        with pytest.raises(ValueError, match="within the store"):
            store.windows(bad, 10)
    with pytest.raises(ValueError, match="within the store"):
        token_store.written(docs.limit(0), token_store.packed_bytes(F.col("text"))).drawn(1, 1, "s")


def test_token_store_deals_and_keeps_documents_and_not_their_ids(spark, monkeypatch):
    from emberline.plans import dialects

    dealt, keep = [], dialects.kept_table
    monkeypatch.setattr(dialects, "kept_table", lambda df: dealt.append(df) or keep(df))
    docs = spark.createDataFrame([(k % 3, "ab" * k) for k in range(9)], "doc_id long, text string")
    store = token_store.written(docs, token_store.packed_bytes(F.col("text")))
    assert len(dealt) == 1 and "binary" not in dict(dealt[0].dtypes).values()
    assert sorted((r.id, r.n) for r in store.index.collect()) == sorted((k % 3, 2 * k + 1) for k in range(9)) and store.total == 81


def test_permutations_are_one_to_one_and_differ_by_key(spark):
    sizes = [*range(1, 40), 100, 997]
    rows = spark.createDataFrame([(n, p) for n in sizes for p in range(n)], "n long, p long")
    out = rows.select("n", "p", *(permutation.permuted(F.col("p"), F.col("n"), F.lit(k)).alias(k) for k in ("one", "two"))).collect()
    for n in sizes:
        own = [r for r in out if r.n == n]
        assert sorted(r.one for r in own) == sorted(r.two for r in own) == list(range(n))
        assert n < 20 or [r.one for r in own] != [r.two for r in own]


def test_permutations_are_even(spark):
    n, keys = 7, 4000
    out = spark.range(keys).select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("p"), "id").select("p", permutation.permuted(F.col("p"), F.lit(n), F.col("id").cast("string")).alias("x"))
    for p in range(3):
        seen = [r["count"] for r in out.where(F.col("p") == p).groupBy("x").count().collect()]
        assert len(seen) == n and sum((c - keys / n) ** 2 / (keys / n) for c in seen) < 30


def test_no_product_in_the_plan_of_file_specs(spark):
    from emberline.plans import built

    out = built.file_specs(spark, "/root/testdata/sf0.001")
    assert "CartesianProduct" not in out._jdf.queryExecution().toString() and "NestedLoop" not in out._jdf.queryExecution().toString()
    rows = out.collect()
    by = {}
    for r in rows:
        by.setdefault(r.spec, []).append(r)
    assert all(len({r.part for r in rs}) == len(rs) == rs[0].k and sum(r.slow for r in rs) == rs[0].d <= min(3, rs[0].k) for rs in by.values())
    assert {r.d for r in rows} == {1, 2, 3} and {r.k for r in rows} == {2, 3, 4}


def test_localization_figures(spark):
    tasks = spark.createDataFrame([("t", ["a", "b", "c"], ["b"], {"a": 0.2, "b": 0.4, "c": 0.4}), ("u", ["a"], ["a"], None)], "task_id string, functions array<string>, slow_functions array<string>, profile map<string,double>")
    step = lambda kind, status, *edited: (kind, status, list(edited))
    records = [
        ("r", "1", "t", 0.5, 3.0, [step("edit", "ok", "zz"), step("edit", "ok", "c", "b"), step("edit", "incorrect", "a"), step("stop", "stop")]),
        ("r", "2", "t", 1.0, 1.0, [step("malformed", "malformed"), step("edit", "ok", "a")]),
        ("r", "3", "u", 0.25, 4.0, [step("edit", "ok", "a")] * 21),
        ("r", "4", "u", 0.25, 6.0, []),
    ]
    df = spark.createDataFrame(records, "run string, episode_id string, task_id string, best_ratio double, reference_speedup double, steps array<struct<action_kind:string,status:string,edited:array<string>>>")
    got = {(r.run, r.figure, r.key): (round(r.value, 4), r.n) for r in localize.report(df, tasks).collect()}
    assert got == {
        ("chance", "slow_chance", ""): (0.6667, 2), ("chance", "hot_chance", ""): (0.6667, 2),
        ("r", "success", "1"): (0.75, 4), ("r", "complete", "1"): (0.5, 4),
        ("r", "first_slow", ""): (0.6667, 3), ("r", "first_hot", ""): (0.5, 2),
        ("r", "place", "0"): (23.0, 23), ("r", "place", "2"): (1.0, 1),
        ("r", "correct", "slow"): (1.0, 22), ("r", "correct", "fast"): (0.5, 2),
    }


def test_sides_are_written_in_order_and_counted_in_one_job(spark, tmp_path):
    rows = [(k, ["train", "val"][k % 10 == 3], "x" * (k % 7)) for k in range(500)]
    df = spark.createDataFrame(rows, "place long, kind string, text string").repartition(6)
    told = files.write_sides(df, f"file://{tmp_path}/out", F.col("kind"), "place", ["train", "val", "none"], {"empty": F.col("text") == ""})
    assert told["train"] == {"rows": 450, "empty": sum(t == "" for _, s, t in rows if s == "train")} and told["none"] == {"rows": 0, "empty": 0}
    for side in ("train", "val"):
        lines = [json.loads(line)["place"] for f in sorted((tmp_path / "out" / f"side={side}").glob("part-*")) for line in f.read_text().splitlines()]
        assert lines == [k for k, s, _ in rows if s == side]
    with pytest.raises(Exception, match="no such side"):
        files.write_sides(df, f"file://{tmp_path}/bad", F.col("kind"), "place", ["train"])


def plain_jsonl(path, limit):
    out = []
    with open(path, newline=None) as f:
        for i, line in enumerate(f):
            if limit and i >= limit:
                break
            if line.strip():
                out.append(json.loads(line)["n"])
    return out


def test_line_limits_over_many_splits(spark, tmp_path):
    lines = [json.dumps({"n": k, "pad": "é" * (k * 37 % 200)}) if k % 5 else "  " * (k % 3) for k in range(3000)]
    (tmp_path / "a.jsonl").write_bytes("\n".join(lines).encode())
    (tmp_path / "b.jsonl").write_bytes("\r\n".join(lines[:700]).encode() + b"\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert files.numbered_lines(spark, f"file://{tmp_path}/a.jsonl").rdd.getNumPartitions() >= 1
        for name in ("a", "b"):
            path = tmp_path / f"{name}.jsonl"
            for limit in (1, 2, 699, 1234, 5000):
                assert [r.n for r in files.read_jsonl(spark, f"file://{path}", "n long, pad string", limit).collect()] == plain_jsonl(path, limit)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_task_metadata_keeps_unknown_keys_and_reads_paths(spark, tmp_path):
    metas = ['{"d": 2, "k": 3, "functions": ["f", "g"], "slow_functions": ["g"], "profile0": {"f": 0.25, "g": 0.75}, "search": {"nodes": 9}, "own": [1, {"x": null}]}', '{"d": "two", "functions": null}', "{}", None, "no json", "[1, 2]"]
    df = spark.createDataFrame(list(enumerate(metas)), "task_id long, text string").select("task_id", task_meta.parsed(F.col("text")).alias("meta"))
    df.write.parquet(f"file://{tmp_path}/tasks")
    back = spark.read.parquet(f"file://{tmp_path}/tasks")
    out = {r.task_id: r for r in task_meta.with_columns(back).withColumn("text", task_meta.text(F.col("meta"))).collect()}
    assert json.loads(out[0].text) == json.loads(metas[0])
    assert (out[0].d, out[0].functions, out[0].profile0, out[0].search_nodes) == (2, ["f", "g"], {"f": 0.25, "g": 0.75}, 9)
    for k in range(1, 6):
        assert (out[k].d, out[k].functions, out[k].slow_functions, out[k].profile0, out[k].kind, out[k].search_nodes) == (0, [], [], {}, "function", 0)
    assert "slow_functions" in task_meta.shape(back.where("task_id = 0")) and task_meta.shape(back.limit(0)) in (None, "VOID")
    assert back.where(task_meta.at(F.col("meta"), "d") == 2).count() == 1


def test_sql_functions(spark):
    assert "truncated_best" in sql_functions.register(spark)
    steps = "array(named_struct('step', 1, 'kind', 'edit', 'status', 'incorrect', 'ratio', null), named_struct('step', 2, 'kind', 'edit', 'status', 'ok', 'ratio', 0.5D), named_struct('step', 3, 'kind', 'edit', 'status', 'ok', 'ratio', 0.49D), named_struct('step', 4, 'kind', 'edit', 'status', 'ok', 'ratio', 0.2D), named_struct('step', 5, 'kind', 'stop', 'status', 'stop', 'ratio', null))"
    for budget, best, used in [(0, 1.0, 0), (1, 1.0, 1), (2, 0.5, 2), (3, 0.5, 3), (9, 0.2, 4)]:
        r = spark.sql(f"select truncated_best({steps}, {budget}) as f").first().f
        assert (r.best, r.used) == (best, used)
    r = spark.sql("select speedup(0.25D) as a, reward(0.25D, 2, 1) as b, p_reach(4, 2, 2) as c, canonical_key('s', 'c') as d").first()
    assert r.a == 4 and math.isclose(r.b, math.log(4) - 0.07) and math.isclose(r.c, 5 / 6) and len(r.d) == 16
    spark.createDataFrame([(1, "b", 5), (1, "a", 9), (2, "z", 1)], "g int, o string, v int").createOrReplaceTempView("some_rows")
    rows = spark.sql("select * from numbered(rows => table(some_rows), `group` => 'g', `by` => 'o')").collect()
    assert sorted((r.g, r.o, r.v, r.k) for r in rows) == [(1, "a", 9, 1), (1, "b", 5, 2), (2, "z", 1, 1)]


@pytest.mark.parametrize("few", [3, 100, 10_000])
def test_exact_medians(spark, few):
    rng = random.Random(7)
    groups = {"one": [4.0], "ties": [1.0] * 300 + [2.0] * 300, "heavy": [0.5] * 900 + [rng.random() for _ in range(400)], "two ends": [0.0] * 200 + [0.5] + [1.0] * 200, "odd": [float("nan"), float("inf"), -1.0], None: [rng.gauss(0, 9) for _ in range(700)], "nulls": [None, None]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    rng.shuffle(rows)
    out = {r.g: (r.n, r.median) for r in exact_quantile.upper_median(spark.createDataFrame(rows, "g string, x double"), "g", "x", few).collect()}
    for g, vs in groups.items():
        kept = sorted((v for v in vs if v is not None), key=lambda v: (math.isnan(v), v))
        assert out.get(g) == ((len(kept), kept[len(kept) // 2]) if kept else None)
    assert Counter(out.keys()) == Counter(g for g in groups if g != "nulls")


def test_a_cluster_must_name_a_shared_folder():
    from types import SimpleNamespace

    from emberline.operators.tables import kept_folder

    session = lambda master, **conf: SimpleNamespace(sparkContext=SimpleNamespace(master=master), conf=SimpleNamespace(get=lambda k, *d: conf.get(k.rpartition(".")[2] if "checkpoint" not in k else "checkpoint", *d)))
    with pytest.raises(ValueError, match="must name a folder"):
        kept_folder(session("spark://host:7077", dir="w"))
    assert kept_folder(session("spark://host:7077", checkpoint="hdfs://x/c/")).startswith("hdfs://x/c/emberline-")
    assert kept_folder(session("local[4]", dir="file:///w")).startswith("file:///w/_checkpoints/emberline-")


def test_training_rows_of_a_teacher(spark):
    turns = [("o0", "<EDIT>\nx = 1\n", None), ("o1", None, False), ("o2", "<STOP>", True), ("o3", "not reached", True)]
    steps = [("ok", 0.5), ("malformed", None), ("stop", None)]
    schema = "episode_id string, task_id string, best_ratio double, n_edits int, n_invalid int, reward double, turns array<struct<obs:string,action_text:string,finished:boolean>>, steps array<struct<status:string,ratio:double>>"
    df = spark.createDataFrame([("a", "t", 0.5, 2, 1, 0.6, turns, steps), ("b", "t", 0.9, 1, 0, 0.1, turns, steps), ("c", "u", 0.1, 0, 0, 2.0, [], [])], schema)
    out = {r.episode_id: r for r in distill.rows(df, 6, 1.5).collect()}
    assert set(out) == {"a", "c"} and out["c"].steps is None and out["a"].method == "seqkd"
    assert [(s.step, s.remaining, s.obs, s.action, s.status, s.finished, s.learn) for s in out["a"].steps] == [(0, 6, "o0", "<EDIT>\nx = 1\n</EDIT>", "ok", True, True), (1, 5, "o1", "", "malformed", False, False), (2, 4, "o2", "<STOP>", "stop", True, True)]
    r = distill.stats(df, 6, 1.5).first()
    assert (r.episodes, r.kept, r.steps, r.imitable_steps, r.truncated_steps) == (3, 2, 3, 2, 1)
