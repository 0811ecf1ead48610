"""Queries over source code and the programs that it makes; they have no SQL twin.

Their functions are those of codeops.snippets() and those mined from the interpreter's own library that behave (tasks.accepted()).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions import arrays, keyed
from emberline.operators import codeops, mutate, rewrites, sandbox, specs, tasks
from emberline.operators.tables import kept_table
from emberline.sources.files import standard_library

#: Specs of the snippets' parameters, where they aren't one list of numbers.
SPECS_OF = {"shared": ["list_int", "list_int"], "looked_up": ["list_pair_int", "list_int"], "listed": ["list_str"]}


def functions(spark: SparkSession) -> DataFrame:
    """(name, source) of the snippets and all mined functions."""
    mined = kept_table(codeops.mined(standard_library(spark)))
    return codeops.snippets(spark).unionByName(mined.select(F.concat("func_name", F.lit("_"), F.substring("key", 1, 6)).alias("name"), "source"))


def behaving(spark: SparkSession) -> DataFrame:
    """(seed_name, func_name, source, arg_specs) of the snippets and the accepted functions."""
    known = F.udf(lambda n: SPECS_OF.get(n, ["list_int"]), "array<string>")
    own = codeops.snippets(spark).select(F.col("name").alias("seed_name"), F.col("name").alias("func_name"), "source", known("name").alias("arg_specs"))
    return own.unionByName(accepted(spark, "").where("status = 'ok'").select("seed_name", "func_name", "source", "arg_specs"))


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_table(tasks.accepted(kept_table(codeops.mined(standard_library(spark)))))


def seeds(spark: SparkSession) -> DataFrame:
    return kept_table(tasks.prepared(behaving(spark)))


def nodes_and_seeds(spark: SparkSession, depth: int = 2, most_nodes: int = 8) -> tuple[DataFrame, DataFrame]:
    found = seeds(spark)
    return tasks.expanded(found, depth, most_nodes), found


def all_tasks(spark: SparkSession) -> DataFrame:
    return kept_table(tasks.made(*nodes_and_seeds(spark, 1)))


def mine_stdlib(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codeops.mined(standard_library(spark))


def mining_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codeops.funnel(standard_library(spark))


def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.type_histogram(accepted(spark, sf_dir))


def applicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codeops.slower(functions(spark))


def algorithmic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-written slow versions, found by normalised source, whatever its spaces and comments."""
    rows = [("def counts(xs):\n  out = {}  # by value\n  for x in xs:\n    out[x] = out.get(x, 0) + 1\n  return out", "def counts(xs):\n    return {x: [*xs].count(x) for x in xs}")]
    return codeops.algorithmic(functions(spark), spark.createDataFrame(rows, "fast string, slow string"))


def propose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codeops.faster(codeops.slower(functions(spark)).select("name", F.col("family").alias("undone"), F.col("variant").alias("source")), ("name", "undone"))


def sandbox_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = seeds(spark).where("status = 'ok'").withColumnRenamed("fast", "source")
    jobs = codeops.slower(found, ("seed_name", "func_name", "source", "correct_inputs")).select("seed_name", "func_name", "source", "family", F.col("variant").alias("candidate"), F.col("correct_inputs").alias("inputs"))
    return sandbox.evaluated(jobs.repartition(32, "candidate"), repeats=3).select("seed_name", "family", "status", "n_pass", "n_total", "ratio")


def bfs_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes_and_seeds(spark)[0]


def renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codeops.exploded(functions(spark), "source", lambda s: [(mutate.renamed(s, mutate.rename_map([s], s, "")),)], "renamed string", ("name",))


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codeops.exploded(functions(spark), "source", lambda s: [(mutate.with_bug(s, s), mutate.with_syntax_error(s, s))], "bug string, broken string", ("name",))


def spec_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    guessed = lambda s: [(k, r, spec, float(v)) for k, x in enumerate(specs.guessed_specs(s)) for r, (spec, v) in enumerate(x)]
    return codeops.exploded(functions(spark), "source", guessed, "parameter int, place int, spec string, score double", ("name",))


def name_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be told of each name of each function: bindings, uses, whether it is changed in place and whether a loop reads it."""

    def told(source: str) -> Iterator[tuple]:
        fn = rewrites.function_in(codeops.parsed(source))
        f = rewrites.Facts(fn)
        for name in sorted({*f.stores, *f.loads}):
            yield name, name in f.params, f.stores[name], len(f.loads[name]), name in f.changed, any(map(f.hot, f.loads[name]))

    return codeops.exploded(functions(spark), "source", told, "variable string, parameter boolean, stores int, loads int, changed boolean, hot boolean", ("name",))


def made_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.made(*nodes_and_seeds(spark))


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.trajectories(all_tasks(spark), ("programmatic",), per_task=2)


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.trajectories(all_tasks(spark), ("search",))


def relearned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes that end with the fast program, cleaned and run again."""
    found = all_tasks(spark)
    return tasks.relearned(found, found.select("task_id", (1 / F.col("reference_speedup")).alias("best_ratio"), F.col("fast_source").alias("best_code")), 1.3)


def file_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two to four functions, the first of them slow: one task of each function, dealt into files by a hash of the function."""
    found = all_tasks(spark)
    one_each = found.groupBy("seed_name").agg(F.min(F.struct("task_id", F.struct(*found.columns).alias("t"))).alias("x"))
    n = one_each.count()
    files = one_each.select(F.pmod(F.xxhash64("seed_name"), F.lit(max(1, n // 3))).alias("file"), F.col("x.task_id").alias("task_id"), "x.t")
    place = F.row_number().over(Window.partitionBy("file").orderBy("task_id")) - 1
    parts = files.withColumn("place", place).groupBy("file", F.floor(F.col("place") / 4).alias("part")).agg(F.array_sort(F.collect_list(F.struct("task_id", "t"))).alias("parts"))

    def one(row: dict) -> Iterator[dict]:
        if task := tasks.realised([p["t"] for p in row["parts"]], [0], f"file_{row['file']}_{row['part']}"):
            yield tasks.annotated(task)

    return tasks.each(parts.where(F.size("parts") > 1), one, tasks.TASK)


def hinted_demos(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(row: dict) -> Iterator[dict]:
        if demo := tasks.hinted_demo(row):
            yield demo

    return tasks.each(kept_table(file_tasks(spark, sf_dir)), one, tasks.TRAJECTORY)


def array_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every function of the workload library over each user's values and event types, in time order, as JSON."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    of = F.array_sort(F.collect_list(F.struct("ts", "event_id", (F.floor("value").cast("long") % 50 - 20).alias("x"), "event_type"))).alias("e")
    # A stated number of partitions: the functions cost far more than the bytes by which partitions would be put together.
    users = events.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "user_id").groupBy("user_id").agg(of)
    inputs = users.select(
        "user_id",
        F.expr("transform(e, v -> v.x)").alias("xs"),
        F.expr("transform(e, v -> v.x + 1)").alias("ys"),
        F.expr("transform(e, v -> v.event_type)").alias("ts"),
        F.expr("array('view', 'error')").alias("us"),
        F.expr("transform(e, v -> struct(v.x as a, v.event_id % 7 as b))").alias("ps"),
        F.expr("transform(e, v -> struct(v.event_id % 7 - 3 as a, v.x as b))").alias("qs"),
        F.expr("transform(filter(e, v -> v.x > 0), v -> struct(v.event_type as k, v.x as v))").alias("ns"),
        F.expr("array(struct('view' as k, 'seen' as v), struct('error' as k, 'failed' as v))").alias("ds"),
        F.expr("transform(sequence(0, cast((size(e) - 1) / 3 as int)), i -> slice(transform(e, v -> v.x), i * 3 + 1, 3))").alias("rows"),
        F.lit("view").alias("s"),
        F.lit("weiv").alias("s2"),
        F.lit(3).cast("long").alias("k"),
        F.lit(-5).cast("long").alias("lo"),
        F.lit(15).cast("long").alias("hi"),
    )
    # Several functions share an expression, which is computed once; as columns of a projection they stay apart from the generator.
    library = sorted({**arrays.LIBRARY, **keyed.LIBRARY}.items())
    column = {x: f"f{k}" for k, x in enumerate(dict.fromkeys(x for _, x in library))}
    values = inputs.select("user_id", *(F.to_json(F.struct(F.expr(x).alias("value"))).alias(c) for x, c in column.items()))
    return values.select("user_id", F.inline(F.array(*(F.struct(F.lit(n).alias("function"), F.col(column[x]).alias("result")) for n, x in library))))


QUERIES = {"q_fn_library": array_library}

#: Read no given table but snippets and the interpreter's own library, so they are no part of the catalogue.
DEMONSTRATIONS = {
    "q_mine_stdlib": mine_stdlib,
    "q_mining_funnel": mining_funnel,
    "q_accepted": accepted,
    "q_type_histogram": type_histogram,
    "q_applicable": applicable,
    "q_algorithmic": algorithmic,
    "q_propose": propose,
    "q_sandbox_eval": sandbox_eval,
    "q_bfs_expand": bfs_expand,
    "q_renames": renames,
    "q_mutations": mutations,
    "q_spec_guesses": spec_guesses,
    "q_name_facts": name_facts,
    "q_tasks": made_tasks,
    "q_replay": replay,
    "q_search": search,
    "q_relearned": relearned,
    "q_file_tasks": file_tasks,
    "q_hinted_demos": hinted_demos,
}
