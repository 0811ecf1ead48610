"""Sources and sinks at the edges: JSON lines, Python files, the standard library."""

from __future__ import annotations

import sysconfig
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Splits of files whose line counts may be broadcast.
BROADCAST_SPLITS = 100_000
#: One episode of a run.
STEP = "struct<step:int,action_kind:string,status:string,correct:boolean,ratio:double,improved:boolean,edited:array<string>>"
EPISODE = f"task_id string, seed_name string, families array<string>, reference_speedup double, best_ratio double, n_edits int, n_invalid int, n_correct int, stopped boolean, recovered boolean, reward double, horizon int, steps array<{STEP}>"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line long from 0, value) of the physical lines of text files, split by split: a line's number is its place in its split and the lines of the splits before it.

    Splits are cut at the same places in both passes, as both read the same files under the same settings; lines end with \\n, \\r\\n or \\r, as Python's text files read them.
    """
    split = ["_metadata.file_path", "_metadata.file_block_start"]
    lines = spark.read.text(path).select(F.col(split[0]).alias("path"), F.col(split[1]).alias("split"), "value")
    before = F.sum("n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    # a row for each split
    splits = lines.groupBy("path", "split").agg(F.count("*").alias("n")).select(F.col("path").alias("p"), F.col("split").alias("s"), before.alias("before"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task reads one split after the other, each from its start
        seen: dict[tuple[str, int], int] = {}
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            own = []
            for k in keys:
                own.append(seen.get(k, 0))
                seen[k] = own[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names=["path", "split", "value", "own"])

    placed = lines.mapInArrow(count, "path string, split long, value string, own long")
    return placed.join(F.broadcast(splits) if splits.count() <= BROADCAST_SPLITS else splits.hint("merge"), (F.col("path") == F.col("p")) & (F.col("split") == F.col("s"))).select("path", (F.col("before") + F.col("own")).alias("line"), "value")


def read_jsonl(spark: SparkSession, path: str, schema: str, limit: int = 0) -> DataFrame:
    """Rows of a JSON lines file; blank lines are skipped but count towards the limit, which is on physical lines of each file. 0: all."""
    if not limit:
        return spark.read.schema(schema).json(path)
    lines = numbered_lines(spark, path).where((F.col("line") < limit) & (F.trim("value") != ""))
    return lines.select("path", "line", F.from_json("value", schema, {"allowNonNumericNumbers": "true"}).alias("r")).orderBy("path", "line").select("r.*")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Writes rows as JSON lines and gives their number, which the writing job counts."""
    told = Observation()
    df.observe(told, F.count(F.lit(1)).alias("n")).write.mode(mode).option("ignoreNullFields", "false").json(path)
    return told.get["n"]


def append_episodes(episodes: DataFrame, path: str) -> dict[str, int]:
    """Appends episodes (method, n_invalid, steps) to what path holds: each executor writes its own and the job commits all of them or none.

    Gives the counts of rows, of rows that hold a failure (an invalid edit, or one that went well and gained nothing), and of each method.
    """
    told = Observation()
    failed = F.expr("coalesce(n_invalid > 0, false) or exists(steps, s -> coalesce(s.status = 'ok' and s.ratio >= 1.0, false))")
    methods = (F.count_if(F.col("method") == m).alias(m) for m in ("programmatic", "search"))
    seen = episodes.observe(told, F.count(F.lit(1)).alias("rows"), F.count_if(failed).alias("with_failure"), *methods)
    seen.write.mode("append").option("ignoreNullFields", "false").json(path)
    return dict(told.get)


def write_sides(df: DataFrame, path: str, side: Column, order: str, sides: list[str], counts: dict[str, Column] | None = None) -> dict[str, dict[str, int]]:
    """Writes each side's rows as JSON lines below path/side=..., in the order of `order`, in one job, which counts them as well; only the sample that cuts the ranges is a job of its own.

    Rows are dealt by ranges of the order and sorted within them, so a side's files, by name, follow the order, whatever share of rows it has. Rows of a side that isn't
    in `sides` raise. Gives for each side its rows and the given further counts of conditions.
    """
    more = {"rows": F.lit(True)} | (counts or {})
    told = Observation()
    known = df.withColumn("side", F.when(side.isin(sides), side).otherwise(F.raise_error(F.concat(F.lit("no such side: "), F.coalesce(side, F.lit("null"))))))
    sums = [F.count_if((F.col("side") == s) & c).alias(f"{s}|{n}") for s in sides for n, c in more.items()]
    # counted behind the exchange, as the sample that cuts the ranges would be counted as well
    dealt = known.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), order).observe(told, *sums).sortWithinPartitions("side", order)
    dealt.write.partitionBy("side").option("ignoreNullFields", "false").json(path)
    seen = told.get
    return {s: {n: seen[f"{s}|{n}"] for n in more} for s in sides}


def python_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of every .py file under folder; bytes that aren't UTF-8 are dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").load(folder)
    decode = F.udf(lambda b: bytes(b).decode("utf-8", errors="ignore"))
    return files.select("path", decode("content").alias("content"))


def standard_library(spark: SparkSession) -> DataFrame:
    """The running interpreter's own modules, without packages, tests and bundled tools."""
    skip = r"/(site-packages|dist-packages|test|tests|idlelib|lib2to3|turtledemo|ensurepip|__pycache__)/"
    return python_files(spark, f"file://{sysconfig.get_paths()['stdlib']}").where(~F.col("path").rlike(skip))
