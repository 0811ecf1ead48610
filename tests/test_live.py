"""Bootstrap, the code corpus data source, and the episode stream."""

import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline import plans
from emberline.operators import bootstrap
from emberline.plans import episodes as batch_episodes
from emberline.plans.dialects import Spark
from emberline.sources import code_corpus
from emberline.streaming import episodes

SF = "/root/testdata/sf0.001"


def test_each_replicate_draws_as_many_clusters_as_there_are(spark):
    n = 1500
    d = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 17).cast("double").alias("t"), F.lit(1.0).alias("w"))
    out = bootstrap.replicates(d, "k", "t", "w", 300).collect()
    assert len(out) == 300 and {r.weight for r in out} == {float(n)}
    totals = np.array([r.total for r in out])
    x = np.arange(n) % 17
    # mean and variance of a sum of n draws
    assert abs(totals.mean() - x.sum()) < 5 * np.sqrt(n * x.var() / 300)
    assert 0.75 < totals.var() / (n * x.var()) < 1.3


@pytest.mark.parametrize("n", [1, 7, 150])
def test_bootstrap_interval_is_that_of_plain_draws(spark, n):
    rng = np.random.default_rng(n)
    total, weight = rng.normal(3, 2, n), rng.integers(1, 9, n).astype(float)
    d = spark.createDataFrame([(int(k), float(a), float(b)) for k, (a, b) in enumerate(zip(total, weight))], "k long, t double, w double")
    point, low, high = bootstrap.interval(d, "k", "t", "w", 2000)
    pick = rng.integers(0, n, (4000, n))
    plain = np.sort(total[pick].sum(axis=1) / weight[pick].sum(axis=1))
    assert abs(point - total.sum() / weight.sum()) < 1e-12
    spread = plain.std() * 0.25 + 1e-9
    assert abs(low - plain[100]) < spread and abs(high - plain[3899]) < spread
    assert bootstrap.interval(d.limit(0), "k", "t", "w", 10) is None


def test_code_corpus_reads_folders(spark, tmp_path):
    code_corpus.register(spark)
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    for k, t in enumerate(texts):
        folder = tmp_path / "src" / f"d{k % 7}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"m{k}.py").write_bytes(t.encode() + (b"\xff\xfe ok\r\n" if k % 5 == 0 else b""))
        (folder / f"m{k}.txt").write_text("not code")
    plain = [(str(p), p.read_text(errors="ignore")) for p in sorted((tmp_path / "src").rglob("*.py"))]
    read = lambda **o: spark.read.format("code_corpus").options(**o).load(f"file://{tmp_path}/src")
    for most in (0, 1, 13, 100):
        assert sorted(map(tuple, read(max_files=str(most), files_per_partition="7").collect())) == sorted(plain[: most or None])
    assert read(files_per_partition="7").rdd.getNumPartitions() == 9
    some = f"{tmp_path}/src/d3/"
    assert sorted(r.path for r in read().where(F.col("path").startswith(some)).collect()) == sorted(p for p, _ in plain if p.startswith(some))
    assert [r.content for r in read(max_files="20").where(F.col("path") == plain[3][0]).collect()] == [plain[3][1]]
    (tmp_path / "none").mkdir()
    assert spark.read.format("code_corpus").load(f"file://{tmp_path}/none").count() == 0


def test_code_corpus_pushes_paths_down(spark, tmp_path):
    code_corpus.register(spark)
    for k in range(30):
        (tmp_path / f"m{k:02}.py").write_text(f"x = {k}")
    d = spark.read.format("code_corpus").option("files_per_partition", "1").load(f"file://{tmp_path}")
    assert d.where(F.col("path").isin(f"{tmp_path}/m03.py", f"{tmp_path}/m07.py")).rdd.getNumPartitions() == 2
    assert [r.content for r in d.where((F.col("path") == f"{tmp_path}/m03.py") & (F.length("content") > 1)).collect()] == ["x = 3"]


@pytest.mark.parametrize("size", [7, 50, 1 << 20])
def test_code_corpus_reads_lines(spark, tmp_path, size):
    code_corpus.register(spark)
    rows = [json.dumps({"content": f"é line {k}\n" * (k % 4), "n": k}, ensure_ascii=False) if k % 3 else "  " for k in range(40)] + ['{"other": 1}']
    (tmp_path / "c.jsonl").write_text("\n".join(rows))
    plain = [json.loads(r).get("content", "") for r in rows if r.strip()]
    for most in (0, 5, 1000):
        out = spark.read.format("code_corpus").options(max_files=str(most), bytes_per_partition=str(size)).load(f"file://{tmp_path}/c.jsonl")
        assert Counter(r.content for r in out.collect()) == Counter(plain[: most or None])


def test_episode_stream_gives_the_records_of_the_batch_also_after_a_restart(spark, tmp_path):
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        steps = spark.sql(f"with {batch_episodes.steps(Spark())} select episode_id, step, kind, status, ratio from steps", events=spark.read.parquet(f"{SF}/events.parquet"))
        first = "timestamp'2024-01-01 00:00:00'"
        # steps come out of order: each file has those of one remainder of a hash, all within the time that may be late
        timed = steps.withColumn("ts", F.expr(f"{first} + make_interval(0, 0, 0, 0, 0, step)")).withColumn("file", F.pmod(F.xxhash64("episode_id", "step"), F.lit(4))).cache()
        names = ["episode_id", "step", "kind", "status", "ratio", "ts"]
        source = f"file://{tmp_path}/steps"
        out, log = f"file://{tmp_path}/out", f"file://{tmp_path}/log"

        def run():
            stream = episodes.records(spark.readStream.schema(timed.select(names).schema).option("maxFilesPerTrigger", 1).parquet(source), "30 minutes", "1 hour")
            stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()

        for k in range(4):
            timed.where(F.col("file") == k).select(names).coalesce(1).write.mode("append").parquet(source)
            if k % 2:
                run()  # a query of its own: state comes from the checkpoint
        for days in (30, 60):  # what moves the watermark
            end = spark.createDataFrame([("end", 1, "edit", "ok", 1.0)], "episode_id string, step int, kind string, status string, ratio double").withColumn("ts", F.expr(f"{first} + make_interval(0, 0, 0, {days})"))
            end.select(names).coalesce(1).write.mode("append").parquet(source)
            run()
        got = spark.read.parquet(out).where("episode_id <> 'end'")
        columns = ["episode_id", "best_ratio", "n_edits", "n_invalid", "n_correct", "stopped", "recovered", "n_improved", "last_improved"]
        want = plans.QUERIES["q_episode_records"](spark, SF)
        assert Counter(map(tuple, got.select(columns).collect())) == Counter(map(tuple, want.select(columns).collect()))
    finally:
        spark.conf.unset(store)
