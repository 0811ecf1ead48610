"""Rollout queries, byte tokens and sinks against plain Python; the SQL twins share the queries' text, these don't."""

import hashlib
import json

import duckdb
import numpy as np
import pytest
from pyspark.errors import SparkRuntimeException

from emberline import plans
from emberline.functions.tokens import byte_ids, byte_text, encoded_by
from emberline.plans import rollouts
from emberline.sources.files import append_episodes, read_jsonl, write_jsonl

SF = "/root/testdata/sf0.001"


def rows(table, columns):
    return duckdb.sql(f"select {columns} from '{SF}/{table}.parquet'").fetchall()


def log_softmax(x):
    x = np.asarray(x, dtype=np.float64)
    return x - x.max() - np.log(np.exp(x - x.max()).sum())


def test_reverse_kl_is_exact_over_the_vocabulary(spark):
    logits = dict(rows("embeddings", "vec_id, embedding"))
    want = {}
    for i, x in logits.items():
        if i + 1 in logits:
            s, t = (log_softmax(np.asarray(v, dtype=np.float64) / rollouts.TEMPERATURE) for v in (x, logits[i + 1]))
            want[i] = float((np.exp(s) * (s - t)).sum())
    got = {r.vec_id: r.kl for r in plans.QUERIES["q_reverse_kl"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in want)


def test_action_loss_leaves_masked_places_out(spark):
    seen = [(log_softmax(x)[i * 7 % len(x)], int(np.argmax(x)) == i * 7 % len(x)) for i, x in rows("embeddings", "vec_id, embedding") if i % 5]
    got = plans.QUERIES["q_action_loss"](spark, SF).first()
    assert got.n == len(seen)
    assert abs(got.loss + np.mean([v for v, _ in seen])) < 2e-6 and abs(got.accuracy - np.mean([h for _, h in seen])) < 2e-6


def test_cache_split_takes_whole_documents_until_there_are_enough(spark):
    draw = lambda i: int(hashlib.sha1(f"cache|{i}".encode()).hexdigest()[:15], 16)
    docs = sorted((draw(i), i, len(t) + 1) for i, t in rows("documents", "doc_id, text"))
    n = max(1, int(len(docs) * rollouts.VAL_FRAC))
    while n < len(docs) - 1 and sum(x for _, _, x in docs[:n]) < rollouts.LEAST_VAL:
        n += 1
    want = {}
    for side, part in (("val", docs[:n]), ("train", docs[n:])):
        at = 0
        for _, i, x in part:
            want[i] = (side, at, x)
            at += x
    assert {r.doc_id: (r.side, r.start, r.n) for r in plans.QUERIES["q_token_cache_split"](spark, SF).collect()} == want


def test_selected_turns_are_problematic_and_leave_room(spark):
    got = plans.QUERIES["q_turn_selection"](spark, SF).collect()
    assert got and all(r.room == rollouts.MAX_SEQ - r.n_response - 1 >= rollouts.LEAST_PROMPT and r.n_response % 9 for r in got)


def test_a_record_without_task_is_an_error(spark, tmp_path):
    for t in ("events", "customer"):
        spark.read.parquet(f"{SF}/{t}.parquet").where("true" if t == "events" else "c_custkey <> 3").write.parquet(f"{tmp_path}/{t}.parquet")
    with pytest.raises(SparkRuntimeException, match="no task 3"):
        plans.QUERIES["q_task_diagnostics"](spark, str(tmp_path)).collect()


TEXTS = ["", "plain", "zwölf 😀 \u0000\n\t漢字", "<bos>", None, "x" * 200_000]


def test_byte_tokens_round_trip(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    got = df.withColumn("ids", byte_ids("text", begin=True, end=True)).withColumn("bare", byte_ids("text")).withColumn("back", byte_text("ids")).withColumn("same", byte_text("bare")).orderBy("id").collect()
    for r, t in zip(got, TEXTS, strict=True):
        if t is None:
            assert (r.ids, r.bare, r.back, r.same) == (None,) * 4
        else:
            assert r.bare == [b + 3 for b in t.encode()] and r.ids == [1, *r.bare, 2]
            assert r.same == t and r.back == f"<bos>{t}<eos>"


def test_any_tokenizer_in_batches(spark):
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(TEXTS)], "id int, text string, ids string")
    got = encoded_by(df, "text", lambda: lambda ts: [[len(t), *t.encode()[:2]] for t in ts], begin=7, end=8).orderBy("id").collect()
    assert [r.ids for r in got] == [None if t is None else [7, len(t), *t.encode()[:2], 8] for t in TEXTS]
    assert [r.text for r in got] == TEXTS
    assert encoded_by(df.where("false"), "text", lambda: lambda ts: []).count() == 0


def test_json_lines_count_and_append(spark, tmp_path):
    path, steps = str(tmp_path / "out"), "array<struct<status:string,ratio:double>>"
    assert write_jsonl(spark.range(7).toDF("a"), path) == 7
    assert write_jsonl(spark.range(0).toDF("a"), path) == 0 and write_jsonl(spark.range(3).toDF("a"), path, "append") == 3
    assert read_jsonl(spark, path, "a long").count() == 3
    eps = spark.createDataFrame([("search", 0, [("ok", 0.5)]), ("search", 0, [("ok", 1.2)]), ("programmatic", 2, []), ("other", None, None), (None, 0, [("bad", None)])], f"method string, n_invalid int, steps {steps}")
    log = str(tmp_path / "log")
    for _ in range(2):
        assert append_episodes(eps, log) == {"rows": 5, "with_failure": 2, "programmatic": 1, "search": 2}
    assert append_episodes(eps.where("false"), log) == {"rows": 0, "with_failure": 0, "programmatic": 0, "search": 0}
    assert spark.read.json(log).count() == 10 and all(json.loads(r.value) for r in spark.read.text(log).collect())
