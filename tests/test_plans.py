"""Sources, sinks, lineage, graphs, streaming, registered queries."""

import json
import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from puzzlemill import streaming
from puzzlemill.operators import evaluation, records
from puzzlemill.plans import lineage
from puzzlemill.plans.graph import Graph, Stage
from puzzlemill.sources import generation, readers, writers


def test_graph():
    g = Graph([Stage("c", ("b",)), Stage("a"), Stage("b", ("a",)), Stage("d", ("a",))])
    assert g.order() == ["a", "b", "c", "d"] and g.closure(["c"]) == ["a", "b", "c"] and g.window("b", "c") == ["b", "c"]
    for bad in ([Stage("a"), Stage("a")], [Stage("a", ("x",))], [Stage("a", ("b",)), Stage("b", ("a",))]):
        with pytest.raises(ValueError):
            Graph(bad)
    ran = []
    g.run(["a", "b"], {"a": "complete", "b": "missing"}.get, ran.append)
    assert ran == ["b"] and g.events == [("a", "skipped"), ("b", "ran")]
    with pytest.raises(RuntimeError):
        g.run(["a"], lambda n: "stale", ran.append)
    g.run(["a"], lambda n: "stale", ran.append, rebuild=["a"])
    assert ran[-1] == "a"


def test_lineage(tmp_path):
    out = tmp_path / "out.txt"
    out.write_text("x")
    m = lineage.write_manifest(tmp_path / "m.json", "s", {"k": 1}, {"o": out})
    check = lambda c=1: lineage.status(tmp_path / "m.json", {"k": c})
    assert check() == "complete" and check(2) == "stale" and lineage.status(tmp_path / "none", {}) == "missing"
    assert lineage.artifact_id({**m, "created_at": "later"}) == m["artifact_id"]
    out.write_text("y")
    assert check() == "stale"
    (tmp_path / "m.json").write_text(json.dumps({**m, "stage": "forged"}))
    assert check() == "failed"
    with pytest.raises(ValueError):
        lineage.safe_path(tmp_path, "../x")
    assert lineage.utc_text(datetime(2024, 1, 1, tzinfo=timezone.utc)) == "2024-01-01T00:00:00Z"
    with pytest.raises(RuntimeError), lineage.unchanged(out):
        out.write_text("z")
    with lineage.output_lock(tmp_path / "lock"), pytest.raises(RuntimeError), lineage.output_lock(tmp_path / "lock"):
        pass
    assert not (tmp_path / "lock").exists()


def test_json(spark, tmp_path):
    assert writers.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    (tmp_path / "a.json").write_text('[{"id": 1, "nums": [1, 2], "target": 3}]')
    assert readers.json_document(spark, str(tmp_path / "a.json"), "id long, nums array<long>, target long").first().nums == [1, 2]
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n\n{"x": "no"\n')
    with pytest.raises(Exception, match="(?i)malformed|corrupt|failfast"):
        readers.json_lines(spark, str(tmp_path / "b.jsonl"), "x long").collect()
    loose = readers.json_lines(spark, str(tmp_path / "b.jsonl"), "x long", strict=False).cache()
    assert loose.where("_corrupt_record is not null").count() == 1
    (tmp_path / "d").mkdir()
    (tmp_path / "d/step_3.jsonl").write_text('{"x": 1}\n')
    assert readers.step_files(spark, str(tmp_path / "d"), "x long").first().step == 3
    (tmp_path / "global_step_5").mkdir()
    assert [s for s, _ in readers.step_directories(tmp_path)] == [5]


def test_publish(spark, tmp_path):
    df = spark.range(5).toDF("x")
    read = lambda name: spark.read.schema("x long").json(writers.current(spark, tmp_path / name)).count()
    assert writers.publish(df, tmp_path / "t") == 5 and read("t") == 5
    old = writers.current(spark, tmp_path / "t")
    assert writers.publish(df.limit(2), tmp_path / "t") == 2 and read("t") == 2
    assert spark.read.schema("x long").json(old).count() == 5  # for readers that have begun
    assert writers.publish(df.limit(1), tmp_path / "t") == 1 and len(list((tmp_path / "t").glob("v-*"))) == 2
    assert writers.publish_parquet(df, tmp_path / "p", 5) == 5
    with pytest.raises(ValueError):
        writers.publish_parquet(df, tmp_path / "q", 6)
    writers.append_log(df, tmp_path / "log")
    writers.append_log(df, tmp_path / "log")
    assert spark.read.json(str(tmp_path / "log")).count() == 10
    assert readers.parquet_rows(spark, writers.current(spark, tmp_path / "p"), 2, "x").count() == 3


def test_publish_set_revokes_first(spark, tmp_path):
    df = spark.range(3).toDF("x")
    folder = tmp_path / "set"
    done = writers.publish_set({"all": df, "none": df.limit(0)}, folder, {"stage": "s"}, aliases={"every": "all"})
    assert done["counts"] == {"all": 3, "none": 0, "every": 3} and writers.published_set(spark, folder) == done
    assert spark.read.schema("x long").json(writers.current(spark, folder / "every")).count() == 3
    broken = spark.range(1).selectExpr("raise_error('stop') AS x")
    with pytest.raises(Exception, match="stop"):
        writers.publish_set({"all": broken}, folder, {"stage": "s"})
    with pytest.raises(FileNotFoundError):
        writers.published_set(spark, folder)


def test_ledger(spark, tmp_path):
    path = tmp_path / "l/ledger.jsonl"
    writers.extend_ledger(spark, path, [{"step": 1, "metrics": {"accuracy": 0.5, "format_rate": 1.0}}])
    assert len(writers.extend_ledger(spark, path, [{"step": 2, "metrics": {"accuracy": 0.25, "format_rate": 0.5}}])) == 2
    with pytest.raises(ValueError):
        writers.extend_ledger(spark, path, [{"step": 2}])
    assert [tuple(r) for r in readers.eval_ledger(spark, str(path)).orderBy("step").collect()] == [(1, 0.5, 1.0), (2, 0.25, 0.5)]


def test_positions_and_line_numbers(spark, tmp_path):
    df = spark.range(0, 1000, 1, 7).toDF("x")
    assert all(r.source_index == r.x + 1 for r in readers.numbered(df).collect())
    path = tmp_path / "lines.jsonl"
    path.write_text("".join(f'{{"x": {k}}}\n' if k != 700 else "[1]\n" for k in range(1, 2001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        lines = readers.text_lines(spark, str(path))
        assert lines.rdd.getNumPartitions() > 3
        assert {r.line for r in lines.where("value like '%: 1234}'").collect()} == {1234}
        assert [(r.line, r.value) for r in readers.bad_lines(spark, str(path), "x long").collect()] == [(700, "[1]")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole = lambda rows: rows.withColumn("violations", F.when(F.col("x") < 3, F.array()).otherwise(F.array(F.lit("large"))).cast("array<string>"))
    with pytest.raises(ValueError, match=":700: not an object"):
        readers.json_lines_checked(spark, str(path), "x long", whole)
    path.write_text('{"x": 1}\n\n{"x": 2}\n{"x": 3}\n')
    with pytest.raises(ValueError, match=":4: large"):
        readers.json_lines_checked(spark, str(path), "x long", whole)
    assert readers.json_lines_checked(spark, str(path), "x long", lambda r: r.withColumn("violations", F.array().cast("array<string>"))).count() == 3


def teacher_rows(spark, folder):
    """Four files of three rows; two of each are right."""
    schema = "id string, source_index long, numbers array<long>, target long, response string"
    for i in range(4):
        rows = [(f"r{i}{j}", 3 * i + j, [1, 2], 3, "<answer>1+2</answer>" if j else "none") for j in range(3)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return schema


def test_stream_accumulates_exactly_the_target(spark, tmp_path):
    schema = teacher_rows(spark, tmp_path / "in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    respond = lambda b: records.validated(b).withColumn("ok", F.col("validation.ok"))
    out = str(tmp_path / "out")
    go = lambda contract: streaming.accumulate(stream, respond, out, 3, str(tmp_path / "cp"), contract, operational=("host",)).awaitTermination()
    go({"seed": 1, "host": "a"})
    assert streaming.accepted(spark, out).count() == 3 and streaming.status(spark, out, 3) == "complete"
    # the second batch ends with the row that completes the target
    assert streaming.accepted(spark, out, ok=False).count() == 2 and sorted(streaming.commits(spark, out)) == [0, 1]
    go({"seed": 1, "host": "b"})
    assert streaming.accepted(spark, out).count() == 3
    with pytest.raises(ValueError):
        go({"seed": 2})
    # without its marker a batch does not exist
    (tmp_path / "out/commits/1.json").unlink()
    assert streaming.accepted(spark, out).count() == 2


def test_stream_stops_within_one_large_batch(spark, tmp_path):
    schema = teacher_rows(spark, tmp_path / "in")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    respond = lambda b: records.validated(b).withColumn("ok", F.col("validation.ok"))
    streaming.accumulate(stream, respond, str(tmp_path / "out"), 3, str(tmp_path / "cp"), {}).awaitTermination()
    assert sorted(r.source_index for r in streaming.accepted(spark, str(tmp_path / "out")).collect()) == [1, 2, 4]


def test_adopted_rows_are_validated_again(spark, tmp_path):
    schema = teacher_rows(spark, tmp_path / "in")
    old = spark.read.schema(schema).parquet(str(tmp_path / "in")).withColumn("ok", F.lit(True))
    streaming.adopt(old, str(tmp_path / "out"), 100)
    assert streaming.accepted(spark, str(tmp_path / "out")).count() == 8 and streaming.status(spark, str(tmp_path / "out"), 100) == "open"
    with pytest.raises(ValueError):
        streaming.adopt(old, str(tmp_path / "out"), 100)


def test_evaluation_is_published_with_its_ledger(spark, tmp_path):
    rows = spark.createDataFrame([("a", "p", [1, 2], 3), ("b", "p", [1, 2], 4)], "id string, prompt string, numbers array<long>, target long")
    respond = lambda r: r.withColumn("response", F.lit("<answer>1+2</answer>")).withColumn("generated_tokens", F.lit(5).cast("long")).withColumn("finish_reason", F.lit("stop"))
    samples = evaluation.evaluate(rows, respond, 10)
    told = evaluation.publish_evaluation(samples, str(tmp_path / "e"), 7)
    assert told["count"] == 2 and told["accuracy"] == 0.5
    assert [tuple(r) for r in readers.eval_ledger(spark, str(tmp_path / "e/ledger.jsonl")).collect()] == [(7, 0.5, 1.0)]
    with pytest.raises(ValueError):
        evaluation.publish_evaluation(samples, str(tmp_path / "e"), 7)
    with pytest.raises(ValueError):
        evaluation.evaluate(rows.unionByName(rows), respond, 10)


def test_engines_have_deadlines(spark):
    requests = spark.createDataFrame([(k, f"p{k}") for k in range(7)], "position long, prompt string").repartition(2)
    echo = lambda: lambda prompts: [{"text": p.upper(), "finish_reason": "stop", "token_count": 1} for p in prompts]
    assert {(r.position, r.text) for r in generation.generate(requests, echo, 3, 30).collect()} == {(k, f"P{k}") for k in range(7)}

    def slow():
        import time

        return lambda prompts: time.sleep(3)

    with pytest.raises(Exception, match="no answer within"):
        generation.generate(requests.limit(1), slow, 1, 0.2).collect()


def test_manifest_checks(tmp_path, spark):
    out = tmp_path / "out.txt"
    out.write_text("x")
    with pytest.raises(ValueError, match="train_input"):
        lineage.write_manifest(tmp_path / "m.json", "s", {}, {"o": out}, counts={"train_input": 3, "solvable_train": 1, "unsolved_train": 1})
    m = lineage.write_manifest(tmp_path / "m.json", "s", {}, {"o": out}, counts={"accepted_count": 2, "target_accepted_count": 2, "o": 1}, schemas={"o": "x long"})
    assert lineage.manifest_violations(m, "s", {"o": 1}, {"o": "x long"}) == []
    assert len(lineage.manifest_violations(m, "t", {"o": 2}, {"o": "y long"})) == 3
    out.write_text("xy")
    assert lineage.manifest_violations(m) == ["o has another size"]
    unfinished = {**m, "completed": False}
    unfinished["artifact_id"] = lineage.artifact_id(unfinished)
    (tmp_path / "m.json").write_text(json.dumps(unfinished))
    assert lineage.status(tmp_path / "m.json", {}) == "stale"
    lineage.revoke_manifest(tmp_path / "m.json")
    assert lineage.status(tmp_path / "m.json", {}) == "missing"
    v1 = lineage.v1_manifest(tmp_path / "run/manifest.json", {"counts": {"a": 1}}, datetime(2024, 1, 1, tzinfo=timezone.utc))
    assert (v1["name"], v1["stage"], v1["manifest_version"], v1["created_at"]) == ("run", "run", 1, "2024-01-01T00:00:00+00:00")
    tick = lineage.increasing_clock(lambda: datetime(2024, 1, 1, tzinfo=timezone.utc))
    assert [tick(), tick()] == ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00.000001Z"]
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "a long, b string")
    assert lineage.table_digest(a) == lineage.table_digest(a.orderBy(F.desc("a")).repartition(3).select("b", "a"))
    assert lineage.table_digest(a)["digest"] != lineage.table_digest(a.distinct())["digest"]


def test_locks_of_dead_processes(tmp_path):
    path = tmp_path / "lock"
    path.write_text(json.dumps({"pid": 2**22 + 1, "host": os.uname().nodename, "token": "old"}))
    with lineage.output_lock(path):
        assert json.loads(path.read_text())["pid"] == os.getpid()
        path.write_text(json.dumps({"pid": os.getpid(), "host": os.uname().nodename, "token": "of another"}))
    assert path.exists()  # whoever has taken it keeps it
    path.write_text(json.dumps({"pid": 1, "host": "elsewhere", "token": "t"}))
    with pytest.raises(RuntimeError, match="another host"), lineage.output_lock(path):
        pass
    assert sorted(p.name for p in tmp_path.iterdir()) == ["lock"]


def test_registered_queries_have_sql_with_the_same_columns():
    from puzzlemill.plans import queries, record_queries  # noqa: F401

    assert set(queries.ORACLE_SQL) == set(queries.QUERIES)
    assert len(queries.QUERIES) >= 70


def order_lines(spark, folder):
    """A small table of order lines; its orders make a puzzle each, of every kind and size."""
    rows = [(k, float(1 + (k * 7 + i * 5) % 9)) for k in range(48) for i in range(5)]
    spark.createDataFrame(rows, "l_orderkey long, l_quantity double").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_schema_report_counts_every_kind(spark, tmp_path):
    from puzzlemill.plans import queries

    assert [tuple(r) for r in queries.schema_report(spark, order_lines(spark, tmp_path)).collect()] == [("gold_expr", 6)]  # kind 7 of 48


def test_solved_source_takes_every_size(spark, tmp_path):
    from puzzlemill.plans import queries

    assert tuple(queries.solved_source(spark, order_lines(spark, tmp_path)).first()) == (48, 48, 0)


def test_entry_without_corpus_operators():
    import __spark_entry__ as entry

    assert "eval_summary" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
