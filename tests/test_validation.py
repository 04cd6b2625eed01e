"""Validation of records and configurations, and nulls where puzzles are expected."""

import random
from datetime import datetime, timezone
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from puzzlemill import schemas
from puzzlemill.functions.arithmetic import check, solve
from puzzlemill.operators import preferences, records, sampling, validation
from puzzlemill.plans import config


def every_value(values):
    """All that pairwise operations can make, by brute force."""
    if len(values) == 1:
        return set(values)
    out = set()
    for i, a in enumerate(values):
        for j, b in enumerate(values):
            if i != j:
                rest = [v for k, v in enumerate(values) if k not in (i, j)]
                for c in [a + b, a - b, a * b, *([a / b] if b else [])]:
                    out |= every_value([*rest, c])
    return out


def test_solver_against_brute_force():
    rng = random.Random(3)
    for _ in range(6):
        numbers = [rng.randint(0, 9) for _ in range(4)]
        reach = every_value([Fraction(n) for n in numbers])
        for target in range(-3, 40):
            found = solve(tuple(numbers), target)
            assert (found is not None) == (target in reach)
            assert found is None or check(found, numbers, target)[0]


def test_no_row_is_lost_to_nulls(spark):
    rows = [("a", 1, [1, 2], 3), ("b", 2, None, 3), ("c", 3, [1, None], 3), ("d", 4, [1, 2], None), ("e", 5, [1, 1], 9), ("f", 6, [3, 2**52], 2**52 + 3), ("g", 7, [], 1)]
    solved = records.solve(spark.createDataFrame(rows, "id string, source_index long, numbers array<long>, target long"))
    assert {r.id for r in solved.collect()} == set("abcdefg")
    assert {r.id: r.reason for r in records.unsolved_records(solved).collect()} == {"b": "invalid_puzzle", "c": "invalid_puzzle", "d": "invalid_puzzle", "e": "no_solution", "g": "invalid_puzzle"}
    v = records.validated(spark.createDataFrame(rows, "id string, source_index long, numbers array<long>, target long").withColumn("response", F.when(F.col("id") == "f", f"<answer>3+{2**52}</answer>").otherwise("<answer>1+2</answer>")))
    got = {r.id: (r.validation.ok, r.validation.error) for r in v.collect()}
    assert got["a"] == (True, None) and got["f"] == (True, None) and {got[k] for k in "bcd"} == {(False, "invalid_puzzle")}


def test_numbers_are_checked(spark):
    df = lambda v, kind: spark.createDataFrame([(1, v, 3)], f"at long, nums {kind}, target long")
    go = lambda v, kind: records.normalize(df(v, kind), "train", "at", strict=True).first().numbers
    assert go("[1, 2]", "string") == [1, 2] and go([1.0, 2.0], "array<double>") == [1, 2]
    for v, kind in (("[1, 2.5]", "string"), ("nothing", "string"), ([1.5], "array<double>"), ([], "array<long>"), ([1, None], "array<long>"), ([-1], "array<long>"), (None, "string")):
        with pytest.raises(Exception, match="numbers"):
            go(v, kind)


def test_schemas(spark):
    df = spark.createDataFrame([], schemas.UNSOLVED)
    assert validation.require_schema(df.select("reason", "id", "target", "numbers", "source_index"), schemas.UNSOLVED).columns == df.columns
    with pytest.raises(ValueError, match="missing: reason; type: target is string, not bigint; unknown: more"):
        validation.require_schema(df.drop("reason").withColumn("more", F.lit(1)).withColumn("target", F.lit("x")), schemas.UNSOLVED)
    deep = "long"
    for _ in range(70):
        deep = f"array<{deep}>"
    with pytest.raises(ValueError, match="nested deeper"):
        validation.require_schema(spark.createDataFrame([], f"x {deep}"), f"x {deep}")


def test_free_json(spark):
    texts = {'{"b": [1, {"a": null}], "a": "\u00e9"}': None, "[1, NaN]": "non_finite", "1e400": "non_finite", '{"a": 1, "a": 1}': "key", "{": "json", "[" * 66 + "]" * 66: "nesting", "[" * 65 + "]" * 65: None, "[" * 100_000: "nesting"}
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = {r.t: r.f for r in df.select("t", validation.json_fault("t").alias("f")).collect()}
    assert got == {**texts, None: "json"}
    assert df.where("t like '{%null%'").select(validation.canonical_value("t")).first()[0] == '{"a":"\u00e9","b":[1,{"a":null}]}'
    assert df.where("t = '{'").select(validation.canonical_value("t")).first()[0] is None


def test_teacher_sources_and_chosen(spark):
    schema = "id string, prompt string, numbers array<long>, target long, response string"
    rows = [("a", "p", [1, 2], 3, "<answer>1+2</answer>"), ("b", " ", [1, None], None, ""), ("a", "p", None, 3, "<answer>2+2</answer>"), (None, None, [1], 1, None)]
    df = spark.createDataFrame(rows, schema)
    got = sorted((str(r.id), r.violations) for r in validation.teacher_source_violations(df).collect())
    assert got == [("None", ["id", "prompt"]), ("a", ["duplicate_id"]), ("a", ["duplicate_id", "numbers"]), ("b", ["prompt", "numbers", "target"])]
    chosen = [r.violations for r in validation.chosen_violations(df).collect()]
    assert chosen.count([]) == 1 and all("correct" in v for v in chosen if v)
    with pytest.raises(ValueError, match="response"):
        validation.chosen_violations(df.drop("response"))
    assert validation.count_violations({"train_input": 2, "solvable_train": 1, "unsolved_train": 1}) == []
    assert validation.count_violations({"train_input": True}) and validation.count_violations({"target_accepted_count": 0, "accepted_count": 0})


def test_pair_records(spark):
    chosen = spark.createDataFrame([("s", "p", "good")], "id string, prompt string, response string")
    bad = spark.createDataFrame([("s", "c1", "bad"), ("s", "c2", "good"), ("s", "c3", " ")], "source_id string, candidate_id string, rejected string")
    pairs = bad.select("source_id", "candidate_id", F.lit("wrong_value").alias("rejected_category"), F.lit("high_temp").alias("generation_route"))
    one = preferences.pair_records(pairs.where("candidate_id = 'c1'"), chosen, bad).first()
    assert (one.prompt, one.chosen, one.rejected, one.provenance.candidate_id) == ("p", "good", "bad", "c1")
    for name, message in (("c2", "equal"), ("c3", "empty")):
        with pytest.raises(Exception, match=message):
            preferences.pair_records(pairs.where(F.col("candidate_id") == name), chosen, bad).collect()
    with pytest.raises(Exception, match="empty"):
        preferences.pair_records(pairs, chosen.where("id = 'x'"), bad).collect()


def test_configurations(tmp_path):
    (tmp_path / "c.yaml").write_text("a: 1\nb: [2]\n")
    c = config.load("c.yaml", tmp_path)
    assert c == {"a": 1, "b": [2]}
    config.exact_keys(c, "a", "b")
    for bad in (lambda: config.require_keys(c, "z"), lambda: config.exact_keys(c, "a")):
        with pytest.raises(ValueError):
            bad()
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(ValueError):
        config.load(tmp_path / "l.json")
    merged = config.merge_training({"train": {"weight_decay": 0.1}, "accepted_output": "x", "output_dir": "o"}, "m", "v")
    assert (merged["weight_decay"], merged["train_data"], merged["model_path"], merged["val_data"]) == (0.1, "x", "m", "v") and config.merge_training(c, "m", "v") == c
    good = {"target_pairs": 1, "forced_wrong_fraction": 0.5, "high_temp_fraction": 0.5, "forced_wrong_temperature": 1, "high_temp_temperature": 1, "top_p": 1, "max_new_tokens": 1, "batch_size": 1, "malformed_cap_fraction": 0, "preferred_wrong_value_min_fraction": 0}
    assert config.preference_violations(good) == []
    assert config.preference_violations({**good, "top_p": 0, "batch_size": 0}) == ["batch_size", "top_p"]
    assert config.preference_violations({**good, "forced_wrong_fraction": 0, "high_temp_fraction": 0}) == ["no route has a share"]
    run = {"batch_size": 1, "max_model_len": 1, "max_new_tokens": 1, "stop_after_accepted": 1, "seed": 0, "schema_version": 0, "worker_timeout_seconds": 1, "gpu_memory_utilization": 1, "temperature": 0, "top_p": 0.5, "devices": [0, 1], "topology": "dual_tp1", "enable_thinking": False, "model_path": str(tmp_path), "input_path": str(tmp_path)}
    assert config.generation_violations(run) == []
    assert config.generation_violations({**run, "devices": [1, 1], "top_p": 0, "seed": True, "enable_thinking": 0}) == ["devices", "enable_thinking", "seed", "top_p"]
    rl = {"algorithm": {"adv_estimator": "grpo", "use_kl_in_reward": False}, "actor_rollout_ref": {"actor": {"use_kl_loss": False, "ppo_mini_batch_size": 2, "ppo_micro_batch_size_per_gpu": 1}, "rollout": {"tensor_model_parallel_size": 1}, "model": {"override_config": {"attn_implementation": "flash_attention_2"}}}, "data": {"train_batch_size": 2, "validation_files": ["v"], "apply_chat_template_kwargs": {"enable_thinking": False}}, "trainer": {}}
    assert config.reinforcement_violations(rl, ["v"]) == []
    assert config.reinforcement_violations({**rl, "critic": {}, "trainer": {"max_actor_ckpt_to_keep": 1}}, ["w"]) == ["critic", "data.validation_files", "trainer.max_actor_ckpt_to_keep"]
    assert config.minimal_reinforcement_violations({"kl_coeff": 0.1, "group_size": 0}) == ["group_size", "kl_coeff"]
    assert config.run_name(" r ", datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc), "abcdef0123") == "r-20240102-030405-abcdef0"
    with pytest.raises(ValueError):
        config.run_name("r", datetime(2024, 1, 2), "a")


def test_large_balanced_samples(spark):
    """Beyond the ranked size only rows near the sample are ranked; the sample is the same."""
    df = spark.range(40_000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 100 == 0, "rare").when(F.col("id") % 3 == 0, "b").otherwise("a").alias("bucket_key"))
    got = {r.id for r in sampling.balanced_sample(df, 5000, 7).collect()}
    old, sampling.RANKED = sampling.RANKED, 10**9
    try:
        want = {r.id for r in sampling.balanced_sample(df, 5000, 7).collect()}
    finally:
        sampling.RANKED = old
    assert got == want and len(got) == 5000
    assert sampling.quotas({"a": 10, "b": 2, "c": 5}, 9) == {"a": 4, "b": 2, "c": 4}
    for size in (40_001, 5):
        with pytest.raises(Exception, match="out of range"):
            sampling.balanced_sample(df if size > 5 else df.limit(3), size, 7).collect()


def test_exact_sample_is_the_seeded_one(spark):
    """Turns shuffled first, then the buckets in order of name, then the sample."""
    rng = random.Random(5)
    pools = {"a": [f"a{k}" for k in range(6)], "b": ["b0", "b1"]}
    turns = ["a", "b"]
    rng.shuffle(turns)
    mixed = {n: list(p) for n, p in pools.items()}
    for n in ("a", "b"):
        rng.shuffle(mixed[n])
    want = mixed["a"][:3] + mixed["b"][:2]
    rng.shuffle(want)
    assert sampling.exact_ids(pools, 5, 5) == want
    rows = [(x, n, k) for k, (n, x) in enumerate((n, x) for n, p in pools.items() for x in p)]
    got = sampling.exact_sample(spark.createDataFrame(rows, "id string, bucket_key string, source_index long"), 5, 5, position="source_index")
    assert [r.id for r in got.orderBy("_place").collect()] == want
