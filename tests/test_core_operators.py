"""Relational operators on small known cases."""

import collections

import pytest
from pyspark.sql import functions as F

from puzzlemill.operators import checkpoints, metrics, preferences, records, rollouts, sampling


def test_balanced_sample(spark):
    df = spark.createDataFrame([(f"r{i}", f"b{i % 3}") for i in range(12)], "id string, bucket_key string")
    got = sampling.balanced_sample(df, 6, 5).collect()
    assert set(collections.Counter(r.bucket_key for r in got).values()) == {2}
    assert sorted(got) == sorted(sampling.balanced_sample(df.orderBy(F.desc("id")).repartition(5), 6, 5).collect())
    skew = spark.createDataFrame([(f"r{i}", "a" if i else "b") for i in range(9)], "id string, bucket_key string")
    assert collections.Counter(r.bucket_key for r in sampling.balanced_sample(skew, 5, 1).collect()) == {"a": 4, "b": 1}
    exact = sampling.exact_sample(df, 6, 5)
    assert set(collections.Counter(r.bucket_key for r in exact.collect()).values()) == {2}
    with pytest.raises(ValueError):
        sampling.exact_sample(df, 13, 5)


def test_splits_and_leaks(spark):
    df = spark.createDataFrame([(f"r{i}", f"b{i % 3}") for i in range(30)], "id string, bucket_key string")
    train, val, ev = (x.select("id") for x in sampling.three_way_split(df, 9, 3, 42))
    assert (train.count(), val.count(), ev.count()) == (21, 9, 3)
    assert sampling.leaked(train, val).isEmpty() and ev.join(val, "id", "left_anti").isEmpty()
    assert sampling.same_ids(df, train.union(val)) and not sampling.same_ids(df, train)
    with pytest.raises(ValueError, match="unknown"):
        sampling.exclude(df, spark.createDataFrame([("nope",)], "id string"))
    with pytest.raises(ValueError, match="twice"):
        sampling.exclude(df, spark.createDataFrame([("r1",), ("r1",)], "id string"))


def test_rollouts(spark):
    src = spark.createDataFrame([("a", 0), ("b", 1)], "id string, source_index long")
    got = [(r.id, r.rollout_index, r.position) for r in rollouts.expand(src, 2).orderBy("position").collect()]
    assert got == [("a", 0, 0), ("a", 1, 1), ("b", 0, 2), ("b", 1, 3)]
    got = [(r.id, r.generation_route, r.position) for r in rollouts.expand_routes(src, ["x", "y"], 1).orderBy("position").collect()]
    assert got == [("a", "x", 0), ("a", "y", 1), ("b", "x", 2), ("b", "y", 3)]


def test_acceptance(spark):
    rows = [("a", 0, "one", True), ("a", 1, "two ", True), ("a", 2, "one\r", True), ("a", 3, "bad", False), ("a", 4, "three", True)]
    ok, bad = rollouts.accept_rollouts(spark.createDataFrame(rows, "id string, position long, response string, ok boolean"))
    assert [r.position for r in ok.orderBy("position").collect()] == [0, 1] and [r.position for r in bad.collect()] == [3]


def test_prefix(spark):
    df = spark.createDataFrame([(i, i % 2 == 0) for i in range(10)], "position long, ok boolean")
    assert rollouts.cut_at_target(df, 3).count() == 5
    assert rollouts.cut_at_target(df, 50).count() == 10
    src = spark.createDataFrame([(f"r{i}", i) for i in range(5)], "id string, source_index long")
    report = lambda ids: rollouts.prefix_report(spark.createDataFrame([(x,) for x in ids], "id string"), src).first().is_prefix
    assert report(["r0", "r1"]) and not report(["r0", "r2"]) and not report(["r0", "r0"]) and not report(["zz"]) and report([])
    assert rollouts.unprocessed(src, src.limit(2)).count() == 3


def test_merge_demands_completeness(spark):
    asked = spark.createDataFrame([(0, "a"), (1, "b")], "position long, id string")
    reply = lambda ps: spark.createDataFrame([(p, "t") for p in ps], "position long, text string")
    assert rollouts.merge_responses(asked, reply([0, 1])).count() == 2
    for ps in ([0], [0, 1, 2], [0, 1, 1]):
        with pytest.raises(Exception, match="request|response"):
            rollouts.merge_responses(asked, reply(ps)).collect()


def test_quotas_and_budgets():
    assert list(preferences.category_quotas(6000).values()) == [4200, 900, 600, 180, 120]
    assert sum(preferences.category_quotas(7).values()) == 7
    assert preferences.route_budgets({"a": 0.5, "b": 0.5, "c": 0}, 5, 10) == {"a": 2, "b": 3}
    assert preferences.route_budgets({"a": 0.9, "b": 0.1}, 10, 6) == {"a": 6, "b": 4}
    assert preferences.route_budgets({"a": 1.0}, 10, 6) == {"a": 6}


def candidates(spark):
    rows = [(f"s{i}", i, f"s{i}:{r}", r, "wrong_value" if i < 6 else "truncated", 2 * i + k) for i in range(8) for k, r in enumerate(preferences.ROUTES)]
    return spark.createDataFrame(rows, "source_id string, source_index long, candidate_id string, generation_route string, rejected_category string, arrival long")


def test_pairs(spark):
    c = candidates(spark)
    chosen = spark.createDataFrame([(f"s{i}",) for i in range(8)], "id string")
    got = preferences.select_pairs(c, chosen, 4, 42).collect()
    assert len(got) == 4 and collections.Counter(r.generation_route for r in got[:4])["forced_wrong"] in (1, 2, 3)
    only = preferences.select_pairs(c.where("rejected_category = 'wrong_value'"), chosen, 4, 42, unique_source=True).collect()
    assert len({r.source_id for r in only}) == 4
    v1 = preferences.select_pairs_v1(c, 14, 0.1).orderBy("arrival").collect()
    assert collections.Counter(r.rejected_category for r in v1) == {"wrong_value": 12, "truncated": 1}
    assert v1[0].id == "s0-dpo-0"
    report = preferences.pair_report(preferences.select_pairs_v1(c, 14, 0.1), 14, 0.5).first()
    assert (report.num_pairs, report.pair_shortfall, report.wrong_value_shortfall) == (13, 1, 0)


def rollout_rows(spark, rewards):
    rows = [(i, float(r), 10 + i, i == 0, r >= 1.2, r >= 0.2, "x" if i % 2 else "") for i, r in enumerate(rewards)]
    return spark.createDataFrame(rows, "position long, reward double, response_length long, truncated boolean, answer_correct boolean, format_ok boolean, bucket string")


def test_rollout_metrics(spark):
    m = metrics.rollout_metrics(rollout_rows(spark, [1.2, 1.2, 0.2, 0, 0, 0, 0, 0]), 4).first()
    assert m.reward_std == pytest.approx(0.5092887197) and m.group_reward_std == pytest.approx(0.2772634127)
    assert (m.frac_reward_zero_std, m.all_wrong_group_fraction, m.all_correct_group_fraction) == (0.5, 0.5, 0.0)
    s = metrics.group_summary(rollout_rows(spark, [0, 1, 1, 1, 0.5]), 2).first()
    assert (s.reward_std, s.group_reward_std, s.frac_reward_zero_std) == pytest.approx((0.4, 0.25, 0.5))
    assert metrics.rollout_metrics(rollout_rows(spark, [0.2] * 3), 3).first().frac_reward_zero_std == 1
    empty = metrics.rollout_metrics(rollout_rows(spark, [1]).limit(0), 4).first()
    assert empty["count"] == 0 and empty.reward == 0
    b = metrics.bucket_metrics(rollout_rows(spark, [0, 1.2, 0, 0])).collect()
    assert [(r.bucket, r.accuracy) for r in b] == [("x", 0.5)]
    wide = metrics.wide_bucket_metrics(rollout_rows(spark, [0, 1.2, 0, 0]), ["x"]).first()
    assert wide["bucket/x/reward"] == pytest.approx(0.6)


def test_advantages(spark):
    got = [r.advantage for r in metrics.group_advantages(rollout_rows(spark, [0, 2, 1, 1, 5]), 2, 0.9).orderBy("position").collect()]
    assert got == [-0.9, 0.9, 0.0, 0.0, 0.0]


def test_eval_summary(spark):
    schema = "correct boolean, format_ok boolean, valid_expression boolean, generated_tokens long, truncated boolean"
    two = metrics.eval_summary(spark.createDataFrame([(True, True, True, 10, False), (False, True, False, 30, True)], schema)).first()
    assert tuple(two) == (2, 0.5, 1.0, 0.5, 20.0, 30, 1, 0.5)
    assert tuple(metrics.eval_summary(spark.createDataFrame([], schema)).first()) == (0, 0, 0, 0, 0, 0, 0, 0)
    assert metrics.prefixed(two_columns(spark), "eval").columns == ["eval/a"]


def two_columns(spark):
    return spark.createDataFrame([(1.0, True, "x")], "a double, b boolean, c string")


def test_checkpoints(spark):
    ledger = spark.createDataFrame([(10, 0.5, 0.9), (20, 0.7, 0.1), (30, 0.7, 0.2), (40, 0.7, 0.2)], "step long, accuracy double, format_rate double")
    best = checkpoints.best_checkpoint(ledger).first()
    assert (best.step, best.final_step) == (30, 40)
    assert {r.step for r in checkpoints.retained(ledger).collect()} == {30, 40}
    names = spark.createDataFrame([("step_9",), ("step_10",), ("final",)], "name string")
    assert checkpoints.latest_checkpoint(names).first()[0] == "step_10"
    assert checkpoints.match_steps(ledger.select("step"), ledger.select("step")).count() == 4
    with pytest.raises(Exception, match="without"):
        checkpoints.match_steps(ledger.select("step"), ledger.select("step").limit(2)).collect()
    cells = checkpoints.evaluation_matrix(spark.createDataFrame([("m",)], "model string"), spark.createDataFrame([("d",), ("e",)], "dataset string"), spark.createDataFrame([("m", "d", 0.5)], "model string, dataset string, accuracy double"))
    assert {(r.dataset, r.status) for r in cells.collect()} == {("d", "complete"), ("e", "failed")}


def test_records(spark):
    raw = spark.createDataFrame([(1, "[2, 3]", 5), (2, "[1, 1]", 9)], "source_index long, nums string, target long")
    solved = records.solve(records.normalize(raw, "train", "source_index"))
    assert records.unsolved_records(solved).first().id == "train-000002"
    src = records.source_records(solved)
    assert src.first().gold_expr == "(2+3)" and records.source_violations(src).first().violations == []
    forged = records.source_violations(src.withColumn("prompt", F.lit("x")).withColumn("target", F.lit(6).cast("long")))
    assert set(forged.first().violations) == {"prompt", "gold_expr"}
    nested = records.training_record(src).first()
    assert nested.prompt[0].role == "user" and nested.reward_model.ground_truth.numbers == [2, 3]
    assert records.training_violations(records.training_record(src)).first().violations == []
    sft = records.validated(src.withColumn("response", F.lit("<answer>2+3</answer>"))).withColumn("provenance", F.lit("{}"))
    assert records.sft_violations(sft).first().violations == []
    assert records.source_columns(sft).columns == src.columns
    pair = spark.createDataFrame([("p", "a", "a", "wrong_value", "nowhere")], "prompt string, chosen string, rejected string, rejected_category string, generation_route string")
    assert records.pair_violations(pair).first().violations == ["different", "generation_route"]
    assert records.violation_report(records.pair_violations(pair)).count() == 2


def test_masks(spark):
    df = spark.createDataFrame([([1, 2], [1, 2, 3, 4])], "prompt_ids array<long>, full_ids array<long>")
    r = records.supervised_masks(df, 6, 0).first()
    assert (r.input_ids, r.labels, r.attention_mask) == ([1, 2, 3, 4, 0, 0], [-100, -100, 3, 4, -100, -100], [1, 1, 1, 1, 0, 0])
    assert records.supervised_masks(df, 3, 0).first().labels == [-100, -100, 3]
    with pytest.raises(Exception, match="prefix"):
        records.supervised_masks(spark.createDataFrame([([9], [1, 2])], df.schema), 6, 0).collect()
    ids = spark.createDataFrame([([1, 2, 3], [4, 5, 6]), ([], [1]), ([1], [])], "prompt_ids array<long>, completion_ids array<long>")
    assert [tuple(r) for r in records.policy_ids(ids, 2, 1).collect()] == [([2, 3], [4])]
