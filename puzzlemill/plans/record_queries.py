"""Registered queries over records: validation with planted faults, ids and tokens, rewards, checkpoints, flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as A
from ..operators import checkpoints, evaluation, metrics, preferences, records, rollouts, sampling, validation
from .puzzles import puzzles
from .queries import BUCKETS, CANDS, LEDGER, LIST, REWARDS, ROLLS, ROUNDED, SAMPLES, SUMMARY, _bucketed, _candidates, _ledger, _rewards, _rolls, _rounded, _table, _with, query

PROMPT = f"'Using the numbers ' || {LIST} || ', create an equation that equals ' || target || '.' || chr(10) || 'Use each number exactly once. Only use +, -, *, / and parentheses.' || chr(10) || 'Do not use any other numbers. Keep the response concise.' || chr(10) || 'Finally return <answer> equation </answer>.'"


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _bucketed(spark, sf_dir).withColumnRenamed("gold", "gold_expr")
    return p.withColumn("prompt", A.solution_prompt(F.col("numbers"), F.col("target")))


# --- truncation, token ids, names, fractions ---------------------------------

FLAGS = "SELECT *, CASE l_returnflag WHEN 'R' THEN 'LENGTH' WHEN 'A' THEN 'stop' END AS reason, CASE WHEN l_quantity < 45 THEN CAST(l_quantity AS BIGINT) END AS tokens, CASE l_linestatus WHEN 'O' THEN 'eos' END AS ended FROM lineitem"


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("l_returnflag") == "R", "LENGTH").when(F.col("l_returnflag") == "A", "stop")
    tokens = F.when(F.col("l_quantity") < 45, F.col("l_quantity").cast("bigint"))
    return _table(spark, sf_dir, "lineitem").withColumn("reason", reason).withColumn("tokens", tokens).withColumn("ended", F.when(F.col("l_linestatus") == "O", "eos"))


@query(f"SELECT reason, ended, truncated, source, count(*) AS n FROM (SELECT reason, ended, coalesce(reason = 'LENGTH', false) OR (reason IS NULL AND ended IS NULL AND coalesce(tokens >= 40, false)) AS truncated, CASE WHEN reason IS NULL AND tokens IS NULL AND ended IS NULL THEN 'unavailable' WHEN reason = 'LENGTH' THEN 'finish_reason' WHEN reason IS NULL AND ended IS NULL AND tokens >= 40 THEN 'token_count' ELSE 'metadata' END AS source FROM ({FLAGS})) GROUP BY ALL")
def truncation_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _generated(spark, sf_dir).withColumn("e", A.truncation_evidence(F.col("reason"), F.col("tokens"), F.col("ended"), 40))
    return g.groupBy("reason", "ended", "e.truncated", "e.source").agg(F.count("*").alias("n"))


IDS = "SELECT l_orderkey AS k, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_quantity, l_partkey) AS ids FROM lineitem GROUP BY l_orderkey"


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct("l_linenumber", "l_quantity", "l_partkey")
    lines = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(one)).alias("lines"))  # a dozen lines at most
    return lines.select("k", F.transform("lines", lambda x: x["l_quantity"].cast("bigint")).alias("ids"))


def _joined(c: str) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


@query(f"SELECT k, array_to_string(CASE WHEN list_contains(ids, 7) THEN ids[1:list_position(ids, 7)] ELSE ids END, ',') AS trimmed, len(ids) >= 3 AND NOT list_has_any(ids, [7, 11]) AS capped FROM ({IDS})")
def eos_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _ids(spark, sf_dir).select("k", A.trim_to_eos(F.col("ids"), 7).alias("trimmed"), A.ends_in_cap(F.col("ids"), 3, [7, 11]).alias("capped"))
    return i.select("k", _joined("trimmed"), "capped")


@query(f"SELECT k, array_to_string(list_reverse(list_reverse(p)[1:2]), ',') AS prompt_ids, array_to_string(c[1:3], ',') AS completion_ids FROM (SELECT k, ids[1:k % 4] AS p, ids[k % 4 + 1:] AS c FROM ({IDS})) WHERE len(p) > 0 AND len(c) > 0")
def policy_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.least(F.col("k") % 4, F.size("ids")).cast("int")
    i = _ids(spark, sf_dir).select("k", F.slice("ids", F.lit(1), at).alias("prompt_ids"), F.slice("ids", at + 1, F.size("ids")).alias("completion_ids"))
    return records.policy_ids(i, 2, 3).select("k", _joined("prompt_ids"), _joined("completion_ids"))


@query("SELECT c_custkey, coalesce(TRY_CAST(regexp_extract(c_name, '(\\d+)\\D*$', 1) AS BIGINT), -1) AS number FROM customer")
def checkpoint_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", A.checkpoint_number(F.col("c_name")).alias("number"))


@query("SELECT c_mktsegment, arg_max(c_name, c_custkey) AS name FROM customer GROUP BY c_mktsegment")
def latest_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoints.latest_checkpoint(_table(spark, sf_dir, "customer"), "c_name", "c_mktsegment").select("c_mktsegment", F.col("c_name").alias("name"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey > 0 AND gcd(l_partkey, l_suppkey) = 1 AS reduced FROM lineitem")
def reduced_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", A.reduced_fraction(F.concat_ws("/", "l_partkey", "l_suppkey")).alias("reduced"))


@query("SELECT stage, CAST(CAST('0x' || substr(sha256('sha256-stage-v1|42|' || stage), 1, 16) AS UBIGINT) AS VARCHAR) AS seed FROM (SELECT DISTINCT event_type AS stage FROM events UNION SELECT 'validation' UNION SELECT 'evaluation')")
def stage_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of stages, one for each of a short list of names."""
    names = ["validation", "evaluation", *[r[0] for r in _table(spark, sf_dir, "events").select("event_type").distinct().collect()]]
    return spark.createDataFrame([(n, str(sampling.stage_seed(42, n))) for n in names], "stage string, seed string")


@query(_with(f"SELECT id, 'Using the numbers ' || {LIST} || ', create a plausible but mathematically wrong answer for ' || target || '.' || chr(10) || 'Use the same numbers exactly once. Only use +, -, *, / and parentheses.' || chr(10) || 'The expression must be parseable and evaluate to a value different from ' || target || '.' || chr(10) || 'Return a complete <answer> expression </answer> block.' || chr(10) || 'Do not mention that the response is intentionally wrong.' || chr(10) || 'Imitate the style and brevity of this response:' || chr(10) || gold AS prompt FROM puzzles"))
def forced_wrong_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return puzzles(spark, sf_dir).select("id", A.forced_wrong_prompt(F.col("numbers"), F.col("target"), F.col("gold")).alias("prompt"))


@query(_with(f"SELECT 'train-' || lpad(CAST(k AS VARCHAR), CAST(greatest(6, length(CAST(k AS VARCHAR))) AS INTEGER), '0') AS id, k AS source_index, {LIST} AS numbers, target FROM puzzles"))
def normalized_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = puzzles(spark, sf_dir).select(F.col("k").alias("at"), F.to_json("numbers").alias("nums"), "target")
    n = records.normalize(raw, "train", "at", strict=True)
    return n.select("id", "source_index", A.numbers_text(F.col("numbers")).alias("numbers"), "target")


# --- solvable and unsolved ------------------------------------------------------


@query(_with("SELECT CASE WHEN kind < 4 THEN 'solved' WHEN kind = 4 THEN 'invalid_puzzle' ELSE 'no_solution' END AS state, count(*) AS n FROM puzzles GROUP BY 1"))
def solvable_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three numbers of each puzzle, with a target that can be reached, none, or one out of reach."""
    n = F.slice("numbers", F.lit(1), F.lit(3))
    reach = F.get(n, F.lit(0)) + F.get(n, F.lit(1)) * F.get(n, F.lit(2))
    target = F.when(F.col("kind") < 4, reach).when(F.col("kind") > 4, F.lit(10**12))
    s = records.solve(puzzles(spark, sf_dir).select("id", "source_index", n.alias("numbers"), target.alias("target")))
    solved = s.where("gold_expr is not null").select(F.lit("solved").alias("state"))
    return solved.unionByName(records.unsolved_records(s).select(F.col("reason").alias("state"))).groupBy("state").agg(F.count("*").alias("n"))


# --- reports of violations with planted faults -------------------------------------


@query(_with("""SELECT violation, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN kind = 0 THEN 'id' END, CASE WHEN kind = 1 THEN 'source_index' END, CASE WHEN kind = 2 THEN 'numbers' END, CASE WHEN kind = 3 THEN 'target' END, CASE WHEN kind IN (2, 3, 4) THEN 'prompt' END, CASE WHEN kind IN (2, 3, 5, 7) THEN 'gold_expr' END, CASE WHEN kind IN (2, 5, 6) THEN 'bucket' END], lambda x: x IS NOT NULL)) AS violation FROM puzzles) GROUP BY violation"""))
def source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of source rows is broken by a kind of puzzle of its own."""
    kind = F.col("kind")
    s = _source(spark, sf_dir).select(
        F.when(kind != 0, F.col("id")).otherwise("").alias("id"),
        F.when(kind == 1, -1).otherwise(F.col("source_index")).alias("source_index"),
        F.when(kind == 2, F.array().cast("array<bigint>")).otherwise(F.col("numbers")).alias("numbers"),
        F.when(kind == 3, -1).otherwise(F.col("target")).alias("target"),
        F.when(kind == 4, "?").otherwise(F.col("prompt")).alias("prompt"),
        F.when(kind == 5, "1+").otherwise(F.col("gold_expr")).alias("gold_expr"),
        F.when(kind == 6, F.col("bucket").withField("score", F.lit(99).cast("bigint"))).otherwise(F.col("bucket")).alias("bucket"),
    )
    return records.violation_report(records.source_violations(s))


@query(_with("""SELECT violation, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN k % 5 = 0 THEN 'validation' END, CASE WHEN error IS NOT NULL THEN 'correct' END, CASE WHEN k % 7 = 0 THEN 'provenance' END], lambda x: x IS NOT NULL)) AS violation FROM puzzles) GROUP BY violation"""))
def sft_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared validations against recomputed ones; every fifth declares another value."""
    v = records.validated(puzzles(spark, sf_dir))
    told = F.when(F.col("k") % 5 == 0, F.col("validation").withField("value", F.lit("forged"))).otherwise(F.col("validation"))
    rows = v.withColumn("validation", told).withColumn("provenance", F.when(F.col("k") % 7 != 0, F.lit("teacher")))
    return records.violation_report(records.sft_violations(rows))


@query(_with("""SELECT violation, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN k % 3 = 0 THEN 'chosen' END, CASE WHEN k % 5 = 0 AND k % 3 <> 0 THEN 'different' END, CASE WHEN error IS NULL THEN 'rejected_category' END, CASE WHEN k % 2 = 0 THEN 'generation_route' END], lambda x: x IS NOT NULL)) AS violation FROM puzzles) GROUP BY violation"""))
def pair_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = records.validated(puzzles(spark, sf_dir))
    chosen = F.when(F.col("k") % 3 == 0, "").when(F.col("k") % 5 == 0, F.col("response")).otherwise(F.concat(F.lit("good "), "response"))
    route = F.when(F.col("k") % 2 == 0, "elsewhere").otherwise("high_temp")
    rows = p.select(F.lit("?").alias("prompt"), chosen.alias("chosen"), F.col("response").alias("rejected"), F.col("validation.error").alias("rejected_category"), route.alias("generation_route"))
    return records.violation_report(records.pair_violations(rows))


@query(_with("""SELECT violation, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN kind = 0 THEN 'data_source' END, CASE WHEN kind = 1 THEN 'ability' END, CASE WHEN kind = 2 THEN 'prompt' END, CASE WHEN kind = 3 THEN 'id' END], lambda x: x IS NOT NULL)) AS violation FROM puzzles) GROUP BY violation"""))
def training_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("kind")
    s = _source(spark, sf_dir).withColumn("prompt", F.when(kind == 2, "").otherwise(F.col("prompt"))).withColumn("id", F.when(kind == 3, "").otherwise(F.col("id")))
    r = records.training_record(s.withColumn("gold_expr", F.concat_ws("|", kind.cast("string"), "gold_expr")))
    planted = F.substring_index("extra_info.gold_expr", "|", 1)
    r = r.withColumn("data_source", F.when(planted == "0", "other").otherwise(F.col("data_source"))).withColumn("ability", F.when(planted == "1", "art").otherwise(F.col("ability")))
    return records.violation_report(records.training_violations(r))


@query(_with("""SELECT violation, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN kind = 0 THEN 'id' END, CASE WHEN kind = 0 THEN 'duplicate_id' END, CASE WHEN kind = 1 THEN 'prompt' END, CASE WHEN kind = 2 THEN 'numbers' END, CASE WHEN kind = 3 THEN 'target' END], lambda x: x IS NOT NULL)) AS violation FROM puzzles) GROUP BY violation"""))
def teacher_source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("kind")
    s = _source(spark, sf_dir).select(
        F.when(kind != 0, F.col("id")).otherwise("").alias("id"),
        F.when(kind == 1, "  ").otherwise(F.col("prompt")).alias("prompt"),
        F.when(kind != 2, F.col("numbers")).alias("numbers"),
        F.when(kind != 3, F.col("target")).alias("target"),
    )
    return records.violation_report(validation.teacher_source_violations(s))


@query(_with("SELECT 'correct' AS violation, count(*) AS n FROM puzzles WHERE error IS NOT NULL"))
def chosen_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = puzzles(spark, sf_dir).withColumn("prompt", A.solution_prompt(F.col("numbers"), F.col("target")))
    return records.violation_report(validation.chosen_violations(s))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_orderkey % 6 WHEN 1 THEN 'non_finite' WHEN 2 THEN 'key' WHEN 3 THEN 'json' WHEN 4 THEN 'nesting' WHEN 5 THEN 'json' END AS fault, l_orderkey % 6 IN (0, 4) AND l_orderkey % 6 = 0 AS exact FROM lineitem""")
def json_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free JSON: whole, with a number that is none, a key twice, cut off, nested too deep, null."""
    texts = ['{"a": [1, 2.5], "b": null}', '{"a": 1e999, "c": 2}', '{"a": 1, "a": 2}', '{"a": ', "[" * 66 + "]" * 66]
    li = _table(spark, sf_dir, "lineitem").withColumn("text", F.get(F.array(*[F.lit(t) for t in texts]), (F.col("l_orderkey") % 6).cast("int")))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", validation.json_fault("text").alias("fault"), validation.exact_keys(F.col("text"), "b", "a").alias("exact"))


# --- rollouts, unions, prefixes, order ---------------------------------------------


@query(_with(f"{ROLLS} SELECT id, count(*) AS n FROM (SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY id, ok ORDER BY position) AS y FROM firsts) WHERE NOT ok OR y <= 2) GROUP BY id HAVING count(*) > 1"))
def accepted_and_rejected_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.checks import duplicate_ids

    good, bad = rollouts.accept_rollouts(_rolls(spark, sf_dir))
    return duplicate_ids(rollouts.every_record(good, bad), "id")


@query(_with("SELECT count(*) AS n, count(*) AS distinct_ids, count(*) AS known, max(k) - min(k) + 1 = count(*) AS is_prefix FROM puzzles WHERE error IS NULL"))
def prefix_of_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solved puzzles are no prefix of all; the report says what they lack."""
    p = puzzles(spark, sf_dir)
    done = records.validated(p).where("validation.ok").select("id")
    return rollouts.prefix_report(done, p.select("id", "source_index")).select("n", "distinct_ids", "known", "is_prefix")


@query(_with("SELECT id FROM puzzles WHERE error IS NOT NULL"))
def unprocessed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = puzzles(spark, sf_dir)
    return rollouts.unprocessed(p, records.validated(p).where("validation.ok")).select("id")


@query(_with("SELECT id, k AS source_index FROM puzzles"))
def in_source_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shuffled sample of everything gets its positions and its order back."""
    p = puzzles(spark, sf_dir)
    mixed = p.select("id", F.lit(0).alias("source_index"))
    return sampling.in_source_order(mixed, p.select("id", "source_index"))


@query("SELECT true AS same, false AS other")
def same_id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return spark.createDataFrame([(sampling.same_ids(d, d.orderBy(F.desc("id"))), sampling.same_ids(d, labels))], "same boolean, other boolean")


# --- checkpoints and evaluations ------------------------------------------------------


@query(f"WITH {LEDGER} SELECT step FROM (SELECT step FROM ledger WHERE run = 'click' ORDER BY step DESC LIMIT 2) UNION SELECT step FROM (SELECT step FROM ledger WHERE run = 'click' ORDER BY accuracy DESC, format_rate DESC, step LIMIT 1)")
def retained_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoints.retained(_ledger(spark, sf_dir).where("run = 'click'"), 2)


@query(f"WITH {LEDGER} SELECT a.step, a.accuracy, b.format_rate FROM ledger a JOIN ledger b ON a.step = b.step AND a.run = 'click' AND b.run = 'view'")
def matched_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = _ledger(spark, sf_dir)
    return checkpoints.match_steps(ledger.where("run = 'click'").select("step", "accuracy"), ledger.where("run = 'view'").select("step", "format_rate"))


@query(f"WITH {LEDGER}, s AS (SELECT DISTINCT run AS model FROM ledger), d AS (SELECT 'even' AS dataset UNION SELECT 'odd' UNION SELECT 'none'), r AS (SELECT run AS model, CASE WHEN step % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, round(avg(accuracy), 6) AS accuracy FROM ledger GROUP BY ALL) SELECT s.model, d.dataset, r.accuracy, CASE WHEN r.accuracy IS NULL THEN 'failed' ELSE 'complete' END AS status FROM s, d LEFT JOIN r ON r.model = s.model AND r.dataset = d.dataset")
def evaluation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = _ledger(spark, sf_dir)
    kind = F.when(F.col("step") % 2 == 0, "even").otherwise("odd").alias("dataset")
    results = ledger.groupBy(F.col("run").alias("model"), kind).agg(F.round(F.avg("accuracy"), 6).alias("accuracy"))
    sets = spark.createDataFrame([("even",), ("odd",), ("none",)], "dataset string")
    return checkpoints.evaluation_matrix(ledger.select(F.col("run").alias("model")), sets, results)


@query(f"WITH {LEDGER} SELECT run, step, max(accuracy) OVER (PARTITION BY run ORDER BY step) AS best_accuracy FROM ledger")
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoints.running_best(_ledger(spark, sf_dir), "run").select("run", "step", "best_accuracy")


@query(_with(f"{SAMPLES}, t AS (SELECT {SUMMARY} FROM samples) " + ROUNDED.format(by="")))
def evaluation_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From inputs to metrics, with an engine that looks its answers up."""
    p = _source(spark, sf_dir)
    told = p.select("id", "response", F.length("response").cast("bigint").alias("generated_tokens"), F.when(F.length("response") >= 40, F.lit("length")).alias("finish_reason"))
    samples = evaluation.evaluate(p.select("id", "prompt", "numbers", "target"), lambda rows: rows.join(told, "id"), 10**6)
    return _rounded(metrics.eval_summary(samples), avg_generated_tokens=6)


# --- rewards and metrics ------------------------------------------------------------------


@query(_with(f"""{REWARDS}, g AS (SELECT floor(k / 8) AS g, count(*) AS n, CASE WHEN min(reward) = max(reward) THEN 0 ELSE stddev_pop(reward) END AS s FROM rewards GROUP BY 1 HAVING count(*) = 8)
SELECT (SELECT round(stddev_pop(reward), 6) FROM rewards) AS reward_std, round(coalesce(avg(s), 0), 6) AS group_reward_std, round(coalesce(avg(CASE WHEN s = 0 THEN 1 ELSE 0 END), 0), 6) AS frac_reward_zero_std FROM g"""))
def group_summary_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.group_summary(_rewards(spark, sf_dir), 8), reward_std=6, group_reward_std=6, frac_reward_zero_std=6)


@query(_with(f"""{REWARDS} SELECT k % 10 AS step, count(*) AS rollout_count, round(avg(reward), 9) AS mean_reward, round(avg(CAST(answer_correct AS INT)), 9) AS accuracy, round(avg(CAST(format_ok AS INT)), 9) AS format_rate, round(avg(CASE WHEN k % 3 = 0 THEN 0 ELSE response_length END), 9) AS avg_gen_tokens, max(CASE WHEN k % 3 = 0 THEN 0 ELSE response_length END) AS max_gen_tokens, CAST(sum(CAST(truncated AS INT)) AS BIGINT) AS truncated_count FROM rewards GROUP BY 1"""))
def step_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rewards(spark, sf_dir).withColumn("step", F.col("k") % 10).withColumn("token_count", F.when(F.col("k") % 3 != 0, F.col("response_length")))
    return _rounded(metrics.step_metrics(r, "step"))


@query(_with(f"""{REWARDS} SELECT round(avg(reward) FILTER (bucket = '3'), 6) AS "val/bucket/3/reward", round(avg(CAST(answer_correct AS INT)) FILTER (bucket = '5'), 6) AS "val/bucket/5/accuracy", round(avg(CAST(format_ok AS INT)) FILTER (bucket = '4'), 6) AS "val/bucket/4/format_rate" FROM rewards"""))
def prefixed_bucket_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = metrics.prefixed(metrics.wide_bucket_metrics(_rewards(spark, sf_dir), ["3", "4", "5"]), "val")
    keep = ["val/bucket/3/reward", "val/bucket/5/accuracy", "val/bucket/4/format_rate"]
    return wide.select(*[F.round(F.col(f"`{c}`"), 6).alias(c) for c in keep])


@query(_with("""SELECT id, kind NOT IN (4) AS format_ok, error IS NULL OR kind = 5 AS correct, round(CAST(CASE WHEN kind <> 4 THEN 0.5 ELSE 0 END + CASE WHEN error IS NULL OR kind = 5 THEN 2.0 ELSE 0 END + CASE WHEN length(response) <= 20 THEN 0 WHEN length(response) >= 60 THEN -0.5 ELSE -0.5 * (length(response) - 20) / 40.0 END AS DOUBLE), 9) AS reward FROM puzzles"""))
def combined_rewards_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = puzzles(spark, sf_dir).withColumn("completion", F.col("response")).withColumn("token_count", F.length("response"))
    r = records.combined_rewards(rows, 60, 20, -0.5, 0.5, 2.0)
    return r.select("id", "format_ok", "correct", F.round("reward", 9).alias("reward"))


@query(_with("""SELECT id, round(CAST(CASE WHEN k % 4 = 0 THEN 0 ELSE CASE WHEN expression IS NOT NULL THEN 0.2 ELSE 0 END + CASE WHEN error IS NULL THEN 1.0 ELSE 0 END END AS DOUBLE), 9) AS score, CASE WHEN k % 4 = 0 THEN 'unsupported_data_source' ELSE error END AS error, CASE WHEN k % 4 <> 0 THEN expression END AS expression, k % 4 <> 0 AND error IS NULL AS answer_correct FROM puzzles"""))
def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _source(spark, sf_dir)
    r = records.training_record(p.withColumn("gold_expr", F.col("response")))
    r = r.withColumn("solution", F.col("extra_info.gold_expr")).withColumn("data_source", F.when(F.col("extra_info.source_index") % 4 == 0, "other").otherwise(F.col("data_source")))
    out = records.rule_scores(r)
    return out.select("extra_info.id", F.round("score.score", 9).alias("score"), "score.error", "score.expression", "score.answer_correct")


@query(_with("""SELECT id, trim(response, ' ') AS response, error IS NULL AS ok, 'engine' AS generator, 'teacher' AS stage FROM puzzles"""))
def teacher_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = puzzles(spark, sf_dir).withColumn("response", F.concat(F.lit(" \n"), "response", F.lit("\t ")))
    return records.teacher_payload(p, "engine").select("id", "response", "validation.ok", "provenance.generator", "provenance.stage")


# --- preference records --------------------------------------------------------------------


@query(_with(f"""{CANDS} SELECT {PROMPT} AS prompt, '<answer>' || gold || '</answer>' AS chosen, candidate_id AS rejected, rejected_category, generation_route, c.source_id FROM cands c JOIN puzzles p ON p.id = c.source_id WHERE rejected_category = 'number_mismatch'"""))
def preference_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _candidates(spark, sf_dir).withColumn("rejected", F.col("candidate_id"))
    chosen = _source(spark, sf_dir).withColumn("response", F.concat(F.lit("<answer>"), "gold_expr", F.lit("</answer>")))
    pairs = preferences.pair_records(pool.where("rejected_category = 'number_mismatch'").select("source_id", "candidate_id", "rejected_category", "generation_route"), chosen, pool)
    triples = records.preference_triple(pairs.select("prompt", "chosen", "rejected")).distinct()
    return pairs.join(triples, ["prompt", "chosen", "rejected"]).select("prompt", "chosen", "rejected", "rejected_category", "generation_route", "provenance.source_id")


@query(_with(f"{BUCKETS} SELECT id, {PROMPT} AS source_prompt, 'user' AS role, 'assistant' AS reply_role, gold AS reply FROM buckets"))
def message_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _source(spark, sf_dir)
    asked = records.message_record(s)
    both = records.message_record(s.withColumn("response", F.col("gold_expr")), with_answer=True)
    reply = F.get("messages", F.lit(1))
    return asked.select("id", "source_prompt", F.get("prompt", F.lit(0))["role"].alias("role")).join(both.select("id", reply["role"].alias("reply_role"), reply["content"].alias("reply")), "id")
