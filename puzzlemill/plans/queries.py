"""Registered queries over the driver tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions.arithmetic import expression_depth
from ..operators import checkpoints, metrics, preferences, records, rollouts, sampling
from .puzzles import SQL, puzzles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
SEED = 42


def query(sql: str | None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _with(body: str) -> str:
    return f"WITH {SQL} {body}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(numbers: str = "numbers") -> F.Column:
    return A.numbers_text(F.col(numbers)).alias("numbers")


LIST = "'[' || array_to_string(list_transform(numbers, lambda x: CAST(x AS VARCHAR)), ', ') || ']'"
DEPTH = "CASE len(numbers) - CASE WHEN kind = 7 THEN 1 ELSE 0 END WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 5 END"
BUCKETS = f""", d AS (SELECT *, len(numbers) AS n, {DEPTH} AS depth FROM puzzles),
s AS (SELECT *, (CASE WHEN n >= 4 THEN 1 ELSE 0 END) + (CASE WHEN n >= 5 THEN 2 ELSE 0 END) + (CASE WHEN depth >= 4 THEN 1 ELSE 0 END) + (CASE WHEN length(gold) >= 18 THEN 1 ELSE 0 END) AS score FROM d),
buckets AS (SELECT *, n || '_' || CASE WHEN score <= 1 THEN 'easy' WHEN score <= 3 THEN 'medium' ELSE 'hard' END AS bucket_key FROM s)"""


def _bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = puzzles(spark, sf_dir).withColumn("depth", expression_depth("gold"))
    return p.withColumn("bucket", A.bucket(F.col("numbers"), F.col("gold"), F.col("depth"))).withColumn("bucket_key", F.col("bucket.bucket_key"))


# --- sources and buckets -----------------------------------------------------


@query(_with(f"{BUCKETS} SELECT id, k AS source_index, {LIST} AS numbers, target, gold AS gold_expr, 'Using the numbers ' || {LIST} || ', create an equation that equals ' || target || '.' || chr(10) || 'Use each number exactly once. Only use +, -, *, / and parentheses.' || chr(10) || 'Do not use any other numbers. Keep the response concise.' || chr(10) || 'Finally return <answer> equation </answer>.' AS prompt, depth AS expr_depth, length(gold) AS expr_len, score, bucket_key FROM buckets"))
def puzzle_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _bucketed(spark, sf_dir)
    return p.select("id", "source_index", _text(), "target", F.col("gold").alias("gold_expr"), A.solution_prompt(F.col("numbers"), F.col("target")).alias("prompt"), "bucket.expr_depth", "bucket.expr_len", "bucket.score", "bucket_key")


@query(_with(f"{BUCKETS} SELECT bucket_key, count(*) AS n FROM buckets GROUP BY bucket_key"))
def bucket_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.counts(_bucketed(spark, sf_dir), "bucket_key")


@query(_with("SELECT count(*) AS puzzles, count(*) AS solved, 0 AS wrong FROM puzzles"))
def solved_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every puzzle has a solution, and it checks."""
    p = puzzles(spark, sf_dir)
    s = records.solve(p.select("id", "source_index", "numbers", "target"))
    v = records.validated(s.withColumn("response", F.concat(F.lit("<answer>"), "gold_expr", F.lit("</answer>"))))
    return v.agg(F.count("*").alias("puzzles"), F.count("gold_expr").alias("solved"), F.sum((~F.col("validation.ok")).cast("bigint")).alias("wrong"))


# --- answers -------------------------------------------------------------------


@query(_with("SELECT id, expression AS answer, CASE WHEN kind = 5 THEN gold ELSE expression END AS answer_v1, expression IS NOT NULL AS has_answer FROM puzzles"))
def answer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("response")
    return puzzles(spark, sf_dir).select("id", A.answer_text(r).alias("answer"), A.answer_text(r, "v1").alias("answer_v1"), A.has_answer(r).alias("has_answer"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS answer FROM conversations")
def answer_extract_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns as answers, the odd ones followed by a tag that is never closed."""
    after = F.when(F.col("turn") % 2 == 0, "").otherwise(" <answer> and")
    tagged = F.concat(F.lit("So <answer>"), "text", F.lit(" </Answer>"), after)
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", A.answer_text(tagged).alias("answer"))


@query(_with("SELECT id, error IS NULL AS ok, value, expression, error FROM puzzles"))
def validate_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.validated(puzzles(spark, sf_dir)).select("id", "validation.ok", "validation.value", "validation.expression", "validation.error")


SAMPLES = """, samples AS (SELECT k, id, len(numbers) AS n, error IS NULL AS correct, expression IS NOT NULL AS format_ok, coalesce(error NOT IN ('missing_answer_tag', 'invalid_expression'), true) AS valid_expression,
 length(response) AS generated_tokens, length(response) >= 40 AS truncated FROM puzzles)"""
SUMMARY = """count(*) AS count, avg(CAST(correct AS INT)) AS accuracy, avg(CAST(format_ok AS INT)) AS format_rate, avg(CAST(valid_expression AS INT)) AS valid_expression_rate, avg(generated_tokens) AS avg_generated_tokens,
 max(generated_tokens) AS max_generated_tokens, sum(CAST(truncated AS INT)) AS truncated_count, avg(CAST(truncated AS INT)) AS truncated_rate"""
ROUNDED = "SELECT {by} count, round(accuracy, 9) AS accuracy, round(format_rate, 9) AS format_rate, round(valid_expression_rate, 9) AS valid_expression_rate, round(avg_generated_tokens, 6) AS avg_generated_tokens, max_generated_tokens, CAST(truncated_count AS BIGINT) AS truncated_count, round(truncated_rate, 9) AS truncated_rate FROM t"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = puzzles(spark, sf_dir).withColumn("n", F.size("numbers").cast("bigint")).withColumn("generated_tokens", F.length("response").cast("bigint"))
    return records.eval_samples(p.withColumn("truncated", A.is_truncated(F.lit(None).cast("string"), F.col("generated_tokens"), 40)))


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits.get(c, 9)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(_with(f"{SAMPLES}, t AS (SELECT {SUMMARY} FROM samples) " + ROUNDED.format(by="")))
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.eval_summary(_samples(spark, sf_dir)), avg_generated_tokens=6)


@query(_with(f"{SAMPLES}, t AS (SELECT n, {SUMMARY} FROM samples GROUP BY n) " + ROUNDED.format(by="n, ")))
def eval_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.eval_summary(_samples(spark, sf_dir), "n"), avg_generated_tokens=6)


@query(_with(f"{SAMPLES} SELECT count(*) AS count, round(avg(CAST(correct AS INT)), 9) AS accuracy, round(avg(CAST(format_ok AS INT)), 9) AS format_rate, round(avg(CAST(correct AS INT)), 9) AS valid_expression_rate, round(avg(generated_tokens), 6) AS avg_generated_tokens, CAST(sum(CAST(truncated AS INT)) AS BIGINT) AS truncated_count FROM samples"))
def eval_summary_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.eval_summary(_samples(spark, sf_dir), compat="v1"), avg_generated_tokens=6)


# --- samples, splits, leaks ------------------------------------------------------


def _sample_sql(table: str, key: str, bucket: str, size: int, seed: int) -> str:
    return f"""SELECT * EXCLUDE (rk, turn) FROM (SELECT *, row_number() OVER (PARTITION BY {bucket} ORDER BY sha256('{seed}|' || {key}), {key}) AS rk, sha256('{seed}|' || {bucket}) AS turn FROM {table}) ORDER BY rk, turn LIMIT {size}"""


VAL, EVAL = sampling.stage_seed(SEED, "validation"), sampling.stage_seed(SEED, "evaluation")


@query(_with(f"{BUCKETS}, v AS ({_sample_sql('buckets', 'id', 'bucket_key', 200, VAL)}) SELECT id, bucket_key FROM v"))
def stratified_val(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.balanced_sample(_bucketed(spark, sf_dir).select("id", "bucket_key"), 200, VAL)


@query(_with(f"{BUCKETS}, v AS ({_sample_sql('buckets', 'id', 'bucket_key', 200, VAL)}), e AS ({_sample_sql('v', 'id', 'bucket_key', 50, EVAL)}) SELECT id, bucket_key FROM e"))
def eval_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.three_way_split(_bucketed(spark, sf_dir).select("id", "bucket_key"), 200, 50, SEED)[2]


@query(_with(f"{BUCKETS}, v AS ({_sample_sql('buckets', 'id', 'bucket_key', 200, VAL)}) SELECT id, bucket_key FROM buckets WHERE id NOT IN (SELECT id FROM v)"))
def train_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.three_way_split(_bucketed(spark, sf_dir).select("id", "bucket_key"), 200, 50, SEED)[0]


@query(f"WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang FROM documents), s AS ({_sample_sql('d', 'id', 'lang', 120, 7)}) SELECT id, lang FROM s")
def stratified_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang")
    return sampling.balanced_sample(d, 120, 7, bucket="lang")


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.leaked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT min(doc_id) AS doc_id, text, lang FROM documents GROUP BY text, lang")
def text_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return rollouts.first_texts(d, "lang", "text", "doc_id")


@query("SELECT l_orderkey, n FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) WHERE n > 1")
def id_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.checks import duplicate_ids

    return duplicate_ids(_table(spark, sf_dir, "lineitem"), "l_orderkey")


# --- rollouts ---------------------------------------------------------------------

ROLLS = """, rolls AS (SELECT k, id, r, k * 4 + r AS position, CASE r WHEN 1 THEN response || ' ' WHEN 3 THEN '<answer>' || gold || '</answer>' ELSE response END AS response,
 CASE r WHEN 3 THEN kind = 7 ELSE error IS NOT NULL END AS wrong FROM puzzles, (VALUES (0), (1), (2), (3)) v(r)),
plain AS (SELECT k, id, r, position, trim(response) AS response, NOT wrong AS ok FROM rolls),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, response ORDER BY position) AS x FROM plain) WHERE x = 1)"""


def _rolls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rollouts.expand(puzzles(spark, sf_dir), 4)
    r = F.col("rollout_index")
    other = F.when(r == 1, F.concat("response", F.lit(" "))).when(r == 3, F.concat(F.lit("<answer>"), "gold", F.lit("</answer>"))).otherwise(F.col("response"))
    return records.validated(p.withColumn("response", other)).withColumn("ok", F.col("validation.ok"))


@query(_with(f"{ROLLS} SELECT id, r AS rollout_index, position, CAST(floor(position / 4) AS BIGINT) AS source FROM rolls"))
def rollout_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts.expand(puzzles(spark, sf_dir), 4).select("id", "rollout_index", "position", rollouts.source_position(F.col("position"), 4).alias("source"))


@query(_with(f"{ROLLS} SELECT id, r AS rollout_index, response FROM (SELECT *, row_number() OVER (PARTITION BY id, ok ORDER BY position) AS y FROM firsts) WHERE ok AND y <= 2"))
def rft_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts.accept_rollouts(_rolls(spark, sf_dir))[0].select("id", "rollout_index", "response")


@query(_with(f"{ROLLS} SELECT id, r AS rollout_index, response FROM firsts WHERE NOT ok"))
def rft_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts.accept_rollouts(_rolls(spark, sf_dir))[1].select("id", "rollout_index", "response")


@query(_with("SELECT id, k AS source_index, error IS NULL AS ok FROM puzzles WHERE k <= coalesce((SELECT CASE WHEN count(*) = 300 THEN max(k) END FROM (SELECT k FROM puzzles WHERE error IS NULL ORDER BY k LIMIT 300)), 9223372036854775807)"))
def teacher_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.validated(puzzles(spark, sf_dir)).select("id", "source_index", F.col("validation.ok").alias("ok"))
    return rollouts.cut_at_target(rows, 300, "source_index")


@query(_with("SELECT id, CAST(('0x' || substr(sha256('42|teacher|' || id || '|' || r), 1, 8)) AS BIGINT) AS request_seed, r AS rollout_index FROM puzzles, (VALUES (0), (1)) v(r)"))
def request_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rollouts.expand(puzzles(spark, sf_dir), 2)
    return p.select("id", A.request_seed(42, "teacher", F.col("id"), F.col("rollout_index")).alias("request_seed"), "rollout_index")


@query(_with(f"{ROLLS} SELECT id, r AS rollout_index, response, CASE WHEN k < ceil((SELECT max(k) + 1 FROM puzzles) / 2) THEN 0 ELSE 1 END AS shard FROM rolls"))
def position_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in two shards and the responses of both, joined by position; completeness is checked on the way."""
    p = puzzles(spark, sf_dir)
    asked = rollouts.expand(p, 4).select("id", "rollout_index", "position")
    told = _rolls(spark, sf_dir)
    total = p.agg(F.max("k") + 1).scalar()
    told = told.withColumn("shard", rollouts.shard(F.col("k"), total)).select("position", "response", "shard")
    both = told.where("shard = 1").unionByName(told.where("shard = 0"))
    return rollouts.merge_responses(asked, both).select("id", "rollout_index", "response", "shard")


# --- preference pairs --------------------------------------------------------------

CANDS = """, cands AS (SELECT id AS source_id, k, id || ':' || route AS candidate_id, route AS generation_route, k * 2 + CASE route WHEN 'high_temp' THEN 1 ELSE 0 END AS arrival,
 CASE WHEN k % 11 = 0 AND route = 'high_temp' THEN 'truncated' WHEN error IS NULL THEN 'unexpected_correct' ELSE error END AS rejected_category FROM puzzles, (VALUES ('forced_wrong'), ('high_temp')) v(route))"""
RANK = "CASE rejected_category WHEN 'wrong_value' THEN 1 WHEN 'number_mismatch' THEN 2 WHEN 'invalid_expression' THEN 3 WHEN 'missing_answer_tag' THEN 4 WHEN 'truncated' THEN 5 END"
TARGET = 100


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = records.validated(puzzles(spark, sf_dir))
    rows = rollouts.expand_routes(p, preferences.ROUTES, 1)
    cut = A.is_truncated(F.when((F.col("k") % 11 == 0) & (F.col("generation_route") == "high_temp"), F.lit("length")), F.lit(0), 1024)
    return rows.select(F.col("id").alias("source_id"), "k", F.col("k").alias("source_index"), F.concat_ws(":", "id", "generation_route").alias("candidate_id"), "generation_route", F.col("position").alias("arrival"), preferences.category(F.coalesce(cut, F.lit(False)), F.col("validation.error")).alias("rejected_category"))


@query(_with(f"{CANDS} SELECT generation_route, rejected_category, count(*) AS n FROM cands GROUP BY ALL"))
def dpo_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).groupBy("generation_route", "rejected_category").agg(F.count("*").alias("n"))


def _pairs_sql() -> str:
    quotas = preferences.category_quotas(TARGET)
    steps, used = [], []
    for i, (name, need) in enumerate(quotas.items()):
        free = "".join(f" AND source_id NOT IN (SELECT source_id FROM {u})" for u in used)
        steps.append(f"""p{i} AS (SELECT source_id, candidate_id, generation_route, rejected_category FROM (SELECT *, row_number() OVER (PARTITION BY generation_route ORDER BY sha256('{SEED}|' || source_id || '|' || candidate_id)) AS turn FROM cands WHERE rejected_category = '{name}'{free}) ORDER BY turn, generation_route LIMIT {need})""")
        used.append(f"p{i}")
    every = " UNION ALL ".join(f"SELECT * FROM {u}" for u in used)
    return f"""{CANDS}, {', '.join(steps)}, picked AS ({every}),
late AS (SELECT source_id, candidate_id, generation_route, rejected_category FROM cands WHERE rejected_category <> 'unexpected_correct' AND source_id NOT IN (SELECT source_id FROM picked))
SELECT source_id, candidate_id, generation_route, rejected_category FROM (SELECT *, 0 AS l FROM picked UNION ALL SELECT *, 1 AS l FROM late) ORDER BY l, {RANK}, sha256('{SEED}|' || source_id || '|' || candidate_id) LIMIT {TARGET}"""


@query(_with(_pairs_sql()))
def dpo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = puzzles(spark, sf_dir).select("id")
    return preferences.select_pairs(_candidates(spark, sf_dir), chosen, TARGET, SEED).select("source_id", "candidate_id", "generation_route", "rejected_category")


V1_SQL = f"""{CANDS}, ranked AS (SELECT *, {RANK} AS rk, CASE WHEN rejected_category IN ('invalid_expression', 'missing_answer_tag', 'truncated') THEN row_number() OVER (PARTITION BY rejected_category IN ('invalid_expression', 'missing_answer_tag', 'truncated') ORDER BY {RANK}, k, generation_route, arrival) ELSE 0 END AS bad FROM cands WHERE rejected_category <> 'unexpected_correct'),
pairs AS (SELECT source_id || '-dpo-' || (row_number() OVER (ORDER BY rk, k, generation_route, arrival) - 1) AS id, rejected_category FROM (SELECT * FROM ranked WHERE bad <= 300 ORDER BY rk, k, generation_route, arrival LIMIT 3000))"""


@query(_with(f"{V1_SQL} SELECT id, rejected_category FROM pairs"))
def dpo_pairs_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.select_pairs_v1(_candidates(spark, sf_dir), 3000, 0.1).select("id", "rejected_category")


@query(_with(f"""{V1_SQL}, t AS (SELECT count(*) AS n, sum(CASE WHEN rejected_category IN ('invalid_expression', 'missing_answer_tag', 'truncated') THEN 1 ELSE 0 END) AS bad, sum(CASE WHEN rejected_category = 'wrong_value' THEN 1 ELSE 0 END) AS good FROM pairs)
SELECT n AS num_pairs, greatest(0, 3000 - n) AS pair_shortfall, round(CASE WHEN n > 0 THEN bad / n ELSE 0 END, 9) AS malformed_fraction, round(CASE WHEN n > 0 THEN good / n ELSE 0 END, 9) AS wrong_value_fraction, CAST(greatest(0, ceil(n * 0.7) - good) AS BIGINT) AS wrong_value_shortfall FROM t"""))
def dpo_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preferences.select_pairs_v1(_candidates(spark, sf_dir), 3000, 0.1)
    return _rounded(preferences.pair_report(pairs, 3000, 0.7))


@query(_with("SELECT k, route AS generation_route FROM (SELECT *, row_number() OVER (ORDER BY k) - 1 AS spot FROM puzzles), (VALUES ('forced_wrong', 0), ('high_temp', 1)) v(route, i) WHERE spot < 150 ORDER BY spot, i LIMIT 300"))
def route_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.route_requests(puzzles(spark, sf_dir), {"forced_wrong": 0.5, "high_temp": 0.5}, 150, 2.0, 10**9, "k").select("k", "generation_route")


# --- rewards and metrics -------------------------------------------------------------

REWARDS = """, rewards AS (SELECT k, id, CASE WHEN expression IS NOT NULL THEN 0.2 ELSE 0.0 END + CASE WHEN error IS NULL THEN 1.0 ELSE 0.0 END AS reward, error IS NULL AS answer_correct, expression IS NOT NULL AS format_ok,
 length(response) AS response_length, length(response) >= 40 AS truncated, CAST(len(numbers) AS VARCHAR) AS bucket FROM puzzles)"""


def _rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = records.validated(puzzles(spark, sf_dir))
    ok, formed = F.col("validation.ok"), F.col("validation.expression").isNotNull()
    return v.select("k", "id", F.col("k").alias("position"), A.rule_reward(formed, ok).alias("reward"), ok.alias("answer_correct"), formed.alias("format_ok"), F.length("response").cast("bigint").alias("response_length"), (F.length("response") >= 40).alias("truncated"), F.size("numbers").cast("string").alias("bucket"))


@query(_with(f"{REWARDS} SELECT id, round(CAST(reward AS DOUBLE), 9) AS reward, answer_correct, format_ok, round(CAST(CASE WHEN response_length <= 20 THEN 0 WHEN response_length >= 60 THEN -0.5 ELSE -0.5 * (response_length - 20) / 40.0 END AS DOUBLE), 9) AS length_penalty FROM rewards"))
def reward_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rewards(spark, sf_dir)
    return _rounded(r.select("id", "reward", "answer_correct", "format_ok", A.length_penalty(F.col("response_length"), 60, 20, -0.5).alias("length_penalty")))


@query(_with(f"""{REWARDS}, g AS (SELECT *, min(reward) OVER w AS lo, max(reward) OVER w AS hi, avg(reward) OVER w AS m, stddev_pop(reward) OVER w AS s FROM rewards WINDOW w AS (PARTITION BY floor(k / 8)))
SELECT id, round(CASE WHEN lo = hi THEN 0.0 ELSE greatest(-1.5, least(1.5, (reward - m) / s)) END, 6) AS advantage FROM g"""))
def group_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.group_advantages(_rewards(spark, sf_dir), 8, 1.5).select("id", "advantage"), advantage=6)


@query(_with(f"""{REWARDS}, g AS (SELECT floor(k / 8) AS g, min(reward) AS lo, max(reward) AS hi, CASE WHEN min(reward) = max(reward) THEN 0 ELSE stddev_pop(reward) END AS s FROM rewards GROUP BY 1),
one AS (SELECT count(*) AS count, round(avg(reward), 6) AS reward, round(stddev_pop(reward), 6) AS reward_std, round(avg(CAST(answer_correct AS INT)), 6) AS accuracy, round(avg(CAST(format_ok AS INT)), 6) AS format_rate, round(avg(response_length), 6) AS avg_response_length, max(response_length) AS max_response_length, CAST(sum(CAST(truncated AS INT)) AS BIGINT) AS truncated_count, round(avg(CAST(truncated AS INT)), 6) AS truncated_rate FROM rewards),
two AS (SELECT round(avg(s), 6) AS group_reward_std, round(avg(CASE WHEN s = 0 THEN 1 ELSE 0 END), 6) AS frac_reward_zero_std, round(avg(CASE WHEN lo >= 1.2 THEN 1 ELSE 0 END), 6) AS all_correct_group_fraction, round(avg(CASE WHEN hi <= 0 THEN 1 ELSE 0 END), 6) AS all_wrong_group_fraction FROM g)
SELECT *, CAST(0 AS DOUBLE) AS kl FROM one, two"""))
def grpo_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.rollout_metrics(_rewards(spark, sf_dir), 8)
    return out.select(*[F.round(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(_with(f"{REWARDS} SELECT bucket, round(avg(CAST(answer_correct AS INT)), 6) AS accuracy, round(avg(CAST(format_ok AS INT)), 6) AS format_rate, round(avg(reward), 6) AS reward FROM rewards GROUP BY bucket"))
def bucket_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.bucket_metrics(_rewards(spark, sf_dir))
    return out.select("bucket", *[F.round(c, 6).alias(c) for c in ("accuracy", "format_rate", "reward")])


LEDGER = "ledger AS (SELECT event_type AS run, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS step, round(avg(value), 6) AS accuracy, round(max(value), 6) AS format_rate FROM events GROUP BY 1, 2)"


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    day = F.unix_date(F.to_date("ts")).cast("bigint").alias("step")
    return e.groupBy(F.col("event_type").alias("run"), day).agg(F.round(F.avg("value"), 6).alias("accuracy"), F.round(F.max("value"), 6).alias("format_rate"))


@query(f"WITH {LEDGER} SELECT run, step, accuracy, format_rate, final_step FROM (SELECT *, max(step) OVER (PARTITION BY run) AS final_step, row_number() OVER (PARTITION BY run ORDER BY accuracy DESC, format_rate DESC, step) AS x FROM ledger) WHERE x = 1")
def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoints.best_checkpoint(_ledger(spark, sf_dir), "run")


@query(f"WITH {LEDGER} SELECT run, step FROM ledger WHERE step % 7 = 0 OR step = 20000")
def due_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoints.due_evaluations(_ledger(spark, sf_dir), 7, 20000).select("run", "step")


# --- records and masks ---------------------------------------------------------------


@query("SELECT conv_id, turn, 'user' AS role, coalesce(text, '') AS content FROM conversations")
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", A.user_message(F.coalesce("text", F.lit(""))).alias("m"))
    return c.select("conv_id", "turn", F.inline("m"))


@query(_with(f"{BUCKETS} SELECT 'countdown' AS data_source, 'user' AS role, 'rule' AS style, {LIST} AS numbers, target, id, k AS source_index, bucket_key FROM buckets"))
def training_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _bucketed(spark, sf_dir)
    p = p.withColumn("prompt", A.solution_prompt(F.col("numbers"), F.col("target"))).withColumnRenamed("gold", "gold_expr")
    r = records.training_record(p)
    return r.select("data_source", F.get("prompt.role", F.lit(0)).alias("role"), "reward_model.style", A.numbers_text(F.col("reward_model.ground_truth.numbers")).alias("numbers"), "reward_model.ground_truth.target", "extra_info.id", "extra_info.source_index", "extra_info.bucket.bucket_key")


@query(_with("SELECT 'gold_expr' AS violation, count(*) AS n FROM puzzles WHERE kind = 7 HAVING count(*) > 0"))
def schema_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _bucketed(spark, sf_dir).withColumn("prompt", A.solution_prompt(F.col("numbers"), F.col("target"))).withColumnRenamed("gold", "gold_expr")
    return records.violation_report(records.source_violations(p.select("id", "source_index", "numbers", "target", "gold_expr", "prompt", "bucket")))


@query("""WITH t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n FROM conversations), u AS (SELECT conv_id, turn, n, least(n, 40) AS p, least(n + 5, 64) AS w FROM t)
SELECT conv_id, turn, CAST(64 AS BIGINT) AS length, CAST(w AS BIGINT) AS attended, CAST(w - least(p, w) AS BIGINT) AS learned FROM u WHERE n + 5 >= p""")
def token_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    ids = lambda k: F.transform(F.sequence(F.lit(0), k - 1), lambda i: (i % 50).cast("bigint"))
    p = F.least("n", F.lit(40))
    c = c.select("conv_id", "turn", F.when(p > 0, ids(p)).otherwise(F.array().cast("array<bigint>")).alias("prompt_ids"), ids(F.col("n") + 5).alias("full_ids"))
    m = records.supervised_masks(c, 64, 0)
    return m.select("conv_id", "turn", F.size("input_ids").cast("bigint").alias("length"), F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).cast("bigint").alias("attended"), F.size(F.filter("labels", lambda x: x != -100)).cast("bigint").alias("learned"))
