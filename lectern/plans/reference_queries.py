"""Queries of the reading-test operators over the test tables, each beside the SQL that says the same.

Repeated deliveries (same key) count once everywhere. Doubles are rounded to nine digits, as sums depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import answers as A
from lectern.functions import evidence, replies, rules, text, tokens
from lectern.operators import bins, checks, context, metrics, recovery, sampling, sequence
from lectern.plans.session import cut, large_rows, table

LENGTH, BINS, PADDING, WINDOW = 200_000, 50, 500, 500
LENGTHS = [32_000, 64_000, 128_000, 200_000]
_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}

# Tables without repeats, in both engines.
_CTE = """
res AS (SELECT DISTINCT ON (result_id) * FROM results ORDER BY result_id, loaded_at),
que AS (SELECT DISTINCT ON (q_id) * FROM questions ORDER BY q_id, loaded_at),
val AS (SELECT DISTINCT ON (validation_id) * FROM validations ORDER BY validation_id, loaded_at),
asg AS (SELECT DISTINCT ON (assignment_id) * FROM depth_assignments ORDER BY assignment_id),
sets AS (SELECT DISTINCT ON (set_id) * FROM question_sets ORDER BY set_id, loaded_at),
sc AS (SELECT *, coalesce(correct_answer, []) AS ca, coalesce(model_answer, []) AS ma FROM res),
sd AS (SELECT *, len(list_intersect(ca, ma)) AS both_n, len(list_distinct(ca)) AS ca_n, len(list_distinct(ma)) AS ma_n,
  (len(ma) = 0 OR parsing_status IS NOT DISTINCT FROM 'parsing_error') AS no_ans FROM sc),
se AS (SELECT *, (both_n = ca_n AND both_n = ma_n) AS same_set, CASE WHEN ma_n > 0 THEN both_n / ma_n ELSE 0 END AS p, CASE WHEN ca_n > 0 THEN both_n / ca_n ELSE 0 END AS r FROM sd),
sf AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * (p * r) / (p + r) ELSE 0 END AS f1 FROM se),
scored AS (SELECT *,
  CASE WHEN no_ans THEN 'parsing_error' WHEN same_set THEN 'correct' WHEN question_type = 'multiple_choice' AND both_n > 0 THEN 'partially_correct' ELSE 'incorrect' END AS category,
  CASE WHEN no_ans THEN 0.0 WHEN question_type IN ('single_choice', 'negative_question') THEN CASE WHEN same_set THEN 1.0 ELSE 0.0 END WHEN question_type = 'multiple_choice' THEN f1 ELSE 0.0 END::DOUBLE AS report_score FROM sf),
placed AS (SELECT res.*, que.position.start_pos AS start_pos, que.position.end_pos AS end_pos FROM res JOIN que ON res.q_id = que.q_id
  WHERE que.position.start_pos >= 0 AND que.position.end_pos > que.position.start_pos)
"""


def _q(sql: str | None = None, raw: bool = False):
    def add(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql if raw else f"WITH {_CTE.strip()}{sql}" if sql.startswith(",") else f"WITH {_CTE.strip()}\n{sql}"
        return f

    return add


def _r(c: Column | str) -> Column:
    return F.round(c, 9)


def _once(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    return table(spark, d, name).dropDuplicates([key])


def _results(s, d):
    return _once(s, d, "results", "result_id")


def _questions(s, d):
    return _once(s, d, "questions", "q_id")


def _placed(s, d):
    q = _questions(s, d).select("q_id", "position.start_pos", "position.end_pos").where("start_pos >= 0 and end_pos > start_pos")
    return _results(s, d).join(q, "q_id")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(_r(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema))


_COUNTS = """count(*) AS total, count(*) FILTER (question_type = 'single_choice') AS single_choice, count(*) FILTER (question_type = 'multiple_choice') AS multiple_choice,
count(*) FILTER (question_type = 'negative_question') AS negative_question, count(*) FILTER (category = 'correct') AS correct, count(*) FILTER (category = 'partially_correct') AS partially_correct,
count(*) FILTER (category = 'incorrect') AS incorrect, count(*) FILTER (category = 'parsing_error') AS parsing_error,
round(coalesce(avg(CASE WHEN correct_answer = model_answer THEN 1.0 ELSE 0.0 END) FILTER (question_type = 'single_choice'), 0), 9) AS single_accuracy,
round(coalesce(avg(p) FILTER (question_type = 'multiple_choice'), 0), 9) AS multi_precision, round(coalesce(avg(r) FILTER (question_type = 'multiple_choice'), 0), 9) AS multi_recall,
round(coalesce(avg(f1) FILTER (question_type = 'multiple_choice'), 0), 9) AS multi_f1_score, round(coalesce(avg(report_score), 0), 9) AS mean_score"""


@_q(f"SELECT {_COUNTS} FROM scored")
def all_metrics(s: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.all_metrics(_results(s, d)))


@_q(f"SELECT model_name, {_COUNTS} FROM scored GROUP BY model_name")
def metrics_by_model(s, d):
    return _rounded(metrics.all_metrics(_results(s, d), "model_name"))


@_q("SELECT novel_id, count(*) FILTER (category = 'correct') AS correct, count(*) FILTER (category = 'partially_correct') AS partially_correct, count(*) FILTER (category = 'incorrect') AS incorrect, count(*) FILTER (category = 'parsing_error') AS parsing_error FROM scored GROUP BY novel_id")
def category_counts(s, d):
    return metrics.category_counts(_results(s, d), "novel_id")


@_q("SELECT result_id, category, round(report_score, 9) AS report_score, CASE WHEN parsing_status = 'parsing_error' THEN 'gray' WHEN report_score = 1 THEN 'green' WHEN report_score > 0 THEN 'yellow' ELSE 'red' END AS color FROM scored")
def row_scores(s, d):
    x = metrics.scored(_results(s, d))
    return x.select("result_id", "category", _r("report_score").alias("report_score"), A.color(F.col("report_score"), F.col("parsing_status")).alias("color"))


@_q("""SELECT result_id, round(CASE WHEN question_type = 'single_choice' THEN CASE WHEN ca = ma THEN 1 ELSE 0 END WHEN question_type = 'multiple_choice' THEN f1 ELSE 0 END::DOUBLE, 9) AS test_score,
CASE WHEN question_type = 'multiple_choice' THEN round(p, 9) END AS precision_value, CASE WHEN question_type = 'multiple_choice' THEN round(r, 9) END AS recall_value FROM scored""")
def testtime_scores(s, d):
    k, c, m = F.col("question_type"), F.col("correct_answer"), F.col("model_answer")
    x = _results(s, d).select("result_id", _r(A.test_score(k, c, m)).alias("test_score"), A.test_metrics(k, c, m).alias("metrics"))
    return x.select("result_id", "test_score", _r(F.try_element_at("metrics", F.lit("precision"))).alias("precision_value"), _r(F.try_element_at("metrics", F.lit("recall"))).alias("recall_value"))


_EDGES = f"edges AS (SELECT CAST(i AS INTEGER) AS bin, CAST(floor(i * ({LENGTH}.0 / {BINS})) AS BIGINT) AS start_pos, CASE WHEN i < {BINS - 1} THEN CAST(floor((i + 1) * ({LENGTH}.0 / {BINS})) AS BIGINT) ELSE {LENGTH} END AS end_pos FROM range({BINS}) t(i))"
_ACC = f"acc AS (SELECT CAST(greatest(least(trunc(start_pos / ({LENGTH}.0 / {BINS})), {BINS - 1}), 0) AS INTEGER) AS bin, avg(score) AS accuracy, count(*) AS question_count FROM placed GROUP BY 1)"


@_q(f", {_EDGES}, {_ACC} SELECT e.bin, e.start_pos, e.end_pos, round(accuracy, 9) AS accuracy, coalesce(question_count, 0) AS question_count FROM edges e LEFT JOIN acc ON e.bin = acc.bin")
def accuracy_bins(s, d):
    return _rounded(bins.accuracy_bins(_placed(s, d), LENGTH, BINS))


_COV = f"""{_EDGES}, raw AS (SELECT e.bin, sum((least(q.position.end_pos, e.end_pos) - greatest(q.position.start_pos, e.start_pos)) / (q.position.end_pos - q.position.start_pos)) AS raw
FROM edges e JOIN que q ON q.position.start_pos < e.end_pos AND q.position.end_pos > e.start_pos AND q.position.end_pos > q.position.start_pos GROUP BY 1),
cov AS (SELECT e.bin, e.start_pos, e.end_pos, coalesce(raw, 0) AS raw, coalesce(raw, 0) / (SELECT max(raw) FROM raw) AS coverage FROM edges e LEFT JOIN raw ON e.bin = raw.bin)"""


@_q(f", {_COV} SELECT bin, start_pos, end_pos, round(raw, 6) AS raw, round(coverage, 6) AS coverage FROM cov")
def coverage_bins(s, d):
    q = _questions(s, d).select("position.start_pos", "position.end_pos")
    return bins.coverage_bins(q, LENGTH, BINS).withColumns({"raw": F.round("raw", 6), "coverage": F.round("coverage", 6)})


@_q(f", {_COV}, {_ACC} SELECT c.bin, round(coverage, 6) AS coverage, round(accuracy, 6) AS accuracy, coalesce(question_count, 0) AS question_count FROM cov c LEFT JOIN acc ON c.bin = acc.bin")
def combined_bins(s, d):
    q = _questions(s, d).select("position.start_pos", "position.end_pos")
    return bins.combined_bins(q, _placed(s, d), LENGTH, BINS).select("bin", F.round("coverage", 6).alias("coverage"), F.round("accuracy", 6).alias("accuracy"), "question_count")


_GRID = """okd AS (SELECT * FROM res WHERE depth_bin IS NOT NULL AND test_context_length IS NOT NULL AND score IS NOT NULL),
labels AS (SELECT unnest(['0%', '25%', '50%', '75%', '100%']) AS depth_bin), lens AS (SELECT DISTINCT test_context_length FROM okd),
cells AS (SELECT test_context_length, depth_bin, avg(score) AS accuracy, count(*) AS question_count FROM okd GROUP BY ALL),
grid AS (SELECT lens.test_context_length, labels.depth_bin, accuracy, coalesce(question_count, 0) AS question_count FROM lens CROSS JOIN labels LEFT JOIN cells USING (test_context_length, depth_bin))"""


@_q(f", {_GRID} SELECT test_context_length, depth_bin, round(accuracy, 9) AS accuracy, question_count FROM grid")
def depth_grid(s, d):
    return _rounded(bins.depth_grid(_results(s, d)))


@_q(f", {_GRID} SELECT test_context_length, round(avg(accuracy), 9) AS accuracy FROM grid GROUP BY 1")
def depth_column_avg(s, d):
    return _rounded(bins.column_averages(bins.depth_grid(_results(s, d))))


@_q(f", {_GRID} SELECT round(sum(accuracy * question_count) / sum(question_count) FILTER (accuracy IS NOT NULL), 9) AS accuracy FROM grid")
def weighted_avg_accuracy(s, d):
    return _rounded(bins.weighted_accuracy(bins.depth_grid(_results(s, d))))


@_q(f""", {_GRID} SELECT CAST(list_position(['100%', '75%', '50%', '25%', '0%'], depth_bin) AS INTEGER) AS row, depth_bin, {', '.join(f"round(coalesce(max(accuracy) FILTER (test_context_length = {n}), -0.05), 9) AS len_{n}" for n in LENGTHS)} FROM grid GROUP BY depth_bin""")
def depth_pivot(s, d):
    return _rounded(bins.depth_pivot(bins.depth_grid(_results(s, d)), LENGTHS))


@_q("""SELECT novel_id, result_id, start_pos, score, round(CASE WHEN count(*) OVER (PARTITION BY novel_id) < 20 THEN score ELSE avg(score) OVER (PARTITION BY novel_id ORDER BY start_pos, result_id ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) END, 9) AS trend FROM placed""")
def trend_line(s, d):
    return _rounded(sequence.trend_line(_placed(s, d), "novel_id", tie="result_id"))


@_q("""SELECT model_name, count(*) AS total, count(*) FILTER (parsing_status = 'success') AS success, count(*) FILTER (parsing_status = 'regex_extracted') AS regex_extracted,
count(*) FILTER (parsing_status = 'error') AS error, count(*) FILTER (parsing_status = 'timeout') AS timeout, count(*) FILTER (parsing_status = 'context_build_error') AS context_build_error, count(*) FILTER (parsing_status = 'parsing_error') AS parsing_error,
count(*) FILTER (question_type = 'single_choice') AS single_choice, count(*) FILTER (question_type = 'multiple_choice') AS multiple_choice, round(avg(coalesce(score, 0)), 9) AS mean_score FROM res GROUP BY 1""")
def run_summary(s, d):
    return _rounded(metrics.run_summary(_results(s, d), "model_name"))


@_q("""SELECT depth_bin, test_context_length, count(*) AS n, round(avg(score), 9) AS mean_score FROM (SELECT coalesce(depth_bin, 'unknown') AS depth_bin, coalesce(test_context_length, 0) AS test_context_length, coalesce(score, 0) AS score FROM res)
GROUP BY GROUPING SETS ((depth_bin), (test_context_length))""")
def depth_summary(s, d):
    return _rounded(metrics.depth_summary(_results(s, d)))


@_q("""SELECT model_name, count(*) AS total, count(*) FILTER (question_type = 'single_choice') AS single_choice, count(*) FILTER (question_type = 'multiple_choice') AS multiple_choice, round(avg(coalesce(score, 0)), 9) AS mean_score,
round(coalesce(avg(CASE WHEN score = 1 THEN 1.0 ELSE 0.0 END) FILTER (question_type = 'single_choice'), 0), 9) AS single_accuracy, round(coalesce(avg(coalesce(metrics['f1_score'], 0)) FILTER (question_type = 'multiple_choice'), 0), 9) AS multi_f1 FROM res GROUP BY 1""")
def noref_summary(s, d):
    return _rounded(metrics.no_reference_summary(_results(s, d), "model_name"))


@_q("""SELECT count(*) AS total, count(*) FILTER (is_valid) AS passed, count(*) FILTER (NOT coalesce(is_valid, false)) AS failed, round(avg(CASE WHEN is_valid THEN 1.0 ELSE 0.0 END), 9) AS pass_rate,
count(*) FILTER (NOT coalesce(answer_matches, false)) AS answer_mismatch, count(*) FILTER (NOT coalesce(evidence_found, false)) AS evidence_not_found, count(*) FILTER (NOT coalesce(is_answerable, false)) AS not_answerable, count(*) FILTER (coalesce(confidence, 'low') = 'low') AS low_confidence FROM val""")
def validation_stats(s, d):
    return _rounded(metrics.validation_stats(_once(s, d, "validations", "validation_id")))


@_q("SELECT novel_id, count(*) FILTER (category <> 'correct') AS errors, count(*) AS total, round(avg(CASE WHEN category <> 'correct' THEN 1.0 ELSE 0.0 END), 9) AS error_rate FROM scored GROUP BY 1")
def error_rate(s, d):
    return _rounded(metrics.error_rate(_results(s, d), "novel_id"))


@_q("""SELECT model_name, CAST(sum(coalesce(total_questions, 0)) AS BIGINT) AS asked, CAST(sum(coalesce(got, 0)) AS BIGINT) AS got, round(coalesce(sum(coalesce(got, 0)) / nullif(sum(coalesce(total_questions, 0)), 0), 0), 9) AS success_rate, CAST(sum(coalesce(single, 0)) AS BIGINT) AS single_choice, CAST(sum(coalesce(multiple, 0)) AS BIGINT) AS multiple_choice
FROM sets LEFT JOIN (SELECT set_id, count(*) AS got, count(*) FILTER (question_type = 'single_choice') AS single, count(*) FILTER (question_type = 'multiple_choice') AS multiple FROM que GROUP BY 1) g USING (set_id) GROUP BY 1""")
def generation_summary(s, d):
    return _rounded(metrics.generation_summary(_once(s, d, "question_sets", "set_id"), _questions(s, d), "model_name"))


@_q("SELECT parsing_status, count(*) AS n FROM res WHERE parsing_status IN ('error', 'timeout', 'context_build_error', 'parsing_error') GROUP BY 1")
def failure_breakdown(s, d):
    return recovery.failure_breakdown(_results(s, d))


@_q("SELECT result_id, assignment_id, q_id FROM res WHERE parsing_status IN ('error', 'timeout', 'context_build_error', 'parsing_error')")
def failed_results(s, d):
    return recovery.failed_results(_results(s, d)).select("result_id", "assignment_id", "q_id")


_MERGE = """prev AS (SELECT * FROM res QUALIFY row_number() OVER (PARTITION BY assignment_id ORDER BY tested_at, result_id) = 1 OR assignment_id IS NULL),
later AS (SELECT DISTINCT ON (assignment_id) res.* FROM res ANTI JOIN prev USING (result_id) WHERE res.assignment_id IS NOT NULL ORDER BY assignment_id, res.result_id DESC)"""


def _runs(s, d):
    """First and later results of each assignment; results without one are all first, and no window gathers them."""
    from pyspark.sql import Window as W

    r = _results(s, d).select("result_id", "assignment_id", "parsing_status", "score", "tested_at")
    rank = F.row_number().over(W.partitionBy("assignment_id").orderBy("tested_at", "result_id"))
    known = r.where("assignment_id is not null").withColumn("n", rank)
    return known.where("n = 1").drop("n", "tested_at").unionByName(r.where("assignment_id is null").drop("tested_at")), known.where("n > 1").drop("n", "tested_at")


@_q(f""", {_MERGE} SELECT prev.assignment_id, prev.result_id, coalesce(later.parsing_status, prev.parsing_status) AS parsing_status, CASE WHEN later.result_id IS NOT NULL THEN later.score ELSE prev.score END AS score, later.result_id IS NOT NULL AS was_recovered FROM prev LEFT JOIN later ON prev.assignment_id = later.assignment_id""")
def recovery_merge(s, d):
    first, later = _runs(s, d)
    return recovery.merge_recovered(first, later, "assignment_id", "result_id", "result_id")


@_q(f", {_MERGE} SELECT count(*) AS retried, count(*) FILTER (parsing_status NOT IN ('error', 'timeout', 'context_build_error', 'parsing_error')) AS recovered, count(*) FILTER (parsing_status IN ('error', 'timeout', 'context_build_error', 'parsing_error')) AS still_failed FROM later")
def recovery_counts(s, d):
    later = _runs(s, d)[1].where("assignment_id is not null")
    last = later.groupBy("assignment_id").agg(F.max_by("parsing_status", "result_id").alias("parsing_status"))
    return recovery.recovery_counts(last)


@_q("""SELECT result_id, q_id, first_q, question FROM (SELECT res.result_id, que.question, max(k.q_id) AS q_id, min(k.q_id) AS first_q FROM res JOIN que ON res.q_id = que.q_id JOIN que k ON k.question = que.question WHERE res.parsing_status IN ('error', 'timeout', 'context_build_error', 'parsing_error') GROUP BY ALL)""")
def retry_rows(s, d):
    q = _questions(s, d).select("q_id", "question")
    r = _results(s, d).select("result_id", "q_id", "parsing_status").join(q, "q_id").drop("q_id")
    return recovery.retry_rows(r, q, "question", "q_id").select("result_id", F.col("asked.q_id").alias("q_id"), F.col("first_q_id").alias("first_q"), "question")


@_q("SELECT result_id, CASE WHEN depth IS NULL THEN NULL WHEN depth <= 0.125 THEN '0%' WHEN depth <= 0.375 THEN '25%' WHEN depth <= 0.625 THEN '50%' WHEN depth <= 0.875 THEN '75%' ELSE '100%' END AS label FROM res")
def depth_bin_label(s, d):
    return _results(s, d).select("result_id", rules.depth_label(F.col("depth")).alias("label"))


_IDX = "numbered AS (SELECT q_id, row_number() OVER (ORDER BY q_id) - 1 AS idx FROM que)"


@_q(f", {_IDX} SELECT q_id, idx, ([0.0, 0.25, 0.5, 0.75, 1.0])[(idx % 20) % 5 + 1]::DOUBLE AS target_depth, (['0%', '25%', '50%', '75%', '100%'])[(idx % 20) % 5 + 1] AS depth_bin, ([32000, 64000, 128000, 200000])[(idx % 20) // 5 + 1] AS context_length FROM numbered")
def schedule_uniform(s, d):
    return sequence.schedule(sequence.numbered(_questions(s, d).select("q_id"), ["q_id"]), "uniform", LENGTHS)


@_q(f", {_IDX} SELECT q_id, idx, 0.4::DOUBLE AS target_depth, '50%' AS depth_bin, ([32000, 64000, 128000, 200000])[idx % 4 + 1] AS context_length FROM numbered")
def schedule_fixed(s, d):
    return sequence.schedule(sequence.numbered(_questions(s, d).select("q_id"), ["q_id"]), "fixed", LENGTHS, 0.4)


@_q("SELECT novel_id, level, range_start, CAST(questions AS BIGINT) AS questions, CAST(sum(questions) OVER (PARTITION BY novel_id ORDER BY level) AS BIGINT) AS running_total FROM (SELECT novel_id, level, range_start, CASE WHEN level > total_tokens THEN 0 ELSE greatest(5, ((level - range_start) // 10000) * 5) END AS questions FROM novels, (SELECT level, coalesce(lag(level) OVER (ORDER BY level), 0) AS range_start FROM (SELECT unnest([2000, 4000, 8000, 16000, 32000, 64000, 128000, 192000, 256000, 512000, 1000000, 2000000]) AS level)) WHERE total_tokens IS NOT NULL)", raw=True)
def level_plan(s, d):
    return sequence.level_plan(s, table(s, d, "novels"))


_MD5 = lambda key, seed=0: f"md5(concat({key}, '|{seed}'))"


@_q(f"SELECT novel_id, layer, k, layer * 50000 + CAST(('0x' || substr({_MD5('novel_id || chr(45) || layer || chr(45) || k')}, 1, 7)) AS BIGINT) % least(50000, total_tokens - layer * 50000) AS position FROM (SELECT *, unnest(range(20 // layers + CASE WHEN layer < 20 % layers THEN 1 ELSE 0 END)) AS k FROM (SELECT novel_id, total_tokens, CAST(ceil(total_tokens / 50000) AS BIGINT) AS layers, unnest(range(CAST(ceil(total_tokens / 50000) AS BIGINT))) AS layer FROM novels WHERE total_tokens > 0))", raw=True)
def stratified_sample(s, d):
    return sampling.sampling_strategy("Stratified")(table(s, d, "novels"), "novel_id", "total_tokens", 20)


@_q(f"""SELECT novel_id, position FROM (SELECT novel_id, position, min(turn) AS turn FROM (SELECT novel_id, CASE WHEN total_tokens <= 80 THEN k ELSE h % total_tokens END AS position, CASE WHEN total_tokens <= 80 THEN h ELSE k END AS turn
FROM (SELECT novel_id, total_tokens, k, CAST(('0x' || substr({_MD5('novel_id || chr(45) || k')}, 1, 7)) AS BIGINT) AS h FROM (SELECT novel_id, total_tokens, unnest(range(CASE WHEN total_tokens <= 80 THEN total_tokens ELSE 104 END)) AS k FROM novels WHERE total_tokens > 0))) GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY novel_id ORDER BY turn, position) <= 20""", raw=True)
def random_sample(s, d):
    return sampling.sampling_strategy("random")(table(s, d, "novels"), "novel_id", "total_tokens", 20)


_DEPTH_SAMPLE = f"""dq AS (SELECT q_id, position.end_pos AS end_pos, CAST(least(trunc(greatest(0.0, least(1.0, coalesce(position.end_pos, 0) / 400000)) * 5), 4) AS INTEGER) AS b, {_MD5('q_id')} AS h, {_MD5('q_id', 1)} AS h1 FROM que),
pass1 AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY h, q_id) AS rn FROM dq), taken AS (SELECT q_id, b FROM pass1 WHERE rn <= 60 + CASE WHEN b < 3 THEN 1 ELSE 0 END),
extra AS (SELECT q_id, b FROM dq ANTI JOIN taken USING (q_id) ORDER BY h1, q_id LIMIT (303 - (SELECT count(*) FROM taken)))"""


@_q(f", {_DEPTH_SAMPLE} SELECT q_id, b AS depth_bin_index FROM taken UNION ALL SELECT q_id, b FROM extra")
def depth_sample(s, d):
    q = _questions(s, d).select("q_id", "position.end_pos")
    return sampling.sample_by_depth(q, "q_id", "end_pos", 303, 400_000).select("q_id", "depth_bin_index")


@_q(f"SELECT result_id, category FROM scored WHERE category <> 'correct' ORDER BY {_MD5('result_id')}, result_id LIMIT 50")
def error_sample(s, d):
    bad = metrics.scored(_results(s, d)).where(F.col("category").isin("incorrect", "partially_correct", "parsing_error")).select("result_id", "category")
    return sampling.first_by_hash(bad, "result_id", 50)


@_q(f"SELECT novel_id, result_id FROM scored WHERE category <> 'correct' QUALIFY row_number() OVER (PARTITION BY novel_id ORDER BY {_MD5('result_id')}, result_id) <= 3")
def error_sample_by_novel(s, d):
    bad = metrics.scored(_results(s, d)).where("category <> 'correct'").select("novel_id", "result_id")
    return sampling.sample_each(bad, "novel_id", "result_id", 3)


@_q(f"SELECT q_id, (['single_choice', 'multiple_choice'])[CAST(('0x' || substr({_MD5('q_id')}, 1, 7)) AS BIGINT) % 2 + 1] AS question_type FROM que")
def random_question_type(s, d):
    return _questions(s, d).select("q_id", sampling.random_choice(F.col("q_id"), ("single_choice", "multiple_choice")).alias("question_type"))


_STRUCT = r"""CASE WHEN question IS NULL OR regexp_full_match(question, '[\s\x{00A0}\x{3000}\x{2000}-\x{200A}\x{202F}\x{205F}]*') THEN 'the question is blank' WHEN question_type IS NULL THEN 'the question has no type' WHEN choice IS NULL THEN 'the question has no choices'
WHEN cardinality(choice) < 2 THEN 'there are fewer than two choices' WHEN len(list_filter(map_values(choice), lambda v: v IS NULL)) > 0 THEN 'a choice has no text' WHEN answer IS NULL THEN 'the question has no answer list' WHEN len(answer) = 0 THEN 'the answer list is empty'
WHEN position IS NULL THEN 'the question has no position' WHEN position.start_pos IS NULL OR position.end_pos IS NULL THEN 'an end of the position is missing' WHEN position.start_pos < 0 THEN 'the position starts before the text' WHEN position.end_pos < position.start_pos THEN 'the position ends before it starts' END"""
_CONTENT = "CASE WHEN coalesce(question_type, '') NOT IN ('single_choice', 'multiple_choice', 'negative_question') THEN 'the type is not known' WHEN question_type = 'multiple_choice' AND cardinality(choice) - len(answer) < 2 THEN 'there are fewer than two wrong choices' END"
_ANSWER = "CASE WHEN len(list_filter(coalesce(answer, []), lambda a: a IS NULL)) > 0 THEN 'an answer has no text' WHEN len(list_filter(coalesce(answer, []), lambda a: NOT coalesce(list_contains(map_keys(choice), a), false))) > 0 THEN 'answer is not a choice' END"
_COLS = ("question", "question_type", "choice", "answer", "position")


@_q(f"SELECT q_id, {_STRUCT} AS error FROM que")
def structure_validation(s, d):
    return _questions(s, d).select("q_id", rules.structure_error(*map(F.col, _COLS)).alias("error"))


@_q(f"SELECT q_id, {_CONTENT} AS error FROM que")
def content_validation(s, d):
    return _questions(s, d).select("q_id", rules.content_error(*map(F.col, ("question_type", "choice", "answer"))).alias("error"))


@_q(f"SELECT q_id, {_ANSWER} AS error FROM que")
def answer_subset(s, d):
    return _questions(s, d).select("q_id", rules.answer_error(F.col("choice"), F.col("answer")).alias("error"))


@_q(f"SELECT q_id, coalesce({_STRUCT}, {_CONTENT}, {_ANSWER}) AS error FROM que")
def question_validation(s, d):
    return _questions(s, d).select("q_id", rules.question_error(*map(F.col, _COLS)).alias("error"))


_NORM = lambda a: f"list_sort(list_filter(list_transform({a}, lambda x: trim(lower(x))), lambda x: x <> ''))"


@_q(f"SELECT validation_id, array_to_string({_NORM('coalesce(model_answer, [])')}, ',') AS answers FROM val")
def answer_normalize(s, d):
    return _once(s, d, "validations", "validation_id").select("validation_id", F.array_join(A.normalized("model_answer"), ",").alias("answers"))


@_q(f"""SELECT validation_id, CASE WHEN question_type = 'multiple_choice' THEN list_sort(list_distinct({_NORM('coalesce(que.answer, [])')})) = list_sort(list_distinct({_NORM('coalesce(val.model_answer, [])')})) ELSE {_NORM('coalesce(que.answer, [])')} = {_NORM('coalesce(val.model_answer, [])')} END AS same FROM val JOIN que ON val.q_id = que.q_id""")
def answer_compare(s, d):
    v = _once(s, d, "validations", "validation_id").select("validation_id", "q_id", "model_answer")
    return v.join(_questions(s, d).select("q_id", "answer", "question_type"), "q_id").select("validation_id", A.matches(F.col("answer"), F.col("model_answer"), F.col("question_type")).alias("same"))


@_q("""SELECT validation_id, CAST(greatest(coalesce(list_position(['low', 'medium', 'high'], confidence), 0) - 1, 0) AS INTEGER) AS rank,
array_to_string(list_filter([CASE WHEN NOT coalesce(answer_matches, false) THEN 'answer mismatch' END, CASE WHEN NOT coalesce(evidence_found, false) THEN 'evidence not found' END, CASE WHEN NOT coalesce(is_answerable, false) THEN 'not answerable' END, CASE WHEN coalesce(confidence, '') NOT IN ('medium', 'high') THEN 'confidence too low' END], lambda x: x IS NOT NULL), ';') AS reasons FROM val""")
def validation_reasons(s, d):
    v = _once(s, d, "validations", "validation_id")
    c = F.col("confidence")
    return v.select("validation_id", rules.confidence_rank(c).alias("rank"), F.array_join(rules.failure_reasons(F.col("answer_matches"), F.col("evidence_found"), F.col("is_answerable"), c), ";").alias("reasons"))


@_q("""SELECT validation_id, CASE WHEN confidence IN ('low', 'medium', 'high') THEN confidence ELSE 'low' END AS confidence, CASE WHEN isnan(evidence_similarity) THEN 1.0 ELSE greatest(0.0, least(1.0, evidence_similarity)) END::DOUBLE AS similarity,
array_to_string(CASE WHEN is_valid THEN []::VARCHAR[] WHEN len(coalesce(failure_reasons, [])) = 0 THEN ['Unknown validation failure'] ELSE failure_reasons END, ';') AS reasons FROM (SELECT * REPLACE (coalesce(evidence_similarity, 1.0) AS evidence_similarity) FROM val)""")
def validation_invariants(s, d):
    v = _once(s, d, "validations", "validation_id")
    x = v.select("validation_id", rules.settled_validation(F.col("is_valid"), F.col("evidence_similarity"), F.col("confidence"), F.col("failure_reasons")).alias("v"))
    return x.select("validation_id", "v.confidence", F.col("v.evidence_similarity").alias("similarity"), F.array_join("v.failure_reasons", ";").alias("reasons"))


@_q("SELECT q_id, bool_or(is_valid) AS is_valid FROM (SELECT que.q_id, coalesce(val.is_valid, false) AS is_valid FROM que JOIN val ON que.q_id = val.q_id) GROUP BY 1 HAVING bool_or(is_valid)")
def precheck_filter(s, d):
    v = _once(s, d, "validations", "validation_id").groupBy("q_id").agg(F.max(F.coalesce("is_valid", F.lit(False))).alias("is_valid"))
    q = _questions(s, d).select("q_id").join(v, "q_id").withColumn("has_validation", F.lit(True))
    return checks.precheck(q, ignore_invalid=True).select("q_id", "is_valid")


@_q("""SELECT q_id, ok IS NOT NULL AS has_validation, ok AS is_valid, CASE WHEN ok IS NULL THEN 'not validated' WHEN NOT ok THEN 'not valid' END AS problem FROM que LEFT JOIN (SELECT q_id, bool_or(coalesce(is_valid, false)) AS ok FROM val GROUP BY 1) v USING (q_id)""")
def precheck_report(s, d):
    return checks.precheck_report(_questions(s, d), _once(s, d, "validations", "validation_id"))


@_q(f"SELECT q_id FROM que WHERE coalesce(position.end_pos, 0) + {PADDING} <= 32000")
def fits_in_context(s, d):
    return checks.fitting(_questions(s, d).select("q_id", "position.end_pos"), "end_pos", PADDING, 32_000).select("q_id")


@_q(f"""SELECT novel_id, min_end, max_end, testable, CASE WHEN n IS NULL THEN 'the novel has no tokens' WHEN 200000 > n THEN 'a context length exceeds the novel' WHEN min_end IS NULL THEN 'no question has a position' WHEN 32000 < min_end + {PADDING} THEN 'the shortest context length ends before the first question' WHEN testable = 0 THEN 'no question fits any context length' END AS error
FROM (SELECT que.novel_id, min(position.end_pos) FILTER (position.end_pos > 0) AS min_end, max(position.end_pos) FILTER (position.end_pos > 0) AS max_end, count(*) FILTER (position.end_pos - position.start_pos + {2 * PADDING} < 200000) AS testable, max(total_tokens) AS n FROM que LEFT JOIN novels ON novels.novel_id = que.novel_id GROUP BY 1)""")
def length_feasibility_by_novel(s, d):
    q = _questions(s, d).select("novel_id", "position.start_pos", "position.end_pos").join(table(s, d, "novels").select("novel_id", "total_tokens"), "novel_id", "left")
    return checks.length_report(q, LENGTHS, "total_tokens", PADDING, by="novel_id")


@_q(f"""SELECT min(position.end_pos) FILTER (position.end_pos > 0) AS min_end, max(position.end_pos) FILTER (position.end_pos > 0) AS max_end, count(*) FILTER (position.end_pos - position.start_pos + {2 * PADDING} < 200000) AS testable,
CASE WHEN min(position.end_pos) FILTER (position.end_pos > 0) + {PADDING} > 32000 THEN 'the shortest context length ends before the first question' END AS error FROM que""")
def length_feasibility(s, d):
    return checks.length_report(_questions(s, d).select("position.start_pos", "position.end_pos"), LENGTHS, 2_400_000, PADDING)


@_q("SELECT coalesce(CAST(trunc(max(position.end_pos) FILTER (position.end_pos > 0) * 1.2::DOUBLE) AS BIGINT), 100000) AS novel_length FROM que")
def estimated_length(s, d):
    return checks.estimated_novel_length(_questions(s, d).select("position.end_pos"))


@_q("SELECT DISTINCT test_context_length FROM res WHERE test_context_length IS NOT NULL")
def distinct_lengths(s, d):
    return table(s, d, "results").where("test_context_length is not null").select("test_context_length").distinct()


@_q("SELECT depth_bin, context_length, count(*) AS n FROM asg GROUP BY ALL")
def assignment_distribution(s, d):
    return _once(s, d, "depth_assignments", "assignment_id").groupBy("depth_bin", "context_length").agg(F.count("*").alias("n"))


@_q(r"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+')) AS INTEGER) AS n_tokens FROM documents", raw=True)
def token_counts(s, d):
    return table(s, d, "documents").select("doc_id", tokens.count_tokens(F.coalesce("text", F.lit(""))).alias("n_tokens"))


_TOK = r"regexp_extract_all(coalesce(text, ''), '[ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+')"


@_q(f"SELECT doc_id, array_to_string(({_TOK})[1:50], '') AS head FROM documents", raw=True)
def first_n_context(s, d):
    return table(s, d, "documents").select("doc_id", tokens.decode(tokens.first_tokens(tokens.encode(F.coalesce("text", F.lit(""))), 50)).alias("head"))


@_q(f"SELECT doc_id, array_to_string(({_TOK})[n_chars % 40 + 1 : n_chars % 40 + 20], '') AS part FROM documents", raw=True)
def evidence_slice(s, d):
    at = F.col("n_chars") % 40
    return table(s, d, "documents").select("doc_id", tokens.decode(tokens.token_slice(tokens.encode(F.coalesce("text", F.lit(""))), at, at + 20)).alias("part"))


@_q(f"SELECT doc_id, array_to_string(({_TOK})[1:{LENGTH}], '') AS head FROM documents", raw=True)
def first_n_context_full(s, d):
    return table(s, d, "documents").select("doc_id", tokens.decode(tokens.first_tokens(tokens.encode(F.coalesce("text", F.lit(""))), LENGTH)).alias("head"))


@_q(f"SELECT doc_id, array_to_string(tok[p + 1 : p + {2 * PADDING}], '') AS part FROM (SELECT doc_id, tok, CAST(('0x' || substr({_MD5('doc_id')}, 1, 7)) AS BIGINT) % greatest(len(tok), 1) AS p FROM (SELECT doc_id, {_TOK} AS tok FROM documents))", raw=True)
def evidence_slice_full(s, d):
    """As long as the padding on both sides of a question, at places over the whole text."""
    docs = table(s, d, "documents").select("doc_id", tokens.encode(F.coalesce("text", F.lit(""))).alias("tokens"))
    at = sampling.seeded_number(F.col("doc_id")) % F.greatest(F.size("tokens"), F.lit(1))
    return docs.select("doc_id", tokens.decode(tokens.token_slice(F.col("tokens"), at, at + 2 * PADDING)).alias("part"))


_BUILD = f"""j AS (SELECT a.assignment_id, a.target_depth AS dep, a.context_length AS len, q.position.start_pos AS qs, q.position.end_pos AS qe, n.total_tokens AS n FROM asg a JOIN que q ON a.q_id = q.q_id LEFT JOIN novels n ON q.novel_id = n.novel_id),
k AS (SELECT *, least(greatest(0, qs - {PADDING}), n) AS s, least(n, qe + {PADDING}) AS e FROM j),
l AS (SELECT *, greatest(e - s, 0) AS sz, CASE WHEN n IS NULL THEN 'the novel has no tokens' WHEN NOT coalesce(len > 0, false) THEN 'the context length is not positive' WHEN NOT coalesce(dep BETWEEN 0 AND 1, false) THEN 'invalid target depth' WHEN qs IS NULL OR qe IS NULL THEN 'position is missing' WHEN greatest(e - s, 0) >= len THEN 'evidence exceeds the context length' END AS err FROM k),
m AS (SELECT *, CAST(trunc((len - sz) * dep) AS BIGINT) AS wp FROM l),
o AS (SELECT *, least(wp, s) + least(greatest(wp - s, 0), n - e) AS pre, least(len - sz - wp, n - e) + least(greatest(len - sz - wp - (n - e), 0), s) AS suf FROM m)"""


@_q(f""", {_BUILD} SELECT assignment_id, err IS NULL AS success, err AS error_message, CASE WHEN err IS NULL THEN pre ELSE 0 END AS prefix_length, CASE WHEN err IS NULL THEN suf ELSE 0 END AS suffix_length, CASE WHEN err IS NULL THEN pre + sz + suf ELSE 0 END AS total_length, round(CASE WHEN err IS NULL AND pre + sz + suf > 0 THEN pre / (pre + sz + suf) ELSE 0 END, 9) AS actual_depth FROM o""")
def context_build(s, d):
    q = _questions(s, d).select("q_id", "novel_id", "position.start_pos", "position.end_pos")
    a = _once(s, d, "depth_assignments", "assignment_id").join(q, "q_id").join(table(s, d, "novels").select("novel_id", "total_tokens"), "novel_id", "left")
    b = context.build_contexts(a, F.col("start_pos"), F.col("end_pos"), F.col("target_depth"), F.col("context_length"), None, F.col("total_tokens"), PADDING)
    return b.select("assignment_id", "built.success", "built.error_message", "built.prefix_length", "built.suffix_length", "built.total_length", _r("built.actual_depth").alias("actual_depth"))


@_q()
def context_text(s, d):
    """Whole contexts of all assignments whose novel has chapters among the documents; its text is these by doc_id, with an
    empty line between. Evidence beyond the end of that text is empty. A novel is cut into pieces of tokens and only the part
    that a group of assignments takes goes to their task. Contexts are some 300 times as large as what is read, and more where
    novels are longer, so many tasks share them and no file gets large."""
    q = _questions(s, d).select("q_id", "novel_id", "position.start_pos", "position.end_pos")
    a = _once(s, d, "depth_assignments", "assignment_id").where("context_length > 0").select("assignment_id", "q_id", "target_depth", "context_length").join(q, "q_id")
    chapters = table(s, d, "documents").where("kind = 'chapter' and novel_id is not null and text <> ''").select("novel_id", F.struct("doc_id", "text").alias("c"))
    texts = chapters.groupBy("novel_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["text"]), "\n\n").alias("text"))
    novels = texts.select("novel_id", tokens.pieces("text").alias("pieces"))
    a = a.join(novels.select("novel_id", tokens.count_in_pieces(F.col("pieces")).alias("n")), "novel_id")
    b = context.build_contexts(a, F.col("start_pos"), F.col("end_pos"), F.col("target_depth"), F.col("context_length"), None, F.col("n"), PADDING, spans=True)
    b = cut(b.select("assignment_id", "novel_id", "built.success", "built.total_length", *context.SPANS))  # small rows, used twice
    large_rows(s)
    return context.texts_of_spans(b, novels, "novel_id", "assignment_id", 32 * s.sparkContext.defaultParallelism).select("assignment_id", "success", "total_length", "context")


_LINES = "array_to_string(list_transform(map_entries(choice), lambda e: concat(e.key, '. ', e.value)), chr(10))"
_SORTED_LINES = "array_to_string(list_transform(list_sort(map_entries(choice)), lambda e: concat(upper(e.key), '. ', e.value)), chr(10))"


@_q(f"SELECT q_id, {_LINES} AS lines, {_SORTED_LINES} AS sorted_lines FROM que")
def choice_format(s, d):
    return _questions(s, d).select("q_id", text.choice_lines(F.col("choice")).alias("lines"), text.sorted_choice_lines(F.col("choice")).alias("sorted_lines"))


@_q("SELECT q_id, CASE WHEN length(question) > 100 THEN concat(substr(question, 1, 97), '...') ELSE question END AS hover, CASE WHEN length(question) > 50 THEN concat(substr(question, 1, 50), '...') ELSE question END AS preview FROM que")
def hover_truncate(s, d):
    return _questions(s, d).select("q_id", text.hover(F.col("question")).alias("hover"), text.preview(F.col("question")).alias("preview"))


@_q("SELECT result_id, CASE WHEN depth_bin <> '' AND test_context_length <> 0 THEN concat_ws('|', CAST(q_id AS VARCHAR), depth_bin, CAST(test_context_length AS VARCHAR)) ELSE CAST(q_id AS VARCHAR) END AS key FROM res")
def result_key(s, d):
    return _results(s, d).select("result_id", text.result_key(F.col("q_id").cast("string"), F.col("depth_bin"), F.col("test_context_length")).alias("key"))


@_q(f"SELECT q_id, concat('Question: ', coalesce(question, ''), chr(10), 'Choices:', chr(10), coalesce({_LINES}, ''), chr(10), 'Reply as {{\"answer\": []}}') AS prompt FROM que")
def prompt_render(s, d):
    return _questions(s, d).select("q_id", text.render('Question: {question}\nChoices:\n{choices}\nReply as {"answer": []}', question=F.col("question"), choices=text.choice_lines(F.col("choice"))).alias("prompt"))


@_q("SELECT novel_id, CASE WHEN total_tokens >= 1000000 THEN printf('%.2fM', floor(total_tokens / 10000 + 0.5) / 100) WHEN total_tokens >= 1000 THEN printf('%.1fK', floor(total_tokens / 100 + 0.5) / 10) ELSE CAST(total_tokens AS VARCHAR) END AS tokens, replace(list_last(string_split(novel_path, '/')), '.txt', '') AS name, concat(total_tokens // 1000, 'K-', (total_tokens + 4000) // 1000, 'K') AS bin FROM novels WHERE total_tokens IS NOT NULL", raw=True)
def labels(s, d):
    n = F.col("total_tokens")
    return table(s, d, "novels").where(n.isNotNull()).select("novel_id", text.token_count_label(n).alias("tokens"), text.dataset_name(F.col("novel_path"), ".txt").alias("name"), text.bin_label(n, n + 4000).alias("bin"))


@_q(r"SELECT doc_id, CAST(CASE WHEN a > 0 THEN a + 1 ELSE 0 END AS INTEGER) AS first_end FROM (SELECT doc_id, length(regexp_extract(text, '^(?s:(.*?))[.!?][ \t\n\x0B\f\r]', 1)) + CASE WHEN regexp_matches(text, '[.!?][ \t\n\x0B\f\r]') THEN 1 ELSE -999999999 END AS a FROM documents WHERE text IS NOT NULL)", raw=True)
def sentence_boundary(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", text.boundary_after(F.col("text"), F.lit(0)).alias("first_end"))


# Objects in the stored replies are flat, so braces without others inside are all the objects there are.
_REPLY = r"""rt AS (SELECT result_id, raw_answer, trim(raw_answer, chr(32) || chr(9) || chr(10) || chr(13)) AS t FROM res),
rj AS (SELECT *, CASE WHEN t <> '' AND json_valid(t) THEN t::JSON END AS whole, list_filter(regexp_extract_all(raw_answer, '\{[^{}]*\}'), lambda x: json_valid(x)) AS objects FROM rt),
rs AS (SELECT result_id, CASE WHEN coalesce(t, '') = '' THEN 'parsing_error' WHEN whole IS NOT NULL THEN CASE WHEN json_type(whole) = 'OBJECT' THEN 'success' ELSE 'error' END WHEN len(objects) > 0 THEN 'regex_extracted' ELSE 'parsing_error' END AS status,
  CASE WHEN json_type(whole) = 'OBJECT' THEN whole WHEN whole IS NULL AND len(objects) > 0 THEN list_last(objects)::JSON END AS last_object,
  CASE WHEN json_type(whole) = 'OBJECT' THEN whole WHEN len(objects) > 0 THEN objects[1]::JSON END AS first_object, raw_answer FROM rj),
ra AS (SELECT *, CASE WHEN last_object IS NOT NULL THEN coalesce(json_extract_string(last_object, '$.answer[*]'), []) ELSE [] END AS got FROM rs)"""


@_q(f", {_REPLY} SELECT result_id, status, array_to_string(got, ',') AS answers FROM ra")
def parse_answer(s, d):
    return _results(s, d).select("result_id", replies.parse_answer("raw_answer").alias("r")).select("result_id", F.array_join("r.answer", ",").alias("answers"), "r.status")


@_q(f", {_REPLY} SELECT result_id, CAST(json(first_object) AS VARCHAR) AS object FROM ra")
def parse_object(s, d):
    return _results(s, d).select("result_id", F.get_json_object(replies.parse_object("raw_answer"), "$").alias("object"))


@_q()
def text_normalize(s, d):
    return _once(s, d, "validations", "validation_id").select("validation_id", evidence.normalize_text("evidence").alias("text"))


@_q()
def aligned_window(s, d):
    docs = table(s, d, "documents").where("text <> ''").select("doc_id", tokens.encode("text").alias("tokens"))
    w = docs.select("doc_id", tokens.aligned_window(WINDOW)("tokens", sampling.seeded_number(F.col("doc_id")) % F.size("tokens")).alias("w"))
    return w.select("doc_id", "w.start", "w.end", tokens.decode("w.tokens").alias("text"))


@_q(f""", {_REPLY}, rr AS (SELECT ra.result_id, got, coalesce(res.correct_answer, []) AS ca, res.question_type, CASE WHEN ra.raw_answer IS NULL THEN 'timeout' ELSE status END AS st FROM ra JOIN res USING (result_id) JOIN que ON res.q_id = que.q_id),
rn AS (SELECT *, len(list_intersect(ca, got)) AS b, len(list_distinct(ca)) AS nc, len(list_distinct(got)) AS ng FROM rr)
SELECT result_id, st AS parsing_status, array_to_string(got, ',') AS answers, round(CASE WHEN st IN ('error', 'timeout') THEN 0.0 WHEN question_type = 'single_choice' THEN CASE WHEN ca = got THEN 1.0 ELSE 0.0 END WHEN question_type = 'multiple_choice' AND b > 0 THEN 2 * ((b / ng) * (b / nc)) / ((b / ng) + (b / nc)) ELSE 0.0 END::DOUBLE, 9) AS score FROM rn""")
def offline_test_pipeline(s, d):
    """Answers the stored replies give when the whole test is run over them again."""
    from lectern.plans.pipelines import replay

    return replay(_results(s, d), _questions(s, d))


@_q()
def evidence_match(s, d):
    """Whether the stored evidence is found in its context, and how similar the best stretch is where it reaches 0.8."""
    v = _once(s, d, "validations", "validation_id").select("validation_id", "context_id", "evidence")
    c = _once(s, d, "contexts", "context_id").select("context_id", "context")
    both = v.where("context_id is not null").join(c, "context_id", "left").unionByName(v.where("context_id is null").withColumn("context", F.lit(None).cast("string")))
    return evidence.match_evidence(both, "evidence", "context", 0.8, 0.8).select("validation_id", "evidence_found", "evidence_similarity")


_END = r"[.!?][ \t\n\x0B\f\r]"


@_q(rf"""SELECT doc_id, place, CAST(CASE WHEN regexp_matches(tail, '{_END}') THEN place + length(regexp_extract(tail, '^(?s:(.*?)){_END}', 1)) + 2 ELSE place END AS INTEGER) AS sentence_after, CAST(CASE WHEN contains(tail, chr(10) || chr(10)) THEN place + position(chr(10) || chr(10) IN tail) + 1 ELSE place END AS INTEGER) AS paragraph_after,
CAST(CASE WHEN regexp_matches(head, '{_END}') THEN length(head) - length(list_last(string_split_regex(head, '{_END}'))) ELSE place END AS INTEGER) AS sentence_before, CAST(CASE WHEN contains(head, chr(10) || chr(10)) THEN length(head) - length(list_last(string_split(head, chr(10) || chr(10)))) ELSE place END AS INTEGER) AS paragraph_before
FROM (SELECT doc_id, CAST(length(text) // 3 AS INTEGER) AS place, substr(text, 1, length(text) // 3) AS head, substr(text, length(text) // 3 + 1) AS tail FROM documents WHERE text IS NOT NULL)""", raw=True)
def text_boundaries(s, d):
    """Sentence and paragraph ends before and after a place a third into each text."""
    t, at = F.col("text"), F.col("place")
    docs = table(s, d, "documents").where("text is not null").select("doc_id", "text", F.floor(F.length("text") / 3).cast("int").alias("place"))
    p = text.PARAGRAPH_END
    return docs.select("doc_id", "place", text.boundary_after(t, at).alias("sentence_after"), text.boundary_after(t, at, p).alias("paragraph_after"), text.boundary_before(t, at).alias("sentence_before"), text.boundary_before(t, at, p).alias("paragraph_before"))


@_q("SELECT result_id, coalesce(len(ma) > 0 AND len(list_filter(ma, lambda a: NOT coalesce(list_contains(map_keys(choice), a), false))) = 0, false) AS valid FROM sc JOIN que ON sc.q_id = que.q_id")
def valid_answer(s, d):
    keys = F.map_keys("choice")
    return _results(s, d).select("result_id", "q_id", "model_answer").join(_questions(s, d).select("q_id", "choice"), "q_id").select("result_id", A.valid_answer(F.col("model_answer"), keys).alias("valid"))


@_q(f"SELECT question_type, errors, error_rate, {', '.join(c.split(' AS ')[-1] for c in _COUNTS.replace(chr(10), ' ').split(', ') if ' AS ' in c)} FROM (SELECT question_type, count(*) FILTER (category <> 'correct') AS errors, round(avg(CASE WHEN category <> 'correct' THEN 1.0 ELSE 0.0 END), 9) AS error_rate, {_COUNTS} FROM scored GROUP BY 1)")
def report_by_type(s, d):
    """The sections of a report for each type of question."""
    r = _results(s, d)
    rate = metrics.error_rate(r, "question_type").drop("total").withColumnRenamed("question_type", "type_")
    m = metrics.all_metrics(r, "question_type")
    return _rounded(m.join(rate, m["question_type"].eqNullSafe(rate["type_"])).drop("type_"))


@_q("""SELECT result_id, question_type, category, array_to_string(ca, ', ') AS correct, array_to_string(ma, ', ') AS answered, CASE WHEN length(question) > 100 THEN concat(substr(question, 1, 97), '...') ELSE question END AS hover FROM (SELECT scored.*, que.question FROM scored JOIN que ON scored.q_id = que.q_id) WHERE category IN ('incorrect', 'partially_correct', 'parsing_error')""")
def error_cases(s, d):
    q = _questions(s, d).select("q_id", "question")
    bad = metrics.scored(_results(s, d)).where(F.col("category").isin("incorrect", "partially_correct", "parsing_error")).join(q, "q_id")
    join = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ")
    return bad.select("result_id", "question_type", "category", join("correct_answer").alias("correct"), join("model_answer").alias("answered"), text.hover(F.col("question")).alias("hover"))


@_q("""SELECT p.result_id, p.start_pos, round(report_score, 9) AS report_score, CASE WHEN p.parsing_status = 'parsing_error' THEN 'gray' WHEN report_score = 1 THEN 'green' WHEN report_score > 0 THEN 'yellow' ELSE 'red' END AS color FROM placed p JOIN scored USING (result_id)""")
def scatter_points(s, d):
    """What the plot of a report shows of each result."""
    x = metrics.scored(_placed(s, d))
    return x.select("result_id", "start_pos", _r("report_score").alias("report_score"), A.color(F.col("report_score"), F.col("parsing_status")).alias("color"))


@_q(f", {_COV}, {_GRID} SELECT 'coverage' AS part, CAST(bin AS BIGINT) AS x, NULL AS y, round(coverage, 6) AS value FROM cov UNION ALL SELECT 'depth', test_context_length, depth_bin, round(coalesce(accuracy, -0.05), 6) FROM grid UNION ALL SELECT 'mean', test_context_length, NULL, round(avg(accuracy), 6) FROM grid GROUP BY test_context_length")
def combined_depth_cells(s, d):
    """All cells of the combined page: coverage along the text, depth by length, means by length."""
    cov = bins.coverage_bins(_questions(s, d).select("position.start_pos", "position.end_pos"), LENGTH, BINS)
    grid = bins.depth_grid(_results(s, d))
    cell = lambda df, part, x, y, v: df.select(F.lit(part).alias("part"), F.col(x).cast("bigint").alias("x"), (F.col(y) if y else F.lit(None).cast("string")).alias("y"), F.round(v, 6).alias("value"))
    return cell(cov, "coverage", "bin", None, F.col("coverage")).unionByName(cell(grid, "depth", "test_context_length", "depth_bin", F.coalesce("accuracy", F.lit(-0.05)))).unionByName(cell(bins.column_averages(grid), "mean", "test_context_length", None, F.col("accuracy")))


@_q("""SELECT set_id, coalesce(CASE WHEN set_id % 7 = 0 THEN 64000 END, nullif(sets.total_tokens, 0), nullif(novels.total_tokens, 0)) AS context_length FROM sets LEFT JOIN novels ON sets.novel_id = novels.novel_id""")
def context_length_choice(s, d):
    """The context length of each set: one given for every seventh, else the set's tokens, else the novel's."""
    n = table(s, d, "novels").select("novel_id", F.col("total_tokens").alias("novel_tokens"))
    j = _once(s, d, "question_sets", "set_id").join(n, "novel_id", "left")
    return j.select("set_id", bins.length_choice(F.when(F.col("set_id") % 7 == 0, 64_000), F.col("total_tokens"), F.col("novel_tokens")).alias("context_length"))


@_q("""SELECT novel_id, CASE WHEN total_tokens >= 1000000 THEN printf('%.2fM', floor(total_tokens / 10000 + 0.5) / 100) WHEN total_tokens >= 1000 THEN printf('%.1fK', floor(total_tokens / 100 + 0.5) / 10) ELSE CAST(total_tokens AS VARCHAR) END AS tokens, coalesce(max(level) FILTER (level <= total_tokens), 0) AS longest_level, count(level) FILTER (level <= total_tokens) AS levels, CAST(coalesce(sum(questions), 0) AS BIGINT) AS questions
FROM (SELECT novel_id, total_tokens, level, CASE WHEN level > total_tokens THEN 0 ELSE greatest(5, ((level - range_start) // 10000) * 5) END AS questions FROM novels, (SELECT level, coalesce(lag(level) OVER (ORDER BY level), 0) AS range_start FROM (SELECT unnest([2000, 4000, 8000, 16000, 32000, 64000, 128000, 192000, 256000, 512000, 1000000, 2000000]) AS level)) WHERE total_tokens IS NOT NULL) GROUP BY novel_id, total_tokens""", raw=True)
def novel_analysis(s, d):
    """How long each novel is and what can be asked about it."""
    return sequence.novel_analysis(s, table(s, d, "novels"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
