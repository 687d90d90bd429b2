import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import bins, checks, context, metrics, recovery, sampling, sequence


def test_accuracy_and_coverage_of_known_positions(spark):
    starts = [24000, 26000, 45000, 70000, 120000, 130000, 137000]
    rows = [(s, s + 500, 0.0 if k == 1 else 1.0) for k, s in enumerate(starts)] + [(250000, 250400, 1.0), (-5, 10, 1.0)]
    df = spark.createDataFrame(rows, "start_pos bigint, end_pos bigint, score double")
    acc = {r["bin"]: (r["accuracy"], r["question_count"]) for r in bins.accuracy_bins(df, 200_000).collect()}
    assert acc[6] == (0.5, 2) and acc[49] == (1.0, 1) and acc[0] == (1.0, 1) and acc[1] == (None, 0) and len(acc) == 50
    cov = {r["bin"]: r for r in bins.coverage_bins(df, 200_000).collect()}
    assert cov[6]["raw"] == 2.0 and cov[6]["coverage"] == 1.0 and cov[49]["raw"] == 0.0 and cov[0]["raw"] == pytest.approx(10 / 15) and cov[49]["end_pos"] == 200_000


@pytest.mark.parametrize("length, n", [(100, 7), (1000, 50), (13, 1), (10, 20)])
def test_coverage_against_a_loop(spark, length, n):
    rng = random.Random(n)
    qs = [(a := rng.randrange(-5, length + 5), a + rng.randrange(-2, length)) for _ in range(60)]
    want = [0.0] * n
    for s, e in qs:
        for i in range(n):
            lo, hi = int(i * (length / n)), int((i + 1) * (length / n)) if i < n - 1 else length
            if e > s:
                want[i] += max(0, min(e, hi) - max(s, lo)) / (e - s)
    got = [r["raw"] for r in bins.coverage_bins(spark.createDataFrame(qs, "start_pos bigint, end_pos bigint"), length, n).orderBy("bin").collect()]
    assert got == pytest.approx(want)


def test_bins_of_nothing(spark):
    df = spark.createDataFrame([], "start_pos bigint, end_pos bigint, score double")
    assert [r["coverage"] for r in bins.coverage_bins(df, 100, 4).collect()] == [0.0] * 4
    assert [r["accuracy"] for r in bins.accuracy_bins(df, 100, 4).collect()] == [None] * 4
    with pytest.raises(ValueError):
        bins.coverage_bins(df, 0)
    with pytest.raises(ValueError):
        bins.accuracy_bins(df, 10, 0)


def test_depth_grid(spark):
    df = spark.createDataFrame([("0%", 100, 1.0), ("0%", 100, 0.0), ("100%", 200, 1.0), (None, 100, 1.0), ("odd", 100, 1.0)], "depth_bin string, test_context_length bigint, score double")
    grid = bins.depth_grid(df)
    assert grid.count() == 10
    assert {r["test_context_length"]: r["accuracy"] for r in bins.column_averages(grid).collect()} == {100: 0.5, 200: 1.0}
    assert bins.weighted_accuracy(grid).first()["accuracy"] == pytest.approx(2 / 3)
    wide = {r["depth_bin"]: r for r in bins.depth_pivot(grid, [100, 200]).collect()}
    assert wide["0%"]["len_100"] == 0.5 and wide["0%"]["len_200"] == -0.05 and wide["100%"]["row"] == 1
    assert bins.resolved_length(5, None) == 5
    with pytest.raises(ValueError):
        bins.resolved_length(None, None)


def test_metrics_of_nothing_and_quirks(spark):
    schema = "question_type string, correct_answer array<string>, model_answer array<string>, parsing_status string, score double"
    assert metrics.all_metrics(spark.createDataFrame([], schema)).first().asDict()["mean_score"] == 0.0
    df = spark.createDataFrame([("single_choice", ["a"], ["a", "a"], "success", 0.0), ("single_choice", ["a"], ["a"], "parsing_error", 0.0)], schema)
    m = metrics.all_metrics(df).first()
    assert m["single_accuracy"] == 0.5 and m["correct"] == 1 and m["parsing_error"] == 1 and m["mean_score"] == 0.5


@pytest.mark.parametrize("n", [19, 20, 21, 57])
def test_trend_against_a_loop(spark, n):
    rng = random.Random(n)
    rows = [(1, k, rng.randrange(15), float(rng.randrange(5))) for k in range(n)] + [(None, 0, 3, 1.0)]
    df = spark.createDataFrame(rows, "run bigint, idx bigint, start_pos bigint, score double").repartition(3)
    got = {r["idx"]: r["trend"] for r in sequence.trend_line(df, "run", block=7).where("run = 1").collect()}
    order = sorted(rows[:-1], key=lambda r: (r[2], r[1]))
    for i, r in enumerate(order):
        near = [x[3] for x in order[max(0, i - 10) : i + 11]]
        assert got[r[1]] == pytest.approx(r[3] if n < 20 else sum(near) / len(near))


def test_numbering_and_schedules(spark):
    df = spark.range(1000).repartition(7).select((F.col("id") * 3).alias("q"))
    numbered = sequence.numbered(df, ["q"])
    assert [r["idx"] for r in numbered.orderBy("q").collect()] == list(range(1000))
    rows = sequence.schedule(numbered, "uniform", [10, 20]).orderBy("idx").take(11)
    assert [(r["target_depth"], r["depth_bin"], r["context_length"]) for r in rows] == [(d, f"{int(d * 100)}%", n) for n in (10, 20) for d in (0.0, 0.25, 0.5, 0.75, 1.0)] + [(0.0, "0%", 10)]
    assert [r["context_length"] for r in sequence.schedule(numbered, "fixed", [10, 20], 0.3).orderBy("idx").take(3)] == [10, 20, 10]
    for bad in (("legacy", [10], None), ("uniform", [], None), ("fixed", [10], 1.5), ("fixed", [10], None)):
        with pytest.raises(ValueError):
            sequence.schedule(numbered, *bad)


def test_sampling(spark):
    q = spark.range(100).select(F.col("id").alias("q_id"), (F.col("id") * 5 + 1).alias("end_pos"))
    got = sampling.sample_by_depth(q, "q_id", "end_pos", 23, 1000).collect()
    assert len(got) == 23 and len({r["q_id"] for r in got}) == 23
    counts = [sum(r["depth_bin_index"] == b for r in got) for b in range(5)]
    assert counts[0] >= 5 and counts[1] >= 5 and counts[3] == counts[4] == 0
    assert sampling.sample_by_depth(q, "q_id", "end_pos", 0, 1000).count() == 0 and sampling.sample_by_depth(q, "q_id", "end_pos", 100, 1000).count() == 100
    n = spark.createDataFrame([(1, 120_000), (2, 3)], "novel_id bigint, total_tokens bigint")
    rows = sampling.stratified_positions(n, "novel_id", "total_tokens", 7).collect()
    assert [sum(r["novel_id"] == 1 and r["layer"] == k for r in rows) for k in range(3)] == [3, 2, 2]
    assert all(r["layer"] * 50_000 <= r["position"] < {1: 120_000, 2: 3}[r["novel_id"]] for r in rows)
    p = [r["position"] for r in sampling.random_positions(spark, 30, 50).collect()]
    assert sorted(p) == list(range(30)) and p == [r["position"] for r in sampling.random_positions(spark, 30, 50).collect()]
    with pytest.raises(ValueError):
        sampling.sampling_strategy("other")
    assert sampling.sample_each(q.withColumn("g", F.col("q_id") % 2), "g", "q_id", 4).groupBy("g").count().orderBy("g").collect() == [(0, 4), (1, 4)]


def loop_context(tok, s0, e0, depth, length, pad):
    n = len(tok)
    s, e = max(0, s0 - pad), min(n, e0 + pad)
    ev = tok[s:e]
    if len(ev) >= length:
        return None
    room = length - len(ev)
    p = int(room * depth)
    q = room - p
    before, after = tok[:s], tok[e:]
    prefix = (after[: p - len(before)] if p > len(before) else []) + (before[len(before) - min(p, len(before)) :] if p else [])
    suffix = after[:q] + (before[len(before) - min(len(before), q - len(after)) :] if q > len(after) else [])
    return prefix, ev, suffix


def test_contexts_against_a_loop(spark):
    rng = random.Random(3)
    rows, want = [], []
    for k in range(300):
        n = rng.randrange(5, 40)
        tok = [f"t{i} " for i in range(n)]
        s = rng.randrange(0, n)
        e = s + rng.randrange(0, 9)
        d, length, pad = rng.choice([0.0, 0.25, 0.5, 1.0, 0.3]), rng.randrange(3, 50), 2
        rows.append((k, tok, s, e, d, length))
        want.append(loop_context(tok, s, e, d, length, pad))
    df = spark.createDataFrame(rows, "k int, tokens array<string>, s bigint, e bigint, d double, n bigint")
    got = context.build_contexts(df, F.col("s"), F.col("e"), F.col("d"), F.col("n"), "tokens", padding=2).orderBy("k").collect()
    for r, w in zip(got, want):
        b = r["built"]
        if w is None:
            assert not b["success"] and "exceeds" in b["error_message"] and r["context"] == ""
        else:
            p, ev, q = w
            assert r["context"] == "".join(p + ev + q) and (b["prefix_length"], b["evidence_length"], b["suffix_length"]) == (len(p), len(ev), len(q))
            assert b["actual_depth"] == pytest.approx(len(p) / len(p + ev + q))


def test_context_errors(spark):
    df = spark.createDataFrame([(["a"] * 9, 1, 2, -0.1), (["a"] * 9, 1, 2, 1.1), (["a"] * 9, None, 2, 0.5), (["a"] * 9, 1, None, 0.5), (["a"] * 9, 1, 2, None)], "tokens array<string>, s bigint, e bigint, d double")
    got = [r["built"]["error_message"] for r in context.build_contexts(df, F.col("s"), F.col("e"), F.col("d"), F.lit(8), "tokens", padding=1).collect()]
    assert got == ["invalid target depth"] * 2 + ["position is missing"] * 2 + ["invalid target depth"]


def test_recovery(spark):
    prev = spark.createDataFrame([("a", 0, "error"), ("b", 1, "success"), ("c", 2, "timeout"), ("a", 3, "success"), (None, 4, "error")], "key string, idx int, parsing_status string")
    new = spark.createDataFrame([("a", 0, "success"), ("a", 1, "error"), ("b", 2, "timeout"), ("z", 3, "success")], "key string, n int, parsing_status string")
    got = [(r["key"], r["parsing_status"], r["was_recovered"]) for r in recovery.merge_recovered(prev, new, "key", "idx", "n").orderBy("idx").collect()]
    assert got == [("a", "error", True), ("b", "timeout", True), ("c", "timeout", False), ("a", "error", True), (None, "error", False)]
    q = spark.createDataFrame([("a", 5, "x"), ("a", 9, "y"), ("b", 1, "z")], "key string, place int, body string")
    again = recovery.retry_rows(prev, q, "key", "place").collect()
    assert [(r["key"], r["asked"]["body"], r["first_place"]) for r in again] == [("a", "y", 5)]
    assert tuple(recovery.recovery_counts(new).first()) == (4, 2, 2)


def test_checks(spark):
    q = spark.createDataFrame([(True, True), (True, False)], "has_validation boolean, is_valid boolean")
    assert checks.precheck(q, ignore_invalid=True).count() == 1 and checks.precheck(q, skip=True).count() == 2
    for rows, kw in (([(True, True), (True, False)], {}), ([(False, None)], {"ignore_invalid": True}), ([(True, False)], {"ignore_invalid": True})):
        with pytest.raises(ValueError):
            checks.precheck(spark.createDataFrame(rows, q.schema), **kw)
    p = spark.createDataFrame([(100, 200), (5000, 5100)], "start_pos bigint, end_pos bigint")
    checks.check_lengths(p, [1200, 2000], 10_000, 500)
    for lengths, n in (([20_000], 10_000), ([300], 10_000), ([1100], 10_000)):
        with pytest.raises(ValueError):
            checks.check_lengths(p, lengths, n, 500)
    assert checks.estimated_novel_length(p).first()[0] == 6120 and checks.estimated_novel_length(p.limit(0)).first()[0] == 100_000


def test_level_plan_has_every_level(spark):
    novels = spark.createDataFrame([(1, 2_400_000), (2, 200_000), (3, None)], "novel_id bigint, total_tokens bigint")
    rows = sequence.level_plan(spark, novels).orderBy("novel_id", "level").collect()
    assert [(r.level, r.questions) for r in rows if r.novel_id == 1] == [(2_000, 5), (4_000, 5), (8_000, 5), (16_000, 5), (32_000, 5), (64_000, 15), (128_000, 30), (192_000, 30), (256_000, 30), (512_000, 125), (1_000_000, 240), (2_000_000, 500)]
    assert [r.running_total for r in rows if r.novel_id == 2] == [5, 10, 15, 20, 25, 40, 70, 100, 100, 100, 100, 100]
    assert len(rows) == 24
    assert sequence.level_plan(spark, novels, per_10k=10).where("novel_id = 1 and level = 2000000").first().questions == 1000


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_numbers_of_many_wide_rows(spark, coalesce):
    """Ranges of the rows and of the counts are the same, whatever the engine does with small partitions."""
    from lectern.operators.sequence import numbered

    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        rows = spark.range(1_000_000).selectExpr("id", "cast(reverse(cast(id as string)) as bigint) as k", "repeat(cast(id as string), 12) as wide")
        got = numbered(rows, ["k", "id"])
        c = got.selectExpr("count(*) as n", "count(distinct idx) as d", "min(idx) as a", "max(idx) as b", "count_if(length(wide) < 12) as short").first()
        assert tuple(c) == (1_000_000, 1_000_000, 0, 999_999, 0)
        w = got.where("idx < 3 or idx > 999996").orderBy("idx").collect()
        keys = sorted((int(str(i)[::-1]), i) for i in range(1_000_000))
        assert [(r["k"], r["id"]) for r in w] == keys[:3] + keys[-3:]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_trend_keeps_every_row(spark):
    from lectern.operators.sequence import trend_line

    rows = spark.range(60_000).selectExpr("'r' as run", "id as idx", "id * 7919 % 50000 as start_pos", "cast(id % 3 as double) as score")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        assert trend_line(rows, "run", block=1000).select("idx").distinct().count() == 60_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_results_without_a_key_are_kept(spark):
    from lectern.operators.recovery import merge_recovered

    prev = spark.createDataFrame([(None, k, "error") for k in range(50)] + [(1, 50, "error"), (2, 51, "ok")], "k bigint, o bigint, status string")
    new = spark.createDataFrame([(1, 1, "ok"), (None, 2, "ok")], "k bigint, o bigint, status string")
    got = {r["o"]: (r["k"], r["status"], r["was_recovered"]) for r in merge_recovered(prev, new, "k", "o", "o").collect()}
    assert len(got) == 52 and got[50] == (1, "ok", True) and got[51] == (2, "ok", False) and got[7] == (None, "error", False)
