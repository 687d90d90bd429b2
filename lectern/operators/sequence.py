"""Ordered operators: global row numbers without a global window, moving averages, schedules and level plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import token_count_label
from lectern.plans.session import cut
from lectern.schema import DEPTH_LABELS

DEPTHS = (0.0, 0.25, 0.5, 0.75, 1.0)


def numbered(df: DataFrame, order: list[str | Column], name: str = "idx") -> DataFrame:
    """``df`` with 0, 1, 2, ... in the given order, which must be total. Rows are sorted over all tasks by range, each task
    numbers its own, and the tasks' sizes are added; no task holds more than its range.

    The sorted rows are written to the shared folder with their task and place, and sizes and rows are both read from there:
    ranges come from a sample, and two plans of the same sort would draw their borders differently."""
    keys = [f"k{i}_" for i in range(len(order))]
    with_keys = df.withColumns({k: (F.col(o) if isinstance(o, str) else o) for k, o in zip(keys, order)})
    in_order = with_keys.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at_", F.monotonically_increasing_id()).drop(*keys)
    rows = cut(in_order.withColumns({"part_": F.shiftright("at_", 33), "local_": F.col("at_").bitwiseAND((1 << 33) - 1)}).drop("at_"))
    sizes = rows.groupBy("part_").agg(F.count("*").alias("n_"))
    before = sizes.select("part_", F.coalesce(F.sum("n_").over(W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    return rows.join(F.broadcast(before), "part_").withColumn(name, (F.col("before_") + F.col("local_")).cast("bigint")).drop("part_", "before_", "local_")


def trend_line(results: DataFrame, run: str, position: str = "start_pos", score: str = "score", tie: str = "idx", window: int = 20, block: int = 50_000) -> DataFrame:
    """(run, tie, position, score, trend): the mean score of the rows at most window // 2 places before or after, by position,
    within each run. A run of fewer rows than ``window`` keeps its scores unsmoothed. Ties in position follow ``tie``.

    Rows get their place in the run first; means are then taken in blocks of places, each with the rows of its neighbours
    that reach into it, so that a run of any length is spread over many tasks."""
    half = window // 2
    placed = numbered(results.select(run, tie, position, score), [run, position, tie], "at_")
    runs = placed.groupBy(run).agg(F.min("at_").alias("from_"), F.count("*").alias("n_"))
    placed = placed.join(runs, placed[run].eqNullSafe(runs[run])).drop(runs[run]).withColumn("at_", F.col("at_") - F.col("from_"))
    own = F.floor(F.col("at_") / block)
    near = F.sequence(F.floor(F.greatest(F.col("at_") - half, F.lit(0)) / block), F.floor((F.col("at_") + half) / block))
    blocks = placed.withColumn("own_", own).withColumn("block_", F.explode(near))
    w = W.partitionBy(run, "block_").orderBy("at_").rowsBetween(-half, half)
    out = blocks.withColumn("m_", F.avg(score).over(w)).where("own_ = block_")
    return out.select(run, tie, position, score, F.when(F.col("n_") < window, F.col(score)).otherwise(F.col("m_")).alias("trend"))


def schedule_uniform(questions: DataFrame, lengths: list[int], idx: str = "idx") -> DataFrame:
    """``questions`` with target_depth, depth_bin and context_length: depths change fastest, then lengths."""
    if not lengths:
        raise ValueError("no context lengths")
    c = F.col(idx) % (len(DEPTHS) * len(lengths))
    depth, length = (c % len(DEPTHS)).cast("int"), (c / len(DEPTHS)).cast("int")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), i + 1)
    return questions.withColumns({"target_depth": pick(DEPTHS, depth), "depth_bin": pick(DEPTH_LABELS, depth), "context_length": pick(lengths, length)})


def schedule_fixed(questions: DataFrame, lengths: list[int], depth: float, idx: str = "idx") -> DataFrame:
    """The same depth for all, lengths in turn."""
    from lectern.functions.rules import depth_label

    if not lengths:
        raise ValueError("no context lengths")
    if depth is None or not 0.0 <= depth <= 1.0:
        raise ValueError("a fixed depth must lie between 0 and 1")
    return questions.withColumns({"target_depth": F.lit(float(depth)), "depth_bin": depth_label(F.lit(float(depth))), "context_length": F.element_at(F.array(*map(F.lit, lengths)), (F.col(idx) % len(lengths)).cast("int") + 1)})


def schedule(questions: DataFrame, mode: str, lengths: list[int], depth: float | None = None, idx: str = "idx") -> DataFrame:
    """By mode: 'uniform' or 'fixed'; the legacy mode has no schedule."""
    if mode == "uniform":
        return schedule_uniform(questions, lengths, idx)
    if mode == "fixed":
        return schedule_fixed(questions, lengths, depth, idx)
    raise ValueError(f"no schedule in mode {mode!r}")


# Levels of context length that a plan is made for.
LEVELS = (2_000, 4_000, 8_000, 16_000, 32_000, 64_000, 128_000, 192_000, 256_000, 512_000, 1_000_000, 2_000_000)


def level_plan(spark: SparkSession, novels: DataFrame, levels: tuple[int, ...] = LEVELS, per_10k: int = 5, key: str = "novel_id", tokens: str = "total_tokens") -> DataFrame:
    """(novel, level, range_start, questions, running_total): questions to ask for each level that a novel is long enough for:
    max(5, tens of thousands of tokens since the level before times ``per_10k``); 0 for longer levels."""
    plan = novels.where(F.col(tokens).isNotNull()).select(key, tokens, F.posexplode(F.array(*map(F.lit, levels))).alias("step", "level"))
    w = W.partitionBy(key).orderBy("step")
    start = F.coalesce(F.lag("level").over(w), F.lit(0))
    need = F.when(F.col("level") > F.col(tokens), 0).otherwise(F.greatest(F.lit(5), F.floor((F.col("level") - F.col("range_start")) / 10_000) * per_10k))
    out = plan.withColumn("range_start", start).withColumn("questions", need.cast("bigint"))
    return out.select(key, "level", "range_start", "questions", F.sum("questions").over(w).alias("running_total"))


def novel_analysis(spark: SparkSession, novels: DataFrame, levels: tuple[int, ...] = LEVELS, per_10k: int = 5, key: str = "novel_id", tokens: str = "total_tokens") -> DataFrame:
    """(novel, tokens, longest_level, levels, questions): the length of each novel in words, the longest level it reaches (0: none),
    how many it reaches, and how many questions its plan asks. Novels of unknown length are left out."""
    plan = level_plan(spark, novels, levels, per_10k, key, tokens)
    reached = F.col("questions") > 0
    sums = plan.groupBy(key).agg(F.coalesce(F.max(F.when(reached, F.col("level"))), F.lit(0)).alias("longest_level"), F.count_if(reached).alias("levels"), F.sum("questions").alias("questions"))
    return novels.where(F.col(tokens).isNotNull()).select(key, token_count_label(F.col(tokens)).alias("tokens")).join(sums, key)
