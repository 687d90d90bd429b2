"""Coverage and accuracy along a context, and grids of depth and length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.schema import DEPTH_LABELS


def _check(length: int, bins: int) -> None:
    if bins <= 0:
        raise ValueError("the number of bins must be positive")
    if length <= 0:
        raise ValueError("the context length must be positive")


def bin_edges(spark: SparkSession, length: int, bins: int) -> DataFrame:
    """(bin, start_pos, end_pos): equal bins with whole edges; the last ends at ``length``."""
    _check(length, bins)
    size = length / bins
    i = F.col("id")
    end = F.when(i < bins - 1, ((i + 1) * F.lit(size)).cast("bigint")).otherwise(F.lit(length).cast("bigint"))
    return spark.range(bins).select(i.cast("int").alias("bin"), (i * F.lit(size)).cast("bigint").alias("start_pos"), end.alias("end_pos"))


def coverage_bins(questions: DataFrame, length: int, bins: int = 50, start: str = "start_pos", end: str = "end_pos", digits: int | None = None) -> DataFrame:
    """(bin, start_pos, end_pos, raw, coverage): each question spreads a weight of one over the bins it meets, in proportion
    to the overlap; coverage is relative to the fullest bin. Questions without length count for nothing, parts beyond
    ``length`` are lost. Each question is spread over its own bins only, then summed: no comparison with every bin."""
    edges = bin_edges(questions.sparkSession, length, bins)
    size = length / bins
    clip = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(bins - 1)).cast("int")
    lo, hi = clip(F.floor(F.col("s") / size) - 1), clip(F.floor(F.col("e") / size) + 1)
    i = F.col("bin")
    left = (i * F.lit(size)).cast("bigint")
    right = F.when(i < bins - 1, ((i + 1) * F.lit(size)).cast("bigint")).otherwise(F.lit(length))
    part = F.least(F.col("e"), right) - F.greatest(F.col("s"), left)
    spread = (
        questions.select(F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e"))
        .where("e > s and e > 0")
        .where(F.col("s") < length)
        .withColumn("bin", F.explode(F.sequence(lo, hi)))
        .withColumn("part", part)
        .where("part > 0")
    )
    share = F.col("part") / (F.col("e") - F.col("s"))
    raw = spread.groupBy("bin").agg((F.sum(share) if digits is None else F.round(F.sum(share), digits)).alias("raw"))
    full = edges.join(raw, "bin", "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    top = full.agg(F.max("raw").alias("top"))
    return full.join(F.broadcast(top), F.lit(True)).select("bin", "start_pos", "end_pos", "raw", F.when(F.col("top") > 0, F.col("raw") / F.col("top")).otherwise(0.0).alias("coverage"))


def accuracy_bins(results: DataFrame, length: int, bins: int = 50, start: str = "start_pos", score: str = "score") -> DataFrame:
    """(bin, start_pos, end_pos, accuracy, question_count): mean score of the results that start in a bin, null for an empty
    one. Starts beyond the last bin count in it, negative ones in the first."""
    edges = bin_edges(results.sparkSession, length, bins)
    i = F.least(F.greatest((F.col(start) / F.lit(length / bins)).cast("bigint"), F.lit(0)), F.lit(bins - 1)).cast("int")
    got = results.where(F.col(start).isNotNull()).groupBy(i.alias("bin")).agg(F.avg(score).alias("accuracy"), F.count("*").alias("question_count"))
    return edges.join(got, "bin", "left").withColumn("question_count", F.coalesce("question_count", F.lit(0)))


def depth_grid(results: DataFrame, labels: tuple[str, ...] = DEPTH_LABELS) -> DataFrame:
    """(test_context_length, depth_bin, accuracy, question_count) for every tested length and label; null accuracy where
    nothing was tested. Rows without depth, length or score are left out; other labels have no cell."""
    rows = results.where("depth_bin is not null and test_context_length is not null and score is not null")
    grid = rows.select("test_context_length").distinct().withColumn("depth_bin", F.explode(F.array(*map(F.lit, labels))))
    cells = rows.groupBy("test_context_length", "depth_bin").agg(F.avg("score").alias("accuracy"), F.count("*").alias("question_count"))
    return grid.join(cells, ["test_context_length", "depth_bin"], "left").withColumn("question_count", F.coalesce("question_count", F.lit(0)))


def column_averages(grid: DataFrame) -> DataFrame:
    """(test_context_length, accuracy): mean of a length's filled cells, each cell counting once."""
    return grid.groupBy("test_context_length").agg(F.avg("accuracy").alias("accuracy"))


def weighted_accuracy(cells: DataFrame) -> DataFrame:
    """(accuracy): mean over cells weighted by their counts; null without any."""
    full = F.col("accuracy").isNotNull()
    return cells.agg((F.sum(F.when(full, F.col("accuracy") * F.col("question_count"))) / F.nullif(F.sum(F.when(full, F.col("question_count"))), F.lit(0))).alias("accuracy"))


def depth_pivot(grid: DataFrame, lengths: list[int], missing: float = -0.05, labels: tuple[str, ...] = DEPTH_LABELS) -> DataFrame:
    """One row for each label, deepest first by ``row``, one column for each length; ``missing`` marks cells without data."""
    row = F.array_position(F.array(*(F.lit(x) for x in reversed(labels))), F.col("depth_bin")).cast("int")
    wide = grid.groupBy("depth_bin").pivot("test_context_length", lengths).agg(F.first("accuracy"))
    return wide.select(row.alias("row"), "depth_bin", *(F.coalesce(F.col(f"`{n}`"), F.lit(missing)).alias(f"len_{n}") for n in lengths))


def combined_bins(questions: DataFrame, results: DataFrame, length: int, bins: int = 50) -> DataFrame:
    """Coverage and accuracy of the same bins side by side."""
    return coverage_bins(questions, length, bins).join(accuracy_bins(results, length, bins).select("bin", "accuracy", "question_count"), "bin")


def length_choice(given: Column, total_tokens: Column, context_length: Column) -> Column:
    """The context length given, else the set's total tokens, else its context length; zeros count as missing."""
    return F.coalesce(given, F.nullif(total_tokens, F.lit(0)), F.nullif(context_length, F.lit(0)))


def resolved_length(given: Column | None, metadata: DataFrame | None) -> int:
    """The context length given, else total_tokens, else context_length of a metadata row; an error without any."""
    if isinstance(given, int):
        return given
    row = metadata.first() if metadata is not None else None
    for name in ("total_tokens", "context_length"):
        if row is not None and name in row.asDict() and row[name]:
            return int(row[name])
    raise ValueError("no context length is given and the metadata has none")
