"""Running failed results again and merging what came back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.answers import failed


def failed_results(results: DataFrame, status: str = "parsing_status") -> DataFrame:
    return results.where(failed(F.col(status)))


def retry_rows(results: DataFrame, questions: DataFrame, on: str, order: str, status: str = "parsing_status") -> DataFrame:
    """Failed results with the question to ask again. Of questions with the same key the last by ``order`` is asked, and
    ``first_<order>`` is the place of the first; failed results without a question are dropped."""
    last = questions.where(F.col(on).isNotNull()).groupBy(on).agg(F.max_by(F.struct(*[F.col(c) for c in questions.columns if c != on]), order).alias("asked"), F.min(order).alias(f"first_{order}"))
    return failed_results(results, status).join(last, on)


def merge_recovered(previous: DataFrame, recovered: DataFrame, key: str, order: str, recovered_order: str) -> DataFrame:
    """``previous`` with every row whose key was recovered replaced, successful ones too; of several recovered rows of one key
    the last counts. Both have the same columns but for the orders; ``was_recovered`` tells which rows are new. Order is that
    of ``previous``. Rows with a null key are kept as they are and take no part in the join."""
    values = [c for c in previous.columns if c not in (key, order)]
    last = recovered.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*values), recovered_order).alias("new_"))
    joined = previous.where(F.col(key).isNotNull()).join(last, key, "left").withColumn("row_", F.coalesce("new_", F.struct(*values)))
    merged = joined.select(key, order, *(F.col(f"row_.{c}").alias(c) for c in values), F.col("new_").isNotNull().alias("was_recovered"))
    return merged.unionByName(previous.where(F.col(key).isNull()).select(key, order, *values, F.lit(False).alias("was_recovered")))


def recovery_counts(recovered: DataFrame, status: str = "parsing_status") -> DataFrame:
    """(retried, recovered, still_failed)."""
    return recovered.agg(F.count("*").alias("retried"), F.count_if(~failed(F.col(status))).alias("recovered"), F.count_if(failed(F.col(status))).alias("still_failed"))


def failure_breakdown(results: DataFrame, status: str = "parsing_status") -> DataFrame:
    return failed_results(results, status).groupBy(status).agg(F.count("*").alias("n"))
