"""Running figures of results as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from lectern.functions import answers as A


def read_results(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Result files (Parquet) as they appear in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def live_scores(results: DataFrame, time: str = "tested_at", window: str = "1 hour", late: str = "60 days", key: str = "result_id") -> DataFrame:
    """(window_start, model_name, n, mean_score, errors): results by the time they were tested. A repeated delivery counts once
    while its time is within ``late`` of the newest; later rows are dropped, and counted by :class:`TooLate`. Rows come up to
    a month behind the newest, hence the default.
    A batch gives the same figures over all its rows."""
    k, c, m, s = (F.col(x) for x in ("question_type", "correct_answer", "model_answer", "parsing_status"))
    rows = results.withWatermark(time, late)
    rows = rows.dropDuplicatesWithinWatermark([key]) if results.isStreaming else rows.dropDuplicates([key])
    return (
        rows.groupBy(F.window(time, window).alias("w"), "model_name")
        .agg(F.count("*").alias("n"), F.avg(A.report_score(k, c, m, s)).alias("mean_score"), F.count_if(A.failed(s)).alias("errors"))
        .select(F.col("w.start").alias("window_start"), "model_name", "n", "mean_score", "errors")
    )


class TooLate(StreamingQueryListener):
    """How many rows each query has dropped as too late, by the query's id. Added with ``spark.streams.addListener`` before
    the query starts; figures come with the progress of each batch."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        at = str(event.progress.id)
        self.rows[at] = self.rows.get(at, 0) + sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
