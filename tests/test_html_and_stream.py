import re

import pytest
from pyspark.sql import functions as F

from lectern.sources import html
from lectern.streaming.live import TooLate, live_scores, read_results

D = "/root/testdata/sf0.001"


def test_report_and_heatmaps(spark, tmp_path):
    q = spark.read.parquet(f"{D}/questions.parquet").dropDuplicates(["q_id"]).select("q_id", "question", "position.start_pos", "position.end_pos")
    r = spark.read.parquet(f"{D}/results.parquet").dropDuplicates(["result_id"]).join(q, "q_id")
    at = tmp_path / "out" / "r.html"
    html.report(r, str(at), {"model": "<m>", "api_key": "SECRET"}, errors=3)
    text = at.read_text(encoding="utf-8")
    assert "Metrics" in text and "&lt;m&gt;" in text and "SECRET" not in text and "polyline" in text
    with pytest.raises(ValueError):
        html.report(r.limit(0), str(at))
    for mode in ("coverage", "accuracy", "combined", "depth", "combined_depth"):
        html.heatmap(mode, str(tmp_path / f"{mode}.html"), q, r, 200_000, 20)
        assert "<svg" in (tmp_path / f"{mode}.html").read_text()
    with pytest.raises(ValueError):
        html.heatmap("other", str(at))


def test_stream_is_the_batch(spark, tmp_path):
    rows = spark.read.parquet(f"{D}/results.parquet")
    folder = str(tmp_path / "in")
    rows.write.parquet(folder)
    s = live_scores(read_results(spark, folder, rows.schema), late="4000 days").writeStream.outputMode("complete").format("memory").queryName("live").start()
    s.processAllAvailable()
    s.stop()
    once = rows.dropDuplicates(["result_id"]).where("tested_at is not null")
    got = spark.table("live")
    assert got.agg(F.sum("n")).first()[0] == once.count()
    assert got.count() == once.groupBy(F.window("tested_at", "1 hour"), "model_name").count().count()


@pytest.mark.parametrize("more, whole", [({}, True), ({"late": "1 day"}, False)])
def test_stream_in_order_of_arrival(spark, tmp_path, more, whole):
    rows = spark.read.parquet(f"{D}/results.parquet").dropDuplicates(["result_id"]).where("tested_at is not null").cache()
    folder, name, late = str(tmp_path / "in"), f"arrivals_{whole}".lower(), TooLate()
    parts = [p.drop("part") for p in (rows.withColumn("part", F.expr("ntile(8) over (order by loaded_at, result_id)")).where(F.col("part") == k) for k in range(1, 9))]
    parts[0].write.parquet(folder)
    spark.streams.addListener(late)
    s = live_scores(read_results(spark, folder, rows.schema), **more).writeStream.outputMode("complete").format("memory").queryName(name).start()
    for k in range(8):
        if k:
            parts[k].write.mode("append").parquet(folder)
        s.processAllAvailable()
    s.stop()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    spark.streams.removeListener(late)
    counted, dropped = spark.table(name).agg(F.sum("n")).first()[0], late.rows[str(s.id)]
    assert counted + dropped == rows.count()
    assert (dropped == 0) == whole


def test_plot_shows_every_result(spark, tmp_path):
    r = spark.read.parquet(f"{D}/results.parquet").limit(1).drop("q_id").crossJoin(spark.range(6000).withColumnRenamed("id", "k"))
    r = r.withColumn("result_id", F.col("k").cast(dict(r.dtypes)["result_id"])).withColumn("start_pos", F.col("k") * 10).withColumn("question", F.lit("q"))
    html.report(r, str(tmp_path / "r.html"))
    text = (tmp_path / "r.html").read_text(encoding="utf-8")
    assert sum(map(int, re.findall(r"<title>(\d+) result", text))) == 6000
    assert "6000 of 6000 results have a position and are shown" in text
