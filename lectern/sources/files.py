"""Text and JSON-lines files. The first line of a JSON-lines file may be a header object with the key ``metadata``."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.plans.session import cut
from lectern.schema import QUESTION

#: Places of headers that are sent to all executors; those of more files are joined by a shuffle.
SENT_HEADERS = 100_000
_SECRET = re.compile(r"api.?key|secret|password|authorization|access.?token|credential", re.IGNORECASE)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files, as UTF-8."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_head(spark: SparkSession, path: str, lines: int = 100) -> DataFrame:
    """(path, text): the first lines of each file with their line ends."""
    return read_text(spark, path).select("path", F.substring_index("text", "\n", lines).alias("head"), "text").select("path", F.when(F.length("head") < F.length("text"), F.concat("head", F.lit("\n"))).otherwise(F.col("text")).alias("text"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, at, line): every line with its file, the start of the block it was read in, and an order within the block."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line"))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value, metadata): the first line of each file that is an object with an object ``metadata``, and that as JSON.
    Files without one do not appear. Only the first line of a file's first block can be a header."""
    first = _lines(spark, path).where("at = 0").groupBy("file").agg(F.min(F.struct("line", "value")).alias("f")).select("file", "f.line", "f.value")
    meta = F.get_json_object("value", "$.metadata")
    return first.where(F.coalesce(F.get_json_object("value", "$").startswith("{") & meta.startswith("{"), F.lit(False))).withColumn("metadata", meta)


def read_metadata(spark: SparkSession, path: str) -> dict:
    """The header of a file as a dictionary, or of the first file by name that has one; empty without one."""
    first = read_headers(spark, path).orderBy("file").select("value").first()
    try:
        return json.loads(first["value"])["metadata"] if first else {}
    except ValueError:
        return {}


def read_rows(spark: SparkSession, path: str, schema: T.StructType = QUESTION, strict: bool = True) -> tuple[dict, DataFrame]:
    """(metadata, rows): rows typed by ``schema`` with their raw text in ``raw``. The header of each file is left out, and no line
    that only equals one. Blank lines are skipped. With ``strict`` a line that is no JSON fails the read; else such a line
    comes out with null fields."""
    heads = read_headers(spark, path).select("file", "line")
    rows = _lines(spark, path).where(~F.col("value").rlike(r"^\s*$")).join(F.broadcast(heads) if heads.count() <= SENT_HEADERS else heads, ["file", "line"], "left_anti")
    options = {"mode": "FAILFAST" if strict else "PERMISSIVE"}
    return read_metadata(spark, path), rows.select(F.from_json("value", schema, options).alias("r"), F.col("value").alias("raw")).select("r.*", "raw")


def _tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    rows = _lines(spark, path).where(~F.col("value").rlike(r"^\s*$")).where(F.get_json_object("value", "$.metadata").isNull())
    return rows.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")


def read_positions(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """((start_pos, end_pos) of every question with both, number of lines skipped). Lines with metadata count for nothing."""
    rows = _tolerant(spark, path, "position struct<start_pos:bigint,end_pos:bigint>").select("position.start_pos", "position.end_pos")
    good = rows.where("start_pos is not null and end_pos is not null")
    return good, rows.where("start_pos is null or end_pos is null").count()


def read_scores(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """((start_pos, end_pos, score) of every result with all three, number of lines skipped); a score may be a text."""
    rows = _tolerant(spark, path, "position struct<start_pos:bigint,end_pos:bigint>, score string").selectExpr("position.start_pos", "position.end_pos", "try_cast(score as double) as score")
    good = rows.where("start_pos is not null and end_pos is not null and score is not null")
    return good, rows.where("start_pos is null or end_pos is null or score is null").count()


def read_depth_scores(spark: SparkSession, path: str) -> DataFrame:
    """(depth_bin, test_context_length, score) of every result with all three."""
    rows = _tolerant(spark, path, "depth_bin string, test_context_length bigint, score string").selectExpr("depth_bin", "test_context_length", "try_cast(score as double) as score")
    return rows.where("depth_bin is not null and test_context_length is not null and score is not null")


def redacted(value):
    """A copy without anything that is named like a credential."""
    if isinstance(value, dict):
        return {k: redacted(v) for k, v in value.items() if not _SECRET.search(str(k))}
    return [redacted(v) for v in value] if isinstance(value, list) else value


def write_rows(rows: DataFrame, path: str, metadata: dict | None = None, order: str | None = None) -> None:
    """One JSON-lines file, header first when there is metadata, rows by ``order``; what was at ``path`` is replaced once the
    new file is whole. Credentials in metadata are left out."""
    spark = rows.sparkSession
    fields = [c for c in rows.columns if c != order]
    lines = rows.select((F.col(order) if order else F.monotonically_increasing_id()).alias("n_"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))
    _single_file(spark, metadata, lines, path)


def _single_file(spark: SparkSession, metadata: dict | None, lines: DataFrame, path: str) -> None:
    """One text file of ``lines`` (n_, value) by n_, after its header, written beside ``path`` and moved there when whole. One
    task writes it, as a single file needs; larger sets belong in Parquet."""
    lines = lines.withColumn("k_", F.lit(1))
    if metadata:
        head = spark.range(1).select(F.lit(None).cast(lines.schema["n_"].dataType).alias("n_"), F.lit(json.dumps({"metadata": redacted(metadata)}, ensure_ascii=False)).alias("value"), F.lit(0).alias("k_"))
        lines = head.unionByName(lines)
    temp = f"{path}.writing"
    lines.repartition(1).sortWithinPartitions("k_", "n_").select("value").write.mode("overwrite").text(temp)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = [s.getPath() for s in fs.listStatus(hadoop(temp)) if s.getPath().getName().startswith("part-")][0]
    fs.delete(hadoop(path), True)
    fs.rename(part, hadoop(path))
    fs.delete(hadoop(temp), True)


def write_question_set(questions: DataFrame, path: str, generated_at: str, order: str | None = None, **metadata) -> None:
    """Questions with the counts of their generation."""
    n = questions.count()
    write_rows(questions, path, {"generated_at": generated_at, "total_questions": n, **metadata}, order)


def write_validations(questions: DataFrame, path: str, validated_at: str, original: dict | None = None, valid_only: bool = False, order: str | None = None) -> None:
    """Validated questions with their counts and failures, beside the set's own metadata."""
    from lectern.operators.metrics import validation_stats

    v = questions.select("validation.*")
    stats = validation_stats(v).first().asDict()
    write_rows(questions.where("validation.is_valid") if valid_only else questions, path, {**(original or {}), "validation": {"validated_at": validated_at, "valid_only": valid_only, **stats}}, order)


def write_results(results: DataFrame, path: str, tested_at: str, mode: str = "legacy", config: dict | None = None, order: str | None = None, **metadata) -> None:
    """Results with the metadata of their run; ``mode`` is legacy, depth or no_reference."""
    if mode not in ("legacy", "depth", "no_reference"):
        raise ValueError(f"unknown mode {mode!r}")
    write_rows(results, path, {"tested_at": tested_at, "test_mode": mode, "tested_questions": results.count(), "config": config or {}, **metadata}, order)


def update_summary(spark: SparkSession, path: str, summary: str, schema: T.StructType = QUESTION, to: str | None = None) -> None:
    """The same file with ``novel_summary`` in its metadata; rows keep fields that the schema doesn't know."""
    meta, rows = read_rows(spark, path, schema)
    kept = cut(rows.withColumn("n_", F.monotonically_increasing_id()).select("n_", F.col("raw").alias("value")))
    _single_file(spark, {**meta, "novel_summary": summary}, kept, to or path)

