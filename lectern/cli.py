"""The command line: ``python -m lectern COMMAND``. Every command checks its arguments, reads files, runs one plan and writes files."""

from __future__ import annotations

import argparse
import datetime
import json
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text, tokens
from lectern.operators import checks, metrics, recovery, sampling, sequence
from lectern.plans import config, pipelines
from lectern.plans.provider import CallProvider, Provider, TableProvider, chat_call, probe_all
from lectern.schema import CONFIDENCE, DEPTH_RESULT, QUESTION, VALIDATED_QUESTION
from lectern.sources import files, html

MODES = ("legacy", "uniform", "fixed", "no_reference")
MAPS = ("coverage", "accuracy", "combined", "depth", "combined_depth")


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lectern")
    top.add_argument("--master", default="local[*]")
    top.add_argument("--shared", help="folder that all executors share")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *paths: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for path in paths:
            p.add_argument(f"--{path}", required=True)
        return p

    def model(p: argparse.ArgumentParser) -> None:
        p.add_argument("--config", help="file of NAME=value settings")
        p.add_argument("--replies", help="JSON lines of request_key and reply, instead of calls")
        p.add_argument("--templates", help="folder of templates")
        p.add_argument("--concurrency", type=int, default=5)

    p = command("generate", "novel", "output")
    model(p)
    p.add_argument("--questions", type=int, default=10)
    p.add_argument("--strategy", default="stratified")
    p.add_argument("--window", type=int, default=1000)
    p.add_argument("--attempts", type=int, default=3)
    p.add_argument("--seed", type=int, default=0)
    p = command("validate", "novel", "questions", "output")
    model(p)
    p.add_argument("--threshold", type=float, default=0.8)
    p.add_argument("--confidence", default="medium")
    p.add_argument("--valid-only", action="store_true")
    p = command("test", "questions", "output")
    model(p)
    p.add_argument("--novel")
    p.add_argument("--mode", default="legacy")
    p.add_argument("--length", type=int)
    p.add_argument("--lengths")
    p.add_argument("--depth", type=float)
    p.add_argument("--padding", type=int, default=500)
    p.add_argument("--most", type=int)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--ignore-invalid", action="store_true")
    p.add_argument("--skip-check", action="store_true")
    p.add_argument("--recover", help="results whose failed rows are run again")
    p = command("report", "results", "output")
    p.add_argument("--errors", type=int, default=10)
    p = command("heatmap", "output")
    p.add_argument("--mode", default="coverage")
    p.add_argument("--questions")
    p.add_argument("--results")
    p.add_argument("--length", type=int)
    p.add_argument("--bins", type=int, default=50)
    p = command("analyze", "novel")
    p.add_argument("--output")
    p.add_argument("--per-10k", type=int, default=5)
    p = command("summary", "novel", "questions")
    model(p)
    p.add_argument("--lines", type=int, default=100)
    p.add_argument("--output")
    p = sub.add_parser("probe")
    p.add_argument("--config")
    p.add_argument("--all", help="folder whose *.env files are all probed")
    return top


def check(a: argparse.Namespace) -> None:
    """Faults of the arguments of a command, as errors."""

    def need(ok: bool, said: str) -> None:
        if not ok:
            raise ValueError(said)

    for name in ("novel", "results", "recover", "replies", "config"):
        path = getattr(a, name, None)
        need(not path or Path(path).exists(), f"there is no file {path}")
    if isinstance(getattr(a, "questions", None), str):
        need(Path(a.questions).exists(), f"there is no file {a.questions}")
    if hasattr(a, "concurrency"):
        need(a.concurrency > 0, "concurrency must be positive")
    if a.command == "generate":
        need(a.questions > 0 and a.window > 0 and a.attempts > 0, "questions, window and attempts must be positive")
        sampling.sampling_strategy(a.strategy)
    elif a.command == "validate":
        need(0 <= a.threshold <= 1, "the threshold must lie between 0 and 1")
        need(a.confidence in CONFIDENCE, f"confidence is one of {', '.join(CONFIDENCE)}")
    elif a.command == "test":
        config.check_arguments(a.mode, lengths(a.lengths), a.depth, a.length, a.padding, a.most)
        need(a.novel is not None or a.mode == "no_reference", "a run with text needs a novel")
    elif a.command == "report":
        need(a.errors >= 0, "the number of errors must not be negative")
    elif a.command == "heatmap":
        need(a.mode in MAPS, f"mode is one of {', '.join(MAPS)}")
        need(a.bins > 0 and (a.length is None or a.length > 0), "bins and length must be positive")
        need(bool(a.questions) or a.mode in ("accuracy", "depth"), "coverage needs questions")
        need(bool(a.results) or a.mode == "coverage", "accuracy and depth need results")
    elif a.command == "analyze":
        need(a.per_10k > 0, "questions per 10,000 tokens must be positive")
    elif a.command == "summary":
        need(a.lines > 0, "lines must be positive")
    elif a.command == "probe":
        need(bool(a.config) != bool(a.all), "a configuration or a folder of them, not both")


def lengths(csv: str | None) -> list[int] | None:
    return [int(x) for x in csv.split(",")] if csv else None


def _provider(spark: SparkSession, a: argparse.Namespace) -> Provider:
    if a.replies:
        return TableProvider(spark.read.schema("request_key string, reply string").json(a.replies))
    return CallProvider(chat_call(config.read_config(a.config)), at_once=a.concurrency)


def _novel(spark: SparkSession, path: str) -> DataFrame:
    return files.read_text(spark, path).select(F.lit(1).cast("bigint").alias("novel_id"), "text", tokens.encode("text").alias("tokens"))


def _questions(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    meta, rows = files.read_rows(spark, path, VALIDATED_QUESTION)
    rows = sequence.numbered(rows.withColumn("line_", F.monotonically_increasing_id()), ["line_"]).drop("line_")
    return meta, rows.withColumn("novel_id", F.lit(1).cast("bigint"))


def _now() -> str:
    return datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds")


def generate(spark: SparkSession, a: argparse.Namespace) -> dict:
    novel = _novel(spark, a.novel)
    sized = novel.select("novel_id", F.size("tokens").cast("bigint").alias("n"))
    at = sampling.sampling_strategy(a.strategy)(sized, "novel_id", "n", a.questions, seed=a.seed).select("novel_id", "position")
    rows = pipelines.generate_questions(at, novel, _provider(spark, a), a.window, a.attempts, a.seed).select("sampled_at", *(f.name for f in QUESTION.fields))
    files.write_question_set(rows, a.output, _now(), "sampled_at", asked=a.questions, sampling_strategy=a.strategy, novel_path=a.novel, total_tokens=sized.first()["n"])
    return {"questions": files.read_metadata(spark, a.output)["total_questions"], "asked": a.questions}


def validate(spark: SparkSession, a: argparse.Namespace) -> dict:
    meta, rows = _questions(spark, a.questions)
    done = pipelines.validate_questions(rows.drop("validation"), _novel(spark, a.novel), _provider(spark, a), a.threshold, a.confidence)
    files.write_validations(done.drop("novel_id", "raw"), a.output, _now(), meta, a.valid_only, "idx")
    return files.read_metadata(spark, a.output)["validation"]


def test(spark: SparkSession, a: argparse.Namespace) -> dict:
    _, rows = _questions(spark, a.questions)
    provider, sizes = _provider(spark, a), lengths(a.lengths)
    ready = checks.precheck(rows.withColumns({"has_": F.col("validation").isNotNull(), "valid_": F.col("validation.is_valid")}), a.ignore_invalid, a.skip_check, "has_", "valid_").drop("has_", "valid_", "validation", "raw")
    novel = _novel(spark, a.novel) if a.novel else None
    if a.most and novel is not None:
        ready = sampling.sample_by_depth(ready.withColumn("end_", F.col("position.end_pos")), "idx", "end_", a.most, novel.select(F.size("tokens")).first()[0], a.seed).drop("end_", "depth_bin_index")

    def run(q: DataFrame) -> DataFrame:
        if a.mode == "legacy":
            return pipelines.run_first_tokens(q, novel, provider, a.length, a.padding)
        if a.mode == "no_reference":
            return pipelines.run_without_text(q, provider)
        return pipelines.run_at_depths(q, novel, provider, sizes, a.mode, a.depth, a.padding)

    def keyed(r: DataFrame) -> DataFrame:
        have = [f for f in DEPTH_RESULT.fields if f.name in r.columns]
        cell = (F.col("depth_bin"), F.col("test_context_length")) if "test_context_length" in r.columns else (F.lit(None).cast("string"), F.lit(None).cast("bigint"))
        return r.select("idx", *(F.col(f.name).cast(f.dataType) for f in have), text.result_key(F.col("question"), *cell).alias("result_key"))

    if a.recover:
        old_meta, old = files.read_rows(spark, a.recover, DEPTH_RESULT)
        again = recovery.failed_results(old).select("question").distinct()
        new = keyed(run(ready.join(again, "question", "left_semi")))
        shared = [c for c in new.columns if c in (*old.columns, "result_key", "idx")]
        old = sequence.numbered(old.withColumn("line_", F.monotonically_increasing_id()), ["line_"]).drop("line_", "raw")
        prev = keyed(old).select(*shared)
        out = recovery.merge_recovered(prev, new.select(*shared), "result_key", "idx", "idx")
        counts = recovery.recovery_counts(out.where("was_recovered")).first().asDict()
        files.write_results(out.drop("result_key", "was_recovered"), a.output, _now(), old_meta.get("test_mode", "legacy"), order="idx", recovery=counts)
        return counts
    out = keyed(run(ready)).drop("result_key")
    files.write_results(out, a.output, _now(), "legacy" if a.mode == "legacy" else "no_reference" if a.mode == "no_reference" else "depth", config.read_config(a.config).public(), "idx", novel_path=a.novel, context_length=a.length, padding_size=a.padding)
    return metrics.run_summary(files.read_rows(spark, a.output, DEPTH_RESULT)[1]).first().asDict()


def _results(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    meta, rows = files.read_rows(spark, path, DEPTH_RESULT)
    return meta, rows.withColumns({"result_id": F.monotonically_increasing_id(), "start_pos": F.col("position.start_pos"), "end_pos": F.col("position.end_pos")})


def report(spark: SparkSession, a: argparse.Namespace) -> dict:
    meta, rows = _results(spark, a.results)
    html.report(rows, a.output, meta, a.errors)
    return {"page": a.output}


def heatmap(spark: SparkSession, a: argparse.Namespace) -> dict:
    meta, questions, results, length = {}, None, None, a.length
    if a.questions:
        meta = files.read_metadata(spark, a.questions)
        questions = files.read_positions(spark, a.questions)[0]
    if a.results:
        meta = {**files.read_metadata(spark, a.results), **({"total_tokens": meta["total_tokens"]} if meta.get("total_tokens") else {})}
        results = files.read_depth_scores(spark, a.results) if "depth" in a.mode else files.read_scores(spark, a.results)[0]
    if a.mode != "depth" and not (length := length or meta.get("total_tokens") or meta.get("context_length")):
        raise ValueError("no context length is given and the metadata has none")
    html.heatmap(a.mode, a.output, questions, results, length, a.bins)
    return {"page": a.output, "length": length}


def analyze(spark: SparkSession, a: argparse.Namespace) -> dict:
    sized = files.read_text(spark, a.novel).select("path", F.size(tokens.encode("text")).cast("bigint").alias("total_tokens"))
    out = {
        "novels": [r.asDict() for r in sequence.novel_analysis(spark, sized, per_10k=a.per_10k, key="path").orderBy("path").collect()],
        "levels": [r.asDict() for r in sequence.level_plan(spark, sized, per_10k=a.per_10k, key="path").orderBy("path", "level").collect()],
    }
    if a.output:
        Path(a.output).write_text(json.dumps(out, ensure_ascii=False, indent=1), encoding="utf-8")
    return out


def summary(spark: SparkSession, a: argparse.Namespace) -> dict:
    said = pipelines.summarize(_novel(spark, a.novel).select("novel_id", "text"), _provider(spark, a), a.lines).first()["summary"]
    files.update_summary(spark, a.questions, said, to=a.output)
    return {"summary": said}


def probe(_: SparkSession | None, a: argparse.Namespace) -> dict:
    paths = sorted(Path(a.all).glob("*.env")) if a.all else [Path(a.config)]
    return {"probes": probe_all({p.name: config.read_config(str(p)) for p in paths})}


COMMANDS: dict[str, Callable] = {f.__name__: f for f in (generate, validate, test, report, heatmap, analyze, summary, probe)}


def session(a: argparse.Namespace) -> SparkSession:
    b = SparkSession.builder.appName("lectern").master(a.master)
    return (b.config("spark.checkpoint.dir", a.shared) if a.shared else b).getOrCreate()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 when the command ran, 2 when its arguments or files are at fault; what it says is one JSON object."""
    a = arguments().parse_args(argv)
    try:
        check(a)
        spark = spark or (None if a.command == "probe" else session(a))
        if spark is not None:
            from lectern.plans.session import ship

            ship(spark)
        print(json.dumps(COMMANDS[a.command](spark, a), ensure_ascii=False, default=str))
    except ValueError as e:
        print(f"lectern {a.command}: {e}", file=sys.stderr)
        return 2
    return 0
