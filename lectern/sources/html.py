"""Standalone HTML pages of a run: a report with errors and trend, and heat maps. Only aggregates and bounded samples reach the
driver."""

from __future__ import annotations

import html
import math
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import hover
from lectern.operators import bins, metrics, sampling, sequence
from lectern.schema import DEPTH_LABELS

STYLE = "body{font:14px sans-serif;margin:2em;color:#222}table{border-collapse:collapse}td,th{border:1px solid #bbb;padding:4px 8px}svg{background:#fafafa}"
_COLORS = {"gray": "#9e9e9e", "green": "#2e7d32", "yellow": "#f9a825", "red": "#c62828"}


def page(title: str, *parts: str) -> str:
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{STYLE}</style></head><body><h1>{html.escape(title)}</h1>{''.join(parts)}</body></html>"


def table(rows: list[dict]) -> str:
    if not rows:
        return "<p>No data</p>"
    show = lambda v: html.escape(f"{v:.4g}" if isinstance(v, float) else "" if v is None else str(v))
    head = "".join(f"<th>{html.escape(k)}</th>" for k in rows[0])
    return f"<table><tr>{head}</tr>{''.join('<tr>' + ''.join(f'<td>{show(v)}</td>' for v in r.values()) + '</tr>' for r in rows)}</table>"


def shade(value: float | None) -> str:
    """Red for 0 to green for 1; gray without data."""
    return "#dddddd" if value is None else f"hsl({round(120 * max(0.0, min(1.0, value)))},65%,55%)"


def strip(cells: list[tuple[str, float | None]], height: int = 40) -> str:
    """One row of shaded cells with their labels as hover texts."""
    w = 900 / max(1, len(cells))
    return f"<svg width='900' height='{height}'>" + "".join(f"<rect x='{k * w:.2f}' y='0' width='{w:.2f}' height='{height}' fill='{shade(v)}'><title>{html.escape(label)}</title></rect>" for k, (label, v) in enumerate(cells)) + "</svg>"


def scatter(cells: list[dict], trend: list[dict], top: float) -> str:
    """Cells of results by position and score, larger for more results, with the trend."""
    x = lambda p: 880 * p / max(top, 1) + 10
    y = lambda s: 190 - 170 * s
    dots = "".join(f"<circle cx='{x(p['start_pos']):.1f}' cy='{y(p['score']):.1f}' r='{min(8.0, 2 + math.log2(1 + p['n'])):.1f}' fill='{_COLORS.get(p['color'], '#888')}'><title>{p['n']} result(s): {html.escape(p['hover'] or '')}</title></circle>" for p in cells)
    line = " ".join(f"{x(p['start_pos']):.1f},{y(p['trend']):.1f}" for p in trend)
    return f"<svg width='900' height='200'>{dots}<polyline points='{line}' fill='none' stroke='#1565c0'/></svg>"


def type_section(m: dict, rate, sample: list[dict]) -> list[str]:
    """What a report says of one type of question: its share of each category, the figures that count for it, its sampled errors."""
    kind, n = m["question_type"], m["total"]
    parts = [(c, m[c] / n if n else 0.0) for c in ("correct", "partially_correct", "incorrect", "parsing_error")]
    figures = {"questions": n, "errors": rate["errors"], "error rate": rate["error_rate"], "mean score": m["mean_score"]}
    if kind == "single_choice":
        figures["accuracy"] = m["single_accuracy"]
    if kind == "multiple_choice":
        figures |= {k: m[f"multi_{k}"] for k in ("precision", "recall", "f1_score")}
    colors = ("green", "yellow", "red", "gray")
    x, bars = 0.0, ""
    for (name, share), color in zip(parts, colors):
        bars += f"<rect x='{900 * x:.1f}' y='0' width='{900 * share:.1f}' height='18' fill='{_COLORS[color]}'><title>{name}: {100 * share:.1f} %</title></rect>"
        x += share
    own = [{k: v for k, v in r.items() if k != "question_type"} for r in sample if r["question_type"] == kind]
    return [f"<h3>{html.escape(kind or 'without a type')}</h3>", table([figures]), f"<svg width='900' height='18'>{bars}</svg>", *([table(own)] if own else [])]


def combined(cells: list[dict], height: int = 160) -> str:
    """Coverage as bars and accuracy as points joined where neighbouring bins have any, over the same bins."""
    w = 900 / max(1, len(cells))
    bars = "".join(f"<rect x='{k * w:.2f}' y='{height * (1 - c['coverage']):.1f}' width='{max(1.0, w - 1):.2f}' height='{height * c['coverage']:.1f}' fill='#90caf9'><title>{html.escape(c['label'])}: coverage {c['coverage']:.2f}</title></rect>" for k, c in enumerate(cells))
    runs, run = [], []
    for k, c in enumerate([*cells, {"accuracy": None}]):
        if c["accuracy"] is None:
            runs, run = ([*runs, run] if run else runs), []
        else:
            run.append((k * w + w / 2, height * (1 - c["accuracy"])))
    lines = "".join(f"<polyline points='{' '.join(f'{x:.1f},{y:.1f}' for x, y in r)}' fill='none' stroke='#c62828'/>" for r in runs)
    dots = "".join(f"<circle cx='{k * w + w / 2:.1f}' cy='{height * (1 - c['accuracy']):.1f}' r='3' fill='#c62828'><title>{html.escape(c['label'])}: accuracy {c['accuracy']:.2f} of {c['question_count']}</title></circle>" for k, c in enumerate(cells) if c["accuracy"] is not None)
    return f"<svg width='900' height='{height}'>{bars}{lines}{dots}</svg>"


def report(results: DataFrame, path: str, metadata: dict | None = None, errors: int = 10, across: int = 440, seed: int = 0) -> None:
    """A page with the metrics, the scores by position with their trend, a section for each type of question, and a random sample of
    errors. ``results`` has
    result_id, question, start_pos and the columns of a result. A run without rows is an error; the plot shows
    all rows with a position, counted in cells of ``across`` stretches of position, score and color, and the mean trend of each
    stretch."""
    m = metrics.all_metrics(results).first().asDict()
    if not m["total"]:
        raise ValueError("the run has no results")
    scored = metrics.scored(results.where("start_pos is not null")).withColumn("run_", F.lit(1))
    from lectern.functions.answers import color

    trend = sequence.trend_line(scored, "run_", score="report_score", tie="result_id")
    low, top = scored.agg(F.min("start_pos"), F.max("start_pos")).first()
    stretch = F.floor((F.col("start_pos") - (low or 0)) * across / ((top or 0) - (low or 0) + 1)).alias("stretch")
    every = trend.join(scored.select("result_id", color(F.col("report_score"), F.col("parsing_status")).alias("color"), hover(F.col("question")).alias("hover")), "result_id")
    place = F.avg("start_pos").alias("start_pos")
    dots = [r.asDict() for r in every.groupBy(stretch, F.round("report_score", 2).alias("score"), "color").agg(place, F.count("*").alias("n"), F.min("hover").alias("hover")).orderBy("stretch").collect()]
    line = [r.asDict() for r in every.groupBy(stretch).agg(place, F.avg("trend").alias("trend")).orderBy("stretch").collect()]
    bad = metrics.scored(results).where(F.col("category").isin("incorrect", "partially_correct", "parsing_error"))
    sample = [r.asDict() for r in sampling.first_by_hash(bad.select("result_id", hover(F.col("question")).alias("question"), "category", F.array_join("correct_answer", ", ").alias("correct"), F.array_join("model_answer", ", ").alias("answered"), "question_type"), "result_id", errors, seed).collect()]
    from lectern.sources.files import redacted

    info = [{"key": k, "value": v} for k, v in redacted(metadata or {}).items()]
    rate = metrics.error_rate(results).first()
    types = [r.asDict() for r in metrics.all_metrics(results, "question_type").orderBy("question_type").collect()]
    wrong = {r["question_type"]: r for r in metrics.error_rate(results, "question_type").collect()}
    sections = [part for t in types for part in type_section(t, wrong[t["question_type"]], sample)]
    body = page("Report", "<h2>Run</h2>", table(info), "<h2>Metrics</h2>", table([m]), "<h2>Scores by position</h2>", f"<p>{sum(d['n'] for d in dots)} of {m['total']} results have a position and are shown.</p>", scatter(dots, line, top or 1), "<h2>Question types</h2>", *sections, f"<h2>Errors ({rate['errors']} of {rate['total']}, {100 * rate['error_rate']:.1f} %)</h2>", table(sample))
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(body, encoding="utf-8")


def heatmap(mode: str, path: str, questions: DataFrame | None = None, results: DataFrame | None = None, length: int | None = None, n_bins: int = 50) -> None:
    """A page of one mode: coverage, accuracy, combined, depth or combined_depth."""
    if mode not in ("coverage", "accuracy", "combined", "depth", "combined_depth"):
        raise ValueError(f"unknown mode {mode!r}")
    parts: list[str] = []
    if mode in ("coverage", "combined", "combined_depth"):
        rows = bins.coverage_bins(questions, length, n_bins).orderBy("bin").collect()
        parts += ["<h2>Coverage</h2>", strip([(f"{r['start_pos'] // 1000}K-{r['end_pos'] // 1000}K: {r['coverage']:.2f}", r["coverage"]) for r in rows])]
    if mode == "combined":
        both = bins.coverage_bins(questions, length, n_bins).join(bins.accuracy_bins(results, length, n_bins).select("bin", "accuracy", "question_count"), "bin").orderBy("bin").collect()
        parts += ["<h2>Coverage and accuracy</h2>", combined([r.asDict() | {"label": f"{r['start_pos'] // 1000}K-{r['end_pos'] // 1000}K"} for r in both])]
    if mode in ("accuracy", "combined"):
        cells = bins.accuracy_bins(results, length, n_bins)
        rows = cells.orderBy("bin").collect()
        mean = bins.weighted_accuracy(cells).first()["accuracy"]
        parts += [f"<h2>Accuracy{'' if mean is None else f' (mean {mean:.3f})'}</h2>", strip([(f"{r['start_pos'] // 1000}K-{r['end_pos'] // 1000}K: {'no data' if r['accuracy'] is None else format(r['accuracy'], '.2f')} ({r['question_count']})", r["accuracy"]) for r in rows])]
    if mode in ("depth", "combined_depth"):
        grid = bins.depth_grid(results)
        cells = {(r["depth_bin"], r["test_context_length"]): r for r in grid.collect()}
        lengths = sorted({n for _, n in cells})
        rows = [{"depth": d} | {str(n): cells[d, n]["accuracy"] for n in lengths} for d in reversed(DEPTH_LABELS)]
        means = {r["test_context_length"]: r["accuracy"] for r in bins.column_averages(grid).collect()}
        parts += ["<h2>Depth by length</h2>", *(strip([(f"{r['depth']} {n}", r[str(n)]) for n in lengths], 24) + "<br>" for r in rows), table([*rows, {"depth": "mean"} | {str(n): means[n] for n in lengths}])]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(page(f"Heat map: {mode}", *parts), encoding="utf-8")
