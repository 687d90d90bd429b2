"""

The loops get rows that are already loaded as Python objects; loading is timed apart. They run in one thread, as a program
without an engine would. Prints one line of JSON."""

import json
import os
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import pyarrow.parquet as pq

D = Path(os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"))
LENGTH, BINS, PADDING = 200_000, 50, 500


def load(name: str, key: str | None = None) -> list[dict]:
    rows = pq.read_table(D / f"{name}.parquet").to_pylist()
    return list({r[key]: r for r in rows}.values()) if key else rows


def score(r: dict) -> tuple[str, float, float, float, float]:
    """(category, score, precision, recall, F1) of one result."""
    c, m = set(r["correct_answer"] or []), set(r["model_answer"] or [])
    both = len(c & m)
    p, q = both / len(m) if m else 0.0, both / len(c) if c else 0.0
    f = 2 * p * q / (p + q) if p + q else 0.0
    if not m or r["parsing_status"] == "parsing_error":
        return "parsing_error", 0.0, p, q, f
    kind, same = r["question_type"], c == m
    category = "correct" if same else "partially_correct" if kind == "multiple_choice" and both else "incorrect"
    return category, float(same) if kind in ("single_choice", "negative_question") else f if kind == "multiple_choice" else 0.0, p, q, f


def all_metrics(t):
    out, n = Counter(), 0
    for r in t["results"]:
        category, s, p, q, f = score(r)
        out[category] += 1
        out["score"] += s
        if r["question_type"] == "multiple_choice":
            out.update({"p": p, "r": q, "f": f})
        elif r["question_type"] == "single_choice":
            out["equal"] += r["correct_answer"] == r["model_answer"]
        n += 1
    return {k: v / n for k, v in out.items()}


def metrics_by_model(t):
    by = defaultdict(list)
    for r in t["results"]:
        by[r["model_name"]].append(r)
    return {k: all_metrics({"results": v}) for k, v in by.items()}


def row_scores(t):
    return [(r["result_id"], *score(r)) for r in t["results"]]


def placed(t):
    q = {r["q_id"]: r["position"] for r in t["questions"]}
    for r in t["results"]:
        p = q.get(r["q_id"])
        if p and p["start_pos"] is not None and p["end_pos"] is not None and 0 <= p["start_pos"] < p["end_pos"]:
            yield r, p["start_pos"]


def accuracy_bins(t):
    bins = [[] for _ in range(BINS)]
    for r, at in placed(t):
        if r["score"] is not None:
            bins[min(int(at / (LENGTH / BINS)), BINS - 1)].append(r["score"])
    return [sum(b) / len(b) if b else None for b in bins]


def coverage_bins(t):
    edges = [int(k * LENGTH / BINS) for k in range(BINS)] + [LENGTH]
    raw = [0.0] * BINS
    for r in t["questions"]:
        p = r["position"]
        if p and p["start_pos"] is not None and p["end_pos"] is not None and p["end_pos"] > p["start_pos"]:
            for k in range(BINS):
                n = min(p["end_pos"], edges[k + 1]) - max(p["start_pos"], edges[k])
                if n > 0:
                    raw[k] += n / (p["end_pos"] - p["start_pos"])
    return [x / max(raw) for x in raw]


def depth_grid(t):
    cells = defaultdict(list)
    for r in t["results"]:
        if r["depth_bin"] and r["test_context_length"] and r["score"] is not None:
            cells[r["test_context_length"], r["depth_bin"]].append(r["score"])
    return {k: sum(v) / len(v) for k, v in cells.items()}


def trend_line(t):
    runs, out = defaultdict(list), []
    for r, at in placed(t):
        runs[r["novel_id"]].append((at, r["result_id"], r["score"]))
    for rows in runs.values():
        rows.sort(key=lambda x: x[:2])
        for k in range(len(rows)):
            near = [s for _, _, s in rows[max(0, k - 10) : k + 11] if s is not None]
            out.append(rows[k][2] if len(rows) < 20 else sum(near) / len(near) if near else None)
    return out


def depth_summary(t):
    by = defaultdict(list)
    for r in t["results"]:
        by["depth", r["depth_bin"] or "unknown"].append(r["score"] or 0)
        by["length", r["test_context_length"] or 0].append(r["score"] or 0)
    return {k: sum(v) / len(v) for k, v in by.items()}


def schedule_uniform(t):
    return [(r["q_id"], k % 20 % 5, k % 20 // 5) for k, r in enumerate(sorted(t["questions"], key=lambda r: r["q_id"]))]


def question_validation(t):
    out = []
    for r in t["questions"]:
        p, c, a = r["position"], r["choice"], r["answer"]
        fault = not r["question"] or not r["question"].strip() or not r["question_type"] or c is None or len(c) < 2 or not a or any(v is None for _, v in c) or p is None or p["start_pos"] is None or p["end_pos"] is None or p["start_pos"] < 0 or p["end_pos"] < p["start_pos"]
        fault = fault or r["question_type"] not in ("single_choice", "multiple_choice", "negative_question") or (r["question_type"] == "multiple_choice" and len(c) - len(a) < 2) or not set(a) <= {k for k, _ in c}
        out.append((r["q_id"], fault))
    return out


def token_counts(t):
    return [(r["doc_id"], len(re.findall(r"\s*\S+|\s+", r["text"] or ""))) for r in t["documents"]]


def parse_answer(t):
    out = []
    for r in t["results"]:
        try:
            v = json.loads(r["raw_answer"] or "")
        except ValueError:
            v = None
            for x in reversed(re.findall(r"\{[^{}]*\}", r["raw_answer"] or "")):
                try:
                    v = json.loads(x)
                    break
                except ValueError:
                    pass
        out.append((r["result_id"], v.get("answer") if isinstance(v, dict) else None))
    return out


LOOPS = (all_metrics, metrics_by_model, row_scores, accuracy_bins, coverage_bins, depth_grid, trend_line, depth_summary, schedule_uniform, question_validation, token_counts, parse_answer)


def main() -> None:
    start = time.time()
    t = {"results": load("results", "result_id"), "questions": load("questions", "q_id"), "documents": load("documents")}
    took = {"load": round(time.time() - start, 3)}
    for f in LOOPS:
        start = time.time()
        f(t)
        took[f.__name__] = round(time.time() - start, 3)
    print(json.dumps({"metric": "plain_python", "unit": "sec", "queries": took, "rows": {k: len(v) for k, v in t.items()}, "sf": D.name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
