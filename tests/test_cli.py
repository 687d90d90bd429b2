import json

import pytest

from lectern import cli
from lectern.plans.provider import Retryable, probe_all

SENTENCES = [f"On day {k} the miller of Ashby counted {k} sacks of grain and wrote it down." for k in range(400)]


class Replies:
    """A provider that answers by what a prompt asks for."""

    def __init__(self, lost: int = 0):
        self.lost = lost

    def ask(self, rows, prompt):
        from pyspark.sql import functions as F

        question = '{"question": "How many?", "question_type": "single_choice", "choice": {"a": "one", "b": "two"}, "answer": ["a"]}'
        verdict = '{"answer": ["a"], "evidence": "the miller of Ashby counted", "is_answerable": true, "confidence": "high", "reasoning": "r"}'
        p = F.lower(prompt)
        reply = F.when(p.startswith("write one"), F.lit(question)).when(p.contains("is_answerable"), F.lit(verdict)).when(p.startswith("summarize"), F.lit(" a mill ")).otherwise(F.lit('{"answer": ["a"]}'))
        lost = F.pmod(F.xxhash64("prompt"), F.lit(3)) < self.lost if "prompt" in rows.columns else F.lit(False)
        return rows.withColumn("reply", F.when(~lost, reply)).withColumn("call_error", F.when(lost, "no reply"))


@pytest.fixture
def run(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "novel.txt").write_text("\n".join(SENTENCES), encoding="utf-8")
    monkeypatch.setattr(cli, "_provider", lambda s, a: run.provider)

    def run(*argv):
        code = cli.main([str(tmp_path / a) if str(a).endswith((".txt", ".jsonl", ".html")) else str(a) for a in argv], spark)
        out = capsys.readouterr()
        return (code, json.loads(out.out)) if code == 0 else (code, out.err)

    run.provider = Replies()
    return run


def test_a_whole_run(run, tmp_path):
    code, got = run("generate", "--novel", "novel.txt", "--output", "q.jsonl", "--questions", 12, "--window", 60)
    assert code == 0 and got["asked"] == 12 and 8 <= got["questions"] <= 12
    n = got["questions"]
    code, got = run("validate", "--novel", "novel.txt", "--questions", "q.jsonl", "--output", "v.jsonl")
    assert code == 0 and (got["total"], got["passed"]) == (n, n)
    code, got = run("test", "--novel", "novel.txt", "--questions", "v.jsonl", "--output", "r.jsonl", "--mode", "uniform", "--lengths", "2000,3000", "--padding", 20)
    assert code == 0 and got["total"] == n and got["mean_score"] == 1.0
    rows = [json.loads(x) for x in open("r.jsonl", encoding="utf-8")]
    assert rows[0]["metadata"]["test_mode"] == "depth" and {r["depth_bin"] for r in rows[1:]} == {"0%", "25%", "50%", "75%", "100%"} and all(0 <= r["depth"] <= 1 for r in rows[1:])
    assert run("test", "--novel", "novel.txt", "--questions", "v.jsonl", "--output", "f.jsonl", "--mode", "fixed", "--lengths", "2000", "--depth", 0.4, "--padding", 20, "--most", 5)[1]["total"] == 5
    assert run("test", "--novel", "novel.txt", "--questions", "v.jsonl", "--output", "l.jsonl", "--length", 4000)[0] == 0
    assert run("test", "--questions", "v.jsonl", "--output", "o.jsonl", "--mode", "no_reference")[1]["total"] == n
    for mode in cli.MAPS:
        assert run("heatmap", "--mode", mode, "--questions", "v.jsonl", "--results", "r.jsonl", "--output", f"{mode}.html", "--length", 7000)[0] == 0
        assert "<svg" in (tmp_path / f"{mode}.html").read_text()
    assert run("report", "--results", "r.jsonl", "--output", "report.html")[0] == 0 and "single_choice" in (tmp_path / "report.html").read_text()
    code, got = run("analyze", "--novel", "novel.txt")
    assert code == 0 and [x["level"] for x in got["levels"] if x["questions"]] == [2000, 4000] and got["novels"][0]["questions"] == 10
    assert run("summary", "--novel", "novel.txt", "--questions", "v.jsonl", "--output", "s.jsonl")[1] == {"summary": "a mill"}
    assert json.loads(open("s.jsonl", encoding="utf-8").readline())["metadata"]["novel_summary"] == "a mill"


def test_recovery(run):
    assert run("generate", "--novel", "novel.txt", "--output", "q.jsonl", "--questions", 6)[0] == 0
    rows = [json.loads(x) for x in open("q.jsonl", encoding="utf-8")]
    with open("d.jsonl", "w", encoding="utf-8") as f:
        f.writelines(json.dumps({**r, "question": f"How many {k}?"} if k else r) + "\n" for k, r in enumerate(rows))
    run.provider = Replies(lost=2)
    first = run("test", "--questions", "d.jsonl", "--output", "r.jsonl", "--mode", "no_reference", "--skip-check")[1]
    assert 0 < first["timeout"] <= first["total"]
    run.provider = Replies()
    counts = run("test", "--questions", "d.jsonl", "--output", "r2.jsonl", "--mode", "no_reference", "--skip-check", "--recover", "r.jsonl")[1]
    assert counts == {"retried": first["timeout"], "recovered": first["timeout"], "still_failed": 0}
    out = [json.loads(x) for x in open("r2.jsonl", encoding="utf-8")]
    assert out[0]["metadata"]["recovery"] == counts and len(out) == 1 + first["total"] and {r["parsing_status"] for r in out[1:]} == {"success"}


FAULTS = [
    ("generate --novel none.txt --output x", "no file"), ("generate --novel novel.txt --output x --questions 0", "positive"), ("generate --novel novel.txt --output x --strategy last", "unknown sampling"),
    ("validate --novel novel.txt --questions novel.txt --output x --threshold 2", "threshold"), ("validate --novel novel.txt --questions novel.txt --output x --confidence sure", "confidence"),
    ("test --questions novel.txt --output x", "positive context length"), ("test --questions novel.txt --output x --length 5", "needs a novel"), ("test --questions novel.txt --novel novel.txt --output x --mode fixed --lengths 5", "depth"),
    ("test --questions novel.txt --output x --mode no_reference --length 5", "takes no"), ("test --questions novel.txt --novel novel.txt --output x --length 5 --concurrency 0", "concurrency"),
    ("report --results none --output x", "no file"), ("report --results novel.txt --output x --errors -1", "negative"), ("heatmap --output x", "needs questions"), ("heatmap --output x --mode depth", "need results"),
    ("heatmap --output x --mode pie", "mode is one of"), ("heatmap --output x --questions novel.txt --bins 0", "positive"), ("analyze --novel novel.txt --per-10k 0", "positive"), ("summary --novel novel.txt --questions novel.txt --lines 0", "positive"),
    ("probe", "not both"), ("probe --config novel.txt --all .", "not both"),
]


@pytest.mark.parametrize("line, said", FAULTS)
def test_faulty_arguments(run, line, said):
    code, err = run(*line.split())
    assert code == 2 and said in err


def test_probe_of_all(tmp_path):
    def make(config):
        def call(prompt):
            if config == "slow":
                raise Retryable("busy")
            return "one two three" if config == "good" else None

        return call

    got = probe_all({"b": "slow", "a": "good", "c": "none"}, make)
    assert [(r["name"], r["ok"], r["tokens"], r["error"]) for r in got] == [("a", True, 3, None), ("b", False, 0, "busy"), ("c", False, 0, None)] and got[0]["tokens_per_second"] > 0
