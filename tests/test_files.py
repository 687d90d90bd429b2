import json

from lectern.schema import QUESTION
from lectern.sources import files


def lines(path, rows):
    path.write_text("".join(r + "\n" for r in rows), encoding="utf-8")
    return str(path)


def test_header_only_on_the_first_line(spark, tmp_path):
    rows = [json.dumps({"metadata": {"total_tokens": 9}}), "", json.dumps({"question": "q1", "position": {"start_pos": 1, "end_pos": 2}, "own": 5}), json.dumps({"question": "q2", "metadata": {"x": 1}})]
    meta, df = files.read_rows(spark, lines(tmp_path / "a.jsonl", rows), QUESTION)
    assert meta == {"total_tokens": 9}
    got = {r["question"]: r for r in df.collect()}
    assert set(got) == {"q1", "q2"} and got["q1"]["position"]["end_pos"] == 2 and json.loads(got["q1"]["raw"])["own"] == 5
    assert files.read_rows(spark, lines(tmp_path / "b.jsonl", rows[2:]))[0] == {}
    meta, df = files.read_rows(spark, lines(tmp_path / "c.jsonl", rows[:1]))
    assert meta and df.count() == 0


def test_strict_and_tolerant_reads(spark, tmp_path):
    import pytest

    rows = ['{"metadata": {}}', '{"position": {"start_pos": 1, "end_pos": 2}, "score": "0.5", "depth_bin": "0%", "test_context_length": 10}', "{broken", '{"metadata": 1}', '{"position": {"start_pos": 1}, "score": 1}', '{"position": {"start_pos": 3, "end_pos": 4}, "score": "x"}']
    at = lines(tmp_path / "a.jsonl", rows)
    good, skipped = files.read_positions(spark, at)
    assert good.count() == 2 and skipped == 2
    good, skipped = files.read_scores(spark, at)
    assert [tuple(r) for r in good.collect()] == [(1, 2, 0.5)] and skipped == 3
    assert files.read_depth_scores(spark, at).count() == 1
    with pytest.raises(Exception):
        files.read_rows(spark, at)[1].collect()


def test_write_read_and_redact(spark, tmp_path):
    df = spark.createDataFrame([(2, "é", None), (1, "b", ["x"])], "n int, question string, answer array<string>")
    at = str(tmp_path / "deep" / "out.jsonl")
    files.write_rows(df, at, {"config": {"api_key": "SECRET", "Access-Token": "x", "model": "m"}, "list": [{"password": 1}]}, order="n")
    text = (tmp_path / "deep" / "out.jsonl").read_text(encoding="utf-8").splitlines()
    assert json.loads(text[0]) == {"metadata": {"config": {"model": "m"}, "list": [{}]}}
    assert [json.loads(x) for x in text[1:]] == [{"question": "b", "answer": ["x"]}, {"question": "é", "answer": None}]
    files.update_summary(spark, at, "short")
    assert files.read_metadata(spark, at)["novel_summary"] == "short"
    assert (tmp_path / "deep" / "out.jsonl").read_text(encoding="utf-8").splitlines()[1:] == text[1:]
    files.write_results(df, at, "now", "depth", {"api_key": "k"}, "n")
    assert files.read_metadata(spark, at)["test_mode"] == "depth" and "api_key" not in (tmp_path / "deep" / "out.jsonl").read_text()


def test_text(spark, tmp_path):
    (tmp_path / "n.txt").write_text("a\nb\n\nc", encoding="utf-8")
    assert files.read_head(spark, str(tmp_path / "n.txt"), 2).first()["text"] == "a\nb\n"
    assert files.read_text(spark, str(tmp_path / "n.txt")).first()["text"] == "a\nb\n\nc"


def test_a_header_for_each_file_of_a_folder(spark, tmp_path):
    """A folder with several headers, a file without one, and a row that equals another file's header."""
    head = lambda k: json.dumps({"metadata": {"run": k}})
    row = lambda k: json.dumps({"question": f"q{k}"})
    lines(tmp_path / "a.jsonl", [head(1), row(1), head(2), *(row(k) for k in range(100, 400))])
    lines(tmp_path / "b.jsonl", [head(2), row(2)])
    lines(tmp_path / "c.jsonl", [row(3), head(1), "", "null"])
    heads = {r["file"].rsplit("/", 1)[1]: json.loads(r["metadata"]) for r in files.read_headers(spark, str(tmp_path)).collect()}
    assert heads == {"a.jsonl": {"run": 1}, "b.jsonl": {"run": 2}}
    meta, rows = files.read_rows(spark, str(tmp_path), QUESTION, strict=False)
    raw = [r["raw"] for r in rows.collect()]
    assert meta == {"run": 1} and sorted(raw) == sorted([row(1), head(2), row(2), row(3), head(1), "null", *(row(k) for k in range(100, 400))])
