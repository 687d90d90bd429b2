"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os
import re
import subprocess
import sys
import unicodedata
from difflib import SequenceMatcher

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
CORE = [k for m in entry._modules() if not m.__name__.startswith("lectern.llm") for k in m.queries()]


def plain(v):
    if v is None or isinstance(v, bool | str | int):
        return v
    return "nan" if math.isnan(float(v)) else round(float(v), 6) + 0.0


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def check_normal_form(spark, duck, df):
    marks = {"。": ".", "【": "[", "】": "]"}
    want = {i: None if t is None else "".join(marks.get(c, c) for c in re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t).lower())).strip() for i, t in duck.execute("select validation_id, any_value(evidence) from validations group by 1").fetchall()}
    assert {r["validation_id"]: r["text"] for r in df.collect()} == want


def check_windows(spark, duck, df):
    texts = dict(duck.execute("select doc_id, text from documents where text <> ''").fetchall())
    rows = df.collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        t = re.findall(r"\s*\S+|\s+", texts[r["doc_id"]], re.A)
        assert "".join(t[r["start"] : r["end"]]) == r["text"] and 0 <= r["start"] <= r["end"] <= len(t) and r["end"] - r["start"] <= 500 + 2 * 100 + 1
        assert r["start"] == 0 or r["end"] == len(t) or r["end"] - r["start"] >= 500


def check_evidence(spark, duck, df):
    from lectern.functions.evidence import plain_text

    pairs = {i: (e, c) for i, e, c in duck.execute("select validation_id, any_value(evidence), any_value(context) from validations left join contexts using (context_id) group by 1").fetchall()}
    rows = df.collect()
    assert len(rows) == len(pairs)
    for r in rows:
        e, c = (plain_text(x or "") for x in pairs[r["validation_id"]])
        sim = r["evidence_similarity"]
        assert r["evidence_found"] == (sim is not None and sim >= 0.8) and (sim == 1.0 or not (e and e in c)) and (sim == 0.0) == (not e or not c)
        if sim is None and len(e) < 40:
            assert max((SequenceMatcher(None, e, c[k : k + n]).ratio() for n in range(max(10, int(0.8 * len(e))), int(1.2 * len(e)) + 1) for k in range(max(0, len(c) - n + 1))), default=0) < 0.8


def check_contexts(spark, duck, df):
    assert set(df.columns) == {"assignment_id", "success", "total_length", "context"}  # the texts: test_contexts_are_whole_texts


CHECKS = {"text_normalize": check_normal_form, "aligned_window": check_windows, "evidence_match": check_evidence, "context_text": check_contexts}


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, D)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    if name not in entry.oracle_sql():
        assert got and CHECKS[name](spark, duck, df) is None
        return
    r = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    order = sorted(range(len(names)), key=names.__getitem__)
    assert got == sorted((tuple(plain(row[i]) for i in order) for row in r.fetchall()), key=str)


def test_stored_status_is_what_the_parser_says(spark):
    r = entry.queries()["offline_test_pipeline"](spark, D).select("result_id", "parsing_status", "answers")
    stored = spark.read.parquet(f"{D}/results.parquet").dropDuplicates(["result_id"]).where("raw_answer is not null and parsing_status in ('success', 'regex_extracted')")
    both = r.join(stored.selectExpr("result_id", "parsing_status as old", "array_join(model_answer, ',') as old_answers"), "result_id")
    n = both.count()
    assert n > 0 and both.where("parsing_status = old").count() >= 0.95 * n


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_the_rest_stands_without_the_llm_folder(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in ("lectern", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", f"{root}/{name}", tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "lectern/llm"], check=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'p3_found' in q and 'p1_found' not in q, q; e.oracle_sql()"], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr


def test_cuts_have_the_lengths_of_contexts(spark):
    words = "array_size(regexp_extract_all({}, '\\\\S+', 0))"
    docs = spark.read.parquet(f"{D}/documents.parquet").selectExpr("doc_id", "text", words.format("text") + " as n")
    q = lambda name: docs.join(entry.queries()[name](spark, D), "doc_id").where("n > 1500")
    assert q("first_n_context_full").count() > 0 and q("first_n_context_full").where("head <> text").count() == 0
    parts = q("evidence_slice_full").selectExpr(words.format("part") + " as k", "instr(text, part) / length(text) as at").collect()
    assert max(r.k for r in parts) > 500 and max(r["at"] for r in parts) > 0.2
    assert q("aligned_window").where("end - start > 400").count() > 0


def test_contexts_are_whole_texts(spark, duck):
    got = {r.assignment_id: r for r in entry.queries()["context_text"](spark, D).collect()}
    texts = {k: re.findall(r"\s*\S+|\s+", t, re.A) for k, t in duck.execute("select novel_id, string_agg(text, chr(10) || chr(10) order by doc_id) from documents where kind = 'chapter' and novel_id is not null and text <> '' group by 1").fetchall()}
    rows = duck.execute("select distinct on (a.assignment_id) a.assignment_id, q.novel_id, q.position.start_pos, q.position.end_pos, a.target_depth, a.context_length from depth_assignments a join questions q using (q_id) where a.context_length > 0").fetchall()
    rows = [r for r in rows if r[1] in texts]
    assert rows and set(got) == {r[0] for r in rows}
    built = 0
    for key, novel, start, end, depth, length in rows:
        t, r = texts[novel], got[key]
        if depth is None or not 0 <= depth <= 1 or start is None or end is None:
            assert not r.success and r.context == ""
            continue
        s, e = min(max(0, start - 500), len(t)), min(len(t), end + 500)
        size = max(e - s, 0)
        if size >= length:
            assert not r.success and r.context == ""
            continue
        assert r.success and len(re.findall(r"\s*\S+|\s+", r.context, re.A)) <= r.total_length
        if size and length >= len(t):
            assert "".join(t[s:e]) in r.context and sum(map(len, t)) == len(r.context)
        built += r.context != ""
    assert built > 0
