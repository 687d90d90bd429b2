"""Contexts made of whole pieces of text: the same as those made of tokens, in less time."""

import hashlib
import random
import re
import time

import pyarrow.parquet as pq
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lectern.functions import tokens
from lectern.operators import context


def words(n, seed=0):
    r = random.Random(seed)
    return "".join(r.choice([" ", "\n\n", "  \t", "　 "]) + r.choice(["ab", "河水。", "é,", "x" * 9]) for _ in range(n))


def test_pieces_hold_all_tokens(spark):
    texts = ["", " \n", "a", "a ", *(words(n, n) + end for n in (63, 64, 65, 128, 129, 1000) for end in ("", " \n"))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").withColumn("pieces", tokens.pieces("text"))
    for r in df.select("k", "text", "pieces", tokens.count_in_pieces(F.col("pieces")).alias("n"), tokens.count_tokens("text").alias("want")).collect():
        assert "".join(r.pieces) == r.text and r.n == r.want
        assert all(len(re.findall(tokens.WORDS, p, re.A)) == tokens.PIECE for p in r.pieces[:-1])


def test_contexts_of_pieces_are_those_of_tokens(spark):
    r, rows = random.Random(1), []
    novels = [words(n, n) + end for n, end in ((0, ""), (1, ""), (64, " "), (65, ""), (128, ""), (1000, "\n"))]
    for k in range(600):
        t = r.randrange(len(novels))
        s = r.choice([None, 0, 5, 64, r.randrange(1100), r.randrange(1100)])
        e = r.choice([None, s, (s or 0) + r.randrange(200), max(0, (s or 0) - r.randrange(100))])
        rows.append((k, novels[t], s, e, r.choice([None, 0.0, 0.25, 0.5, 1.0, 1.5, r.random()]), r.choice([None, 0, 10, 64, 200, 500, 3000])))
    df = spark.createDataFrame(rows, "k int, text string, s bigint, e bigint, d double, n bigint").select("*", tokens.encode("text").alias("tokens"), tokens.pieces("text").alias("pieces"))
    made = lambda **x: {r.k: (r.built, r.context) for r in context.build_contexts(df, F.col("s"), F.col("e"), F.col("d"), F.col("n"), padding=7, **x).collect()}
    want = made(tokens="tokens")
    assert made(tokens=None, pieces="pieces") == want and sum(c != "" for _, c in want.values()) > 150


def test_pieces_take_less_time_than_tokens(spark):
    """200 contexts of 64,000 tokens beside a novel that is held once: pieces in half the time of tokens or less."""
    novel = spark.createDataFrame([(1, words(80_000))], "novel_id int, text string").select("novel_id", tokens.encode("text").alias("tokens"), tokens.pieces("text").alias("pieces"), tokens.count_tokens("text").alias("n")).localCheckpoint()
    rows = spark.range(0, 200, 1, 1).selectExpr("id", "1 as novel_id", "id * 390 as s", "id * 390 + 300 as e", "id % 5 / 4D as d")
    took = {}
    for x in ({"tokens": "tokens"}, {"tokens": None, "pieces": "pieces"}):
        df = context.build_contexts(rows.join(novel.hint("shuffle_hash"), "novel_id"), F.col("s"), F.col("e"), F.col("d"), F.lit(64_000), n_tokens=F.col("n"), **x).select(F.md5(F.encode("context", "utf-8")).alias("m"))
        for _ in range(2):  # the first compiles
            began = time.time()
            got = df.agg(F.count_distinct("m"), F.sum(F.hash("m"))).first()
            took[tuple(x)] = got, time.time() - began
    (want, slow), (got, fast) = took.values()
    print(f"tokens {slow:.1f} s, pieces {fast:.1f} s")
    assert got == want and fast < slow / 2, f"{fast:.1f} s, {slow:.1f} s"


def test_long_contexts_are_right(spark, tmp_path):
    """400 contexts of 64,000 tokens from one novel, each as long as asked for and the right text."""
    chapters = [words(30_000, 1), words(50_000, 2)]
    places = [(q, random.Random(q).randrange(79_000)) for q in range(100)]
    asked = [(4 * q + k, q, k / 3, 64_000) for q, _ in places for k in range(4)]
    d = str(tmp_path)
    spark.createDataFrame([(q, 1, (a, a + 300)) for q, a in places], "q_id bigint, novel_id bigint, position struct<start_pos:bigint,end_pos:bigint>").write.parquet(f"{d}/questions.parquet")
    spark.createDataFrame(asked, "assignment_id bigint, q_id bigint, target_depth double, context_length bigint").write.parquet(f"{d}/depth_assignments.parquet")
    spark.createDataFrame([(k, "chapter", 1, t) for k, t in enumerate(chapters)], "doc_id bigint, kind string, novel_id bigint, text string").write.parquet(f"{d}/documents.parquet")
    got = {r.assignment_id: (r.success, r.total_length, r.m) for r in entry.queries()["context_text"](spark, d).select("assignment_id", "success", "total_length", F.md5(F.encode("context", "utf-8")).alias("m")).collect()}
    t = re.findall(tokens.WORDS, "\n\n".join(chapters), re.A)
    at, want = dict(places), {}
    for key, q, depth, length in asked:
        s, e = max(0, at[q] - 500), min(len(t), at[q] + 800)
        p = int((length - (e - s)) * depth)
        f = length - (e - s) - p
        prefix = t[e : e + max(0, p - s)] + t[max(0, s - p) : s]
        suffix = t[e : e + f] + (t[s - (f - (len(t) - e)) : s] if f > len(t) - e else [])
        want[key] = (True, length, hashlib.md5("".join(prefix + t[s:e] + suffix).encode()).hexdigest())
    assert got == want


def test_contexts_of_parts_are_those_of_tokens(spark):
    """Parts of all widths, shared by up to ten rows; evidence may end before it starts, far away."""
    r, rows = random.Random(3), []
    novels = spark.createDataFrame([(k, words(n, n) + end) for k, (n, end) in enumerate(((0, ""), (1, ""), (64, " "), (65, ""), (5000, "\n")))], "novel_id int, text string")
    novels = novels.select("novel_id", tokens.encode("text").alias("tokens"), tokens.pieces("text").alias("pieces"))
    for k in range(600):
        s = r.choice([None, 0, 5, 64, *(r.randrange(5200) for _ in range(4))])
        e = r.choice([None, s, (s or 0) + r.randrange(200), (s or 0) + r.randrange(200), r.randrange(5200)])
        rows.append((k, r.choice([0, 1, 2, 3, 4, 4, 4]), s, e, r.choice([None, 0.0, 0.25, 0.5, 1.0, 1.5, r.random()]), r.choice([0, 10, 64, 200, 500, 3000])))
    rows.append((600, 4, 4900, 10, 0.5, 200))
    df = spark.createDataFrame(rows, "k int, novel_id int, s bigint, e bigint, d double, n bigint").join(novels.select("novel_id", "tokens", F.size("tokens").alias("size")), "novel_id")
    args = [F.col("s"), F.col("e"), F.col("d"), F.col("n")]
    want = {x.k: x.context for x in context.build_contexts(df, *args, "tokens", padding=7).collect()}
    placed = context.build_contexts(df, *args, None, F.col("size"), 7, spans=True).drop("tokens")
    _, parts = context.shares(placed, "novel_id", 128, 10)
    assert parts.agg(F.max("copies_") > 1, F.max("level_")).first() == (True, 6)
    got = {x.k: x.context for x in context.texts_of_spans(placed, novels, "novel_id", "k", 8, 128, 10).collect()}
    assert got == want and len(got) == 601 and sum(c != "" for c in got.values()) > 150


def test_parts_are_small_beside_copies_of_the_novel(spark):
    """20,000 rows of up to 1,000 tokens over one novel of a million: what is sent is a few times the novel, not once for every 1,000 rows."""
    df = spark.range(20_000).selectExpr("id", "1 as novel_id", "id * 49 as s", "id * 49 + 100 as e", "id % 5 / 4D as d", "int(1000 - id % 500) as len")
    placed = context.build_contexts(df, F.col("s"), F.col("e"), F.col("d"), F.col("len"), None, F.lit(1_000_000), 100, spans=True)
    _, parts = context.shares(placed, "novel_id", 1000, 1000)
    sent, most, tasks = parts.select(F.sum(F.expr("copies_ * (last_ - first_)")) * tokens.PIECE, F.max(F.expr("last_ - first_")) * tokens.PIECE, F.sum("copies_")).first()
    assert sent < 3 * 1_000_000 and most <= 2 * 1000 + 2 * tokens.PIECE and tasks >= 20


def test_long_contexts_are_written_a_few_at_a_time(spark, tmp_path):
    """200 contexts of some 400 kB and as many empty ones: a writer that is to hold 4 MB holds little more."""
    d = str(tmp_path)
    places = [(q, 1, (a, a + 300)) for q, a in enumerate(range(0, 70_000, 700))]
    asked = [(4 * q + k, q, 0.5 if k % 2 else 2.0, 64_000) for q, _, _ in places for k in range(4)]
    spark.createDataFrame(places, "q_id bigint, novel_id bigint, position struct<start_pos:bigint,end_pos:bigint>").write.parquet(f"{d}/questions.parquet")
    spark.createDataFrame(asked, "assignment_id bigint, q_id bigint, target_depth double, context_length bigint").write.parquet(f"{d}/depth_assignments.parquet")
    spark.createDataFrame([(1, "chapter", 1, words(80_000, 1))], "doc_id bigint, kind string, novel_id bigint, text string").write.parquet(f"{d}/documents.parquet")
    entry.queries()["context_text"](spark, d).write.option("parquet.block.size", 4 << 20).parquet(f"{d}/out")
    groups = [g for p in (tmp_path / "out").glob("*.parquet") for m in [pq.read_metadata(p)] for g in map(m.row_group, range(m.num_row_groups))]
    held = [sum(g.column(k).total_compressed_size for k in range(g.num_columns)) for g in groups]
    assert sum(g.num_rows for g in groups) == 400 and sum(held) > 20 << 20 and max(held) < 6 << 20, held
