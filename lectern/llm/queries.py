"""Queries of this subpackage over the test tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import leaks, near_copies, one_form, packing, quota_sample, subjects
from lectern.plans.session import table

CATEGORIES = ["question_type", "depth_bin", "context_length"]


# 1: one form


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Validations whose evidence reads as a stretch of its context but is written in other characters."""
    return one_form.quotes_in_other_characters(table(spark, d, "validations"), table(spark, d, "contexts"), "validation_id", "context_id", "evidence", "context").select("validation_id")


def p1_one_form(spark: SparkSession, d: str) -> DataFrame:
    """All evidence and context text in one form."""
    v, c = table(spark, d, "validations"), table(spark, d, "contexts")
    form = one_form.one_form(one_form.letter_pairs((v, "evidence"), (c, "context")))
    both = v.select(F.lit("evidence").alias("source"), F.col("validation_id").alias("id"), F.col("evidence").alias("text")).unionByName(c.select(F.lit("context").alias("source"), F.col("context_id").alias("id"), F.col("context").alias("text")))
    return both.dropDuplicates(["source", "id"]).select("source", "id", form("text").alias("text"))


def p1_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of all evidence with its context, both in one form."""
    return one_form.recomputed_similarity(table(spark, d, "validations"), table(spark, d, "contexts"), "validation_id", "context_id", "evidence", "context")


# 2: near copies


def _question_text() -> F.Column:
    return F.concat_ws(" ", F.col("question"), F.array_join(F.map_values("choice"), " "))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of each question."""
    return near_copies.near_copy_groups(table(spark, d, "questions"), "q_id", _question_text(), 0.7, near_copies.element_set)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of different questions in one group."""
    return near_copies.group_pairs(p2_groups(spark, d), "q_id")


def p2_weighted(spark: SparkSession, d: str) -> DataFrame:
    """The group of each question by its runs of five words, weighted by how often they occur."""
    return near_copies.near_copy_groups(table(spark, d, "questions"), "q_id", _question_text(), elements=near_copies.shingle_counts, weighted=True)


# 4: samples by quota


def _depth_bin(c: F.Column) -> F.Column:
    """The depth in percent that a spelling names; null for others."""
    s = F.regexp_replace(F.translate(c, "０１２３４５６７８９．％　", "0123456789.% "), r"[\s\x{A0}]+", "")
    number = F.regexp_extract(s, r"^(\d+(?:\.\d*)?)%?$", 1).try_cast("double")
    return F.round(F.when(s.endswith("%") | (number > 1), number).otherwise(number * 100), 6)


def _type_name(c: F.Column) -> F.Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " "))), r"[ _-]+", "_")


def _usable_assignments(spark: SparkSession, d: str) -> DataFrame:
    """Usable assignments, once each, in the spelling of the targets."""
    known = table(spark, d, "sample_targets")
    types = known.select("question_type").distinct().select(_type_name(F.col("question_type")).alias("t_"), "question_type").dropDuplicates(["t_"])
    bins = known.select("depth_bin").distinct().select(_depth_bin(F.col("depth_bin")).alias("b_"), "depth_bin").dropDuplicates(["b_"])
    q = table(spark, d, "questions").select("q_id", _type_name(F.col("question_type")).alias("t_")).where("t_ is not null").join(types, "t_").groupBy("q_id").agg(F.min("question_type").alias("question_type"))
    a = table(spark, d, "depth_assignments").where("context_length > 0 and assignment_id is not null").select("assignment_id", "q_id", "context_length", _depth_bin(F.col("depth_bin")).alias("b_")).where("b_ is not null").groupBy("assignment_id").agg(F.min(F.struct("q_id", "context_length", "b_")).alias("a")).select("assignment_id", "a.*")
    return a.join(bins, "b_").join(q, "q_id").select("assignment_id", *CATEGORIES)


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """What each target asks for, what there is, and what the plan draws."""
    return quota_sample.quota_report(_usable_assignments(spark, d), CATEGORIES, table(spark, d, "sample_targets"), table(spark, d, "sample_plans"))


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sample of each plan."""
    return quota_sample.quota_sample(_usable_assignments(spark, d), "assignment_id", CATEGORIES, table(spark, d, "sample_targets"), table(spark, d, "sample_plans"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets that cannot be reached."""
    return p4_report(spark, d).where("not reached").select("plan_id", *CATEGORIES)


# 6: packing


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document in containers of each capacity."""
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "containers"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents too long for one container."""
    return p6_packed(spark, d).where("pieces > 1 and piece = 1").select("container_id", "doc_id")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return packing.fill_report(p6_packed(spark, d))


# 7: leaks


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the test items they carry and the ranges of words and of characters to remove."""
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "test_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the test items they carry."""
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "test_items"), with_places=False).select("doc_id", "item_id")


def p7_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every document without the test material in it."""
    return leaks.cleaned_documents(table(spark, d, "documents"), table(spark, d, "test_items"))


# 8: subjects


def p8_subjects(spark: SparkSession, d: str) -> DataFrame:
    """The subjects of each document with the sentences about them."""
    return subjects.document_subjects(table(spark, d, "documents"), table(spark, d, "doc_labels"), table(spark, d, "subject_areas"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The subjects of each document."""
    return p8_subjects(spark, d).select("doc_id", "subject")


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and sentences of each subject in the corpus."""
    shares = subjects.subject_shares(table(spark, d, "documents"), table(spark, d, "doc_labels"), table(spark, d, "subject_areas"))
    return shares.groupBy("subject").agg(F.count_if(F.col("sentences") >= subjects.SHARE * F.col("of")).alias("documents"), F.sum("sentences").alias("sentences"))


def queries() -> dict:
    own = (p1_found, p1_one_form, p1_similarity, p2_found, p2_groups, p2_weighted, p4_found, p4_report, p4_sample, p6_found, p6_packed, p6_fill, p7_found, p7_leaks, p7_cleaned, p8_found, p8_subjects, p8_composition)
    return {f.__name__: f for f in own}


_LINKS = r"""
WITH RECURSIVE q AS (SELECT DISTINCT ON (q_id) q_id, concat_ws(' ', question, array_to_string(map_values(choice), ' ')) AS t FROM questions ORDER BY q_id),
w AS (SELECT q_id, list_distinct(regexp_extract_all(lower(t), '\p{Han}|[\p{Latin}\p{Cyrillic}\p{Greek}\p{N}]+')) AS w FROM q),
links AS (SELECT a.q_id AS a, b.q_id AS b FROM w a JOIN w b ON a.q_id <> b.q_id AND len(a.w) > 0 AND len(a.w) >= 0.7 * len(b.w) AND len(b.w) >= 0.7 * len(a.w)
  WHERE len(list_intersect(a.w, b.w)) >= 0.7 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) - 1e-9),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
"""

_TARGETS = r"""
WITH t AS (SELECT DISTINCT t.*, p.sample_size FROM sample_targets t JOIN sample_plans p USING (plan_id)),
types AS (SELECT DISTINCT question_type FROM sample_targets),
a AS (SELECT DISTINCT ON (assignment_id) assignment_id, q_id, context_length, regexp_replace(depth_bin, '\s+', '', 'g') AS b FROM depth_assignments),
n AS (SELECT *, TRY_CAST(rtrim(b, '%') AS DOUBLE) AS v FROM a WHERE regexp_full_match(b, '\d+(\.\d*)?%?')),
k AS (SELECT *, CASE WHEN b LIKE '%\%' ESCAPE '\' OR v > 1 THEN v ELSE v * 100 END AS pct FROM n WHERE context_length > 0),
q AS (SELECT DISTINCT ON (q_id) q_id, regexp_replace(lower(trim(question_type)), '[ _-]+', '_', 'g') AS question_type FROM questions),
u AS (SELECT q.question_type, concat(CAST(CAST(pct AS INTEGER) AS VARCHAR), '%') AS depth_bin, context_length, count(*) AS n
  FROM k JOIN q USING (q_id) JOIN types ON types.question_type = q.question_type WHERE pct IN (0, 25, 50, 75, 100) GROUP BY ALL)
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express. Reading look-alikes, tokens of a vocabulary, searches with edits and models
    are not among them; their tests compare them with brute force, round trips and labels."""
    return {
        "p2_found": _LINKS + "SELECT DISTINCT a AS q_id_a, b AS q_id_b FROM reach WHERE a < b",
        "p2_groups": _LINKS + "SELECT q.q_id, least(q.q_id, coalesce(min(r.b), q.q_id)) AS group_id FROM q LEFT JOIN reach r ON r.a = q.q_id GROUP BY q.q_id",
        "p4_found": _TARGETS + "SELECT t.plan_id, t.question_type, t.depth_bin, t.context_length FROM t LEFT JOIN u USING (question_type, depth_bin, context_length) WHERE coalesce(u.n, 0) < t.min_rows OR coalesce(u.n, 0) < t.target_share * t.sample_size",
    }
