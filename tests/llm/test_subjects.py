import numpy as np
import pytest

from lectern.llm.subjects import _Ids, _sentences, document_subjects, sentence_terms, subject_shares


def test_sentences():
    t = np.array(sentence_terms("Chapter 3\n\nThe <b>cat</b> sat down. No! 猫坐在垫子上。\nOf mice and men", _Ids()))
    here, sentence = _sentences(t)
    assert sentence[-1] + 1 == 3 and len(here) == 4 + 6 - 1 + 4
    assert sentence_terms(None, _Ids()) == [] and len(_sentences(np.array(sentence_terms("!!", _Ids())))[0]) == 0


@pytest.fixture(scope="module")
def corpus(spark):
    import random

    rng = random.Random(3)
    own = {"law": "judge court verdict appeal clause witness".split(), "music": "violin sonata tempo chord aria tuning".split()}
    rest = "walked home early with a heavy coat under the grey sky of town".split()
    docs, labels = [], []
    for i in range(240):
        kinds = rng.choice([["law"], ["music"], [], ["law", "music"]])
        s = []
        for k in kinds:
            for _ in range(4):
                s.append(" ".join(rng.sample(own[k], 3) + rng.sample(rest, 4)))
        for _ in range(3):
            s.append(" ".join(rng.sample(rest, 7)))
        rng.shuffle(s)
        docs.append((i, ". ".join(s) + ".", "clash"))
        if i % 2 == 0:
            labels += [(i, k) for k in kinds] or [(i, None)]
    truth = {i: set() for i in range(240)}
    for i, t, _ in docs:
        truth[i] = {k for k, w in own.items() if any(x in t.split() for x in w)}
    docs += [(900, None, ""), (901, "", ""), (902, "Of.", ""), (903, "judge court verdict. " * 20 + "walked home early. " * 20, ""), (904, "walked home early. " * 30_000, "")]
    areas = spark.createDataFrame([("law", ""), ("music", ""), (None, "")], "subject string, description string")
    return spark.createDataFrame(docs, "doc_id bigint, text string, subject string"), spark.createDataFrame(labels + labels[:9] + [(3, "cooking"), (None, "law")], "doc_id bigint, subject string"), areas, truth


def test_subjects_of_unlabelled_documents(corpus):
    docs, labels, areas, truth = corpus
    got = {}
    for r in document_subjects(docs, labels, areas).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    wrong = [i for i in range(1, 240, 2) if got.get(i, set()) != truth[i]]
    assert len(wrong) <= 4 and got[903] == {"law"} and not {900, 901, 902, 904} & set(got)
    again = document_subjects(docs.repartition(3), labels, areas)
    assert {(r["doc_id"], r["subject"]) for r in again.collect()} == {(i, s) for i, v in got.items() for s in v}


def test_nothing_to_learn_from(corpus):
    docs, labels, areas, _ = corpus
    assert subject_shares(docs, labels.limit(0), areas).count() == 0
    assert subject_shares(docs.limit(0), labels, areas).count() == 0
    assert subject_shares(docs, labels, areas.limit(0)).count() == 0


def test_held_out_labels(spark):
    """Trained without every second labelled document of the tables, the model finds their labels (a few are wrong)."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/doc_labels.parquet")
    areas = spark.read.parquet(f"{d}/subject_areas.parquet")
    held = labels.where("pmod(xxhash64(doc_id), 2) = 0")
    found = document_subjects(docs, labels.join(held.select("doc_id").distinct(), "doc_id", "left_anti"), areas).select("doc_id", "subject")
    want = held.where("subject is not null").select("doc_id", "subject").distinct()
    found = found.join(held.select("doc_id").distinct(), "doc_id", "left_semi")
    hit, n, m = found.intersect(want).count(), want.count(), found.count()
    assert hit / n > 0.9 and hit / m > 0.9  # some 500 labelled documents are left to learn from


def test_too_many_subjects(spark):
    docs, labels = spark.createDataFrame([(1, "a judge")], "doc_id bigint, text string"), spark.createDataFrame([(1, "s1")], "doc_id bigint, subject string")
    with pytest.raises(ValueError, match="more than 1000 subjects"):
        subject_shares(docs, labels, spark.range(1001).selectExpr("concat('s', id) as subject"))
