import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import leaks
from lectern.llm.leaks import FMIndex, TestMaterial, WaveletMatrix, cleaned_documents, leaked_items, suffix_order, whole_phrases, without, word_places, words

TestMaterial.__test__ = False
sequences = st.lists(st.integers(0, 4), max_size=120).map(lambda x: np.array([*x, 0], np.uint16))


@settings(deadline=None, max_examples=150)
@given(sequences)
def test_suffix_order(seq):
    def key(i):
        out = []
        for j in range(i, len(seq)):
            out.append((int(seq[j]), j if seq[j] == 0 else -1))
            if seq[j] == 0:
                break
        return out

    assert suffix_order(seq).tolist() == sorted(range(len(seq)), key=key)


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=200))
def test_ranks(xs):
    seq = np.array(xs)
    w = WaveletMatrix(seq, 9)
    i = np.arange(len(xs) + 1)
    for c in range(10):
        assert w.rank(np.full(len(i), c), i).tolist() == [xs[:k].count(c) for k in i]
    s, r = w.symbol_and_rank(i[:-1])
    assert s.tolist() == xs and r.tolist() == [xs[:k].count(xs[k]) for k in i[:-1]]


@settings(deadline=None, max_examples=150)
@given(sequences, st.lists(st.lists(st.integers(1, 4), min_size=3, max_size=3), min_size=1, max_size=6), st.integers(1, 7))
def test_search_and_locate(seq, phrases, sample):
    index = FMIndex(seq, 4, sample)
    lo, hi = index.search(np.array(phrases))
    for p, a, b in zip(phrases, lo, hi):
        want = [i for i in range(len(seq) - 2) if seq[i : i + 3].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_words():
    assert words("<p>The <b>Cаt</b>’s&nbsp;mill-\nstone, ｎｅａｒ *the* ﬁre!</p>") == ["the", "cat", "s", "millstone", "near", "the", "fire"]
    assert words("走了，abc狗") == ["走", "了", "abc", "狗"] and words(None) == [] and words("<<>>") == []


def carries(doc, unit, least):
    """Brute force: some stretch of the unit of at least ``least`` words, at most a ninth of it edited, in the document; the
    first and the last word are equal."""
    for a in range(len(unit) - least + 1):
        for start in range(len(doc)):
            if unit[a] != doc[start]:
                continue
            row = list(range(len(doc) - start))
            for i in range(1, len(unit) - a):
                new, ends = [i], []
                for j in range(1, len(row)):
                    same = unit[a + i] == doc[start + j]
                    if same:
                        ends.append(row[j - 1])
                    new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (not same)))
                row = new
                if i + 1 >= least and ends and min(ends) * 9 <= i + 1:
                    return True
    return False


def changed(rng, w, rate):
    out, n = [], 0
    for x in w:
        if rng.random() < rate:
            n += 1
            k = rng.randrange(3)
            out += [f"z{rng.randrange(10**6)}"] if k == 0 else [] if k == 1 else [x, f"z{rng.randrange(10**6)}"]
        else:
            out.append(x)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(60)]
    items = [(k, [rng.choice(vocabulary) for _ in range(rng.randrange(20, 40))]) for k in range(4)]
    docs = []
    for d in range(14):
        k, unit = rng.choice(items)
        cut = unit[rng.randrange(5) : len(unit) - rng.randrange(5)]
        body = changed(rng, cut, rng.choice([0, 0.05, 0.1, 0.12, 0.2]))
        docs.append((d, [rng.choice(vocabulary) for _ in range(6)] + body + [rng.choice(vocabulary) for _ in range(6)]))
    di = spark.createDataFrame([(d, " ".join(w).upper(), "t", 1) for d, w in docs], "doc_id bigint, text string, passage string, item_id int")
    ii = spark.createDataFrame([(k, " ".join(w), None) for k, w in items], "item_id bigint, passage string, question string")
    got = {(r["doc_id"], r["item_id"]) for r in leaked_items(di, ii, shard_words=90).collect()}
    assert got == {(d, k) for d, w in docs for k, u in items if carries(w, u, 24)}


def test_limits_spans_and_odd_rows(spark):
    w = [f"w{k}" for k in range(60)]
    han = "".join(chr(0x4E00 + 7 * k) for k in range(50))
    spoil = lambda x, at: [y if k not in at else "q" for k, y in enumerate(x)]
    items = spark.createDataFrame([(1, " ".join(w), "w1 w2"), (2, han, None), (3, None, None), (4, "", "too short"), (1, " ".join(w), "w1 w2")], "item_id bigint, passage string, question string")
    docs = [
        (1, " ".join(w[5:29])), (2, " ".join(w[5:28])), (3, " ".join(spoil(w[:27], {6, 13, 20}))), (4, " ".join(spoil(w[:26], {6, 13, 20}))), (5, "，".join(han[3:39])), (6, han[3:38]),
        (7, "pad " * 10 + " ".join(w[:24]) + " gap" * 30 + " " + " ".join(w[30:60])), (8, None), (9, ""), (10, " ".join(w) + " x" * 300_000), (11, " ".join(w[5:29])), (None, " ".join(w)),
    ]
    got = {(r["doc_id"], r["item_id"]): r for r in leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), items).collect()}
    assert set(got) == {(1, 1), (3, 1), (5, 2), (7, 1), (10, 1), (11, 1)}
    assert [tuple(s) for s in got[7, 1]["spans"]] == [(10, 34), (64, 94)] and got[10, 1]["words"] == 60 and got[3, 1]["edits"] == 3
    assert leaked_items(spark.createDataFrame([], "doc_id bigint, text string"), items).count() == 0
    assert leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), items.limit(0)).count() == 0


ODD = [
    "<p>The <b>Cаt</b>’s&nbsp;mill-\nstone, ｎｅａｒ *the* ﬁre!</p>", "cafe\u0301 c\u200bafe\u200b\u0301 İstanbul straße", "走了，abc狗<br>再&amp;见 ＡＢ㎏ &#x41;&lt;p", "plain text, no marks - at all",
    "한국어 각 ½ ℡ e\u0301\u0302x \u0430\u0301", "", "<<>> &;", "thе sеa",
]


@pytest.mark.parametrize("text", ODD)
def test_places_of_words(text):
    start, end = word_places(text)
    assert len(start) == len(end) == len(words(text)) and all(a < b for a, b in zip(start, end)) and list(start) == sorted(start)
    for w, a, b in zip(words(text), start, end):
        assert words(text[a:b].replace("-\n", "")) in ([w], [w[:1]]) or w in "".join(words(text[max(0, a - 9) : b + 9]))


@settings(deadline=None, max_examples=150)
@given(st.text(st.sampled_from("ab Z1,<>/&;#-\n走猫éеа́​ｆﬁ"), max_size=40))
def test_places_of_words_in_any_text(text):
    start, end = word_places(text)
    assert len(start) == len(words(text)) and all(0 <= a <= b <= len(text) for a, b in zip(start, end))


def test_plain_places():
    t = "<p>One two</p>, <b>three</b> 走了 fｏur"
    assert [t[a:b] for a, b in zip(*word_places(t))] == ["One", "two", "three", "走", "了", "fｏur"]
    assert without("ab cd ef", [(3, 6)]) == "ab ef" and without("abcdef", [(2, 4)]) == "ab ef" and without("abc", [(0, 2), (1, 3)]) == ""


def test_phrases_that_stay_whole():
    def fewest(size, least):
        return min(n - size + 1 - size * (n // 9) for n in range(least, 400))

    assert whole_phrases(6, 24) == fewest(6, 24) == 4 and whole_phrases(7, 36) == fewest(7, 36) == 2


@pytest.mark.parametrize("seed", range(2))
def test_stock_phrases_lose_nothing(monkeypatch, seed):
    """Every item and document holds the same phrases; small limits make them stock phrases and cut the hits into slices."""
    rng = random.Random(seed)
    stock = ["which", "of", "the", "following", "is", "the", "one", "she", "meant", "by", "it"]
    vocabulary = [f"v{k}" for k in range(500)]
    pick = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    few = seed == 0  # too few stock phrases in an item to carry a case
    items = [(k, " ".join(pick(14) + stock[: 8 if few else rng.choice([7, 11])] + pick(12) + stock[3:] * (not few and rng.randrange(2))), None) for k in range(60)]
    test = TestMaterial(items)
    docs = []
    for d in range(90):
        body = changed(rng, items[rng.randrange(60)][1].split(), rng.choice([0, 0.06, 0.12]))
        docs.append(pick(5) + stock + body[rng.randrange(6) :] + pick(3) + stock)
    get = test.vocabulary.get
    seq = np.concatenate([np.array([*(get(x, 0) for x in w), 0], np.uint16) for w in docs])
    found = lambda: set(map(tuple, leaks.search_shard(test, list(range(90)), [len(w) + 1 for w in docs], seq)[["doc_id", "item_id"]].to_numpy().tolist()))
    want = found()
    index, sizes, real = FMIndex(seq, len(test.vocabulary)), [], leaks.exact_runs
    for u, *_ in real(index, test, 20, 500):
        sizes.append(len(u))
    assert max(sizes) < 1_000 and (len(sizes) > 3 or few) and (not few or sum(sizes) < sum(len(u) for u, *_ in real(index, test)) / 10)
    monkeypatch.setattr(leaks, "exact_runs", lambda i, t: real(i, t, 20, 500))
    assert found() == want and len(want) > 40


def test_cleaned_documents_carry_nothing(spark):
    w = [f"w{k}" for k in range(60)]
    items = spark.createDataFrame([(1, " ".join(w), ""), (2, "".join(chr(0x4E00 + 7 * k) for k in range(50)), None)], "item_id bigint, passage string, question string")
    docs = [
        (1, "Before. <b>" + " ".join(w[5:40]).upper() + "</b>, after."), (2, " ".join(w[:20]) + " stray " + " ".join(w[22:60]) + " end"), (3, "nothing here"), (4, None), (5, ""), (6, " ".join(w[:15]) + " " + " ".join(w[20:50]) + " " + " ".join(w[15:35])),
        (7, "头" + "".join(chr(0x4E00 + 7 * k) for k in range(45)) + "尾"), (None, " ".join(w)),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, item_id string")
    got = cleaned_documents(df, items).collect()
    left = {r["doc_id"]: (r["text"], r["removed"]) for r in got}
    assert len(got) == len(docs) and left[3] == ("nothing here", 0) and left[4] == (None, 0) and left[5] == ("", 0) and left[7][0] == "头尾"
    assert left[1][0] == "Before. <b></b>, after." and left[2][0].strip() == "end" and left[1][1] == len(" ".join(w[5:40]))
    assert leaked_items(spark.createDataFrame(got), items).count() == 0
    places = {r["doc_id"]: r["places"] for r in leaked_items(df, items).collect()}
    assert docs[0][1][places[1][0]["start"] : places[1][0]["end"]] == " ".join(w[5:40]).upper()


def test_several_passes(spark, monkeypatch):
    w = [f"w{k}" for k in range(90)]
    items = spark.createDataFrame([(k, " ".join(w[30 * k : 30 * k + 30]), None) for k in range(3)], "item_id bigint, passage string, question string")
    docs = spark.createDataFrame([(k, "a " + " ".join(w[30 * k : 30 * k + 30]) + " b") for k in range(3)] + [(9, " ".join(w))], "doc_id bigint, text string")
    monkeypatch.setattr(leaks, "CHARACTERS_PER_PASS", 60)
    assert {(r["doc_id"], r["item_id"]) for r in leaked_items(docs, items).collect()} == {(k, k) for k in range(3)} | {(9, k) for k in range(3)}
    assert {r["doc_id"]: " ".join(r["text"].split()) for r in cleaned_documents(docs, items).collect()} == {0: "a b", 1: "a b", 2: "a b", 9: ""}
