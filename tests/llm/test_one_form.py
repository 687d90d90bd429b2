import itertools
import unicodedata
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import one_form as forms
from lectern.llm.one_form import READINGS, SHAPE, Lattice, count_pairs, letter_pairs, one_form, plain, quotes_in_other_characters, recomputed_similarity, shape

TEXTS = ["the cat sat on the mat and thought of the sea", "кот думал о море и ждал", "of paper and scope", "мир труд май"]


@pytest.fixture(scope="module")
def lattice():
    c = Counter()
    count_pairs(iter(TEXTS * 3), c)
    return Lattice(dict(c))


def test_plain():
    assert plain("Ａ b​ c　\nd ﬁ ﻿é ⼤") == "A b c d fi é 大" and plain("a\x00b\tc") == "ab c" and plain("​ ⁠") == ""


def test_words_keep_one_alphabet(lattice):
    assert lattice.form("thе саt ѕаt") == "the cat sat" and lattice.form("кoт думaл") == "кот думал"
    assert lattice.form("Κеttеllѕ іn") == "Kettells in" and lattice.form("été") == "été" and lattice.form("сafе́") == "café"
    assert lattice.form(None) is None and lattice.form("") == "" and lattice.form("。，!") == "。,!"


def test_best_path_is_the_best_of_all(lattice):
    for word in ("соре", "mop", "hope", "аос", "xyэ", "тор"):
        shapes = [SHAPE.get(c, c) for c in word]

        def score(path):
            return sum(lattice.step(a, b) for a, b in zip(("^", *path), path))

        every = [p for p in itertools.product(*(READINGS.get(c, c) for c in shapes))]
        assert score(tuple(lattice.read(word))) == max(map(score, every))


letters = st.sampled_from("abcdeopxyHKMT" + "авкостенрмф" + "ΑΒο")


@settings(deadline=None, max_examples=200)
@given(st.text(letters, max_size=8), st.randoms())
def test_same_shape_same_form(word, rng):
    c = Counter()
    count_pairs(iter(TEXTS), c)
    own = Lattice(dict(c))
    other = "".join(rng.choice(READINGS.get(SHAPE.get(x, x), x)) for x in word)
    assert shape(other) == shape(word) and own.form(other) == own.form(word)
    assert own.form(own.form(word)) == own.form(word)


def test_long_text(lattice):
    t = "thе sеa ​" * 200_000
    assert lattice.form(t) == ("the sea " * 200_000).strip()


V = "validation_id bigint, context_id bigint, evidence string, context string"
C = "context_id bigint, context string, evidence string, validation_id bigint"


def test_quotes(spark):
    ctx = spark.createDataFrame([(1, "Thе cat sat on the mat.\nIt was “late”.", "x", 9), (1, "Thе cat sat on the mat.\nIt was “late”.", "x", 9), (2, None, "", 1), (3, "", "", 1), (None, "the cat", "", 0)], C)
    rows = [
        (1, 1, "The cat sat", "c"), (1, 1, "The cat sat", "c"), (2, 1, "cat sat", "c"), (3, 1, "Ｔhe cat", "c"), (4, 1, "the cat", "c"), (5, 1, "The dog", "c"), (6, 1, None, "c"), (7, 1, " ​ ", "c"),
        (8, 1, "mat. It was", "c"), (9, 1, 'was "late"', "c"), (10, 2, "x", "c"), (11, 3, "x", "c"), (12, 77, "x", "c"), (13, None, "cat", "c"), (14, 1, "сat sat, on", "c"), (15, 1, "c­at s​at ", "c"),
    ]
    got = quotes_in_other_characters(spark.createDataFrame(rows, V), ctx, "validation_id", "context_id", "evidence", "context").collect()
    assert sorted(r["validation_id"] for r in got) == [1, 3, 8, 15]
    empty = spark.createDataFrame([], V)
    assert quotes_in_other_characters(empty, ctx.limit(0), "validation_id", "context_id", "evidence", "context").count() == 0


def test_column_function(spark):
    df = spark.createDataFrame([(1, "саt on a mаt"), (2, None), (3, "")], "i int, t string")
    form = one_form(letter_pairs((df, "t")))
    got = {r["i"]: r["f"] for r in df.select("i", form("t").alias("f")).collect()}
    assert got[2] is None and got[3] == "" and shape(got[1]) == "cat on a mat" and unicodedata.is_normalized("NFC", got[1])


def test_shapes_of_all_alphabets():
    assert shape("ραιυ") == "paiu" and shape("ꓔꓧꓰ ᴄᴏᴡ Ⲣⲟⲥ Ьaд") == "THE cow Poc baд" and shape("ᏢᎪᎠ оՍ") == "PAD oU"
    names = ("CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "COPTIC", "LISU", "LATIN_FORMS")
    for name in names:
        letters, same = getattr(forms, name), getattr(forms, name + "_AS")
        assert len(letters) == len(same) == len(set(letters)) and same.isascii() and all(shape(c) == x for c, x in zip(letters, same))
    assert len(SHAPE) < 200


def test_recomputed_similarity(spark):
    text = "Norvel dreamed of Emberbourne twelve nights running and wrote it all down before breakfast."
    ctx = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (None, "y", "y")], "context_id bigint, context string, evidence string")
    rows = [
        (1, 1, "Norvel dreаmed of Ｅmberbourne"), (2, 1, "norvel dreamed of emberbourne twelve nights and wrote it down"), (3, 1, "the harbour master sold his boat to nobody at all"), (4, 1, None), (5, 2, "Norvel"),
        (6, 9, "Norvel"), (7, None, "Norvel"), (8, 1, "  "), (1, 1, "Norvel dreаmed of Ｅmberbourne"),
    ]
    v = spark.createDataFrame([(a, b, t, 0.3) for a, b, t in rows], "validation_id bigint, context_id bigint, evidence string, evidence_similarity double")
    got = {r["validation_id"]: (r["evidence_found"], r["evidence_similarity"]) for r in recomputed_similarity(v, ctx, "validation_id", "context_id", "evidence", "context").collect()}
    assert len(got) == 8 and got[1] == (True, 1.0) and got[3] == (False, None) and all(got[k] == (False, 0.0) for k in (4, 5, 6, 7, 8))
    assert got[2][0] and 0.8 <= got[2][1] < 1
