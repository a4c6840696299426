import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpora.functions import text as T
from corpora.functions.stop_words import ENGLISH, stop_words

ODD = "a 　b\u0085\u001cc \t\n\x0b\x0c\rd  e​﻿f"


def column(spark, values, expression):
    rows = [(i, v) for i, v in enumerate(values)]
    table = spark.createDataFrame(rows, "i int, t string")
    return [r[0] for r in table.orderBy("i").select(expression(F.col("t"))).collect()]


def test_words(spark):
    texts = ["don’t İstanbul students' o'neil'sx", None, "", "A1 B-2 isn't"]
    found = column(spark, texts, T.words)
    assert found == [
        ["don", "t", "i", "stanbul", "students", "o'neil", "sx"], [], [], ["a", "b", "isn't"],
    ]
    assert column(spark, ["Don't"], lambda c: T.words(c, lowercase=False)) == [["Don't"]]


def test_white_space_is_that_of_python(spark):
    texts = [ODD, f" {ODD} ", " x ", " \n ", "", *[f"p{c}{c}q{c}" for c in T.SPACE_CHARACTERS]]
    assert len(T.SPACE_CHARACTERS) == 29
    assert all(c.isspace() for c in T.SPACE_CHARACTERS)
    assert column(spark, texts, T.collapse_space) == [re.sub(r"\s+", " ", t).strip() for t in texts]
    assert column(spark, texts, T.strip) == [t.strip() for t in texts]
    assert column(spark, texts, T.word_count) == [len(t.split()) for t in texts]


def test_nul_counts_as_space(spark):
    assert column(spark, ["a\0\0b\0", "\0"], T.clean_document) == ["a b", ""]
    assert column(spark, ["a\0\0b\0", "\0"], T.word_count) == [2, 0]


def test_essay_characters(spark):
    texts = ["café 中文 ok!\n\n(yes) 50% a/b-c \"q\" 'r' [z] end", "中", "x"]
    assert column(spark, texts, T.keep_essay_characters) == [
        "caf ok! (yes) 50 a/b-c \"q\" 'r' z end", "", "x",
    ]


def test_numbers(spark):
    cells = ["7f", "7d", "x", " 7 ", "1e1", "", None, "-.5", "0x10", "nan", "6.", "1_000"]
    assert column(spark, cells, T.to_number) == [
        None, None, None, 7.0, 10.0, None, None, -0.5, None, None, 6.0, None,
    ]


def test_keys_and_paths(spark):
    keys = ["__a b/c__", "___", "x" * 130, "a.b-c"]
    assert column(spark, keys, lambda c: T.safe_key(c, F.lit(7))) == ["a_b_c", "7", "x" * 120, "a.b-c"]
    assert column(spark, ["/t/1.txt", "1.txt", "/t/u/"], T.base_name) == ["1.txt", "1.txt", "u"]
    assert column(spark, ["a%20b+c"], T.decoded_path) == ["a b+c"]


def test_tokens(spark):
    texts = ["Hi, you!", "", "été 50%"]
    assert column(spark, texts, T.tokens) == [["Hi", ",", "you", "!"], [], ["été", "50", "%"]]
    assert column(spark, texts, T.token_length) == [4, 0, 3]


def test_stop_words(spark):
    assert len(ENGLISH) == len(set(ENGLISH)) == 179
    kept = column(
        spark, ["the cat of It's old a ox"], lambda c: T.without_stop_words(T.words(c), ENGLISH)
    )
    assert kept == [["cat", "old"]]
    assert stop_words(words=["B", "a", "b"]) == ["a", "b"]
    assert "the" in stop_words("spark")
    with pytest.raises(ValueError):
        stop_words("none")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(string.printable + ODD, max_size=40), min_size=20, max_size=40))
def test_random_texts(spark, texts):
    texts = [t.replace("\ud800", "") for t in texts]
    assert column(spark, texts, T.collapse_space) == [re.sub(r"\s+", " ", t).strip() for t in texts]
    assert column(spark, texts, T.words) == [
        re.findall(r"[a-zA-Z]+(?:'[a-zA-Z]+)?", t.lower()) for t in texts
    ]
