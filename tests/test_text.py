from __future__ import annotations

import re
import string

import pytest
from helpers import one
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from covaria.functions import parse as P
from covaria.functions import text as X


def test_stop_words_go_before_punctuation(spark):
    assert one(spark, "first line\nThe the, HEART of", X.note_body) == "the heart"


def test_one_line_note_has_no_body(spark):
    assert one(spark, "only one line", X.note_body) == ""
    assert one(spark, "", X.note_body) == ""


def test_only_the_first_line_is_dropped(spark):
    assert one(spark, "a\nbb\ncc", X.note_body) == "bb cc"


def test_ngrams_do_not_reach_past_the_end(spark):
    body = lambda n: lambda x: X.ngrams(X.words(x), n)
    assert one(spark, "a b c", body(2)) == ["a b", "b c"]
    assert one(spark, "a b c", body(3)) == ["a b c"]
    assert one(spark, "a", body(2)) == []
    assert one(spark, "a", body(1)) == ["a"]


def test_raw_tokens_split_symbols(spark):
    assert one(spark, "Été, 5mg!", X.raw_tokens) == ["été", ",", "5mg", "!"]


def test_topic_tokens(spark):
    assert one(spark, "The x-ray showed 12mg of A1b2c3d", X.topic_tokens) == ["ray", "showed", "abcd"]


def test_sentences(spark):
    assert one(spark, "One. Two! Is it?  Yes", X.sentences) == ["One.", "Two!", "Is it?", "Yes"]


TEXT = st.text(alphabet=string.ascii_letters + string.digits + string.punctuation + " \n\t éÉ", max_size=60)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TEXT)
def test_note_body_follows_its_definition(spark, text):
    body = text.lower().split("\n", 1)[1] if "\n" in text else ""
    kept = " ".join(w for w in body.split() if w not in X.ENGLISH_STOP_WORDS)
    expected = kept.translate(str.maketrans("", "", string.punctuation))
    assert one(spark, text, X.note_body) == expected


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TEXT)
def test_topic_tokens_follow_their_definition(spark, text):
    spaced = re.sub(f"[{re.escape(string.punctuation)}]+", " ", text.lower())
    words = re.sub("[0-9]+", "", spaced).split()
    expected = [w for w in words if w not in X.ENGLISH_STOP_WORDS and len(w) >= 3]
    assert one(spark, text, X.topic_tokens) == expected


@pytest.mark.parametrize(
    ("line", "clean"),
    [
        ("a , b", "a_b"),
        ("1.5.2.7", "1_symbol_decimal_5_symbol_decimal_2_symbol_decimal_7"),
        ("x - - y", "x_symbol_hyphen_symbol_hyphen_y"),
        ("a#b", "a_symbol_hash_b"),
        ('say "no"', "say_no"),
        ("a b", "a_b"),
        ("x (y)", "x_symbol_open_parenthesis_y_symbol_close_parenthesis_"),
        ("a z b", "a_symbol_period_b"),
        ("1,x  . ,,b", "1,x_symbol_period,b"),
    ],
)
def test_clean_delimiters(spark, line, clean):
    assert one(spark, line, X.clean_delimiters) == clean


def test_literal_period_keeps_single_letters(spark):
    literal = lambda x: X.clean_delimiters(x, literal_period=True)
    assert one(spark, "a z b . c", literal) == "a_z_b_symbol_period_c"


def test_leukemia_comma_is_an_option(spark):
    joined = lambda x: X.clean_delimiters(x, join_leukemia=True)
    assert one(spark, "1,leukemia ,2", joined) == "1,leukemia2"
    assert one(spark, "1,leukemia ,2", X.clean_delimiters) == "1,leukemia_2"


def test_header_loses_blanks_only(spark):
    header = lambda x: X.clean_delimiters(x, header=True)
    assert one(spark, "key, note ID", header) == "key,noteID"


def test_decimal_mark_first_stop_only(spark):
    assert one(spark, "a.5.b", X.decimal_mark) == "a_symbol_decimal_5.b"
    assert one(spark, "ab", X.decimal_mark) == "ab"


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("term_Problem_Heart Failure", "term_problem_heart_failure"),
        ("concept_NA", "concept_na"),
        ("aspirinTablet", "aspirin_tablet"),
        ("5 mg", "x5_mg"),
        ("50%", "x50_percent"),
        ("été's", "etes"),
    ],
)
def test_clean_name(spark, raw, clean):
    assert one(spark, raw, X.clean_name) == clean


def test_parse_lists(spark):
    topics = one(spark, "[(3, 0.5), (7, 0.2)]", P.topic_list)
    assert [(t["topic"], t["weight"]) for t in topics] == [(3, 0.5), (7, 0.2)]
    assert one(spark, "[]", P.topic_list) == []
    assert one(spark, "[4, 1, 4]", P.cluster_list) == [4, 1, 4]
    text = lambda x: P.topic_text(P.heaviest_first(P.topic_list(x)))
    assert one(spark, "[(7, 0.25), (3, 0.5)]", text) == "[(3, 0.5), (7, 0.25)]"


def test_the_cleaner_passes_over_a_line_a_few_times(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([("1.2.3.4 - - - xy , 5",)], "line string")
    clean = frame.select(X.clean_delimiters(F.col("line")).alias("y"))
    assert clean.first()["y"] == "1_symbol_decimal_2_symbol_decimal_3_symbol_decimal_4_symbol_hyphen_symbol_hyphen_symbol_hyphen_xy_5"
    assert str(clean._jdf.queryExecution().analyzed()).count("replace(") <= 14
