"""Queries that return all of every document, also on texts that the test tables don't have."""

import pytest
from tests.test_queries import SF, compared

from letterloom.plans import queries as mail

TEXTS = [
    None, "", "a", "short text", "x" * 19, "x" * 20, "a=b_c?d é ü " * 70, "line one\nline two\tand a tab\n" * 30, "日本語とемой 🙂" * 60, "the � sign é" * 60,
    "  two at the start", "a  b   c", "\ta tab\n\t and one\n  more", " \n x", "-- b", "x -- y", "--\n--  z", "a space at the end ", "one before \n a line end", "-- \nsigned", "c1 \x85 and \x93 é", "to a@b.test, c@d.test", "@",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    langs = ["de", "en", None, "xx"]
    rows = [(i, t, langs[i % 4], "s", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").toPandas().to_parquet(f"{d}/documents.parquet")
    return d


def whole(spark, odd, name):
    """What SQL gives on the odd texts, and a row for each of all documents."""
    compared(spark, name, mail.QUERIES, mail.ORACLE_SQL, odd)
    assert mail.QUERIES[name](spark, odd).count() == len(TEXTS)
    assert mail.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_encoded_words_whole(spark, odd):
    whole(spark, odd, "encoded_words_whole")


def test_body_base64_padded_lines_whole(spark, odd):
    whole(spark, odd, "body_base64_padded_lines_whole")


def test_body_charset_whole(spark, odd):
    whole(spark, odd, "body_charset_whole")


@pytest.mark.parametrize("name", ["body_flowed", "body_utf16", "addresses_in_text"])
def test_whole(spark, odd, name):
    whole(spark, odd, name)
