import pytest
from helpers import CATALOG, one
from pyspark.sql import functions as F

from fieldloom.functions import fields as ff
from fieldloom.functions.blanks import squeeze, strip
from fieldloom.functions.dates import day_text, day_value, moment
from fieldloom.functions.shards import document_shard, shard_name, with_shards
from fieldloom.functions.texts import byte_size, csv_cell, leading_int, sheet_base_name
from fieldloom.functions.typed_input import is_acceptable, sanitize


def test_strip_knows_unicode_blanks(spark):
    assert one(spark, "﻿  a b　\n", strip) == "a b"
    assert one(spark, " a  \t b ", squeeze) == "a b"


@pytest.mark.parametrize(
    "field, value, clean",
    [
        ("number", "12345678", None),
        ("number", "+7 (999) 123-45-67", "79991234567"),
        ("number", "12345678901234", "12345678901234"),
        ("number", "123456789012345", None),
        ("code10", "1234567890", "1234567890"),
        ("code10", "12345678901", None),
        ("code10", "123456789012", "123456789012"),
        ("code10", "1234567890\n1", None),
        ("account", "007", "007"),
        ("account", "7a", None),
        ("mail", "Ann@Example.COM", "ann@example.com"),
        ("mail", "ann@example", None),
        ("full_name", "Петров Иван", "ПЕТРОВ ИВАН"),
        ("full_name", "Petrov", None),
        ("full_name", "Petrov 2nd", None),
        ("full_name", "ann lee-o", "ANN LEE-O"),
        ("day", "31.02.2020", "31.02.2020"),
        ("day", "01/02/2020", "01.02.2020"),
        ("day", "01-02-2020", "01.02.2020"),
        ("day", "2020-02-01", "01.02.2020"),
        ("day", "2020/02/01", None),
        ("day", "01.02/2020", None),
        ("plate", "a 1 b", "a 1 b"),
    ],
)
def test_clean_value(spark, field, value, clean):
    assert one(spark, value, lambda v: ff.clean_value(CATALOG[field], v)) == clean


@pytest.mark.parametrize(
    "field, value, term",
    [
        ("number", "+7 (999) 12?-%", "799912?%"),
        ("number", "abc", None),
        ("mail", " Ann@X.org ", "ann@x.org"),
        ("full_name", " ann   lee ", "ANN%LEE%"),
        ("full_name", "ann%", "ANN%"),
        ("plate", "a 12 b", "A12B"),
        ("day", "2020-02-01", "01.02.2020"),
        ("day", "%.02.2020", "%.02.2020"),
        ("mail", "   ", None),
    ],
)
def test_query_term(spark, field, value, term):
    assert one(spark, value, lambda v: ff.query_term(CATALOG[field], v)) == term


@pytest.mark.parametrize(
    "pattern, text, hit",
    [
        ("7999%", "79991234567", True),
        ("79?9", "7999", True),
        ("79?9", "79999", False),
        ("a?c", "a\U0001f600c", True),
        ("a_c", "abc", False),
        ("a_c", "a_c", True),
        ("a\\c%", "a\\cd", True),
        ("a.c", "abc", False),
        ("(a|b)%", "(a|b)c", True),
        ("a%c", "a\nc", False),
        ("%", "", True),
        ("b", "abc", False),
    ],
)
def test_wildcards(spark, pattern, text, hit):
    df = spark.createDataFrame([(pattern, text)], "p string, t string")
    matched = ff.wildcard_match(F.col("t"), ff.like_pattern(F.col("p")), ff.wildcard_regex(F.col("p")))
    assert df.select(matched).first()[0] is hit


def test_mined_runs_keep_order_and_split_long_ones(spark):
    mine = lambda v: ff.mined_digit_runs(CATALOG["number"], v)
    assert one(spark, "79274279737 8434125131 79274279747", mine) == ["79274279737", "8434125131", "79274279747"]
    assert one(spark, "12345678 x 1234567890123456789012345", mine) == ["12345678901234", "56789012345"]
    assert one(spark, "123456789 123456789", mine) == ["123456789"]


def test_dates(spark):
    assert str(one(spark, "01.02.2020", day_value)) == "2020-02-01"
    assert one(spark, "31.02.2020", day_value) is None
    assert one(spark, " 2020-02-01", day_text) is None
    assert str(one(spark, "01.02.2020", moment)) == "2020-02-01 00:00:00"
    assert str(one(spark, "2020-02-01T03:04:05", moment)) == "2020-02-01 03:04:05"
    assert str(one(spark, "2020-02-01 and later", moment)) == "2020-02-01 00:00:00"
    assert one(spark, "soon", moment) is None


def test_shards(spark):
    import hashlib

    digest = hashlib.md5(b"number:79991234567").hexdigest()
    assert one(spark, "79991234567", lambda v: shard_name(CATALOG["number"], v)) == "7999~" + digest[:2]
    assert one(spark, "7%", lambda v: shard_name(CATALOG["plate"], v)) == "7__"
    assert one(spark, "--", lambda v: shard_name(CATALOG["mail"], v)) == "____"
    assert one(spark, "тюя1", lambda v: shard_name(CATALOG["plate"], v)) == "тюя"
    assert one(spark, "people:1", document_shard) == hashlib.md5(b"people:1").hexdigest()[:3]
    df = spark.createDataFrame([("number", "79991234567"), ("plate", "AB")], "field string, term string")
    assert {r["shard"] for r in with_shards(df, CATALOG).collect()} == {"7999~" + digest[:2], "ab_"}


@pytest.mark.parametrize(
    "field, typed, kept",
    [
        ("number", "+7 (999) 123-45-67-89-00", "799912345678900"),
        ("code10", "12 34 56 78 90 12 34", "123456789012"),
        ("account", "id 7%", "7%"),
        ("full_name", "Ann-Lee 3?", "AnnLee ?"),
        ("plate", "a-1 b", "a1b"),
        ("day", "01022020", "01.02.2020"),
        ("day", "1.2", "1..2"),  # a dot is put in after two characters
        ("mail", "a@b@c", "a@b"),
        ("mail", "a*b@c", "ab"),
        ("mail", "a@c*d", "a@c*"),
        ("mail", "a*b", "ab"),
    ],
)
def test_sanitize(spark, field, typed, kept):
    assert one(spark, typed, lambda v: sanitize(CATALOG[field], v)) == kept


def test_acceptable(spark):
    spec = CATALOG["number"]
    assert one(spark, "+79991234567", lambda v: is_acceptable(spec, v)) is True
    assert one(spark, "7999", lambda v: is_acceptable(spec, v)) is False
    assert one(spark, "7999%", lambda v: is_acceptable(spec, v)) is True
    assert one(spark, "x", lambda v: is_acceptable(CATALOG["plate"], v)) is True


def test_text_formats(spark):
    assert one(spark, 'a"b', csv_cell) == '"a""b"'
    assert one(spark, "a;b", csv_cell) == "a;b"
    assert one(spark, None, csv_cell) == ""
    assert one(spark, " 12 pcs", leading_int) == 12
    assert one(spark, "none", leading_int) == 0
    assert one(spark, "a/b [c]: d?", sheet_base_name) == "a_b _c__ d_"
    sizes = spark.range(1).select(*[byte_size(F.lit(n)).alias(str(n)) for n in (1023, 1536, 3 * 1024**2, 5 * 1024**3)])
    assert list(sizes.first()) == ["1023 B", "1.50 KB", "3.00 MB", "5.00 GB"]
