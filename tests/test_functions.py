"""Guarded scalar functions: values, nulls and errors."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fathomic.functions import scalar as fx


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_text(spark):
    assert value(spark, fx.trim(F.lit("  a b\t "))) == "a b"
    assert value(spark, fx.substr(F.lit("héllo"), 2, 3)) == "éll"
    assert value(spark, fx.left(F.lit("abc"), 2)) == "ab"
    assert value(spark, fx.right(F.lit("abc"), 2)) == "bc"
    assert value(spark, fx.byte_length(F.lit("é"))) == 2
    assert value(spark, fx.length(F.lit("é"))) == 1
    assert bytes(value(spark, fx.unhex(F.lit("00fF")))) == b"\x00\xff"
    assert bytes(value(spark, fx.from_base64(F.lit("aGk=")))) == b"hi"
    assert value(spark, fx.concat(F.lit("a"), F.lit(None).cast("string"))) is None
    assert value(spark, fx.regexp_replace(F.lit("a-b"), "(a)-(b)", r"\2$\1")) == "b$a"


@pytest.mark.parametrize(
    "column",
    [
        fx_case
        for fx_case in (
            lambda: fx.substr(F.lit("abc"), 0, 1),
            lambda: fx.substr(F.lit("abc"), 1, -1),
            lambda: fx.left(F.lit("abc"), -1),
            lambda: fx.right(F.lit("abc"), -1),
            lambda: fx.replace(F.lit("abc"), F.lit(""), F.lit("x")),
            lambda: fx.unhex(F.lit("0g")),
            lambda: fx.unhex(F.lit("abc")),
            lambda: fx.from_base64(F.lit("a")),
            lambda: fx.int_divide(F.lit(1), F.lit(0)),
            lambda: fx.finite(F.lit(float("nan"))),
            lambda: fx.float_op(F.lit(1.0), "/", F.lit(0.0)),
            lambda: fx.cast(F.lit(1.5), "double", "bigint"),
            lambda: fx.cast(F.lit("yes"), "string", "boolean"),
            lambda: fx.decimal_divide(F.lit(Decimal("1.00")), F.lit(Decimal("3.00")), 2, 2),
            lambda: fx.double_i64(F.lit(1 << 62)),
        )
    ],
)
def test_errors(spark, column):
    with pytest.raises(Exception):  # noqa: B017
        value(spark, column())


def test_numbers(spark):
    assert value(spark, fx.int_divide(F.lit(-7), F.lit(2))) == -3
    assert value(spark, fx.float_op(F.lit(7.0), "/", F.lit(2.0))) == 3.5
    assert value(spark, fx.floor(F.lit(-1.5))) == -2.0
    assert value(spark, fx.ceil(F.lit(-1.5))) == -1.0
    assert value(spark, fx.round_half_away(F.lit(2.5))) == 3.0
    assert value(spark, fx.decimal_add(F.lit(Decimal("1.25")), F.lit(Decimal("2.5")), 3, 2, 2, 1)) == Decimal("3.75")
    assert value(spark, fx.decimal_multiply(F.lit(Decimal("1.25")), F.lit(Decimal("2.5")), 3, 2, 2, 1)) == Decimal("3.125")
    assert value(spark, fx.decimal_divide(F.lit(Decimal("1.00")), F.lit(Decimal("4.00")), 2, 2)) == Decimal("0.25")
    with pytest.raises(ValueError, match="38"):
        fx.decimal_multiply("a", "b", 20, 2, 20, 2)


def test_casts(spark):
    assert value(spark, fx.cast(F.lit(2.0), "double", "bigint")) == 2
    assert value(spark, fx.try_cast(F.lit(2.5), "double", "bigint")) is None
    assert value(spark, fx.cast(F.lit("TRUE"), "string", "boolean")) is True
    assert value(spark, fx.try_cast(F.lit("yes"), "string", "boolean")) is None
    assert value(spark, fx.try_cast(F.lit("12x"), "string", "bigint")) is None


def test_times(spark):
    t = F.to_timestamp(F.lit("2024-01-01 00:00:01.500"))
    u = F.to_timestamp(F.lit("2024-01-01 00:00:03"))
    assert value(spark, fx.timestamp_diff_seconds(t, u)) == -1
    assert value(spark, fx.timestamp_diff_seconds(u, t)) == 1
    assert str(value(spark, fx.date_add_days(F.to_date(F.lit("2024-02-28")), 2))) == "2024-03-01"
    assert value(spark, fx.date_diff_days(F.to_date(F.lit("2024-01-01")), F.to_date(F.lit("2024-01-03")))) == -2
    assert str(value(spark, fx.timestamp_add_seconds(u, 60)))[:16] == "2024-01-01 00:01"


@pytest.mark.parametrize(
    ("url", "domain"),
    [
        ("https://www.site.test:443/p?q=1", "site.test"),
        ("HTTP://WWW.Site.Test/x", "Site.Test"),
        ("//www.docs.test/c", "docs.test"),
        ("site.test?from=x", "site.test"),
        ("https://a:b@www.site.test/p", "site.test"),
        ("https://[2001:db8::1]:8443/p", "[2001:db8::1]"),
        ("https://u:p@[2001:db8::2]/p", "[2001:db8::2]"),
        ("", ""),
    ],
)
def test_url_domain(spark, url, domain):
    assert value(spark, fx.url_domain(F.lit(url))) == domain
