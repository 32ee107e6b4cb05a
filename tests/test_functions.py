from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custodia.functions import masks, predicates, scalars

STEWARD, ANALYST, OWNER = ["DATA_STEWARD"], ["DEPOSITS_ANALYST"], ["DATA_OWNER", "DATA_STEWARD"]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "shown"),
    [(None, None), ("", "****"), ("a", "****"), ("abcd", "****"), ("abcde", "ab*de"), ("abcdefgh", "ab****gh")],
)
def test_steward_sees_the_ends_of_long_texts(spark, text, shown):
    assert value(spark, masks.mask_string(F.lit(text).cast("string"), "PII", STEWARD)) == shown


def test_others_see_the_full_mask_even_for_null(spark):
    assert value(spark, masks.mask_string(F.lit(None).cast("string"), "PII", ANALYST)) == "***MASKED***"


def test_clear_is_tested_before_partial(spark):
    assert value(spark, masks.mask_string(F.lit("secret text"), "PII", OWNER)) == "secret text"
    assert value(spark, masks.mask_string(F.lit("secret text"), "PII", ["SVC_PIPELINE"])) == "secret text"


@pytest.mark.parametrize(("tag", "expected"), [("INTERNAL", "CLEAR"), ("QUASI_IDENTIFIER", "CLEAR"), ("PII", "FULL"), (None, "FULL")])
def test_only_protected_tags_are_masked(tag, expected):
    assert masks.level(tag, ANALYST) == expected


def test_dates_and_numbers(spark):
    born = F.lit(date(1975, 6, 30))
    assert value(spark, masks.mask_date(born, "PII", STEWARD)) == date(1975, 1, 1)
    assert value(spark, masks.mask_date(born, "PII", ANALYST)) is None
    amount = F.lit(Decimal("123456.78")).cast("decimal(15,2)")
    assert value(spark, masks.mask_number(amount, "SENSITIVE", STEWARD)) == Decimal("120000.00")
    assert value(spark, masks.mask_number(F.lit(Decimal("-1.00")).cast("decimal(15,2)"), "SENSITIVE", STEWARD)) == Decimal("-10000.00")
    assert value(spark, masks.mask_number(amount, "SENSITIVE", ANALYST)) is None


def test_mask_follows_the_column_type(spark):
    schema = T.StructType.fromDDL("s string, d date, n decimal(15,2), k bigint, f double, t timestamp")
    df = spark.createDataFrame([("abcdef", date(2000, 5, 5), Decimal("15000.00"), 2**60 + 7, 1.5, None)], schema)
    out = df.select([masks.mask_for(f, "PII", STEWARD) for f in schema])
    assert [f.dataType for f in out.schema] == [f.dataType for f in schema]
    r = out.first()
    assert (r.s, r.d, r.n, r.f) == ("ab**ef", date(2000, 1, 1), Decimal("10000.00"), 1.5)
    assert r.k == (2**60 + 7) // 10000 * 10000


def test_policy_for_type(spark):
    got = [value(spark, masks.policy_for_type(F.lit(t))) for t in ("VARCHAR", "DATE", "BIGINT", "FLOAT", "TIMESTAMP_NTZ")]
    assert got == ["CLASSIFICATION_MASK_VARCHAR", "CLASSIFICATION_MASK_DATE", "CLASSIFICATION_MASK_NUMBER", None, None]


@pytest.mark.parametrize(("text", "filled"), [(None, False), ("", False), ("  ", False), (" x ", True)])
def test_is_filled_is_never_null(spark, text, filled):
    assert value(spark, predicates.is_filled(F.lit(text).cast("string"))) is filled


@pytest.mark.parametrize(("diff", "outside"), [("1.00", False), ("1.01", True), ("-1.01", True), ("0.00", False)])
def test_tolerance_is_inclusive(spark, diff, outside):
    a = F.lit(Decimal("100.00")).cast("decimal(38,2)")
    b = F.lit(Decimal("100.00") + Decimal(diff)).cast("decimal(38,2)")
    assert value(spark, predicates.outside(a, b, "1.00")) is outside


def test_format_must_match_the_whole_value(spark):
    patterns = {"PERSON": "[0-9]{3}-[0-9]{2}-[0-9]{4}"}
    ok = lambda text, kind: value(spark, predicates.format_ok(F.lit(text).cast("string"), F.lit(kind).cast("string"), patterns))
    assert ok("123-45-6789", "PERSON") is True
    assert ok("x123-45-6789", "PERSON") is False
    assert ok("123-45-67890", "PERSON") is False
    assert ok(None, "PERSON") is False
    assert ok("123-45-6789", None) is False


def test_not_in_domain_catches_null(spark):
    assert value(spark, predicates.not_in_domain(F.lit(None).cast("string"), ["A"])) is True
    assert value(spark, predicates.not_in_domain(F.lit("A"), ["A"])) is False


def test_ratio_is_null_without_a_denominator(spark):
    assert value(spark, scalars.ratio(F.lit(7), F.lit(8), 4)) == 0.875
    assert value(spark, scalars.ratio(F.lit(7), F.lit(12), 4)) == 0.5833
    assert value(spark, scalars.ratio(F.lit(0), F.lit(0), 4)) is None


def test_stamp_formats(spark):
    ts = F.lit("2024-01-31 05:06:07").cast("timestamp")
    assert value(spark, scalars.stamp(ts)) == "2024-01-31 05:06:07 +00:00"
    assert value(spark, scalars.stamp(ts, scalars.STAMP_COMPACT)) == "2024_01_31_05_06_07"


def test_variant_field_tries_every_spelling(spark):
    assert value(spark, scalars.variant_field(F.lit('{"QUERY_ID": "a"}'), "query_id", "QUERY_ID")) == "a"
    assert value(spark, scalars.variant_field(F.lit("not json"), "query_id")) is None


def test_nested_mentions(spark):
    col = F.array(F.struct(F.lit("A.B.MART_DEPOSITS").alias("objectName")))
    assert value(spark, predicates.nested_mentions(col, "mart_deposits")) is True
    assert value(spark, predicates.nested_mentions(col, "mart_loans")) is False
