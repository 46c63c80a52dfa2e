"""Redaction takes texts that nothing in them needs as they are."""

from functools import reduce

from pyspark.sql import functions as F

from tallyhouse.functions import text


def test_redaction_is_skipped_only_where_nothing_matches(spark):
    texts = ["plain  text", "a@b.de", "REF: abcd", "ref abc", "Bestellung  x_99/aa", "Rechnungsnummer ABCD", "DE" + "1" * 20, "GB12ABCDEFGHIJKL", "1234567", "123456", "invoice#abcde order", "", "  ", "refabcd", "Übung - İ"]
    rows = spark.createDataFrame([(x,) for x in [*texts, None]], "t string")
    plain = F.left(F.trim(F.regexp_replace(reduce(lambda x, rule: F.regexp_replace(x, *rule), text.REDACTIONS, F.col("t")), r"\s+", " ")), F.lit(500))
    assert rows.where(~text.redact(F.col("t")).eqNullSafe(F.nullif(plain, F.lit("")))).count() == 0
