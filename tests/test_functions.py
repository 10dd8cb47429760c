import math

from pyspark.sql import functions as F

from millrace.functions import labels as L
from millrace.functions import text as T


def one(spark, expr, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(expr.alias("x")).first()[0]


def test_tokens_and_content(spark):
    assert one(spark, T.tokens(F.col("t")), t="Jak-to 3,5 kg i Łódź?") == ["jak-to", "3,5", "kg", "i", "łódź"]
    assert one(spark, T.content(T.tokens(F.col("t"))), t="Jak i Łódź w x") == ["łódź"]
    assert one(spark, T.units(T.tokens(F.col("t"))), t="3 kg i 5 zł") == ["kg"]


def test_numbers_of_any_kind_are_word_characters(spark):
    assert one(spark, T.words(F.col("t")), t="The Ã³ x² Ⅳ a_1 n\u0303o") == ["the", "ã³", "x²", "ⅳ", "a_1", "n", "o"]


def test_shingles_of_short_and_long(spark):
    assert one(spark, T.shingles(T.words(F.col("t")), 3), t="a b") == ["a b"]
    assert one(spark, T.shingles(T.words(F.col("t")), 3), t="a b c d") == ["a b c", "b c d"]


def test_jaccard_of_empty_sets(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, T.jaccard(empty, empty)) == 0.0
    assert one(spark, T.jaccard(empty, empty, 1.0)) == 1.0


def test_labels_abstain(spark):
    found = L.query_labels(F.col("q"))
    assert one(spark, found["intent"], q="Co to jest energia?") == "definition"
    assert one(spark, found["form"], q="Co to jest energia?") == "full_question"
    assert one(spark, found["form"], q="jeden dwa trzy cztery pięć sześć siedem") == "unknown"
    assert one(spark, found["intent"], q="jeden dwa trzy cztery pięć sześć siedem") == "unknown"
    assert one(spark, found["intent_confidence"], q="") == 0.0
    assert one(spark, L.intent_applicable(F.lit("procedure"), F.col("q")), q="nic") is None


def test_format_metrics(spark):
    ok = L.format_metrics(F.col("q"))["format_valid"]
    assert one(spark, ok, q="jak działa silnik") is True
    assert one(spark, ok, q="Pytanie: jak działa silnik") is False
    assert one(spark, ok, q="- raz\n- dwa") is False
    assert one(spark, ok, q="  ") is False


def test_band_and_position(spark):
    band = lambda v: one(spark, L.overlap_band_reward(F.lit(v), 0.2, 0.6))
    assert band(0.4) == 1.0 and band(0.1) == 0.5 and math.isclose(band(0.8), 0.5)
    place = lambda i, n: one(spark, L.position_bucket(F.lit(i), F.lit(n)))
    assert [place(0, 1), place(0, 5), place(2, 5), place(4, 5)] == ["middle", "beginning", "middle", "end"]
