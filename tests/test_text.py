import pytest
from pyspark.sql import functions as F

from passagekit.functions import scoring
from passagekit.functions import text as X


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(("word", "want"), [("أله", "اله"), ("قرأ", "قرا"), ("نبأ", "نبا"), ("كَرِيمٌ", "كريم"), ("رحـم", "رحم")])
def test_root_fold(spark, word, want):
    assert one(spark, X.normalize_root("t"), t=word) == want


@pytest.mark.parametrize(("word", "want"), [("أشده", "اشده"), ("آتيناه", "اتيناه"), ("موسى", "موسي"), ("صلاة", "صلاه")])
def test_search_fold(spark, word, want):
    assert one(spark, X.normalize_search("t"), t=word) == want


def test_clean_profiles(spark):
    assert one(spark, X.normalize_clean("t"), t="شيء  من") == "شي من"
    assert one(spark, X.normalize_clean("t", "fold"), t="أشده") == "شده"
    with pytest.raises(ValueError):
        X.normalize_clean("t", "other")


def test_nfc(spark):
    assert one(spark, X.nfc("t"), t="é") == "é"


@pytest.mark.parametrize(("s", "a", "part"), [(1, 1, 1), (2, 141, 1), (2, 142, 2), (2, 253, 3), (78, 1, 30), (114, 6, 30), (0, 0, 1)])
def test_parts(spark, s, a, part):
    assert one(spark, X.part_of("s", "a"), s=s, a=a) == part


def test_even_sample(spark):
    assert one(spark, X.even_sample(F.sequence(F.lit(0), F.lit(6)), 5)) == [0, 1, 2, 4, 5]
    assert one(spark, X.even_sample(F.sequence(F.lit(0), F.lit(2)), 5)) == [0, 1, 2]


def test_tokens_split_at_any_space(spark):
    assert one(spark, X.tokens("t"), t=" A b\tc ") == ["a", "b", "c"]


def test_stop_words(spark):
    assert one(spark, X.without_stop_words(X.tokens("t")), t="من إلى كتاب") == ["كتاب"]


def test_stem(spark):
    assert one(spark, X.heuristic_stem("t"), t="والكتاب") == "ك-ت-ا-ب"
    assert one(spark, X.heuristic_stem("t"), t="abc") == ""


def test_period_and_language(spark):
    assert one(spark, X.detect_period("t"), t="verses about mercy (Makki)") == "makkiyya"
    assert one(spark, X.detect_period("t"), t="medinan") == "madani"
    assert one(spark, X.detect_period("t"), t="none") is None
    assert one(spark, X.detect_language("t"), t="الصبر") == "ar"
    assert one(spark, X.detect_language("t"), t="the way of the world") == "en"
    assert one(spark, X.detect_language("t"), t="xyz") == "unknown"


def test_ids(spark):
    assert one(spark, X.passage_id("s", "a"), s=2, a=255) == "2:255"
    assert one(spark, X.point_id("s", "a"), s=2, a=255) == 2255
    s, a = X.parse_id("t")
    assert [one(spark, F.array(s, a), t=t) for t in ("2:255", "x:1", "2")] == [[2, 255], [None, 1], [None, None]]
    assert one(spark, X.arabic_digits("n"), n=105) == "١٠٥"


def test_match_positions(spark):
    forms = F.array(F.lit("يوسف"))
    assert one(spark, X.match_positions("t", forms), t="قال وَيُوسُفَ نعم") == [1]
    assert one(spark, X.match_positions("t", forms), t="") == []


def test_title(spark):
    assert one(spark, X.title_of("t"), t=" a  b ") == "a b"
    assert one(spark, X.title_of("t"), t="x" * 60) == "x" * 48 + "…"


def test_scores(spark):
    got = one(spark, F.array(scoring.reciprocal_rank(F.lit(0)), scoring.reciprocal_rank(F.lit(2)), scoring.reciprocal_rank(F.lit(None).cast("int"))))
    assert got == pytest.approx([1 / 60, 1 / 62, 0])
    assert one(spark, F.array(scoring.coverage_blend(F.lit(0.8), F.lit(0.0)), scoring.coverage_blend(F.lit(0.8), F.lit(1.0)))) == pytest.approx([0.2, 0.8])
    assert one(spark, scoring.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(6.0), F.lit(8.0)))) == pytest.approx(1)
    assert one(spark, scoring.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
