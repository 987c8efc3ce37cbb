from pyspark.sql import functions as F

from tagloom.functions import feats as FE
from tagloom.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


def test_segment(spark):
    assert one(spark, T.segment_sentences("t"), t=" One  two. Three?! four") == ["One two.", "Three?!", "four"]
    assert one(spark, T.segment_sentences("t"), t="") == []
    assert one(spark, T.segment_sentences_quoted("t"), t='He said "go." Then left.') == ['He said "go."', "Then left."]


def test_tokenize(spark):
    assert one(spark, T.tokenize_ud("t"), t="Élan, don't_x 3!") == ["Élan", ",", "don't_x", "3", "!"]
    assert one(spark, T.peel_trailing_punct(T.tokenize_whitespace("t")), t="go. now?! .") == ["go", ".", "now", "?!", "."]


def test_case_and_forms(spark):
    got = [one(spark, T.form_case("t"), t=x) for x in ("ABC", "Abc", "abc", "1a", "", "A")]
    assert got == ["UU", "Ul", "ll", "??", "ll", "Ul"]
    assert one(spark, T.normalize_form("t"), t="Don't") == "dont"
    assert one(spark, T.normalize_form("t"), t="...") == "..."
    assert one(spark, T.clean_language_name("t"), t="Sorbian (Upper)") == "Upper Sorbian"


def test_feats(spark):
    assert one(spark, FE.normalize_feats("f"), f="B=2| A=1 |junk|_") == "A=1|B=2"
    assert one(spark, FE.normalize_feats("f"), f="_") == "_"
    assert one(spark, FE.feats_to_map("f"), f="A=1|A=2|B=x=y") == {"A": "2", "B": "x=y"}
    assert one(spark, FE.feats_partial_match("g", "p"), g="A=1|B=2", p="A=1") is True
    assert one(spark, FE.feats_partial_match("g", "p"), g="A=1", p="_") is False
    assert one(spark, FE.feats_partial_match("g", "p"), g="_", p="_") is True
    assert one(spark, FE.feats_match_script("g", "p"), g="_", p="A=1") is True


def test_format_sniff_and_markup(spark):
    assert one(spark, T.detect_input_format("t"), t="<TEI><tok id='1'>x</tok></TEI>") == "teitok"
    assert one(spark, T.detect_input_format("t"), t="# text = a\n1\ta") == "conllu"
    assert one(spark, T.detect_input_format("t"), t="plain") == "raw"
    assert one(spark, T.extract_plain_text("t"), t="<p>One <note>no</note>two</p><div>3</div>") == "One two\n\n3"


def test_natural_sort(spark):
    rows = spark.createDataFrame([("a10",), ("a9",), ("a1b2",)], "t string").orderBy(T.natural_sort_key("t")).collect()
    assert [r.t for r in rows] == ["a1b2", "a9", "a10"]
    assert rows and F is not None
