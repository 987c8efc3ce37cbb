"""Null ids and texts, repeated rows, empty tables and columns of clashing names."""
import pytest

from tagloom.llm import bpe, decontaminate, exact_dedup, language_id, matroska, pii, secrets, simhash, toxicity, warc

#: Names that the operators use inside.
SCHEMA = "doc_id long, text string, th string, size string, word string, fp string, ids string, iv string, _t string, _k0 string, n string"
ROWS = [(1, "aa bb", *["x"] * 9), (1, "aa bb", *["x"] * 9), (None, "cc", *[None] * 9), (2, None, *["y"] * 9), (3, "", *[None] * 9)]
LABELS = "doc_id long, quality int, toxic int"


def items(spark):
    return spark.createDataFrame([(1, "aa bb"), (2, None), (None, "zz")], "item_id long, text string")


OPERATORS = {
    "toxicity": lambda s, d: toxicity.score_documents(d, toxicity.fit(d, s.createDataFrame([], LABELS))),
    "decontaminate": lambda s, d: decontaminate.scan_documents(d, items(s)),
    "language_id": lambda s, d: language_id.identify(d, language_id.fit_dictionaries(d.selectExpr("doc_id", "text", "n AS lang"))),
    "pii": lambda s, d: pii.pseudonymise(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "matroska": lambda s, d: matroska.media_features(matroska.store_media(d)),
    "exact_dedup": lambda s, d: exact_dedup.remove_repeated(d, length=4, gram=4),
    "bpe": lambda s, d: bpe.encode_documents(d, with_digests=True),
    "secrets": lambda s, d: secrets.find_secrets(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(spark, name):
    d = spark.createDataFrame(ROWS, SCHEMA)
    got = OPERATORS[name](spark, d).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "3", "None"]
    assert OPERATORS[name](spark, d.limit(0)).count() == 0


def test_warc_of_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0


CLASH = "doc_id long, text string, runs string, items string, n_words string, _text string, toxicity string, _toxicity string, toxicity_text string, n_bytes string, n_removed string, t string, k0 string"
CLASH_ROWS = [(1, "aa bb", *["x"] * 11), (1, "aa bb", *["x"] * 11), (None, "cc", *[None] * 11), (2, None, *["y"] * 11), (3, "", *[None] * 11)]
KEEPERS = {
    "remove_spans": lambda s, d: decontaminate.remove_spans(d, items(s)),
    "remove_spans in blocks": lambda s, d: decontaminate.remove_spans(d, items(s), block_words=1),
    "drop_toxic": lambda s, d: toxicity.drop_toxic(d, toxicity.fit(d, s.createDataFrame([], LABELS))),
    "redact_secrets": lambda s, d: secrets.redact_secrets(d),
}


@pytest.mark.parametrize("name", KEEPERS)
def test_all_columns_stay(spark, name):
    d = spark.createDataFrame(CLASH_ROWS, CLASH)
    got = KEEPERS[name](spark, d)
    assert got.columns == d.columns and [f.dataType for f in got.schema] == [f.dataType for f in d.schema]
    rest = lambda rows: sorted(repr(tuple(r)[2:]) for r in rows)
    assert rest(got.collect()) == rest(d.collect())


def test_exact_dedup_renames_its_own_columns(spark):
    got = exact_dedup.remove_repeated(spark.createDataFrame(CLASH_ROWS, CLASH), length=4, gram=4, passage=0)
    assert len(set(got.columns)) == len(got.columns) and {"n_bytes", "_n_bytes", "_n_removed"} <= set(got.columns)
    assert got.count() == len(CLASH_ROWS)


def test_very_long_texts(spark):
    """A text of a million characters passes each operator in one piece."""
    import random

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    long = " ".join(rng.choice(words) for _ in range(180_000))
    d = spark.createDataFrame([(1, long, *["x"] * 9), (2, long + " end", *["x"] * 9), (3, "b", *["x"] * 9)], SCHEMA)
    for name, operator in OPERATORS.items():
        assert sorted(r.doc_id for r in operator(spark, d).select("doc_id").collect()) == [1, 2, 3], name


def test_broadcasts_where_workers_lack_the_package(tmp_path):
    """A session started elsewhere, with the package only on the driver's path."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
import sys
sys.path.insert(0, {root!r})
from tagloom.llm import decontaminate, toxicity, language_id
d = s.createDataFrame([(1, "you idiot"), (2, "one two three")], "doc_id long, text string")
b = s.createDataFrame([(1, "two three")], "item_id long, text string")
print(toxicity.score_documents(d, toxicity.fit(d, s.createDataFrame([], "doc_id long, toxic int"))).collect())
print(decontaminate.scan_documents(d, b).collect())
print(language_id.identify(d, {{"x": b"abc def " * 20, "y": b"one two " * 20}}).collect())
print("all well")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "all well" in out.stdout, out.stderr[-3000:]
