"""Language detection by trigrams against its SQL, on odd tables."""
import duckdb

from tagloom.plans import load


def test_odd_rows_equal_sql(spark, tmp_path):
    rows = [
        (2, "The cat sat on the mat. " * 9, "en"), (4, "Der Hund saß auf der Matte, ÄÖÜ.", "de"), (6, None, "de"), (8, "", "fr"), (10, "1 2 3 …", "en"), (12, "le chat 中文字 𝐀𝐁 s'est assis", "fr"),
        (12, "The same id again", "en"), (14, "no language here", None), (1, "the mat of the dog", "en"), (3, None, "en"), (5, "", None), (7, "ein Hund und der Kater", "de"), (None, "the end", "en"), (9, "中文字", "zh"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("language_detect", "language_topk"):
        got = sorted(map(repr, map(tuple, load()[0][name](spark, str(tmp_path)).collect())))
        assert got == sorted(map(repr, duck.execute(load()[1][name]).fetchall()))


def test_no_row_leaves_for_each_trigram(spark, data):
    """The plan explodes nothing: one row for each text and language is shuffled."""
    plan = load()[0]["language_topk"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_known_trigrams_are_found_without_a_sort(monkeypatch):
    """By slots, or by a search where there are too many for slots: each counted as often as it is there."""
    from collections import Counter

    import numpy as np

    from tagloom.operators import language as LA

    text = " the cat sat on the mat, le chat 中文字 𐀀𐀁 assis " * 40
    codes = LA._codes(text)
    want = Counter(text[i : i + 3] for i in range(len(text) - 2))
    for count in (1, 20):
        known = np.unique(np.append(np.unique(codes)[::2][:count], LA._codes("zzz")))
        slots = LA._slots(known)
        assert slots is not None and LA._slots(np.arange(5000)) is None
        monkeypatch.setattr(np, "unique", None)
        for how in (slots, None):
            assert LA._found(codes, known, how).tolist() == [want[LA._gram(k)] for k in known.tolist()]
        monkeypatch.undo()
