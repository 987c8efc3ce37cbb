"""Documents in blocks: the tokens, counts and tags of the paths that have a row for each token."""
import random

import numpy as np
import pyarrow as pa
import pytest

from tagloom.operators import lexicon as L
from tagloom.operators import tagger as TA
from tagloom.plans import blocks as BL
from tagloom.plans import corpus, load, q_io

TEXTS = [
    "", None, " ", "\n\n", ".", "...", "a. b", "Hello world. how are you? ", "x.\u0085", "x.  ", "x. ", "x. y", "a -- b -- c. -- . --", "--", "-- --",
    "don't e-mail_x 12 ½ ² ٣٤ a1 1a é É Ñandú ÀÉ ÎLE", "İstanbul ıI ΣΑΣ ß ẞ. ǅ ǆ", "a b​c　﻿d. \U0001f600\U0001d400b x", "éx ́", "no end at all and so on " * 300,
    "Ab cd ef. " * 50, "\tlead. \r\n\x0b next!?  ?! x", "日本語。テスト. 中文", "a.b.c d.  e .f", "unknownforms zzqqxx QWERTY 123abc", "AB Ab aB ab A a", "Ⅷ ⅷ ७८", "\x1c\x1d x.\x1c y",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    rows = [(i + k, t, "en") for k in (0, 1001) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{d}/documents.parquet")
    return d


def test_tokens_are_those_of_the_regular_expressions(spark, odd):
    classes, docs = BL.code_points(spark), corpus.read(spark, odd, "documents").filter("text IS NOT NULL")
    want = {r.text: [s for s in r.f if s] for r in corpus.words(docs, ("text",)).collect()}
    got = BL.cut(pa.array(["left out", *want], pa.string()).slice(1), classes)
    forms = iter(got["forms"].take(pa.array(got["codes"])).to_pylist())
    lengths = iter(got["lengths"].tolist())
    assert [[[next(forms) for _ in range(next(lengths))] for _ in range(n)] for n in got["n_sents"]] == list(want.values())


def test_broken_bytes_are_replaced(spark):
    text = pa.StringArray.from_buffers(2, pa.py_buffer(np.array([0, 3, 7], np.int32)), pa.py_buffer(b"a\xff.x \xe9y"))
    got = BL.cut(text, BL.code_points(spark))
    assert got["forms"].take(pa.array(got["codes"])).to_pylist() == ["a", "�", ".", "x", "�", "y"] and got["n_sents"].tolist() == [1, 1]


@pytest.mark.parametrize("size", [1, 400, 6 << 20])
def test_blocks_train_what_tokens_train(spark, odd, monkeypatch, size):
    monkeypatch.setattr(BL, "BLOCK_BYTES", size)
    train = corpus.gold(spark, odd).filter("doc_id % 2 = 0")
    rows = BL.blocks(corpus.read(spark, odd, "documents")).cache()
    want, m = TA.tag_model(L.transition_counts(train), L.case_counts(train)), BL.model(rows)
    assert (m.transitions, m.cases) == (want.transitions, want.cases)
    forms = BL.forms(rows)
    assert sorted((r.form, BL.TAGS[r.tag], r.n) for r in BL.entries(BL.cells(forms)).collect()) == sorted(map(tuple, L.vocab_counts(train, ["form", "tag"]).collect()))
    assert forms.count() == corpus.tokens(spark, odd).select("form").distinct().count()


def test_two_stage_shuffles_no_tokens(spark, odd, monkeypatch):
    """The rows of the tagger that gathers sentences by a shuffle of their tokens, without one."""
    monkeypatch.setattr(BL, "BLOCK_BYTES", 2000)
    made = load()[0]["two_stage"](spark, odd)
    want = TA.write_pred(q_io.tagged(spark, odd, tag="'_'", carry=("tag", "head", "deprel")))
    assert made.dtypes == want.dtypes and sorted(map(str, made.collect())) == sorted(map(str, want.collect()))
    exchanged = lambda df: [x for x in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "Aggregate" in x and "doc_id" in x]
    assert exchanged(want) and not exchanged(made)


def test_without_documents_that_train_tags_are_unknown(spark, tmp_path):
    spark.createDataFrame([(1, "The cat. On -- it"), (3, None)], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, load()[0]["two_stage"](spark, str(tmp_path)).select("doc_id", "form", "tag").collect()))
    assert got == sorted((1, f, None if f == "--" else "<unknown>") for f in ("The", "cat", ".", "On", "--", "it"))


def test_blocks_are_tagged_as_one_by_one():
    rnd = random.Random(7)
    m = TA.TagModel({"A": {"B": 3, "A": 3}, "B": {"A": 1, "C": 3, "D": 2}, "C": {"A": 1}}, {"A": {"ll": 2, "UU": 1}, "C": {"Ul": 3}})
    tags, n = ["A", "A.B", "B", "C", "D"], 60
    cells = [{t: rnd.choice([0.25, 0.5, 1e-12]) for t in rnd.sample(tags, rnd.choice([1, 2, 2, 3, 5]))} for _ in range(n)]
    tag, p = np.full((5, n), -1), np.zeros((5, n))
    for i, c in enumerate(cells):
        for j, t in enumerate(sorted(c)):
            tag[j, i], p[j, i] = tags.index(t), c[t]
    case, cuts = np.array([rnd.randrange(4) for _ in range(n)]), np.arange(n) == 5
    for s in ({}, {"factor": 1.2, "smooth": 0.01}, {"epsilon": 0.3, "case_min": 0.7}, {"beam": 2, "threshold": 0.4}):
        s = {**TA.DEFAULTS, **s}
        st = TA.Settings(**{k: v for k, v in s.items() if not k.startswith("end")})
        sents = [[rnd.randrange(n) for _ in range(rnd.randint(1, 15))] for _ in range(300)]
        want = []
        for x in sents:
            part = []
            for f in [*x, None]:
                if f in (5, None):
                    want += TA.viterbi([(cells[y], TA.CASES[case[y]]) for y in part], m, st) + [None] * (f is not None)
                    part = []
                else:
                    part.append(f)
        codes = np.array([f for x in sents for f in x])
        new = np.concatenate([np.arange(len(x)) == 0 for x in sents])
        best = TA.best_tags(codes, new, cuts, tags, tag, p, case, m, s)
        assert [tags[k] if k >= 0 else None for k in best] == want


def test_evidence_in_the_row_weighs_as_the_lattice(spark):
    from pyspark.sql import functions as F

    from tagloom.operators import lookup as LU

    names = ("N", "V")
    e = spark.createDataFrame([("running", "V", 3), ("sing", "N", 2), ("going", "V", 9), ("going", "N", 1), ("king", "N", 1), ("Sing", "V", 2), ("KING", "V", 7)], "form string, tag string, n long")
    forms = spark.createDataFrame([("ungoing",), ("g",), ("xyz",), ("SING",), ("kiNg",)], "form string").union(e.select("form")).distinct()
    number = F.when(F.col("tag") == "N", 0).otherwise(1)
    own = e.groupBy("form").agg(F.collect_list(F.struct(number.alias("tag"), F.col("n").cast("double").alias("w"))).alias("ts"), F.sum("n").alias("freq"))
    own, ends = forms.join(own, "form", "left"), L.ending_index(e.withColumn("tag", number))
    full, three = ({r.form: r.cell for r in LU.evidence_in_row(own, ends, 6, most).collect()} for most in (9, 3))
    want = {(r.form, r.tag): r.p for r in LU.candidate_lattice(forms, e, L.ending_index(e), e.groupBy("tag").agg(L.n("n_types"))).collect()}
    assert len(three["ungoing"]) < len(full["ungoing"]) and three["king"] == full["king"] == [0, 1] and three["xyz"] == []
    at = sorted(three)
    tags, tag, p = TA.weighed_cells(pa.array([three[f] for f in at], pa.list_(pa.float64())), names, TA.TagModel(), {"N": 3.0, "V": 4.0}, {"endlen": 6, "endretry": 2, "ending_decay_base": 2.0, "fallback": 1e-6})
    assert {(f, tags[t]): w for i, f in enumerate(at) for t, w in zip(tag[:, i], p[:, i]) if t >= 0} == pytest.approx(want, rel=1e-15)
