from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom import annotators
from tagloom.operators import alignment, lemma_rules, metrics, spans, splits
from tagloom.operators import tagger as TA
from tagloom.operators import transforms as X

TAGS = "abc"


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.dictionaries(st.sampled_from(TAGS), st.floats(0.1, 1), min_size=1), min_size=1, max_size=4),
    st.lists(st.integers(1, 9), min_size=9, max_size=9),
)
def test_viterbi_is_the_best_path(cells, counts):
    m = TA.TagModel(transitions={p: {t: counts[3 * i + j] for j, t in enumerate(TAGS)} for i, p in enumerate(TAGS)})

    def weight(path):
        w = cells[0][path[0]]
        for k in range(1, len(path)):
            w *= cells[k][path[k]] * m.transitions[path[k - 1]][path[k]]
        return w

    best = TA.viterbi([(c, "ll") for c in cells], m, TA.Settings())
    top = max(weight(p) for p in product(*cells))
    assert abs(weight(best) - top) <= 1e-9 * top


def test_viterbi_dead_end_restarts():
    m = TA.TagModel(transitions={"a": {"a": 1}})
    assert TA.viterbi([({"a": 1.0}, "ll"), ({"b": 1.0}, "ll"), ({"b": 0.5, "c": 0.4}, "ll")], m, TA.Settings()) == ["a", "b", "b"]


def test_lemma_rules():
    assert lemma_rules.make_rule("walked", "walk") == "*ed#*"
    assert lemma_rules.make_rule("same", "same") == "*#*"
    assert lemma_rules.apply_rule("talked", "*ed#*") == "talk"
    assert lemma_rules.apply_rule("sing", "*ed#*") == ""


def test_alignment_and_scores(spark):
    g = spark.createDataFrame([(1, 0, i, w) for i, w in enumerate("the cat sat on the mat".split())], "doc_id long, sent_ord int, tok_ord int, form string")
    p = spark.createDataFrame([(1, 0, i, w) for i, w in enumerate("the sat on the mat".split())], "doc_id long, sent_ord int, tok_ord int, form string")
    rows = {r.g_pos: r.p_pos for r in alignment.align_gold_pred(g, p).collect()}
    assert rows == {0: 0, 1: None, 2: 1, 3: 2, 4: 3, 5: 4}
    blocks = {(r.g_pos, r.p_pos) for r in alignment.sequence_align(g, p).collect()}
    assert blocks == {(0, 0), (2, 1), (3, 2), (4, 3), (5, 4)}
    names = "form upos xpos lemma feats reg".split()
    pair = spark.createDataFrame([("a", "N", "n", "a", "_", "", "a", "N", "n", "a", "_", "")], ", ".join(f"{s}_{n} string" for s in "gp" for n in names))
    assert all(r.correct == r.total for r in metrics.accuracy_metrics(pair).collect())


def test_splits_are_stable(spark):
    ids = spark.range(200).selectExpr("cast(id AS string) AS id")
    a = {r.id: r.split for r in splits.split_cutpoints(ids).collect()}
    more = spark.range(300).selectExpr("cast(id AS string) AS id")
    b = {r.id: r.split for r in splits.preserve_splits(more, spark.createDataFrame(list(a.items()), "id string, split string")).collect()}
    assert len(a) == 200 and len(b) == 300 and all(b[k] == v for k, v in a.items())


def test_iob_and_validate(spark):
    rows = [(1, 0, i, x, 1.0) for i, x in enumerate(["B-P", "I-P", "O", "I-L", "B-L"])]
    got = spans.iob_to_spans(spark.createDataFrame(rows, "doc_id long, sent_ord int, tok_ord int, iob string, score double")).collect()
    assert sorted((r.label, r.start, r.end) for r in got) == [("L", 3, 3), ("L", 4, 4), ("P", 0, 1)]
    t = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 1, 0), (1, 1, 0, 9)], "doc_id long, sent_ord int, tok_ord int, head int")
    assert sorted(r.problem for r in X.validate(t).collect()) == ["head out of range", "not one root", "not one root"]


def test_implicit_mwt(spark):
    rows = [(1, 0, i, f, s) for i, (f, s) in enumerate([("don", False), ("t", True), ("a", False), (",", True), ("b", None)])]
    t = spark.createDataFrame(rows, "doc_id long, sent_ord int, tok_ord int, form string, space_after boolean")
    assert [r.form for r in X.implicit_mwt(t).collect()] == ["dont"]
    assert [r.form for r in X.merge_contractions(t).collect()] == ["dont"]


def test_annotators(spark):
    @annotators.annotator("upper", ["normalize"], aliases=["UP"])
    def upper(df):
        return df.selectExpr("upper(form) AS form")

    t = spark.createDataFrame([("a",)], "form string")
    assert annotators.run_pipeline(t, ["up"]).first().form == "A"
    assert annotators.run_pipeline(t, ["up"], tasks=["tag"]).first().form == "a"


def test_streaming(spark, data, tmp_path):
    from tagloom.streaming import stream_documents, stream_form_counts

    spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").write.parquet(str(tmp_path / "in"))
    q = stream_form_counts(stream_documents(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("forms").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM forms").first()[0] > 10_000


@settings(max_examples=40, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from(TAGS), st.floats(0.1, 1), min_size=1), min_size=1, max_size=4), st.integers(1, 2), st.floats(0.1, 1))
def test_beam_skips_what_comes_late_and_low(cells, beam, threshold):
    """Brute force: a cell keeps its first ``beam`` tags and, of later ones, those of the threshold or more."""
    m = TA.TagModel(transitions={p: {t: 1 + (i + 2 * j) % 4 for j, t in enumerate(TAGS)} for i, p in enumerate(TAGS)})
    kept = []
    for c in cells:
        k = {}
        for t in sorted(c):
            if len(k) < beam or c[t] >= threshold:
                k[t] = c[t]
        kept.append(k)

    def weight(path):
        w = kept[0][path[0]]
        for k in range(1, len(path)):
            w *= kept[k][path[k]] * m.transitions[path[k - 1]][path[k]]
        return w

    got = TA.viterbi([(c, "ll") for c in cells], m, TA.Settings(beam=beam, threshold=threshold))
    top = max(weight(p) for p in product(*kept))
    assert all(t in k for t, k in zip(got, kept)) and abs(weight(got) - top) <= 1e-9 * top


def test_contractions_follow_by_their_halves():
    m = TA.TagModel(transitions={"P": {"D": 5}, "D": {"N": 3}})
    assert TA.viterbi([({"P.D": 1.0}, "ll"), ({"N": 0.5, "P": 0.5}, "ll")], m, TA.Settings()) == ["P.D", "N"]


def test_attachment_follows_the_alignment(spark):
    """The gold head's partner counts, not its number: a token is missing before it."""
    rows = [(1, 0, 1, None, 2, None, "dep", None), (1, 0, 2, 1, 0, 0, "root", "root"), (1, 0, 3, 2, 2, 1, "dep", "dep"), (1, 0, 4, 3, 2, 2, "dep", "dep")]
    t = spark.createDataFrame(rows, "doc_id long, sent_ord int, g_id int, p_id int, g_head int, p_head int, g_deprel string, p_deprel string")
    r = metrics.attachment_scores(t).first()
    assert (round(r.uas, 6), round(r.las, 6), r.n) == (round(2 / 3, 6), round(2 / 3, 6), 3)


def test_patterns_apply_one_after_another(spark):
    from tagloom.operators import normalize as N

    known = spark.createDataFrame([("corazon", ""), ("coraçon", ""), ("corasón", "corazon"), ("x", "")], "form string, reg string")
    patterns = spark.createDataFrame([("ç", "z", 20), ("ó", "o", 15), ("a", "ó", 99), ("é", "e", 9)], "old string, new string, n long")
    forms = spark.createDataFrame([("coraçón",), ("Coraçón",), ("coraçon",), ("corasón",), ("éx",), ("x",)], "form string")
    got = {r.form: r.reg for r in N.pattern_substitution(forms, patterns, known).collect()}
    # ç first gives nothing known, ó then does; coraçon is known without a regular form; é has too few.
    assert got == {"coraçón": "coraçon", "Coraçón": "coraçon"}


def test_search_for_settings_is_one_pass():
    calls = []

    def score(s):
        calls.append(dict(s))
        return -abs(s["a"] - 3) - abs(s["endlen"] - 4)

    best, top, n = TA.finetune(score, {"a": 1, "endlen": 5}, {"a": [1, 2, 3], "endlen": [4, 5, 6]})
    assert best == {"a": 3, "endlen": 5} and n == len(calls) == 4 and top == -1


def test_process_text(spark):
    from tagloom.operators import lexicon as L
    from tagloom.operators import process as P

    words = [("the", "D", "the"), ("cat", "N", "cat"), ("sat", "V", "sit"), (".", "P", ".")]
    rows = [(d, 0, i, w, t, m, "", i + 1 < 4) for d in range(3) for i, (w, t, m) in enumerate(words)]
    train = spark.createDataFrame(rows, "doc_id long, sent_ord int, tok_ord int, form string, tag string, lemma string, reg string, space_after boolean")
    parts = L.mwt_parts(spark.createDataFrame([("catsat", "cat+sat")], "form string, parts string"))
    docs = spark.createDataFrame([(7, "The cat sat. the catsat"), (8, ""), (9, None)], "doc_id long, text string")
    got = sorted(tuple(r) for r in P.process_text(docs, P.train_tables(train, parts)).collect())
    assert [(r[1], r[2], r[3], r[7], r[8]) for r in got[:5]] == [(0, 0, "The", "D", "the"), (0, 1, "cat", "N", "cat"), (0, 2, "sat", "V", "sit"), (0, 3, ".", "P", "."), (1, 0, "the", "D", "the")]
    assert len(got) == 6 and got[5][3] == "catsat" and got[5][6] == "cat+sat" and [r[4] for r in got[:4]] == [True, True, False, None]


def test_program_as_annotator(spark):
    t = spark.createDataFrame([("ab",), ("c",)], "form string")
    apply = annotators.command(["tr", "a-z", "A-Z"], "form string, pred string")
    assert sorted(tuple(r) for r in apply(t).collect()) == [("ab", "AB"), ("c", "C")]
    assert annotators.READERS.get("tei") and annotators.DETECTORS.get("trigrams")


def test_ranks_over_ranges(spark):
    from tagloom.operators.catalog import ranked

    t = spark.range(500).selectExpr("id", "(id * 7919) % 500 AS k")
    got = {r.k: r["rank"] for r in ranked(t, "k", "id", ranges=7).collect()}
    assert got == {k: k + 1 for k in range(500)}


def test_two_stage_carries_its_columns(spark, data, tmp_path):
    """The rows of a join back, without it."""
    from pyspark.sql import functions as F

    from tagloom.plans import load
    from tagloom.plans.corpus import gold, read

    read(spark, data, "documents").limit(4).write.parquet(f"{tmp_path}/documents.parquet")
    d = str(tmp_path)
    made = load()[0]["two_stage"](spark, d)
    test = gold(spark, d).withColumn("tag", F.lit("_")).select("doc_id", "sent_ord", "tok_ord", "form", "tag", "head", "deprel")
    want = TA.update_tokens(test, load()[0]["viterbi_tag"](spark, d))
    assert made.columns == want.columns and sorted(made.collect()) == sorted(want.collect())
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join") < want._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_a_transition_is_weighed_once(monkeypatch):
    """Not for each token, in either space; spaces and settings don't share weights."""
    met = []
    arc = TA._arc
    monkeypatch.setattr(TA, "_arc", lambda m, s, prev, tag, log: met.append((prev, tag, log, s.factor)) or arc(m, s, prev, tag, log))
    m = TA.TagModel({"a": {"b": 1, "a": 2}, "b": {"a": 3}}, {"a": {"ll": 2}}, {"a": 1})
    for log in (False, True):
        for factor in (1.0, 1.2):
            for _ in range(3):
                assert len(TA.viterbi([({"a": 0.5, "b": 0.5}, "ll")] * 9, m, TA.Settings(factor=factor), log)) == 9
    assert len(met) == len(set(met)) == 16


def test_settings_are_tried_together(spark, monkeypatch):
    """Shares of right tags for many settings in one job are those of a tagger run for each, and nothing is shuffled for them."""
    import random

    from pyspark.sql import functions as F

    from tagloom.operators import lexicon as L
    from tagloom.operators import lookup as LU

    rnd = random.Random(3)
    words = ["the", "The", "cat", "cats", "catty", "sat", "Rome", "ROME", "run", "runs", ".", "--", "12", "é", "q"]
    rows = [(d, s, i, rnd.choice(words) + rnd.choice(["", "", "ed", "xy"]) * (i % 3 == 1), rnd.choice(["D", "N", "N.D", "V", "P"])) for d in range(24) for s in range(3) for i in range(rnd.randint(1, 9))]
    t = spark.createDataFrame(rows, "doc_id long, sent_ord int, tok_ord int, form string, tag string").withColumn("form", F.regexp_replace("form", "^--.+", "--")).cache()
    # Pairs are few, so that arcs are missing and cells are not reached.
    train, dev = t.filter("doc_id < 3"), t.filter("doc_id >= 3")
    e = L.vocab_counts(train, ["form", "tag"]).cache()
    ends, types = L.ending_index(e), L.type_counts(e)
    m = TA.tag_model(L.transition_counts(train).filter("prev < 'P' AND next <> 'V'"), L.case_counts(train))
    forms = dev.select("form").distinct()
    tried = [{**TA.DEFAULTS, **x} for x in ({}, {"factor": 3.0}, {"smooth": 9.0}, {"endlen": 1, "endretry": 0}, {"endretry": 3, "ending_decay_base": 0.1}, {"epsilon": 0.5}, {"beam": 1, "threshold": 0.4})]
    stored = TA.sentences(dev, LU.evidence(forms, e, ends)).cache()
    prior = {r["tag"]: float(r["n_types"]) for r in types.collect()}
    want = []
    for s in tried:
        cells = LU.candidate_lattice(forms, e, ends, types, s["endlen"], s["endretry"], s["ending_decay_base"])
        tagged = TA.viterbi_tag(dev, cells, m, TA.Settings(**{k: v for k, v in s.items() if not k.startswith("end")}), carry=("tag",))
        want.append(tagged.agg(F.avg((F.col("pred") == F.col("tag")).cast("int"))).first()[0])
    assert TA.accuracies(stored, m, prior, tried) == want and len(set(want)) > 1
    monkeypatch.setattr(TA, "TOGETHER", 20)
    monkeypatch.setattr(TA, "DENSE_TAGS", 2)
    assert TA.accuracies(stored, m, prior, tried) == want


def test_sentences_are_tagged_together_as_one_by_one():
    import random

    import numpy as np

    rnd = random.Random(5)
    tags = ["A", "A.B", "B", "C", "D"]
    m = TA.TagModel({"A": {"B": 3, "A": 3}, "B": {"A": 1, "C": 3, "D": 2}, "C": {"A": 1}}, {"A": {"ll": 2, "UU": 1}, "C": {"Ul": 3}})
    for s in (TA.Settings(), TA.Settings(factor=1.2, smooth=0.01), TA.Settings(epsilon=0.3, case_min=0.7)):
        many = [[({t: rnd.choice([0.25, 0.5, 1e-12]) for t in rnd.sample(tags, rnd.randint(1, 4))}, rnd.choice(TA.CASES)) for _ in range(rnd.randint(1, 12))] for _ in range(400)]
        flat, lengths = [c for x in many for c in x], np.array([len(x) for x in many])
        tag, p = np.full((len(flat), 4), -1), np.zeros((len(flat), 4))
        for i, (cell, _) in enumerate(flat):
            for j, t in enumerate(sorted(cell)):
                tag[i, j], p[i, j] = tags.index(t), cell[t]
        at = TA.viterbi_together(np.cumsum(lengths) - lengths, lengths, tag, p, np.array([TA.CASES.index(c) for _, c in flat]), *TA.square(m, s, tags), s.epsilon)
        assert [tags[k] for k in tag[np.arange(len(flat)), at]] == [t for x in many for t in TA.viterbi(x, m, s)]


def test_a_setting_takes_one_job():
    """``ahead`` gets all values of a setting before the first is asked for."""
    jobs, known = [], set()

    def ahead(tried):
        jobs.append(len(tried))
        known.update(map(str, tried))

    def score(s):
        assert str(s) in known
        return -abs(s["a"] - 3) - abs(s["b"] - 2)

    assert TA.finetune(score, {"a": 1, "b": 1}, {"a": [1, 2, 3], "b": [1, 2, 3]}, ahead=ahead) == ({"a": 3, "b": 2}, 0, 5) and jobs == [1, 2, 2]
    assert TA.finetune(score, {"a": 1, "b": 1}, {"a": [1, 2, 3], "b": [1, 2, 3]}, most=2)[2] == 2


def test_transitions_of_the_pseudo_tags_need_no_neighbours_row(spark, data):
    from tagloom.operators import lexicon as L
    from tagloom.plans import corpus

    want = sorted(map(tuple, L.transition_counts(corpus.gold(spark, data)).collect()))
    got = corpus.gold_transitions(corpus.tokens(spark, data))
    assert sorted(map(tuple, got.collect())) == want
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
