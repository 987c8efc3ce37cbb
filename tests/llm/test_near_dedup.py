"""The pipeline's near-duplicate stage against exact Jaccard similarity of all pairs."""
import random

import pytest

import corpus_pipeline
from tagloom.llm import near_dedup, simhash


def windows(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = windows(a), windows(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, text, edits):
    w = text.split()
    for i in rng.sample(range(len(w)), edits):
        w[i] = f"new{rng.randint(0, 10**9)}"
    return " ".join(w)


def brute(texts):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


@pytest.mark.parametrize("options", [{}, {"block": 3}, {"block": 3, "wide": 4}])
def test_components_equal_brute_force(spark, options):
    rng = random.Random(3)
    bases = [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([8, 120, 300]))) for _ in range(12)]
    texts = ["", None, "  ", "a b", "A  B", "same words here for five more", *bases]
    texts += [edited(rng, b, min(len(b.split()) // 40 + k, 8)) for b in bases for k in range(5)]
    want = brute(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = near_dedup.similar_documents(frame, **options).collect()
    groups, theirs = {}, {}
    for r in found:
        groups.setdefault(r.component, set()).add(r.id)
    for i, r in enumerate(want):
        theirs.setdefault(r, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, theirs.values()))
    assert any(1 < len(g) < len(texts) for g in theirs.values())


def test_stage_drops_what_four_bits_miss(spark, data):
    rng = random.Random(5)
    texts = []
    for _ in range(20):
        base = " ".join(f"w{rng.randint(0, 3000)}" for _ in range(200))
        copy = edited(rng, base, 4)
        assert 0.8 <= jaccard(base, copy) < 0.95
        texts += [base, copy]
    bits = [(simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() for a, b in zip(texts[::2], texts[1::2])]
    assert max(bits) > simhash.BITS
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, frame, data).collect()) == list(range(0, 40, 2))


def test_repeated_and_missing_ids(spark):
    rows = [(1, "one two three four five six"), (1, "other words stand in this row"), (1, "one two three four five six"), (None, "one two three four five six"), (2, "ONE two three four five six")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in near_dedup.drop_similar(frame).collect())
    assert got == [("1", rows[0][1]), ("1", rows[1][1]), ("None", rows[0][1])]
    assert near_dedup.drop_similar(frame.limit(0)).count() == 0


def test_fingerprints_alone_propose_copies_with_few_edits(spark, monkeypatch):
    """The SimHash method is a step of the stage: with no band at all it still finds what its radius holds."""
    rng = random.Random(7)
    texts = []
    for _ in range(12):
        base = " ".join(f"w{rng.randint(0, 3000)}" for _ in range(1500))
        texts += [base, edited(rng, base, 2)]
    close = [(simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).bit_count() <= simhash.BITS for a, b in zip(texts[::2], texts[1::2])]
    assert any(close)
    monkeypatch.setattr(near_dedup, "_candidate_edges", lambda cells: spark.createDataFrame([], "u bigint, v bigint, cell bigint"))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of = {r.id: r.component for r in near_dedup.similar_documents(frame).collect()}
    assert [of[2 * i] == of[2 * i + 1] for i in range(12)] == close
