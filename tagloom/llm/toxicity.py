"""Toxicity: a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs and digit or symbol substitutions to the
letters they imitate, and turns what is no letter into spaces. The lexicon holds
beginnings of words (a whole word ends in a space) with log-odds weights learned
from labelled rows, and a few fixed words. Matches inside an exception phrase
don't count. Weights are summed, normalised by the length of the text, and a
small logistic model over these sums gives the score.

Learning uses a bounded sample of labelled training rows: at most ``max_pos``
toxic and ``max_neg`` other documents, chosen by a hash of the id. Part of it
gives the lexicon, the rest the logistic model, so neither sees its own rows.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_names, held_out_column, is_training, sliced, stored, table

MAX_POS, MAX_NEG = 2500, 5000
MAX_PATTERNS = 4000
#: Beginnings of words of up to so many letters are patterns of their own, besides whole words of any length.
MAX_PREFIX = 12
THRESHOLD = 0.3
#: Words that count without any labels, and phrases that excuse a match.
SEED_WORDS = ("idiot", "moron", "scum", "stupid", "pathetic", "worthless", "disgusting", "loser", "trash", "clown")
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "clown fish", "clown shoes", "pathetic fallacy", "idiot proof",
    "idiot board", "pond scum", "soap scum",
)
#: Homoglyphs (Cyrillic, Greek, others) and the letters they imitate.
HOMOGLYPHS = dict(
    zip(
        "аеорсухіјѕԁһкмтпгвАЕОРСУХІЈЅКМТВН" "αεορχικντυωΑΕΟΡΧΙΚΝΤΥΗΜΒΖ" "ıⅼɡɑοʟɪ",
        "aeopcyxijsdhkmtnrbaeopcyxijskmtbh" "aeopxikntuwaeopxikntyhmbz" "ilgaoli",
        strict=True,
    )
)
#: Digits that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
_SYMBOL = re.compile(r"[$@](?=[^\W\d_])")


def _fold_table() -> dict[int, str | None]:
    table_: dict[int, str | None] = {c: " " for c in range(0x80) if not chr(c).isalpha()}
    table_.update({ord(c): " " for c in "«»“”‘’–—…¿¡·•„‚   　"})
    table_.update({c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)})
    table_.update({0xFF41 + i: chr(0x61 + i) for i in range(26)})
    table_.update({ord(a): b for a, b in HOMOGLYPHS.items()})
    table_.update({ord(a): b for a, b in DIGITS.items()})
    return table_


_FOLD = _fold_table()


def folded(text: str) -> str:
    """Text as the lexicon sees it: a space before every word, letters folded."""
    t = text.lower()
    if "$" in t or "@" in t:
        t = _SYMBOL.sub(lambda m: "s" if m.group() == "$" else "a", t)
    return f" {t.translate(_FOLD)} "


@dataclass
class Model:
    #: pattern (a space, then the beginning of a word) -> weight
    lexicon: dict[str, float]
    #: coefficients over ``features``; None: no labels, then a fixed curve
    weights: list[float] | None


def _matcher(lexicon: dict[str, float], exceptions):
    import ahocorasick

    a = ahocorasick.Automaton()
    for p, w in lexicon.items():
        a.add_word(p, (len(p), w, p))
    for p in exceptions:
        p = f" {p}"
        a.add_word(p, (len(p), None, p))
    a.make_automaton()
    return a


def features(text: str | None, matcher) -> list[float]:
    """Summed, length-normalised and distinct weights of the matches of a text."""
    t = folded(text) if text else "  "
    best: dict[int, tuple[float, str]] = {}
    excused: list[tuple[int, int]] = []
    if len(matcher):
        for end, (size, w, p) in matcher.iter(t):
            start = end - size + 1
            if w is None:
                excused.append((start, end))
            elif (old := best.get(start)) is None or w > old[0]:
                best[start] = (w, p)
    for a, b in excused:
        for s in [s for s in best if a <= s <= b]:
            del best[s]
    length = max(1.0, len(t) / 100)
    ws = [w for w, _ in best.values()]
    total, strong = sum(ws), sum(w >= 2.5 for w in ws)
    kinds = dict((p, w) for w, p in best.values())
    distinct = sum(kinds.values())
    return [
        1.0, math.log1p(total), math.log1p(total / length), math.log1p(distinct), math.log1p(strong),
        math.log1p(strong / length), max(ws, default=0.0), math.log(length), math.log1p(distinct / length),
    ]


def _probability(f, weights) -> float:
    if weights is None:
        return 1.0 - math.exp(-f[2])
    z = sum(a * b for a, b in zip(f, weights, strict=True))
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "toxic",
    max_pos: int = MAX_POS,
    max_neg: int = MAX_NEG,
    max_patterns: int = MAX_PATTERNS,
) -> Model:
    """Learn lexicon and weights from training rows that have a label of 0 or 1."""
    seeds = {f" {w}": 3.0 for w in SEED_WORDS}
    marks = (
        labels.select(F.col(doc_id).alias("_i"), F.col(label).cast("int").alias("_y"))
        .filter(is_training("_i") & F.col("_y").isin(0, 1))
        .groupBy("_i")
        .agg(F.max("_y").alias("_y"))
    )
    n = {r._y: r["count"] for r in marks.groupBy("_y").count().collect()}
    if not n.get(1) or not n.get(0):
        return Model(seeds, None)
    unit = F.pmod(F.xxhash64("_i", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    rate = {0: min(1.0, max_neg / n[0]), 1: min(1.0, max_pos / n[1])}
    keep = F.when(F.col("_y") == 1, unit < rate[1]).otherwise(unit < rate[0])
    picked = marks.filter(keep).orderBy("_i").limit(2 * (max_pos + max_neg))
    # One text for each id, the least: at most 2 * (max_pos + max_neg) ids and rows; written once, then read thrice.
    sample = docs.select(F.col(doc_id).alias("_i"), F.col(text).cast("string").alias("_t")).join(F.broadcast(picked), "_i")
    sample = stored(sample.groupBy("_i", "_y").agg(F.min("_t").alias("_t")), "toxicity-sample")
    sample = sample.withColumn("_fold", F.pmod(F.xxhash64("_i", F.lit("fold")), F.lit(5)) < 3)

    def prefixes(batches):
        for b in sliced(batches):
            counts: dict[str, list[int]] = {}
            for t, y in zip(b.column("_t").to_pylist(), b.column("_y").to_pylist(), strict=True):
                found = set()
                for w in set(folded(t or "").split()):
                    found.add(f"{w} ")
                    found.update(w[:k] for k in range(3, len(w) + 1 if len(w) <= MAX_PREFIX else MAX_PREFIX + 1))
                for p in found:
                    counts.setdefault(p, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(counts), pa.string()),
                    pa.array([c[1] for c in counts.values()], pa.int64()),
                    pa.array([c[0] for c in counts.values()], pa.int64()),
                ],
                ["p", "pos", "neg"],
            )

    train = sample.filter("_fold").select("_t", "_y")
    sizes = {r._y: r["count"] for r in sample.filter("_fold").groupBy("_y").count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        return Model(seeds, None)
    grouped = train.mapInArrow(prefixes, "p string, pos bigint, neg bigint").groupBy("p")
    weight = F.log(((F.col("pos") + 0.5) / (n_pos + 1)) / ((F.col("neg") + 0.5) / (n_neg + 1)))
    strong = (
        grouped.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .filter(F.col("pos") >= max(3, n_pos // 250))
        .withColumn("w", weight)
        .filter("w >= 1.5")
        .orderBy(F.desc(F.col("pos") * F.col("w")), "p")
        .limit(max_patterns)
    )
    found = {r.p: (r.pos, r.w) for r in strong.collect()}
    longer = Counter()
    for p, (pos, _) in found.items():
        longer[p[:-1]] = max(longer[p[:-1]], pos)
    # A beginning goes where one more letter is supported as well: the longer one is surer.
    lexicon = seeds | {f" {p}": float(w) for p, (pos, w) in found.items() if longer[p] < 0.95 * pos}

    def measure(batches):
        m = _matcher(lexicon, EXCEPTIONS)
        for b in sliced(batches):
            rows = [features(t, m) for t in b.column("_t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_y"), pa.array(rows, pa.list_(pa.float64()))], ["y", "f"])

    rows = sample.filter("not _fold").select("_t", "_y").mapInArrow(measure, "y int, f array<double>")
    data = rows.collect()  # the sample's rows: as many as picked ids, unless ids repeat
    y = np.array([r.y for r in data], float)
    if not len(y) or y.min() == y.max():
        return Model(lexicon, None)
    return Model(lexicon, _logistic(np.array([r.f for r in data]), y, rate).tolist())


def _logistic(x: np.ndarray, y: np.ndarray, rate: dict[int, float]) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept puts the best F1 at THRESHOLD."""
    c = np.where(y == 1, 1 / rate[1], 1 / rate[0])
    c = c * len(c) / c.sum()
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 0.3)
    ridge[0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (c * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (c * (y - p)) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    z = x @ w
    order = np.argsort(-z)
    tp, fp = np.cumsum(y[order] * c[order]), np.cumsum((1 - y[order]) * c[order])
    f1 = 2 * tp / (tp + fp + (y * c).sum())
    k = int(f1.argmax())
    cut = (z[order][k] + (z[order][k + 1] if k + 1 < len(z) else z[order][k] - 1)) / 2
    w[0] += math.log(THRESHOLD / (1 - THRESHOLD)) - cut
    return w


def score_documents(
    docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), column: str = "score"
) -> DataFrame:
    """``keep`` and ``column``, the score (0 to 1) of every whole text.

    One row per row of ``docs``. Null and empty texts are scored as texts without
    matches; very long ones are folded and matched whole, in linear time. Equal texts
    have equal scores. Extra columns are ignored.
    """
    # At most max_patterns patterns, as plain objects: workers need not have this package.
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.weights))
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep) + f", `{column}` double"

    def run(batches):
        lexicon, weights = shared.value
        matcher = _matcher(lexicon, EXCEPTIONS)
        for b in sliced(batches):
            got = [_probability(features(t, matcher), weights) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(got, pa.float64())], [*keep, column])

    last = fresh_names(keep, ["toxicity_text"])["toxicity_text"]
    return docs.select(*keep, F.col(text).cast("string").alias(last)).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those of a score of ``threshold`` or more; all columns stay, whatever
    their names. Null and empty texts score as texts without matches; repeated rows are
    judged alike; empty tables give no rows."""
    name = fresh_names(docs.columns, ["toxicity"])["toxicity"]
    scored = score_documents(docs, model, text, tuple(docs.columns), name)
    return scored.filter(F.col(name) < threshold).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select(
        "doc_id",
        held_out_column().alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
