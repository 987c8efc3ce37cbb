"""Language detection by character trigrams, trained on labelled texts.

Trigrams are counted inside a text's row: what leaves a task of the training is a count for each
language and trigram, of the ranking a score for each text and language.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 300
#: Texts that are worked on at once, and their characters.
ROWS, CHARS = 512, 1 << 22


def letters(text: str = "text"):
    """The whole text in lower case, letters only, words padded."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}]+", " "), F.lit(" "))


def _codes(t: str) -> np.ndarray:
    """A number for each trigram of ``t``, 21 bits a character; a text of two characters is one."""
    c = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64)
    if len(c) < 3:
        c = np.concatenate([c, np.zeros(3 - len(c), np.int64)])
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:]


def _gram(code: int) -> str:
    return "".join(chr(x) for x in (code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF) if x)


def _slots(known: np.ndarray, bits: int = 18):
    """A multiplier and a table that give the place of each of ``known`` (sorted numbers) without a search: no two share a
    slot. None if there are too many for that."""
    keys = known.astype(np.uint64)
    if not 0 < len(keys) <= 1 << bits - 7:
        return None
    for m in range(0x9E3779B97F4A7C15, 0x9E3779B97F4A7C15 + (400 << 33), (1 << 33) + 2):
        at = keys * np.uint64(m) >> np.uint64(64 - bits)
        if len(np.unique(at)) == len(keys):
            table = np.zeros(1 << bits, np.int32)
            table[at] = np.arange(len(keys))
            return np.uint64(m), np.uint64(64 - bits), table
    return None


def _found(codes: np.ndarray, known: np.ndarray, slots) -> np.ndarray:
    """How often each of ``known`` is in ``codes``; nothing is sorted."""
    if slots is None:
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    else:
        m, shift, table = slots
        at = table[codes.view(np.uint64) * m >> shift]
    return np.bincount(at[known[at] == codes], minlength=len(known))


def trigram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, gram, n; a text that is null counts as one null trigram."""

    def run(batches):
        def counted(held):
            rows = []
            for name, found in held.items():
                texts = [t for t in found if t is not None]
                if len(texts) < len(found):
                    rows.append((name, None, len(found) - len(texts)))
                if texts:
                    codes, n = np.unique(np.concatenate([_codes(t) for t in texts]), return_counts=True)
                    rows += [(name, _gram(c), k) for c, k in zip(codes.tolist(), n.tolist())]
            columns = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["lang", "gram", "n"])

        held, size = {}, 0
        for b in batches:
            for name, t in zip(b.column("lang").to_pylist(), b.column("t")):
                t = t.as_py()
                held.setdefault(name, []).append(t)
                size += len(t or "") + 1
                if size >= CHARS:
                    yield counted(held)
                    held, size = {}, 0
        if held:
            yield counted(held)

    out = docs.select(F.col(lang).alias("lang"), letters(text).alias("t")).mapInArrow(run, "lang string, gram string, n bigint")
    return out.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(counts: DataFrame, size: int = PROFILE) -> DataFrame:
    """lang, gram, p: shares of the ``size`` most frequent trigrams of each language."""
    w = Window.partitionBy("lang")
    r = counts.withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), F.asc_nulls_last("gram")))).filter(F.col("r") <= size)
    return r.select("lang", "gram", (F.col("n") / F.sum("n").over(w)).alias("p"))


def language_topk(docs: DataFrame, profile: DataFrame, text: str = "text", k: int = 3) -> DataFrame:
    """doc_id, rank, lang, score: languages by the weight of a text's trigrams in their profiles.

    The profiles, ``PROFILE`` rows a language, are collected when this is built.
    """
    rows = [r for r in profile.collect() if r["gram"] is not None]
    langs = list(dict.fromkeys(r["lang"] for r in rows))
    place = {name: i for i, name in enumerate(langs)}
    code = [int(_codes(r["gram"])[0]) for r in rows]
    known = np.unique(np.array(code, np.int64))
    share = [(int(np.searchsorted(known, c)), place[r["lang"]], r["p"]) for c, r in zip(code, rows)]
    shared = docs.sparkSession.sparkContext.broadcast((langs, known.tolist(), share))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        langs, known, share = shared.value
        known = np.array(known, np.int64)
        weight = np.zeros((len(known), len(langs)))
        for i, j, p in share:
            weight[i, j] = p
        slots = _slots(known)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                b = batch.slice(start, ROWS)
                ids, found, scores = [], [], []
                for d, t in enumerate(b.column("t")):
                    t = t.as_py()
                    if t is None or not len(known):
                        continue
                    n = _found(_codes(t), known, slots)
                    seen = np.flatnonzero(n)
                    part = n[seen] @ weight[seen]
                    for j in np.flatnonzero(part):
                        ids.append(d)
                        found.append(langs[j])
                        scores.append(float(part[j]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang", "score"])

    s = docs.select("doc_id", letters(text).alias("t")).mapInArrow(run, f"doc_id {kind}, lang string, score double")
    s = s.groupBy("doc_id", "lang").agg(F.round(F.sum("score"), 9).alias("score"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), F.asc_nulls_last("lang"))
    return s.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def detect(docs: DataFrame, profile: DataFrame, text: str = "text", k: int = 1) -> DataFrame:
    """The ``k`` best languages of each document, from profiles learned elsewhere."""
    return language_topk(docs, profile, text, k)
