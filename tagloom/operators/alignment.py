"""Alignment of gold and predicted tokens: greedy, one document at a time."""
from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_form

PAIRS = "doc_id bigint, g_pos bigint, p_pos bigint, score int"


def _numbered(tokens: DataFrame, side: str) -> DataFrame:
    kept = tokens.select("doc_id", "sent_ord", "tok_ord", "form", normalize_form("form").alias("norm"), *(["tokid"] if "tokid" in tokens.columns else [F.lit(None).cast("string").alias("tokid")]))
    return kept.withColumn("side", F.lit(side))


def align_gold_pred(gold: DataFrame, pred: DataFrame, max_distance: int = 10, prefer_tokids: bool = True) -> DataFrame:
    """doc_id, g_pos, p_pos (null: no partner), score; positions count a document's tokens.

    Three stages, in gold order, each predicted token used once: equal token ids
    (1000 in the same sentence; else 100 for equal, 50 for contained forms); equal
    normalised forms in the same sentence within ``max_distance`` places, the
    nearest first; the nearest unused equal form within twice that distance.
    """

    def run(key, g: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        g, p = (x.sort_values(["sent_ord", "tok_ord"]).reset_index(drop=True) for x in (g, p))
        used, match = set(), {}
        gs, ps = list(g.itertuples()), list(p.itertuples())
        if prefer_tokids:
            ids: dict[str, list[int]] = {}
            for j, t in enumerate(ps):
                if t.tokid:
                    ids.setdefault(t.tokid, []).append(j)
            for i, t in enumerate(gs):
                for j in ids.get(t.tokid, ()) if t.tokid else ():
                    if j not in used:
                        o = ps[j]
                        s = 1000 if o.sent_ord == t.sent_ord else 100 if o.norm == t.norm else 50 if t.norm in o.norm or o.norm in t.norm else 0
                        if s:
                            used.add(j)
                            match[i] = (j, s)
                            break
        places: dict[tuple, list[int]] = {}
        forms: dict[str, list[int]] = {}
        for j, t in enumerate(ps):
            places.setdefault((t.sent_ord, t.norm), []).append(j)
            forms.setdefault(t.norm, []).append(j)
        for same_sentence, limit in ((True, max_distance), (False, 2 * max_distance)):
            for i, t in enumerate(gs):
                if i in match:
                    continue
                options = places.get((t.sent_ord, t.norm), ()) if same_sentence else forms.get(t.norm, ())
                at = (lambda j: abs(ps[j].tok_ord - t.tok_ord)) if same_sentence else (lambda j: abs(j - i))
                best = min((j for j in options if j not in used and at(j) <= limit), key=lambda j: (at(j), j), default=None)
                if best is not None:
                    used.add(best)
                    match[i] = (best, 1000 - at(best) + 100 if same_sentence else 1000 - at(best))
        doc = int(key[0])
        return pd.DataFrame(
            {"doc_id": [doc] * len(gs), "g_pos": range(len(gs)), "p_pos": pd.array([match.get(i, (None, 0))[0] for i in range(len(gs))], "Int64"), "score": [match.get(i, (None, 0))[1] for i in range(len(gs))]}
        ).astype({"score": "int32"})

    return _numbered(gold, "g").groupBy("doc_id").cogroup(_numbered(pred, "p").groupBy("doc_id")).applyInPandas(run, PAIRS)


def sequence_align(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """doc_id, sent_ord, g_pos, p_pos: matching blocks of the two token sequences of each sentence."""
    seq = lambda t, name: t.groupBy("doc_id", "sent_ord").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("tok_ord", normalize_form("form").alias("f")))), lambda x: x["f"]).alias(name)
    )
    both = seq(gold, "g").join(seq(pred, "p"), ["doc_id", "sent_ord"])

    def run(frames):
        for f in frames:
            rows = []
            for r in f.itertuples():
                for a, b, n in SequenceMatcher(None, list(r.g), list(r.p), autojunk=False).get_matching_blocks():
                    rows += [(r.doc_id, r.sent_ord, a + k, b + k) for k in range(n)]
            yield pd.DataFrame(rows, columns=["doc_id", "sent_ord", "g_pos", "p_pos"])

    return both.mapInPandas(run, "doc_id bigint, sent_ord int, g_pos int, p_pos int")
