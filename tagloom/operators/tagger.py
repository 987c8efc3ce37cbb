"""Bigram HMM tagging: candidates come by joins, the Viterbi search runs per sentence.

Candidates are joined to tokens by form and each sentence is one row of arrays; no
sentence is split and no model is held in memory but the tag table: transitions and
case counts between tags, whose size the tag set bounds (checked against ``MAX_TAGS``).
"""
from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import form_case
from .lookup import SIZE

MAX_TAGS = 5000
#: Tags up to which all transitions are held as a square table.
DENSE_TAGS = 256
#: Tokens of whole sentences that are tagged at once.
TOGETHER = 200_000
CASES = ("UU", "Ul", "ll", "??")


@dataclass
class Settings:
    factor: float = 1.0
    smooth: float = 0.0
    epsilon: float = 1e-10
    case_min: float = 1e-3
    beam: int = 1000
    threshold: float = 1e-4
    fallback: float = 1e-6


#: Where the search for settings starts, and what it tries, in order.
DEFAULTS = {
    "factor": 1.0, "smooth": 0.0, "endlen": 6, "endretry": 2, "beam": 1000, "threshold": 1e-4, "epsilon": 1e-10,
    "fallback": 1e-6, "case_min": 1e-3, "ending_decay_base": 5.0,
}
SEARCH_SPACE = {
    "factor": [0.8, 1.0, 1.2], "smooth": [0.0, 0.001, 0.01], "endlen": [4, 5, 6, 7], "endretry": [1, 2, 3],
    "beam": [500, 1000, 2000], "threshold": [1e-5, 1e-4, 1e-3], "epsilon": [1e-12, 1e-10, 1e-8],
    "fallback": [1e-7, 1e-6, 1e-5], "case_min": [1e-4, 1e-3, 1e-2], "ending_decay_base": [3.0, 5.0, 7.0],
}


@dataclass
class TagModel:
    transitions: dict = field(default_factory=dict)  # prev -> next -> count
    cases: dict = field(default_factory=dict)  # tag -> case -> count
    starts: dict = field(default_factory=dict)
    memo: dict = field(default_factory=dict)  # weights of arcs and cases, as they are met; counts must not change then


def tag_model(transitions: DataFrame, cases: DataFrame | None = None, starts: DataFrame | None = None) -> TagModel:
    m = TagModel()
    limit = MAX_TAGS * MAX_TAGS + 1
    for r in transitions.limit(limit).toLocalIterator():
        m.transitions.setdefault(r["prev"], {})[r["next"]] = r["n"]
    if len(m.transitions) > MAX_TAGS:
        raise ValueError(f"more than {MAX_TAGS} tags: not a tag set")
    if cases is not None:
        for r in cases.limit(limit).toLocalIterator():
            m.cases.setdefault(r["tag"], {})[r["wcase"]] = r["n"]
    if starts is not None:
        m.starts = {r["tag"]: r["n"] for r in starts.limit(limit).toLocalIterator()}
    return m


def _arc(model: TagModel, s: Settings, prev: str, tag: str, log_space: bool):
    """What a transition weighs: a logarithm, or in linear space one number; () where there is no arc."""
    row, into = model.transitions.get(prev.rpartition(".")[2] or prev, {}), tag.partition(".")[0] or tag
    if log_space:
        return math.log(max(row.get(into, 0) / (sum(row.values()) or 1), 1e-6))
    c = row.get(into, 0) + s.smooth
    return (c**s.factor,) if c > 0 else ()


def viterbi(lattice, model: TagModel, s: Settings, log_space: bool = False):
    """The best tag of each cell; ``lattice`` has ({tag: p}, case) for each token.

    Linear space: a transition weighs (count + smooth) ** factor; none at all with
    smooth 0 removes the arc, and a cell that no arc reaches starts anew from the
    best state before. Log space: transitions are shares of their row, 1e-6 if
    unseen, and start counts weigh the first cell. Once ``beam`` tags of a cell are in,
    candidates under ``threshold`` are skipped. Tags of contractions (parts joined by
    ``.``) follow by their last part and are followed by their first. Ties go to the tag
    first by name.
    """
    arcs, weights = model.memo.setdefault((log_space, s.factor, s.smooth, s.case_min), ({}, {}))
    back, scores = [], {}
    for i, (cell, case) in enumerate(lattice):
        fresh, links = {}, {}
        for tag in sorted(cell):
            if len(fresh) >= s.beam and cell[tag] < s.threshold:
                continue
            p = max(cell[tag], s.epsilon)
            if not i:
                if log_space:
                    total = sum(model.starts.values()) or 1
                    fresh[tag] = math.log(p) + math.log(max(model.starts.get(tag, 0) / total, 1e-6))
                else:
                    fresh[tag] = p
                continue
            best, link = None, None
            if log_space:
                p = math.log(p)
            elif (weight := weights.get((tag, case))) is None:
                seen = model.cases.get(tag)
                weight = weights[tag, case] = max(seen[case] / sum(seen.values()), s.case_min) if seen and case in seen else 1.0
            for prev, q in scores.items():
                if (arc := arcs.get((prev, tag))) is None:
                    arc = arcs[prev, tag] = _arc(model, s, prev, tag, log_space)
                if log_space:
                    v = q + p + arc
                elif not arc:
                    continue
                else:
                    v = q * p * arc[0] * weight
                if best is None or v > best or v == best and prev < link:
                    best, link = v, prev
            if best is not None:
                fresh[tag], links[tag] = best, link
        if i and not fresh:  # dead end
            link = max(sorted(scores), key=scores.__getitem__)
            fresh = {t: max(cell[t], s.epsilon) for t in cell}
            links = dict.fromkeys(cell, link)
        if not log_space:
            top = max(fresh.values())
            fresh = {t: v / top for t, v in fresh.items()}
        back.append(links)
        scores = fresh
    if not scores:
        return []
    tag = max(sorted(scores), key=scores.__getitem__)
    out = [tag]
    for links in reversed(back[1:]):
        tag = links[tag]
        out.append(tag)
    return out[::-1]


def viterbi_tag(
    tokens: DataFrame, candidates: DataFrame, model: TagModel, settings: Settings | None = None, log_space: bool = False,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, sent_ord, tok_ord, form, the columns ``carry``, pred. ``--`` tokens get none and cut
    the sequence; forms without candidates are ``<unknown>``."""
    s = settings or Settings()
    cells = candidates.groupBy("form").agg(F.map_from_entries(F.collect_list(F.struct("tag", "p"))).alias("cell"))
    t = tokens.select("doc_id", "sent_ord", "tok_ord", "form", *carry, form_case("form").alias("wcase")).join(cells, "form", "left")
    g = t.groupBy("doc_id", "sent_ord").agg(F.array_sort(F.collect_list(F.struct("tok_ord", "form", *carry, "wcase", F.map_entries("cell").alias("cell")))).alias("ts"))
    # Plain objects of a bounded tag set: workers need not have this package.
    shared = tokens.sparkSession.sparkContext.broadcast((model.transitions, model.cases, model.starts, asdict(s)))
    names = ["doc_id", "sent_ord", "tok_ord", "form", *carry, "pred"]

    def run(frames):
        transitions, cases, starts, st = shared.value
        m, st = TagModel(transitions, cases, starts), Settings(**st)
        for f in frames:
            rows = []
            for r in f.itertuples():
                part: list = []
                done: list = []
                for x in [*r.ts, None]:
                    if x is None or x["form"] == "--":
                        tags = viterbi([c for _, c in part], m, st, log_space)
                        done += [(*(y[c] for c in names[2:-1]), tag) for (y, _), tag in zip(part, tags)]
                        if x is not None:
                            done.append((*(x[c] for c in names[2:-1]), None))
                        part = []
                    else:
                        cell = {e["key"]: e["value"] for e in x["cell"]} if x["cell"] is not None else {"<unknown>": st.fallback}
                        part.append((x, (cell, x["wcase"])))
                rows += [(r.doc_id, r.sent_ord, *d) for d in done]
            yield pd.DataFrame(rows, columns=names)

    kinds = {c: tokens.schema[c].dataType.simpleString() for c in names[:-1]} | {"pred": "string"}
    return g.mapInPandas(run, ", ".join(f"`{c}` {k}" for c, k in kinds.items()))


def update_tokens(tokens: DataFrame, tagged: DataFrame, overwrite: bool = False) -> DataFrame:
    """tokens with pred written to ``tag``: always, or only where there is none."""
    return write_pred(tokens.join(tagged.select("doc_id", "sent_ord", "tok_ord", "pred"), ["doc_id", "sent_ord", "tok_ord"], "left"), overwrite)


def write_pred(tagged: DataFrame, overwrite: bool = False) -> DataFrame:
    """As ``update_tokens``, for tokens that have ``tag`` beside ``pred``: where the tagger carried it, nothing is joined."""
    own = F.when(F.coalesce(F.col("tag"), F.lit("")).isin("", "_"), None).otherwise(F.col("tag"))
    return tagged.withColumn("tag", F.coalesce("pred", "tag") if overwrite else F.coalesce(own, "pred")).drop("pred")


def sentences(tokens: DataFrame, cells: DataFrame) -> DataFrame:
    """ts: a row for each sentence, with what ``accuracies`` needs of its tokens: whether it cuts, tag, case and ``evidence``."""
    t = tokens.select("doc_id", "sent_ord", "tok_ord", "form", "tag").join(cells, "form", "left")
    token = F.struct("tok_ord", (F.col("form") == "--").alias("cut"), "tag", form_case("form").alias("wcase"), "cell")
    return t.groupBy("doc_id", "sent_ord").agg(F.array_sort(F.collect_list(token)).alias("ts")).select("ts")


def weighed(token, size, tag, w, n: int, types, s: dict):
    """token, tag, p of the candidates of ``n`` tokens, by token and tag, from the entries of their ``evidence``
    (``tag`` a number) and ``types``, an array of a weight for each tag (0: none): as ``candidate_lattice`` weighs them."""
    exact = size == 0
    ending = ~exact & (size <= s["endlen"])
    t, k = token[ending], size[ending]
    new = np.append(True, (t[1:] != t[:-1]) | (k[1:] != k[:-1]))[: len(t)]  # a suffix of a token, the longest first
    at = np.cumsum(new)
    first = np.append(True, t[1:] != t[:-1])[: len(t)]
    rank = at - at[np.flatnonzero(first)[np.cumsum(first) - 1]] + 1 if len(t) else at
    kept = rank <= s["endretry"] + 1
    key, inverse = np.unique(t[kept] * len(types) + tag[ending][kept], return_inverse=True)
    weight = np.bincount(inverse, w[ending][kept] * np.power(float(s["ending_decay_base"]), -rank[kept].astype(float)), len(key))
    found = np.zeros(n, bool)
    found[token[exact]] = found[t] = True
    rest, prior = np.flatnonzero(~found), np.flatnonzero(types)
    key = np.concatenate([token[exact] * len(types) + tag[exact], key, (rest[:, None] * len(types) + prior).ravel()])
    weight = np.concatenate([w[exact], weight, np.tile(types[prior], len(rest))])
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    token, tag = key // len(types), key % len(types)
    return token, tag, weight / np.bincount(token, weight, n)[token]


def square(model: TagModel, s: Settings, tags: list[str]):
    """arcs[prev, tag], -inf where there is none, and weights[tag, case]: what ``viterbi`` weighs in linear space."""
    arcs = np.array([[(*_arc(model, s, a, b, False), -np.inf)[0] for b in tags] for a in tags]).reshape(len(tags), len(tags))
    weights = np.ones((len(tags), len(CASES)))
    for i, t in enumerate(tags):
        for j, case in enumerate(CASES):
            if case in (seen := model.cases.get(t) or {}):
                weights[i, j] = max(seen[case] / sum(seen.values()), s.case_min)
    return arcs, weights


def viterbi_together(starts, lengths, tag, p, case, arcs, weights, epsilon: float):
    """Place of the best candidate of each token, as ``viterbi`` finds it in linear space with a beam that nothing reaches.

    All sequences go one token further at once. ``tag`` and ``p`` have a row for each token, with its candidates by name
    (-1 fills up); sequence i is the tokens from ``starts[i]``.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    out = np.zeros(len(tag), np.int64)
    back, q, before = [], None, None
    most = np.maximum(p, epsilon)
    most[tag < 0] = -np.inf
    for i in range(lengths[0] if len(lengths) else 0):
        at = starts[: np.searchsorted(-lengths, -i)] + i
        here, fresh = tag[at], most[at]
        if i:
            q, before = q[: len(at)], before[: len(at)]
            arc = arcs[before[:, :, None], here[:, None, :]]
            with np.errstate(invalid="ignore"):
                v = q[:, :, None] * fresh[:, None, :] * np.maximum(arc, 0) * weights[here, case[at][:, None]][:, None, :]
            v[(arc < 0) | (q[:, :, None] < 0) | (here < 0)[:, None, :]] = -np.inf
            link = v.argmax(1)
            best = np.take_along_axis(v, link[:, None, :], 1)[:, 0, :]
            dead = (best < 0).all(1)
            link[dead] = q[dead].argmax(1)[:, None]
            fresh = np.where(dead[:, None], fresh, best)
            back.append(link)
        q, before = fresh / fresh.max(1)[:, None], here
        last = q.argmax(1)
        out[at] = last
    for i in range(len(back), 0, -1):
        at = starts[: np.searchsorted(-lengths, -i)] + i
        out[at - 1] = np.take_along_axis(back[i - 1], out[at][:, None], 1)[:, 0]
    return out


def weighed_cells(cell, known, model: TagModel, types: dict[str, float], s: dict):
    """Names of all tags, and of each form's candidates the tag and p, a row for each place: by name, -1 fills up.
    ``cell`` has the evidence of each form as ``lookup.evidence_in_row`` has it, with places in ``known`` for tags; a form
    without candidates is ``<unknown>``."""
    entries, n = cell.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2), len(cell)
    tags = sorted({"<unknown>", *known, *types, *model.transitions, *(t for r in model.transitions.values() for t in r), *model.cases})
    token = np.repeat(np.arange(n), pc.list_value_length(cell).to_numpy(zero_copy_only=False) // 2)
    size, number = np.divmod(entries[:, 0].astype(np.int64), SIZE)
    number = np.array([tags.index(t) for t in known])[number]
    t, c, share = weighed(token, size, number, np.ascontiguousarray(entries[:, 1]), n, np.array([types.get(x, 0.0) for x in tags]), s)
    count = np.bincount(t, minlength=n)
    place = np.arange(len(t)) - np.repeat(np.cumsum(count) - count, count)
    tag, p = np.full((max(count.max(initial=0), 1), n), -1), np.zeros((max(count.max(initial=0), 1), n))
    tag[place, t], p[place, t] = c, share
    tag[0, count == 0], p[0, count == 0] = tags.index("<unknown>"), s["fallback"]
    return tags, tag, p


def best_tags(codes, new, cuts, tags: list[str], tag, p, case, model: TagModel, s: dict):
    """The tag of each token, a place in ``tags``, as ``viterbi`` finds it in linear space; -1 for forms that ``cuts`` has.

    ``codes`` are the forms of the tokens, ``new`` marks the first of each sentence; ``tag`` and ``p`` have a row for each place
    among a form's candidates, ``case`` is by form. After a cell of one candidate, what came before no longer matters: its
    score is 1. So sequences are cut at such cells, which end one and begin the next, and all go on at once. Those of two
    candidates at most, nearly all, go apart from the others.
    """
    st, n = Settings(**{k: v for k, v in s.items() if k in Settings.__dataclass_fields__}), len(codes)
    shut = cuts[codes]
    begins = ~shut & (new | np.append(False, shut[:-1])[:n])
    size = (tag >= 0).sum(0)
    one = (size == 1)[codes] & ~shut
    out = np.zeros(n, np.int8)
    if len(tags) > DENSE_TAGS or len(tag) >= st.beam or st.epsilon <= 0:  # too many tags for a table, or a beam that may prune: one by one
        heads = np.flatnonzero(begins)
        for i, j in zip(heads.tolist(), np.append(heads[1:], n).tolist()):
            part = codes[i:j][~shut[i:j]]
            cells = [{tags[k]: w for k, w in zip(tag[:, f].tolist(), p[:, f].tolist()) if k >= 0} for f in part.tolist()]
            found = viterbi([(c, CASES[case[f]]) for c, f in zip(cells, part.tolist())], model, st)
            out[i : i + len(part)] = [sorted(c).index(t) for c, t in zip(cells, found)]
    else:
        arcs, weights = square(model, st, tags)
        arcs = np.pad(np.maximum(arcs, 0), (0, 1)).ravel()  # 0: none
        most = np.where(tag < 0, 0, np.maximum(p, st.epsilon))
        weight = weights[np.maximum(tag, 0), case]
        known = np.where(tag < 0, len(tags), tag)
        heads = np.flatnonzero(begins | one)
        after = np.append(heads[1:], n)
        gone = np.append(0, np.cumsum(shut))
        lengths = after - heads - (gone[after] - gone[heads])
        single = one[heads]
        joined = np.append(~begins[heads[1:]], False)[: len(heads)]  # the next head ends this sequence too
        lengths = lengths + joined
        run = (lengths - joined > 1) | ~single
        heads, lengths = heads[run], lengths[run]
        many = np.append(0, np.cumsum((size > 2)[codes] & ~shut))
        wide = many[heads + lengths] > many[heads]
        _forward(codes, heads[~wide], lengths[~wide], known[:2], most[:2], weight[:2], arcs, len(tags) + 1, out)
        _forward(codes, heads[wide], lengths[wide], known, most, weight, arcs, len(tags) + 1, out)
    best = tag[out, codes] if n else np.zeros(0, np.int64)
    best[shut] = -1
    return best


def _forward(codes, starts, lengths, tag, most, weight, arcs, row: int, out):
    """Writes to ``out`` the place of the best candidate of each token of the sequences from ``starts``. A score of 0: no
    arc reaches the candidate, or there is none."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    down, wide, back = -lengths, len(tag), []
    q = before = None
    for i in range(lengths[0] if len(lengths) else 0):
        at = starts[: np.searchsorted(down, -i)] + i
        form = codes[at]
        here = [t[form] for t in tag]
        fresh = [m[form] for m in most]
        if i:
            count = len(at)
            from_ = [b[:count] * row for b in before]
            q = [x[:count] for x in q]
            best, links = [], []
            for j in range(wide):
                w, top, link = weight[j][form], None, None
                for k in range(wide):
                    v = q[k] * fresh[j]
                    v *= arcs[from_[k] + here[j]]
                    v *= w
                    if k:
                        more = v > top
                        link = more.astype(np.int8) if k == 1 else np.where(more, np.int8(k), link)
                        top = np.maximum(v, top)
                    else:
                        top, link = v, np.zeros(count, np.int8)
                best.append(top)
                links.append(link)
            dead = best[0] == 0
            for x in best[1:]:
                dead &= x == 0
            if dead.any():
                ahead = np.array([x[dead] for x in q]).argmax(0)
                for j in range(wide):
                    links[j][dead] = ahead
                    best[j][dead] = fresh[j][dead]
            back.append(links)
            fresh = best
        top, last = fresh[0], np.zeros(len(at), np.int8)
        for k in range(1, wide):
            last[fresh[k] > top] = k
            top = np.maximum(top, fresh[k])
        q, before = [x / top for x in fresh], here
        out[at] = last
    for i in range(len(back), 0, -1):
        at = starts[: np.searchsorted(down, -i)] + i
        links, last = back[i - 1], out[at]
        link = links[0]
        for j in range(1, wide):
            link = np.where(last == j, links[j], link)
        out[at - 1] = link


def accuracies(rows: DataFrame, model: TagModel, types: dict[str, float], tried: list[dict]) -> list[float]:
    """The share of right tags for each of the settings ``tried`` (all of ``DEFAULTS``), in one job over ``sentences``."""
    names = sorted({*types, *model.transitions, *(t for r in model.transitions.values() for t in r), *model.cases})
    shared = rows.sparkSession.sparkContext.broadcast((model.transitions, model.cases, names, types, tried))

    def parts(batches):
        for b in batches:
            ts = b.column("ts")
            of = pc.list_value_length(ts).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff((np.cumsum(of) - of) // TOGETHER, prepend=-1)).tolist() + [len(ts)]
            yield from (ts.slice(i, j - i) for i, j in zip(edges[:-1], edges[1:]))

    def run(batches):
        transitions, cases, names, types, tried = shared.value
        m = TagModel(transitions, cases)
        tables: dict = {}
        for ts in parts(batches):
            toks = ts.flatten()
            n, of = len(toks), pc.list_value_length(ts).to_numpy(zero_copy_only=False)
            cut, gold, case, cell = (toks.field(c) for c in ("cut", "tag", "wcase", "cell"))
            entries = cell.flatten()
            tags = sorted({*names, *pc.unique(entries.field("tag")).to_pylist(), *(x for x in pc.unique(gold).to_pylist() if x is not None)})
            number = lambda c, known: pc.fill_null(pc.index_in(c, pa.array(known, pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            prior = np.array([types.get(t, 0.0) for t in tags])
            token = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(cell), 0).to_numpy(zero_copy_only=False))
            entry = token, entries.field("size").to_numpy(zero_copy_only=False), number(entries.field("tag"), tags), entries.field("w").to_numpy(zero_copy_only=False)
            gold, case, cut = number(gold, tags), number(case, list(CASES)), pc.fill_null(cut, False).to_numpy(zero_copy_only=False)
            sent = np.repeat(np.arange(len(of)), of)
            new = ~cut & (np.append(True, (sent[1:] != sent[:-1]) | cut[:-1])[:n])
            starts = np.flatnonzero(new)
            lengths = np.bincount(np.cumsum(new)[~cut] - 1, minlength=len(starts))
            counts, lattices = [], {}
            for s in tried:
                key = (s["endlen"], s["endretry"], s["ending_decay_base"])
                if key not in lattices:
                    t, c, share = weighed(*entry, n, prior, s)
                    count = np.bincount(t, minlength=n)
                    column = np.arange(len(t)) - np.repeat(np.cumsum(count) - count, count)
                    tag, p = np.full((n, max(count.max(initial=0), 1)), -1), np.zeros((n, max(count.max(initial=0), 1)))
                    tag[t, column], p[t, column] = c, share
                    lattices[key] = tag, p
                tag, p = lattices[key]
                st = Settings(**{k: v for k, v in s.items() if not k.startswith("end")})
                if len(tags) <= DENSE_TAGS and tag.shape[1] < st.beam:
                    at = (tuple(tags), st.factor, st.smooth, st.case_min)
                    if at not in tables:
                        tables[at] = square(m, st, tags)
                    got = tag[np.arange(n), viterbi_together(starts, lengths, tag, p, case, *tables[at], st.epsilon)] if n else gold
                else:  # too many tags for tables, or a beam that may prune: one by one
                    got = np.full(n, -1)
                    for i, k in zip(starts.tolist(), lengths.tolist()):
                        cells = [({tags[x]: y for x, y in zip(tag[j].tolist(), p[j].tolist()) if x >= 0}, CASES[case[j]]) for j in range(i, i + k)]
                        got[i : i + k] = [tags.index(x) for x in viterbi(cells, m, st)]
                counts.append(int((got == gold)[~cut & (gold >= 0)].sum()))
            yield pa.RecordBatch.from_arrays([pa.array([counts], pa.list_(pa.int64())), pa.array([int((~cut & (gold >= 0)).sum())], pa.int64())], ["hits", "n"])

    found = rows.mapInArrow(run, "hits array<bigint>, n bigint")
    r = found.agg(F.sum("n").alias("n"), *[F.sum(F.col("hits")[i]).alias(f"h{i}") for i in range(len(tried))]).first()
    return [r[f"h{i}"] / r["n"] if r["n"] else 0.0 for i in range(len(tried))]


def finetune(evaluate, start: dict, space: dict, most: int = 200, ahead=None) -> tuple[dict, float, int]:
    """Coordinate search: each setting in turn takes the value of best ``evaluate`` (a function of
    the settings), in one pass over ``space`` and at most ``most`` calls. ``endlen`` never gets smaller;
    of equal values the first stays. ``ahead`` gets what ``evaluate`` will be called with for a setting:
    values of one setting don't depend on each other, so one job can do for all."""
    best, calls = dict(start), 1
    if ahead:
        ahead([best])
    score = evaluate(best)
    for name, values in space.items():
        was = best[name]
        tried = [{**best, name: v} for v in values if v != was and not (name == "endlen" and v < was)][: max(most - calls, 0)]
        if ahead and tried:
            ahead(tried)
        for s in tried:
            calls += 1
            if (got := evaluate(s)) > score:
                best, score = s, got
    return best, score, calls


def softmax_argmax(scores: DataFrame) -> DataFrame:
    """doc_id, tok_ord, label, p of (doc_id, tok_ord, subword, label, score): the best label
    of each token's first subword and its softmax share."""
    first = scores.filter("subword = 0")
    g = first.groupBy("doc_id", "tok_ord").agg(F.max_by("label", F.struct("score", "label")).alias("label"), F.max("score").alias("top"), F.collect_list("score").alias("all"))
    total = F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    return g.select("doc_id", "tok_ord", "label", (1 / total).alias("p"))
