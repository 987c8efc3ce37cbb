"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items form one automaton over word ids (no match crosses
items). The words of each document stream through it; after each word the
automaton gives the longest match that ends there. A document word is hit if it
lies in an occurrence of a window: ``window`` consecutive item words, or a whole
item of fewer words. Spans that exceed the length or coverage limits can be
removed from the text.

The items are read in blocks of at most ``block_words`` words, so that the
automaton that is broadcast has a proven bound: it is flat arrays of at most two
states a word. Each further block takes one more pass over the documents, written
to the shared folder before the next, so a task never holds two automata; the
spans of all blocks are merged.
"""
from __future__ import annotations

import re
from array import array
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, stored, table

WINDOW = 10
BLOCK_WORDS = 1_000_000
#: The bytes that are not part of a word, and A-Z folded to a-z.
_NOT_WORD = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
_FOLD = bytes(
    0x20 if b in set(_NOT_WORD) and not 0x41 <= b <= 0x5A else b + 0x20 if 0x41 <= b <= 0x5A else b
    for b in range(256)
)
_SPANS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normalised_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton of the items of one block, over word ids.

    Most states have one edge, kept in two arrays; only the others have a dict while
    the automaton grows. ``flat`` is what is shipped: plain arrays.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.word, self.to = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.names: list[str] = []
        ids = []
        for name, text in items:
            words = array("i", [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in normalised_words(text)])
            if words:
                self.names.append(name)
                ids.append(words)
                last = 0
                for w in words:
                    last = self._extend(last, w)
        #: (state, item, length): windows of that length that this state holds.
        self.marks: set[tuple[int, int, int]] = set()
        for k, words in enumerate(ids):
            self._mark(k, words, min(window, len(words)))
        self.shortest = min((min(window, len(w)) for w in ids), default=window)

    def _get(self, s: int, w: int) -> int:
        if self.word[s] == w:
            return self.to[s]
        edges = self.more.get(s)
        return edges.get(w, -1) if edges else -1

    def _set(self, s: int, w: int, t: int) -> None:
        if self.word[s] in (-1, w):
            self.word[s], self.to[s] = w, t
        else:
            self.more.setdefault(s, {})[w] = t

    def _state(self, length: int, link: int) -> int:
        for a, x in ((self.word, -1), (self.to, -1), (self.link, link), (self.length, length)):
            a.append(x)
        return len(self.link) - 1

    def _extend(self, last: int, w: int) -> int:
        q = self._get(last, w)
        if q >= 0:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        cur = self._state(self.length[last] + 1, 0)
        p = last
        while p >= 0 and (q := self._get(p, w)) < 0:
            self._set(p, w, cur)
            p = self.link[p]
        if p >= 0:
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q])
        self.word[copy], self.to[copy] = self.word[q], self.to[q]
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        self.link[q] = copy
        while p >= 0 and self._get(p, w) == q:
            self._set(p, w, copy)
            p = self.link[p]
        return copy

    def _mark(self, item: int, words: array, size: int) -> None:
        state = matched = 0
        for w in words:
            state = self._get(state, w)
            matched += 1
            while self.length[self.link[state]] >= size:
                state = self.link[state]
            if (matched := min(matched, self.length[state])) >= size:
                self.marks.add((state, item, size))

    def flat(self) -> tuple:
        """(vocabulary, names, shortest, root, branches, word, to, link, length, above, keys, targets,
        first mark, marks) as plain Python objects: ``root`` has the first state's edges, one for every
        word; where ``branches``, edges beyond a state's first are at ``keys`` = state << 32 | word;
        ``above`` is the nearest state on the link path, itself included, that holds a window."""
        edges = sorted((s << 32 | w, t) for s, e in self.more.items() if s for w, t in e.items())
        root = array("i", [self._get(0, w) for w in range(len(self.vocabulary))])
        branches = bytearray(len(self.link))
        for s in self.more:
            branches[s] = 1
        marks = sorted(self.marks)
        first = array("i", [0]) * (len(self.link) + 1)
        for s, _, _ in marks:
            first[s + 1] += 1
        for s in range(len(self.link)):
            first[s + 1] += first[s]
        above = array("i", [-1]) * len(self.link)
        for s in sorted(range(len(self.link)), key=self.length.__getitem__):
            up = self.link[s]
            above[s] = s if first[s + 1] > first[s] else above[up] if up >= 0 else -1
        held = array("i", [x for _, item, size in marks for x in (item, size)])
        return (
            self.vocabulary, self.names, self.shortest, root, branches, self.word, self.to, self.link, self.length, above,
            array("q", [k for k, _ in edges]), array("i", [t for _, t in edges]), first, held,
        )


def stream(flat: tuple, ids: list[int | None]):
    """Hit runs [(first, end)] of word positions, and the items whose windows occur."""
    _, names, shortest, root, branches, word, to, link, length, above, keys, targets, first, held = flat
    items: set[str] = set()
    runs: list[list[int]] = []
    state = matched = 0
    n = len(keys)
    for i, w in enumerate(ids):
        if w is None:
            state = matched = 0
            continue
        while state:
            if word[state] == w:
                t = to[state]
                break
            if branches[state]:
                key = state << 32 | w
                at = bisect_left(keys, key)
                if at < n and keys[at] == key:
                    t = targets[at]
                    break
            state = link[state]
            matched = length[state]
        else:
            t = root[w]  # every known word is in some item
        state = t
        matched += 1
        at = above[state] if matched >= shortest else -1
        longest = 0
        while at >= 0:
            for k in range(2 * first[at], 2 * first[at + 1], 2):
                if held[k + 1] <= matched:
                    items.add(names[held[k]])
                    longest = max(longest, held[k + 1])
            at = link[at]
            at = above[at] if at >= 0 else -1
        if longest:
            begin = i - longest + 1
            while runs and runs[-1][1] >= begin:
                begin = min(begin, runs.pop()[0])
            runs.append([begin, i + 1])
    return runs, items


def _blocks(benchmark: DataFrame, item: str, text: str, block_words: int):
    """Lists of (item, text) of at most so many words, a longer item alone."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).cast("string").alias("t"))
    block, size = [], 0
    for r in rows.filter("t is not null").toLocalIterator():
        n = len(normalised_words(r.t))
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((r.i if r.i is not None else "", r.t))
        size += n
    yield block


_FOUND = "n_words bigint, runs array<struct<a:int,b:int>>, items array<string>"


def _scan(docs: DataFrame, flat: tuple, finish=None, schema: str | None = None) -> DataFrame:
    """``docs`` (columns k0, ..., t) and n_words, runs (hit word ranges), items.

    With ``finish(batch, n_words, runs)`` that, of the type ``schema``, is the result instead:
    what follows a scan then needs no Python worker of its own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(flat)  # arrays of at most 2 * block_words states
    schema = schema or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", {_FOUND}"

    def run(batches):
        flat = shared.value
        get, shortest = flat[0].get, flat[2]
        for b in sliced(batches):
            n_words, runs, items = [], [], []
            for t in b.column("t").to_pylist():
                ids = list(map(get, normalised_words(t)))
                n_words.append(len(ids))
                known = len(ids) - ids.count(None)
                r, found = stream(flat, ids) if known >= shortest else ([], set())
                runs.append(r)
                items.append(sorted(found))
            if finish:
                yield finish(b, n_words, runs)
                continue
            made = [
                pa.array(n_words, pa.int64()),
                pa.array([[{"a": x, "b": y} for x, y in r] for r in runs], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                pa.array(items, pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, "n_words", "runs", "items"])

    return docs.mapInArrow(run, schema)


def _found(
    docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, keep, window: int, block_words: int, finish=None, schema=None
) -> DataFrame:
    """k0, k1, ... (the columns ``keep``), t (the text), n_words, runs, items.

    With ``finish`` the last pass gives its result (see ``_scan``); ``k_runs`` of its batch, if there, has the runs of former passes.
    """
    names = [f"k{i}" for i in range(len(keep))]
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{text}`").cast("string").alias("t"))

    def with_former(found):
        runs, items = _merged(F.concat("k_runs", "runs")), F.array_sort(F.array_union("k_items", "items"))
        return found.select(*names, "t", "n_words", runs.alias("runs"), items.alias("items"))

    out = flat = None
    for block in _blocks(benchmark, item, item_text, block_words):
        if flat is not None:  # one more pass will follow
            found = _scan(source, flat) if out is None else with_former(_scan(out, flat))
            out = stored(found.withColumnsRenamed({"runs": "k_runs", "items": "k_items"}).drop("n_words"), "leaks")
        flat = Automaton(block, window).flat()
    last = _scan(source if out is None else out, flat, finish, schema)
    return last if finish or out is None else with_former(last)


def scan_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``keep``, n_words, runs array<struct<a,b>> of hit words, items array<string>.

    One row per row of ``docs``. Null texts have no words; items without words
    have no windows; with no items nothing is hit. Texts of any length stream through
    in one go. Repeated items count once per item id, repeated documents are judged
    each; ties don't arise. Other columns are ignored, whatever their names. Spark jobs
    read the items while this is built, and scan the documents where there are several blocks.
    """
    found = _found(docs, benchmark, text, item, item_text, keep, window, block_words)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words", "runs", "items")


def _merged(runs):
    """Union of ranges, as sorted ranges that don't touch."""
    start = F.array().cast("array<struct<a:int,b:int>>")

    def add(acc, r):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["a"].alias("a"), F.greatest(last["b"], r["b"]).alias("b"))
        return F.when(
            (F.size(acc) > 0) & (last["b"] >= r["a"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))
        ).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(F.array_sort(runs), start, add)


def _union(runs: list) -> list:
    """As ``_merged``, of a list of pairs."""
    out: list[list[int]] = []
    for a, z in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return out


def remove_spans(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", max_span: int = 0, max_coverage: float = 1.0,
    item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` without benchmark passages.

    Hit runs of more than ``max_span`` words are cut from the text (from the
    first byte of their first word to the last of their last). A document whose
    hit words are more than ``max_coverage`` of its words is dropped whole.
    Texts without hits, nulls and empty ones among them, stay as they are; so do
    repeated rows, each judged alone. All columns stay, whatever their names. Empty
    tables give no rows.
    """
    keep = [c for c in docs.columns if c != text]
    names = [f"k{i}" for i in range(len(keep))]

    def cut(b, n_words, found):
        texts, kept = b.column("t").to_pylist(), []
        former = b.column("k_runs").to_pylist() if "k_runs" in b.schema.names else [()] * len(texts)
        for i, (n, runs) in enumerate(zip(n_words, found, strict=True)):
            runs = _union([*runs, *((r["a"], r["b"]) for r in former[i] or ())])
            if n and sum(z - a for a, z in runs) > max_coverage * n:
                continue
            kept.append(i)
            runs = [(a, z) for a, z in runs if z - a > max_span]
            if runs:
                raw = texts[i].encode()
                at = [m.span() for m in _SPANS.finditer(raw.lower())]
                parts, last = [], 0
                for a, z in runs:
                    parts.append(raw[last : at[a][0]])
                    last = at[z - 1][1]
                texts[i] = b"".join([*parts, raw[last:]]).decode("utf-8", "replace")
        rows = [b.column(c) for c in names] + [pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(rows, [*names, "t"]).take(pa.array(kept, pa.int64()))

    kinds = {c: docs.schema[c].dataType.simpleString() for c in keep}
    schema = ", ".join([f"`{n}` {kinds[c]}" for c, n in zip(keep, names)] + ["t string"])
    out = _found(docs, benchmark, text, item, item_text, keep, window, block_words, cut, schema)
    back = dict(zip(keep, names)) | {text: "t"}
    return out.select(*[F.col(back[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda s, r: s + r["b"] - r["a"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS txt
  FROM (SELECT item, w, least(10, len(w)) AS k, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS s
        FROM i WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
cand AS (
  SELECT rid, k, s, array_to_string(list_slice(w, s, s + k - 1), ' ') AS txt
  FROM (SELECT rid, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT c.rid, c.k, c.s, win.item FROM cand c JOIN win ON c.k = win.k AND c.txt = win.txt),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit
        FROM (SELECT rid, unnest(generate_series(s, s + k - 1)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
        FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words,
       CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.names, '')) AS items_sha256,
       coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.rid = pos.rid LEFT JOIN its ON d.rid = its.rid
"""
