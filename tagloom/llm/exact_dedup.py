"""Exact substring dedup: what long strings cover that start more than once.

Strings are judged in two units at once: ``length`` bytes, which are what is removed,
and ``passage`` words (as 32-bit codes, A-Z folded), which are only counted. Below,
a window is a string of that many units.

A window can't be shuffled from every position of the corpus, so windows are grouped
first. The anchor of a window is its k-gram of least hash: equal windows have equal
anchors. Consecutive windows of one anchor form a run; runs tile all windows of a
document (about one run for each half window). The lowest bit of an anchor's hash
is its unit. Texts are cut into segments that overlap by a window, so their size
has no bound.

1. Runs of equal bytes are counted, pre-aggregated: where there are two or more,
   all their windows repeat. One run stands for the others from here on.
2. Runs that share their anchor's hash but differ may share some windows. Such a
   window holds one of four spans around the anchor, which are shorter by a quarter
   of what a window has beside it, so the runs agree in that span. Their units
   go, by anchor, to tasks that build a suffix array (two-stage sorting) over
   them; adjacent common prefixes give the windows that repeat.
3. An anchor with more than ``RUNS`` different runs is dealt out over several tasks;
   each tells the kinds of windows that it has, in blocks. Equal blocks (by a 128-bit
   hash) of two tasks are decided, and one stands for them; blocks whose windows'
   common units nobody else has are dropped; the others are cut and so on, down to
   single windows; so few rows move even where a third of all rows share a passage.

Repeated windows go back to the runs, the runs to the texts they are in. Texts are
told apart by a 64-bit hash and their size; equal texts have equal results.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, fresh_names, sliced, stored, table
from .suffix_array import repeated_starts

LENGTH, GRAM = 400, 32
#: Words of a passage ("over 50"), and of its anchors.
PASSAGE, PASSAGE_GRAM = 51, 8
RUNS = 1024
CHUNK_BYTES = 1 << 20
BLOCK_BYTES = 1 << 21
#: Units of a text that are cut into runs at once.
SEGMENT = 1 << 22
_POSITION_BITS = np.uint64(28)
_RUN_SCHEMA = "th bigint, size bigint, lo bigint, n_windows int, place int, anchor bigint, run bigint, sides bigint"
#: Spans around an anchor, each told by 16 bits of ``sides``.
SPANS = 4
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Bytes of a unit, by unit: bytes, words.
UNIT_BYTES = (1, 4)
_DTYPE = (np.dtype(np.uint8), np.dtype("<u4"))
#: Windows in a block, level by level and by unit, for anchors that are dealt out over tasks.
WIDTHS = ((64, 8), (16, 4), (4, 2), (1, 1))


def _gram_hashes(t: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a power of two) at every position."""
    h = t.astype(np.uint64)
    with np.errstate(over="ignore"):
        size, factor = 1, np.uint64(0x9E3779B97F4A7C15)
        while size < gram:
            h = h[:-size] * factor + h[size:]
            factor = factor * factor
            size *= 2
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def units_of(raw: bytes, unit: int) -> bytes:
    """A text's units end to end: its bytes, or a 32-bit code for each word."""
    import xxhash

    if not unit:
        return raw
    words = raw.translate(_LOWER).split()
    return np.fromiter(map(xxhash.xxh32_intdigest, words), "<u4", len(words)).tobytes()


def runs_of(t: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(document, lo, n_windows, place, anchor hash, sides) arrays for units of documents laid end to end.

    ``ends`` has where each document ends; lo counts from its document's start, and
    place, that of the anchor, from lo.
    """
    empty = np.zeros(0, np.int64)
    none = empty, empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if len(t) < length:
        return none
    h = _gram_hashes(t, gram)
    mask = (np.uint64(1) << _POSITION_BITS) - np.uint64(1)
    v = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    width, size = length - gram + 1, 1
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    if width > size:
        v = np.minimum(v[: len(v) - (width - size)], v[width - size :])
    anchor = (v & mask).astype(np.int64)  # of the window at each start
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    doc = np.repeat(np.arange(len(ends)), sizes)[: len(anchor)]
    fits = np.arange(len(anchor)) + length <= ends[doc]
    new = fits.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~fits[:-1]
    lo = np.flatnonzero(new)
    if not len(lo):
        return none
    n, mid = np.add.reduceat(fits, lo), anchor[lo]
    return doc[lo], lo - starts[doc[lo]], n, mid - lo, h[mid], _sides(h, mid, mid - lo, n, length, gram)


def _sides(h: np.ndarray, mid: np.ndarray, place: np.ndarray, n: np.ndarray, length: int, gram: int) -> np.ndarray:
    """16 bits for each span around the anchors at ``mid``, from the hashes of the grams that tile it;
    0 where the run doesn't reach so far. A window with ``a`` units before its anchor holds the span
    between the two cuts around ``a``; equal spans have equal bits."""
    cuts = [(length - gram) * i // SPANS for i in range(SPANS + 1)]
    out = np.zeros(len(mid), np.uint64)
    with np.errstate(over="ignore"):
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            span = length - (b - a)
            reach = (place >= a) & (place - a + span <= n + length - 1)
            start, told = np.where(reach, mid - a, 0), np.zeros(len(mid), np.uint64)
            for at in (*range(0, span - gram, gram), span - gram):
                told = (told + h[start + at]) * np.uint64(0x9E3779B97F4A7C15)
            told = np.where(reach, np.maximum(told >> np.uint64(48), np.uint64(1)), np.uint64(0))
            out |= told << np.uint64(16 * i)
    return out


def _pieces(units: list[bytes], unit: int, length: int, most: int = BLOCK_BYTES):
    """Lists of (index, first unit, units) of about ``most`` bytes together; texts of more than
    a segment are cut, each piece but the last going on for ``length`` - 1 units."""
    size, held, total = UNIT_BYTES[unit], [], 0
    for i, u in enumerate(units):
        n = len(u) // size
        for at in range(0, max(1, n - length + 1), SEGMENT):
            piece = u if n <= SEGMENT else u[at * size : (at + SEGMENT + length - 1) * size]
            if held and total + len(piece) > most:
                yield held
                held, total = [], 0
            held.append((i, at, piece))
            total += len(piece)
    if held:
        yield held


def text_runs(docs: DataFrame, lengths: tuple[int, int], grams: tuple[int, int]) -> DataFrame:
    """All runs, in either unit, of all rows of ``docs`` (th, size, text). A length of 0 leaves a unit out.

    ``sides`` has the bits of the spans around the anchor.
    """
    names = [f.split()[0] for f in _RUN_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        from xxhash import xxh64_intdigest

        for b in sliced(batches):
            th, size = (b.column(c).to_numpy(zero_copy_only=False) for c in ("th", "size"))
            texts = [t.encode() for t in b.column("text").to_pylist()]
            for unit, (length, gram) in enumerate(zip(lengths, grams)):
                if not length:
                    continue
                w = UNIT_BYTES[unit]
                for held in _pieces([units_of(t, unit) for t in texts], unit, length):
                    data = b"".join(p for _, _, p in held)
                    ends = np.cumsum([len(p) // w for _, _, p in held])
                    piece, lo, n, place, anchor, sides = runs_of(np.frombuffer(data, _DTYPE[unit]), ends, length, gram)
                    if not len(piece):
                        continue
                    at = lo + np.concatenate([[0], ends[:-1]])[piece]
                    spans = zip((at * w).tolist(), ((at + n + length - 1) * w).tolist())
                    whole = np.fromiter((xxh64_intdigest(data[a:e], 7) for a, e in spans), np.uint64, len(at)).view(np.int64)
                    row = np.array([i for i, _, _ in held])[piece]
                    base = np.array([x for _, x, _ in held], np.int64)[piece]
                    anchor = (anchor & ~np.uint64(1)) | np.uint64(unit)
                    columns = [th[row], size[row], lo + base, n, place, anchor.view(np.int64), whole, sides.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds)], names)

    return docs.select("th", "size", "text").mapInArrow(run, _RUN_SCHEMA)


def _intervals(mask: np.ndarray) -> list[dict]:
    """[{a, b}] of the maximal stretches of true, ends exclusive."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return [{"a": int(x), "b": int(y)} for x, y in zip(edge[::2], edge[1::2])]


_IV = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


_BLOCK = "anchor bigint, run bigint, place int, at int, n int, inner binary, whole binary, bytes binary"
_BLOCK_NAMES = [f.split()[0] for f in _BLOCK.split(", ")]
_BLOCK_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _blocks_of(data: bytes, first: int, n: int, place: int, level: int, lengths: tuple[int, int], unit: int):
    """(at, n, inner hash, whole hash, units) of the blocks that cut the n windows from
    ``first`` on. ``data`` starts at window ``first``. Blocks are laid out from the
    anchor, so equal windows lie in blocks alike; ``inner`` is what all windows of a
    whole block have in common, so a part of a block has it too."""
    import xxhash

    at, w, length = first, UNIT_BYTES[unit], lengths[unit]
    width = min(WIDTHS[level][unit], length)
    while at < first + n:
        left = (at - place) // width * width + place  # where the whole block begins
        stop = min(left + width, first + n)
        inner = data[(left + width - 1 - first) * w : (left + length - first) * w]
        part = data[(at - first) * w : (stop - 1 + length - first) * w]
        yield at, stop - at, xxhash.xxh3_128_digest(inner, unit), xxhash.xxh3_128_digest(part, 2 + unit), part
        at = stop


def _shared_across(blocks: DataFrame, lengths: tuple[int, int]) -> DataFrame:
    """anchor, run, at, n: windows that blocks of several tasks share, level by level."""
    found = None
    for level in range(len(WIDTHS)):
        kinds = blocks.groupBy("whole").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*[c for c in _BLOCK_NAMES if c != "whole"])).alias("r"))
        kinds = stored(kinds, "dedup-blocks")
        equal = kinds.filter("_n > 1").select(F.col("whole").alias("_w"))
        decided = stored(blocks.join(equal, F.col("whole") == F.col("_w"), "left_semi").select("anchor", "run", "at", "n"), "dedup-decided")
        found = decided if found is None else found.unionByName(decided)
        if level == len(WIDTHS) - 1:
            return found
        kinds = kinds.select("r.*", "whole")
        twice = kinds.groupBy("inner").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("inner").alias("_i"))
        left = kinds.join(twice, F.col("inner") == F.col("_i"), "left_semi")

        def cut(batches, level=level + 1):
            for b in sliced(batches):
                rows = []
                for a, r, p, at, n, data in zip(*[b.column(c).to_pylist() for c in ("anchor", "run", "place", "at", "n", "bytes")], strict=True):
                    rows += [(a, r, p, *x) for x in _blocks_of(data, at, n, p, level, lengths, a & 1)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_BLOCK_KINDS)], _BLOCK_NAMES)

        blocks = stored(left.mapInArrow(cut, _BLOCK), "dedup-cut")


def _suffix_stage(fragments: DataFrame, lengths: tuple[int, int], chunk_bytes: int) -> DataFrame:
    """Repeated windows among the runs of each (anchor, chunk), by suffix array.

    A row for each run with repeated windows (iv); for anchors in several chunks
    also rows for the blocks of windows that this chunk has to tell the others about.
    """
    schema = f"{_BLOCK}, iv array<struct<a:bigint,b:bigint>>"
    names, kinds = [*_BLOCK_NAMES, "iv"], [*_BLOCK_KINDS, _IV]

    def solve(rows, unit):
        length = lengths[unit]
        data = np.frombuffer(b"".join(r[4] for r in rows), _DTYPE[unit])
        sizes = np.array([len(r[4]) for r in rows]) // UNIT_BYTES[unit]
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        n = sizes - length + 1
        valid = np.concatenate([np.arange(a, a + k) for a, k in zip(first, n)])
        repeated, group = repeated_starts(data, valid, length)
        seen: set[int] = set()
        out, at = [], 0
        for r, k in zip(rows, n.tolist()):
            mask = repeated[at : at + k]
            if mask.any():
                out.append((r[0], r[1], *[None] * 6, _intervals(mask)))
            if r[3] > 1:  # each kind of window that others may have too is told once
                names_ = group[at : at + k].tolist()
                new = np.array([g not in seen for g in names_])
                seen.update(names_)
                for a, m, *told in _blocks_of(r[4], 0, k, r[5], 0, lengths, unit):
                    if new[a : a + m].any():
                        out.append((r[0], r[1], r[5], a, m, *told, None))
            at += k
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names)

    def run(batches):
        rows, total, group, held, taken = ([], []), [0, 0], None, [], set()

        def close():
            if len(held) > 1 or held and held[0][3] > 1:
                unit = held[0][0] & 1
                rows[unit].extend(held)
                total[unit] += sum(len(r[4]) for r in held)

        for b in sliced(batches):
            for r in zip(*[b.column(c).to_pylist() for c in ("anchor", "run", "chunk", "chunks", "bytes", "place")], strict=True):
                if (r[0], r[2]) != group:
                    close()
                    group, held, taken = (r[0], r[2]), [], set()
                    for unit in (0, 1):
                        if total[unit] >= chunk_bytes:
                            yield solve(rows[unit], unit)
                            rows[unit].clear()
                            total[unit] = 0
                if r[1] not in taken:  # copies of a text bring the same run again
                    taken.add(r[1])
                    held.append(r)
        close()
        for unit in (0, 1):
            if rows[unit]:
                yield solve(rows[unit], unit)

    return fragments.mapInArrow(run, schema)


def repeated_spans(
    docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, passage: int = PASSAGE,
    passage_gram: int = PASSAGE_GRAM, runs: int = RUNS, chunk_bytes: int = CHUNK_BYTES,
):
    """(texts, spans): ``docs`` as th, size, text with its other columns (``_o_`` before their
    names), and for each (th, size) with repeated windows iv: unit and ranges of window starts.

    Spark jobs run while this is built: runs, kinds of runs and windows that repeat are
    written to the shared folder.
    """
    lengths, grams = (length, passage), (gram, passage_gram)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    others = [c for c in docs.columns if c != text]
    texts = docs.select(F.xxhash64(body).alias("th"), F.octet_length(body).cast("bigint").alias("size"), body.alias("text"), *[F.col(c).alias(f"_o_{c}") for c in others])
    shortest = min(length, 2 * passage - 1) if passage else length
    all_runs = stored(text_runs(texts.filter(F.col("size") >= shortest), lengths, grams), "dedup-runs")
    # Equal runs are alike in all but where they are, and any of their places will do: with single
    # numbers to keep, each from the same first row, runs are aggregated by hash and never sorted.
    kinds = all_runs.groupBy("anchor", "run").agg(
        F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("th", "size", "lo", "n_windows", "place", "sides")]
    )
    kinds = stored(kinds, "dedup-kinds")
    # Where every kind of run has copies, all windows are known to repeat.
    shared = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("n") == 1).alias("alone"))
    shared = shared.filter("kinds > 1 AND alone > 0").select(F.col("anchor").alias("_a"))
    several = stored(kinds.join(shared, F.col("anchor") == F.col("_a"), "left_semi"), "dedup-several")
    told = F.array(*[F.shiftrightunsigned("sides", 16 * i).bitwiseAND(F.lit(0xFFFF)).cast("int") for i in range(SPANS)])
    spans = several.select("anchor", "run", F.posexplode(told).alias("side", "span")).filter("span != 0")
    same = ["anchor", "side", "span"]
    twice = spans.groupBy(*same).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    alike = spans.join(twice, same, "left_semi").select(F.col("anchor").alias("_a"), F.col("run").alias("_r")).distinct()
    left = stored(several.join(alike, (F.col("anchor") == F.col("_a")) & (F.col("run") == F.col("_r")), "left_semi").drop("sides"), "dedup-alike")
    drop_stored(several)
    chunks = left.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / runs).cast("int").alias("chunks")).withColumnRenamed("anchor", "_a")
    wanted = left.join(chunks, F.col("anchor") == F.col("_a")).select(
        F.col("th").alias("_th"), F.col("size").alias("_size"),
        F.struct("anchor", "run", F.pmod("run", "chunks").cast("int").alias("chunk"), "chunks", "lo", F.col("n_windows").alias("k"), "place").alias("r"),
    )
    wanted = wanted.groupBy("_th", "_size").agg(F.collect_list("r").alias("rs"))
    located = texts.join(wanted, (texts["th"] == wanted["_th"]) & (texts["size"] == wanted["_size"])).select("text", "rs")

    def cut(batches):
        names = ["anchor", "run", "chunk", "chunks", "bytes", "place"]
        kinds_ = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32()]
        for b in sliced(batches):
            for t, rs in zip(b.column("text").to_pylist(), b.column("rs").to_pylist(), strict=True):
                raw, units, rows = t.encode(), {}, []
                for r in rs:
                    unit = r["anchor"] & 1
                    if unit not in units:
                        units[unit] = units_of(raw, unit)
                    w = UNIT_BYTES[unit]
                    part = units[unit][r["lo"] * w : (r["lo"] + r["k"] + lengths[unit] - 1) * w]
                    rows.append((r["anchor"], r["run"], r["chunk"], r["chunks"], part, r["place"]))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds_)], names)

    fragments = located.mapInArrow(cut, "anchor bigint, run bigint, chunk int, chunks int, bytes binary, place int")
    dealt = fragments.repartition("anchor", "chunk").sortWithinPartitions("anchor", "chunk")
    solved = stored(_suffix_stage(dealt, lengths, chunk_bytes), "dedup-solved")
    drop_stored(left)
    found = solved.filter(F.col("iv").isNotNull()).select("anchor", "run", "iv")
    told = solved.filter(F.col("inner").isNotNull()).drop("iv")
    if not told.isEmpty():
        late = _shared_across(told, lengths)
        at = F.col("at").cast("bigint")
        found = found.unionByName(late.select("anchor", "run", F.array(F.struct(at.alias("a"), (at + F.col("n")).alias("b"))).alias("iv")))
    copied = kinds.filter("n > 1").select(
        "anchor", "run", F.array(F.struct(F.lit(0).cast("bigint").alias("a"), F.col("n_windows").cast("bigint").alias("b"))).alias("iv")
    )
    found = found.unionByName(copied).groupBy("anchor", "run").agg(F.flatten(F.collect_list("iv")).alias("iv"))
    # Written first, so that the join has two plain shuffles and adaptive execution can split a run that many texts have.
    found = stored(found.select(F.col("anchor").alias("_a"), F.col("run").alias("_r"), "iv"), "dedup-found")
    drop_stored(kinds, solved)
    back = all_runs.join(found, (all_runs["anchor"] == found["_a"]) & (all_runs["run"] == found["_r"]))
    unit = F.col("anchor").bitwiseAND(F.lit(1)).cast("int")
    spans = back.select(
        F.col("th").alias("_th"), F.col("size").alias("_size"),
        F.explode(F.transform("iv", lambda x: F.struct(unit.alias("u"), (x["a"] + F.col("lo")).alias("a"), (x["b"] + F.col("lo")).alias("b")))).alias("s"),
    )
    spans = stored(spans.groupBy("_th", "_size").agg(F.collect_set("s").alias("iv")), "dedup-spans")
    drop_stored(all_runs, found)
    return texts, spans


def _covered(iv, unit: int, length: int) -> list[list[int]]:
    """Maximal [first, end] that the windows of ``iv`` in that unit cover."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"] + length - 1) for s in iv or [] if s["u"] == unit):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def remove_repeated(
    docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, passage: int = PASSAGE,
    passage_gram: int = PASSAGE_GRAM, runs: int = RUNS, chunk_bytes: int = CHUNK_BYTES, with_bytes: bool = True,
) -> DataFrame:
    """The columns of ``docs`` but its text, and n_bytes, n_removed, n_spans, kept_sha256,
    n_passage_words, kept (binary).

    Every byte of a ``length``-byte string that also starts elsewhere, in the same
    document or another, goes; strings are judged on the input. ``n_passage_words``
    counts the words inside strings of ``passage`` words that also start elsewhere
    (words split at ASCII white space, A-Z folded, 32-bit codes); they aren't removed
    unless the byte rule takes them, and ``passage=0`` leaves them out (null).

    One row per row; null and empty texts have no bytes; shorter texts stay whole;
    very long texts are cut into overlapping segments, with the same result;
    repeated rows are copies of each other, so long ones go whole. There are no ties:
    each copy of a string loses its bytes. Empty tables give no rows. Other columns are
    kept, whatever their names: where one is named as a new one, the new one gets an
    underscore more before its name. ``kept`` is left out with ``with_bytes=False``.
    """
    texts, spans = repeated_spans(docs, text, length, gram, passage, passage_gram, runs, chunk_bytes)
    others = [c for c in docs.columns if c != text]
    joined = texts.join(spans, (texts["th"] == spans["_th"]) & (texts["size"] == spans["_size"]), "left").drop("_th", "_size")
    made_ = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "n_passage_words": pa.int64()}
    made_ |= {"kept": pa.binary()} if with_bytes else {}
    sql = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    new = fresh_names(others, made_)
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others] + [f"`{n}` {sql[made_[k]]}" for k, n in new.items()])
    names = [*others, *new.values()]

    def cut(batches):
        for b in sliced(batches):
            rows = []
            for t, iv in zip(b.column("text").to_pylist(), b.column("iv").to_pylist(), strict=True):
                raw, parts, last, removed = t.encode(), [], 0, 0
                gone = _covered(iv, 0, length)
                for a, e in gone:
                    parts.append(raw[last:a])
                    removed, last = removed + e - a, e
                kept = b"".join([*parts, raw[last:]])
                words = sum(e - a for a, e in _covered(iv, 1, passage)) if passage else None
                rows.append((len(raw), removed, len(gone), hashlib.sha256(kept).hexdigest(), words, kept))
            made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(made_.values())]
            yield pa.RecordBatch.from_arrays([*[b.column(f"_o_{c}") for c in others], *made], names)

    return joined.mapInArrow(cut, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs Spark jobs while it is built (see ``repeated_spans``)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated(docs, with_bytes=False)
