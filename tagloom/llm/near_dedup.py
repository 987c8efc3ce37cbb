"""Near duplicates by exact Jaccard similarity of five-word shingles.

SimHash and MinHash only propose. Fingerprints of the shingles go through the method of
``simhash``: segment counts, grid cells, the Manhattan bound, then exact bits. That finds
copies with few edits; MinHash bands add those that its radius misses: two sets of
similarity 0.8 share none of the 50 bands of six rows with probability 3e-7. What
either links is joined to candidate components, and there each pair of sets is compared exactly, as block pairs, so that a
large component isn't one task. Of components of more than ``WIDE`` sets only those
that share a band meet. What leaves a task is a forest, not pairs. Only distinct sets
take part, so copies cost nothing.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, stored
from .components import connected_components
from .simhash import BITS, _LOWER, _forest, fingerprint, link_edges

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS = 50, 6
BLOCK, WIDE = 64, 4096
_RNG = np.random.default_rng(SEED)
_A = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one shingle, no words: none."""
    import xxhash

    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return np.array([], np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - shingle + 1))


def bands(found: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band of the MinHash signature of a set; no members: no keys."""
    import xxhash

    if not len(found):
        return []
    low = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 512):
        np.minimum(least, (low[i : i + 512, None] * _A + _B).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def similar_pairs(sets: list[np.ndarray], similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b), a < b, of the pairs of sets whose Jaccard similarity is at least ``similarity``."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    member = np.repeat(np.arange(n), size)
    _, name, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[name] > 1
    order = np.argsort(name[shared], kind="stable")
    name, member = name[shared][order], member[shared][order]
    name = np.cumsum(np.diff(name, prepend=name[:1]) > 0)
    both = np.zeros((n, n), np.int64)
    for start in range(0, int(name[-1]) + 1 if len(name) else 0, 4096):
        a, b = np.searchsorted(name, [start, start + 4096])
        has = np.zeros((n, 4096), np.float32)
        has[member[a:b], name[a:b] - start] = 1
        both += (has @ has.T).astype(np.int64)
    either = np.maximum(size[:, None] + size[None, :] - both, 1)
    return np.nonzero(np.triu(both >= similarity * either, 1))


def _candidate_edges(cells: DataFrame) -> DataFrame:
    """(u, v, cell): each set of a cell of several, with one of them."""

    def run(batches):
        last_cell = last = None
        for b in batches:
            cell, sid = (b.column(k).to_numpy(zero_copy_only=False) for k in ("cell", "sid"))
            if not len(cell):
                continue
            first = np.concatenate([[cell[0] != last_cell], cell[1:] != cell[:-1]])
            head = np.maximum.accumulate(np.where(first, np.arange(len(cell)), -1))
            lead = np.where(head >= 0, sid[head], last if last is not None else 0)
            last_cell, last = cell[-1], lead[-1]
            found = lead != sid
            columns = [pa.array(x[found]) for x in (sid, lead, cell)]
            yield pa.RecordBatch.from_arrays(columns, ["u", "v", "cell"])

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "u bigint, v bigint, cell bigint")


def _fingerprint_edges(sets: DataFrame, bits: int = BITS) -> DataFrame:
    """(u, v, cell): each set (sid, fp) with one whose fingerprint is equal, or linked to its own.

    All sets of a tree of links have the same ``cell``, so that they meet in a large component too.
    """
    lead = sets.groupBy("fp").agg(F.min("sid").alias("lead"))
    links = stored(link_edges(lead.select("fp"), bits), "near-fingerprint-links")
    roots = links.select(F.col("u").alias("fp"), F.col("v").alias("root"))
    roots = roots.unionByName(links.select(F.col("v").alias("fp"), F.col("v").alias("root"))).unionByName(lead.select("fp", F.col("fp").alias("root")))
    top = lead.select(F.col("fp").alias("root"), F.col("lead").alias("v"))
    edges = roots.distinct().join(top, "root").join(sets.select("fp", F.col("sid").alias("u")), "fp")
    return edges.filter("u <> v").select("u", "v", F.xxhash64("root", F.lit("fingerprint")).alias("cell"))


def _verified_edges(dealt: DataFrame, similarity: float) -> DataFrame:
    """(u, v): forests of the links among the texts of equal ``group``."""

    def links(sid, text):
        sid, at = np.unique(np.array(sid, np.int64), return_index=True)
        if len(sid) < 2:
            return sid[:0], sid[:0]
        a, b = similar_pairs([shingles(text[i]) for i in at], similarity)
        return _forest(sid[a], sid[b]) if len(a) else (sid[:0], sid[:0])

    def run(batches):
        group, sids, texts = None, [], []
        for batch in batches:
            for g, s, t in zip(*(batch.column(k).to_pylist() for k in ("group", "sid", "text"))):
                if g != group:
                    u, v = links(sids, texts)
                    if len(u):
                        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                    group, sids, texts = g, [], []
                sids.append(s)
                texts.append(t)
        u, v = links(sids, texts)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return dealt.repartition("group").sortWithinPartitions("group").mapInArrow(run, "u bigint, v bigint")


def similar_documents(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY, block: int = BLOCK, wide: int = WIDE
) -> DataFrame:
    """id, th (a hash of the text), component: a row for each row of ``docs``.

    Texts whose shingle sets are at least ``similarity`` alike are linked; all
    texts without words are one component. ``component`` is a name, not an id.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(docs[doc_id].alias("id"), docs[text].cast("string").alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("th"), "text")

    def run(batches):
        import xxhash

        for b in sliced(batches):
            found = [shingles(t) for t in b.column("text").to_pylist()]
            sid = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in found], np.uint64).view(np.int64)
            fps = np.array([fingerprint(t, SHINGLE) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            keys = pa.array([bands(s) for s in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(sid), pa.array(fps), keys], ["id", "th", "sid", "fp", "keys"])

    marked = stored(rows.mapInArrow(run, f"id {kind}, th bigint, sid bigint, fp bigint, keys array<bigint>"), "near-docs")
    sets = marked.groupBy("sid").agg(F.first("keys").alias("keys"), F.min(F.struct("id", "th")).alias("at"))
    sets = stored(sets, "near-sets")
    cells = sets.select("sid", F.explode("keys").alias("cell"))
    prints = stored(marked.select("sid", "fp").distinct(), "near-fingerprints")
    edges = stored(_candidate_edges(cells).unionByName(_fingerprint_edges(prints)), "near-candidates")
    roots = stored(connected_components(edges, "near-candidate-components"), "near-roots")
    tops = roots.select(F.col("v").alias("u"), "v").distinct()
    members = roots.unionByName(tops)
    sizes = members.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    in_small = members.join(sizes.filter(F.col("n") <= wide), "v").select(F.col("u").alias("sid"), F.col("v").alias("key"))
    wide_roots = sizes.filter(F.col("n") > wide).select("v")
    in_cells = edges.join(members.join(wide_roots, "v").select("u"), "u").select(F.explode(F.array("u", "v")).alias("sid"), F.col("cell").alias("key"))
    grouped = stored(in_small.unionByName(in_cells).distinct(), "near-groups")
    counts = grouped.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    at = F.pmod(F.xxhash64("sid", F.lit(1)), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64("key", F.least(at, j), F.greatest(at, j))
    )
    dealt = grouped.join(counts, "key").select("sid", F.explode(pairs).alias("group"))
    where = sets.join(members.select(F.col("u").alias("sid")), "sid").select("sid", F.col("at.id").alias("_id"), F.col("at.th").alias("_th"))
    texts = rows.join(where, rows["id"].eqNullSafe(where["_id"]) & (rows["th"] == where["_th"])).select("sid", "text")
    texts = texts.dropDuplicates(["sid"])
    links = stored(_verified_edges(dealt.join(texts, "sid"), similarity), "near-links")
    components = connected_components(links, "near-components").select(F.col("u").alias("_u"), F.col("v").alias("_v"))
    found = marked.drop("keys", "fp").join(components, F.col("sid") == F.col("_u"), "left")
    return found.select("id", "th", F.coalesce("_v", "sid").alias("component"))


def drop_similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest doc_id, then text hash.

    Of repeated rows one stays. Rows without an id all stay.
    """
    found = stored(similar_documents(docs, text, doc_id, **options), "near-found")
    kept = found.filter("id IS NOT NULL").groupBy("component").agg(F.min(F.struct("id", "th")).alias("k"))
    kept = kept.select(F.col("k.id").alias("_id"), F.col("k.th").alias("_th"))
    hashed = docs.withColumn("_text_hash", F.xxhash64(docs[text].cast("string")))
    kept = hashed.join(kept, (hashed[doc_id] == kept["_id"]) & (hashed["_text_hash"] == kept["_th"]), "left_semi")
    return kept.dropDuplicates([doc_id, "_text_hash"]).drop("_text_hash").unionByName(docs.filter(F.col(doc_id).isNull()))
