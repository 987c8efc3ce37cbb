"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint is mapped to the bit counts of its 32 two-bit segments. The
Manhattan distance of these vectors is a lower bound of the Hamming distance. The
segments are dealt into groups; two fingerprints within ``bits`` agree in all but
``bits`` groups, so they meet in a grid cell of some choice of the others (a cell:
equal counts in the chosen groups). In a cell, pairs are tested by the Manhattan
bound, then exactly. What leaves a task is a forest, not pairs. A cell of more
than ``CELL`` fingerprints is dealt out as pairs of blocks. Only distinct
fingerprints take part, so copies cost nothing.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, stored, table
from .components import connected_components

SHINGLE, SEED, BITS = 4, 42, 4
CELL = 4096
#: A-Z folded to a-z; bytes.split() then cuts at \x20 and \x09-\x0D.
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BIT = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)
_LOW = 0x5555555555555555


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; no words: 0."""
    import xxhash

    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        spans = zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(words) - shingle + 1)
    parts = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(parts) > 1000:
        counts = np.concatenate([np.bincount(parts[:, k], minlength=256) @ _BIT for k in range(8)])
    else:
        counts = np.unpackbits(parts, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(parts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """``keep`` and fp, the fingerprint as a (signed) bigint; a row for each row of ``docs``."""
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep) + ", fp bigint"

    def run(batches):
        for b in sliced(batches):
            fps = np.array([fingerprint(t, **options) for t in b.column(len(keep)).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(fps.view(np.int64))], [*keep, "fp"])

    return docs.select(*keep, F.col(text).cast("string").alias("_simhash_text")).mapInArrow(run, schema)


def _embedding(fp):
    """Segment counts in thermometer code: bits of xor of two are their Manhattan distance."""
    a, b = fp.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_LOW))
    return F.shiftleft(a.bitwiseAND(b), 1).bitwiseOR(a.bitwiseOR(b))


def _masks(n: int, bits: int) -> list[int]:
    """Masks over the embedding, one for each choice of groups that may agree.

    More fingerprints: more groups, so that a cell stays small; each is exact.
    """
    agree = 1 if n < 20_000 else 2 if n < 2_000_000 else 3 if n < 200_000_000 else 4
    groups = bits + agree
    edges = [round(32 * i / groups) for i in range(groups + 1)]
    whole = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(whole, agree)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the edges between values u and v: each value but the least of its component, with that."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        old = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == old).all():
            break
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


def _embed(x: np.ndarray) -> np.ndarray:
    a, b = x & np.uint64(_LOW), (x >> np.uint64(1)) & np.uint64(_LOW)
    return ((a & b) << np.uint64(1)) | a | b


def _close(x, y, ex, ey, bits):
    near = np.bitwise_count(ex ^ ey) <= bits  # the Manhattan bound
    near &= np.bitwise_count(x ^ y) <= bits
    return near


def links_in_cells(cell: np.ndarray, fp: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links between fingerprints of equal cell; ``cell`` is sorted."""
    x = fp.view(np.uint64)
    e = _embed(x)
    us, vs = [], []
    shift = 1
    alive = np.arange(len(x))
    while len(alive) and shift <= 64:  # neighbours at growing distance, over all cells at once
        alive = alive[alive + shift < len(x)]
        alive = alive[cell[alive] == cell[alive + shift]]
        near = alive[_close(x[alive], x[alive + shift], e[alive], e[alive + shift], bits)]
        us.append(x[near])
        vs.append(x[near + shift])
        shift += 1
    if len(alive):  # cells of more: row by row, against all that follow
        edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a > 64:
                for i in range(a, b - 1):
                    near = i + 1 + np.flatnonzero(_close(x[i], x[i + 1 : b], e[i], e[i + 1 : b], bits))
                    us.append(np.repeat(x[i], len(near)))
                    vs.append(x[near])
                    if sum(map(len, us[-256:])) > 1 << 20:
                        us, vs = ([z] for z in _forest(np.concatenate(us), np.concatenate(vs)))
    if not us:
        return x[:0], x[:0]
    return _forest(np.concatenate(us), np.concatenate(vs))


def link_edges(fps: DataFrame, bits: int = BITS, cell_size: int = CELL) -> DataFrame:
    """(u, v): forests that join the distinct fingerprints ``fp`` within ``bits`` bits."""
    n = fps.count()
    masks = F.array(*[F.lit(m) for m in _masks(n, bits)])
    cells = fps.select("fp", F.posexplode(masks).alias("_k", "_m"), _embedding(F.col("fp")).alias("_e")).select(
        "fp", F.xxhash64("_k", F.col("_e").bitwiseAND(F.col("_m"))).alias("cell")
    )
    hot = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell_size)
    hot = hot.select(F.col("cell").alias("_hot"), F.ceil(F.col("n") / cell_size).cast("int").alias("blocks"))
    dealt = cells.join(hot, F.col("cell") == F.col("_hot"), "left")
    block = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.xxhash64("cell", F.least(block, j), F.greatest(block, j)),
    )
    dealt = dealt.select("fp", F.explode(F.coalesce(others, F.array("cell"))).alias("cell"))

    def run(batches):
        cells_, fps_, n_held = [], [], 0
        for b in batches:
            cells_.append(b.column("cell").to_numpy(zero_copy_only=False))
            fps_.append(b.column("fp").to_numpy(zero_copy_only=False))
            n_held += b.num_rows
            if n_held >= 1 << 17:
                cell, fp = np.concatenate(cells_), np.concatenate(fps_)
                cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
                u, v = links_in_cells(cell[:cut], fp[:cut], bits)
                cells_, fps_, n_held = [cell[cut:]], [fp[cut:]], len(cell) - cut
                if len(u):
                    yield _edge_batch(u, v)
        if cells_:
            yield _edge_batch(*links_in_cells(np.concatenate(cells_), np.concatenate(fps_), bits))

    def _edge_batch(u, v):
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "u bigint, v bigint")


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    bits: int = BITS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, fp, component_id, a row for each row of ``docs`` (and its columns ``keep``).

    Fingerprints that differ in at most ``bits`` bits are linked; component_id is
    the smallest doc_id that links reach. Texts without words (null, empty, white
    space) have fingerprint 0, linked like any other. Repeated rows are repeated;
    null ids never are component ids unless nothing else is there. Extra columns
    are ignored; empty tables give no rows.
    """
    columns = tuple(dict.fromkeys([doc_id, *keep]))
    marked = stored(fingerprints(docs, text, columns), "simhash-docs")
    distinct = stored(marked.groupBy("fp").agg(F.min(doc_id).alias("lowest")), "simhash-distinct")
    edges = stored(link_edges(distinct.select("fp"), bits), "simhash-edges")
    roots = connected_components(edges, "simhash-components")
    rooted = distinct.join(roots.withColumnRenamed("v", "_root"), distinct["fp"] == roots["u"], "left").select(
        "fp", "lowest", F.coalesce("_root", "fp").alias("_root")
    )
    lowest = rooted.groupBy("_root").agg(F.min("lowest").alias("component_id"))
    of_fp = rooted.drop("lowest").join(lowest, "_root").select(F.col("fp").alias("_fp"), "component_id")
    return marked.join(of_fp, marked["fp"] == of_fp["_fp"]).drop("_fp")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bits: int = BITS) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest doc_id.

    Of repeated rows of that id one stays. Rows without an id all stay.
    """
    found = near_duplicates(docs, text, doc_id, bits)
    ids = found.filter(F.col(doc_id) == F.col("component_id")).select(F.col(doc_id).alias("_kept")).distinct()
    kept = docs.join(ids, docs[doc_id] == ids["_kept"], "left_semi")
    return kept.dropDuplicates([doc_id]).unionByName(docs.filter(F.col(doc_id).isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
