"""Language identification by compression.

Each language has a raw-content zstandard dictionary of text in that language.
A document, folded to lower-case letters and single spaces, is compressed chunk
by chunk over its whole length, once with each dictionary; the language with the
smallest total wins. A first pass uses zstandard's fastest level; where the
margin to the second is under ``CLOSE``, a second pass over the whole text with
shorter chunks and a higher level decides. Where that margin is narrow too, the
answer is rejected (``rejected``; the score is then low); the best guess is still
given. Chunking keeps the dictionary in reach however long the text is.

Dictionaries are fitted on a bounded sample: of at most ``sample_docs`` documents a
language, chosen by a hash of the id, one piece each, from a hashed place anywhere in
the text, and ``dict_bytes`` bytes together. Every language value is learned; where
there are so many that their dictionaries together would pass ``total_bytes``, each
gets a smaller share.
"""
from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out_column, is_training, process_cache, sliced, table

SAMPLE_DOCS = 200
DICT_BYTES = 48_000
#: (level, chunk bytes) of the first pass and of the deciding one.
PASSES = ((1, 4096), (8, 1024))
CLOSE = 0.06
#: Bytes of all dictionaries together, which are broadcast, and of a piece of a document.
TOTAL_BYTES, PIECE = 16_000_000, 600
MIN_MARGIN = 0.01
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII bytes that are no letters become spaces.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def folded(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_FOLD).split())


def fit_dictionaries(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    doc_id: str = "doc_id",
    sample_docs: int = SAMPLE_DOCS,
    dict_bytes: int = DICT_BYTES,
    total_bytes: int = TOTAL_BYTES,
) -> dict[str, bytes]:
    """language -> dictionary content, from a bounded sample of training rows.

    Learns only from rows with an id, a language and a text. The counts choose a
    sampling rate for each language, so one scan of the texts takes the sample; its
    pieces are grouped by language before they come to the driver. Runs Spark jobs.
    """
    rows = docs.select(F.col(doc_id).alias("i"), F.col(lang).cast("string").alias("l"), F.col(text).cast("string").alias("t"))
    train = rows.filter(is_training("i") & F.col("l").isNotNull() & F.col("t").isNotNull())
    counts = train.groupBy("l").count()
    # A hash in [0, 1) of the id decides, so the sample is the same whatever the partitioning.
    unit = lambda salt: F.pmod(F.xxhash64("i", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    rates = counts.select(F.col("l").alias("_l"), F.least(F.lit(1.0), F.lit(2.0 * sample_docs) / F.col("count")).alias("rate"))
    # A row for each language value, so the texts needn't move.
    picked = train.filter(F.length("t") > 0).join(F.broadcast(rates), F.col("l") == F.col("_l")).filter(unit("sample") < F.col("rate"))
    start = (unit("place") * F.greatest(F.length("t") - PIECE, F.lit(0))).cast("int") + 1
    pieces = picked.select("l", F.struct(F.xxhash64("i").alias("h"), "i", F.expr("t").substr(start, F.lit(PIECE)).alias("t")).alias("p"))
    ranked = pieces.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy("p"))).filter(F.col("k") <= sample_docs)
    parts: dict[str, list[str]] = {}
    for r in ranked.select("l", "k", "p.t").orderBy("l", "k").toLocalIterator():
        parts.setdefault(r.l, []).append(r.t)
    budget = min(dict_bytes, max(256, total_bytes // max(1, len(parts))))
    out = {}
    for name, texts in sorted(parts.items()):
        share = max(240, budget // len(texts))
        blob = b" ".join(folded(t)[:share] for t in texts)[:budget]
        if len(blob) >= 64:
            out[name] = blob
    return out


def _compressors(dictionaries: dict[str, bytes]):
    def make():
        import zstandard as zstd

        out = []
        for name in sorted(dictionaries):
            ways = []
            for level, _ in PASSES:
                d = zstd.ZstdCompressionDict(dictionaries[name], dict_type=zstd.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                z = zstd.ZstdCompressor(
                    level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False
                )
                ways.append(z.compress)
            out.append((name, ways))
        return out

    return process_cache(("lang", tuple(sorted(dictionaries.items()))), make)


def classify(text: str | None, compressors) -> tuple[str, float, float]:
    """(language, score, margin) of one text; margin is relative to the smallest size."""
    if not text or not compressors or not _LETTER.search(text):
        return UNKNOWN, 0.0, 0.0
    if len(compressors) == 1:
        return compressors[0][0], 1.0, 1.0
    raw = folded(text)
    for k, (_, size) in enumerate(PASSES):
        chunks = [raw[i : i + size] for i in range(0, len(raw), size)]
        totals = sorted((sum(len(ways[k](c)) for c in chunks), name) for name, ways in compressors)
        best, second = totals[0][0], totals[1][0]
        margin = (second - best) / max(1, best)
        if margin >= CLOSE:
            break
    # Each further 4 bytes saved over the second halve the chance of an error, in effect.
    return totals[0][1], 1.0 - 0.5 * 2.0 ** (-min(second - best, 60) / 4), margin


def identify(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    min_margin: float = MIN_MARGIN,
) -> DataFrame:
    """``keep``, lang_pred, score (0 to 1), margin, rejected.

    One row per row of ``docs``. Null texts and texts without a letter are
    ``und`` with score 0; ties go to the language first by name; very long texts are
    compressed whole, in chunks. Without any dictionary every row is ``und``. Extra
    columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(dictionaries)
    schema = (
        ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
        + ", lang_pred string, score double, margin double, rejected boolean"
    )

    def run(batches):
        z = _compressors(shared.value)
        for b in sliced(batches):
            got = [classify(t, z) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns[: len(keep)],
                    pa.array([g[0] for g in got], pa.string()),
                    pa.array([g[1] for g in got], pa.float64()),
                    pa.array([g[2] for g in got], pa.float64()),
                    pa.array([g[2] < min_margin for g in got], pa.bool_()),
                ],
                [*keep, "lang_pred", "score", "margin", "rejected"],
            )

    return docs.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit_dictionaries(docs))
    return out.select("doc_id", held_out_column().alias("held_out"), "lang_pred", "score", "margin", "rejected")
