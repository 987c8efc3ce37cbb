"""BPE encoding and decoding through a table of distinct words.

Spark splits texts into words (Java regular expressions with Unicode classes).
A first pass counts the distinct words over all texts; the ``hot_words`` most
frequent ones are encoded once, by Spark, and become a broadcast table whose
size that parameter bounds. A second pass dictionary-encodes the words of each
Arrow batch, gets the ids of every distinct word from the table (rarer words are
encoded in the task, once per worker), and joins them back by position with one
vectorised take. Decoding joins ids with the vocabulary's id-to-piece table.

Joining *all* rare words back by position in Spark would shuffle every text once
more than the disk budget allows, hence the bound and the in-task rest.
"""
from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back_memory, process_cache, sliced, table

#: The split pattern of the byte-level pre-tokenizer.
SPLIT_PATTERN = (
    r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
HOT_WORDS = 1 << 16
#: Rarer words that a worker keeps encoded, and rows and bytes that it encodes at once: all bound its memory.
RARE_WORDS, BATCH, BATCH_BYTES = 100_000, 128, 1 << 20
SPECIAL = "<|endoftext|>"


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def words_column(text):
    """array<string>: the words of a text; special tokens are words of their own."""
    parts = F.split(text, r"(?<=<\|endoftext\|>)|(?=<\|endoftext\|>)", -1)
    plain = F.regexp_extract_all(text, F.lit(SPLIT_PATTERN), F.lit(0))
    special = F.flatten(
        F.transform(
            parts,
            lambda p: F.when(p == SPECIAL, F.array(p)).otherwise(
                F.regexp_extract_all(p, F.lit(SPLIT_PATTERN), F.lit(0))
            ),
        )
    )
    return F.when(F.instr(text, SPECIAL) > 0, special).otherwise(plain)


def _tokenizer(path: str):
    def load():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread, one malloc arena a worker
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        return t

    return process_cache(("bpe", path), load)


def _pieces(path: str) -> pa.Array:
    """The bytes of every id, by id: the id-to-piece table (fixed by the vocabulary)."""

    def load():
        t = _tokenizer(path)
        # Byte-level alphabet: printable bytes stand for themselves, the rest
        # follow from code point 256 on, in order of the byte.
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(keep)]
        to_byte = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}
        size = t.get_vocab_size()
        added = {i: x.content for i, x in t.get_added_tokens_decoder().items()}
        out = []
        for i in range(size):
            if i in added:
                out.append(added[i].encode())
            else:
                out.append(bytes(to_byte[c] for c in (t.id_to_token(i) or "")))
        return pa.array(out, pa.large_binary())

    return process_cache(("pieces", path), load)


def _encode_words(path: str, words: list[str]) -> list[list[int]]:
    encoded = _tokenizer(path).encode_batch(words, add_special_tokens=False)
    return [e.ids for e in encoded]


def distinct_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """The distinct-word table over all texts: word, n (occurrences)."""
    words = F.explode(words_column(F.col(text))).alias("word")
    return docs.select(words).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def encode_table(words: DataFrame, path: str) -> DataFrame:
    """Encode each row of a distinct-word table once: word, ids."""

    def run(batches):
        for b in sliced(batches):
            w = b.column("word")
            ids = _encode_words(path, w.to_pylist())
            yield pa.RecordBatch.from_arrays([w, pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    return words.select("word").mapInArrow(run, "word string, ids array<int>")


def encode_documents(
    docs: DataFrame,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    tokenizer_path: str | None = None,
    hot_words: int = HOT_WORDS,
    with_ids: bool = True,
    with_text: bool = False,
    with_digests: bool = False,
) -> DataFrame:
    """Token ids of whole texts, and what they decode to.

    Returns the columns ``keep`` and ``n_tokens``; with ``with_ids`` also
    ``ids array<int>``, with ``with_text`` ``decoded string``, with ``with_digests``
    ``ids_sha256`` and ``decoded_sha256``. One row per row of ``docs``. Null
    texts count as empty: no ids. Empty tables give no rows. Repeated rows are
    repeated. Extra columns are ignored, even of clashing names.
    """
    spark = docs.sparkSession
    path = tokenizer_path or default_tokenizer_path()
    source = docs.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)],
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"),
    )
    table_ = distinct_words(source, "_t").orderBy(F.desc("n"), "word").limit(hot_words)
    hot = {r.word: r.ids for r in encode_table(table_, path).toLocalIterator()}
    shared = spark.sparkContext.broadcast(hot)
    kinds = {k: docs.schema[k].dataType.simpleString() for k in keep}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + ["n_tokens bigint"])
    if with_ids:
        schema += ", ids array<int>"
    if with_text:
        schema += ", decoded string"
    if with_digests:
        schema += ", ids_sha256 string, decoded_sha256 string"
    n_keep = len(keep)

    def run(batches):
        known, rare, pieces = shared.value, {}, _pieces(path)
        out = coded = words = flat = id_lists = decoded = None
        for b in sliced(batches, BATCH, BATCH_BYTES):
            words = b.column(n_keep)
            if isinstance(words, pa.ChunkedArray):
                words = words.combine_chunks()
            flat = words.flatten()
            starts = words.offsets.to_numpy().astype(np.int64)
            starts = starts - starts[0]
            coded = flat.dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            new = [w for w in distinct if w not in known and w not in rare]
            if new:
                if len(rare) + len(new) > RARE_WORDS:
                    rare.clear()
                    new = [w for w in distinct if w not in known]
                rare.update(zip(new, _encode_words(path, new), strict=True))
            per_word = [known.get(w) or rare[w] for w in distinct]
            size = np.fromiter(map(len, per_word), np.int64, len(per_word))
            first = np.concatenate([[0], np.cumsum(size)])
            every = np.fromiter((i for x in per_word for i in x), np.int32, int(first[-1]))
            # The join by position: each word's ids, in the order of the words.
            lengths = size[index]
            ends = np.concatenate([[0], np.cumsum(lengths)])
            at = np.repeat(first[index] - ends[:-1], lengths) + np.arange(ends[-1])
            ids = every[at]
            edges = ends[starts]
            out = [b.column(i) for i in range(n_keep)] + [pa.array(np.diff(edges), pa.int64())]
            offsets = pa.array(edges, pa.int64())
            id_lists = pa.LargeListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
            decoded = pc.binary_join(
                pa.LargeListArray.from_arrays(offsets, pieces.take(pa.array(ids))),
                pa.scalar(b"", pa.large_binary()),
            )
            if with_ids:
                out.append(id_lists.cast(pa.list_(pa.int32())))
            if with_text:
                out.append(pa.array([x.as_py().decode("utf-8", "replace") for x in decoded], pa.string()))
            if with_digests:
                names = process_cache(
                    ("idnames", len(pieces)), lambda: pa.array([str(i) for i in range(len(pieces))], pa.large_string())
                )
                joined = pc.binary_join(pa.LargeListArray.from_arrays(offsets, names.take(pa.array(ids))), pa.scalar(",", pa.large_string()))
                sha = lambda a: pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in a], pa.string())
                out += [sha(joined), sha(decoded)]
            yield pa.RecordBatch.from_arrays(out, names_)
        rare.clear()
        del out, coded, words, flat, id_lists, decoded
        give_back_memory()

    names_ = [*keep, "n_tokens"] + ["ids"] * with_ids + ["decoded"] * with_text + ["ids_sha256", "decoded_sha256"] * with_digests
    split = source.select(*[f"_k{i}" for i in range(n_keep)], words_column(F.col("_t")).alias("_w"))
    return split.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return encode_documents(docs, with_ids=False, with_digests=True)
