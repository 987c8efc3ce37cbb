"""CoNLL-U in and out, as column expressions.

Reading: files come whole (a row each); blocks, lines and fields explode from
arrays, so nothing shuffles but the running count of documents in a file.
Missing values are null inside, ``_`` outside. Decisions on doubtful inputs: empty
nodes (``8.1``) are dropped; a HEAD that is no number is 0; the last token of a
sentence has a null space_after unless it says SpaceAfter=No.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.feats import extract_misc
from ..functions.text import escape

FIELDS = ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")


def read_conllu_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.conllu").text(path)
    return read_conllu(files.select(F.col("_metadata.file_path").alias("file"), "value"))


def sentence_blocks(files: DataFrame, strip_newdoc_ids: bool = False) -> DataFrame:
    """file, block_ord, lines, doc_ord, doc_id, sent_id, text, attrs of ``file, value``."""
    text = F.regexp_replace("value", r"\r\n?", "\n")
    if strip_newdoc_ids:
        text = F.regexp_replace(text, r"(?m)^# newdoc.*$", "# newdoc")
    b = files.select("file", F.posexplode(F.split(text, r"\n[ \t]*\n")).alias("block_ord", "block"))
    b = b.withColumn("lines", F.filter(F.split("block", "\n"), lambda x: F.trim(x) != "")).filter(F.size("lines") > 0)
    notes = F.filter("lines", lambda x: x.startswith("#"))
    pairs = F.transform(F.filter(notes, lambda x: x.contains("=")), lambda x: F.struct(F.trim(F.regexp_extract(x, r"^#\s*([^=]*)=", 1)).alias("k"), F.trim(F.regexp_extract(x, r"=(.*)$", 1)).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    attrs = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), 1)["v"]))
    new = F.exists(notes, lambda x: x.rlike(r"^#\s*newdoc\b"))
    b = b.select("file", "block_ord", "lines", attrs.alias("attrs"), new.cast("int").alias("_new"))
    w = Window.partitionBy("file").orderBy("block_ord").rowsBetween(Window.unboundedPreceding, 0)
    said = F.last(F.when(F.col("_new") == 1, F.coalesce(F.col("attrs")["newdoc id"], F.lit(""))), ignorenulls=True).over(w)
    stem = F.regexp_extract("file", r"([^/]*?)(\.[^./]*)?$", 1)
    b = b.withColumn("doc_ord", F.greatest(F.sum("_new").over(w), F.lit(1)).cast("int")).withColumn("doc_id", F.coalesce(F.nullif(said, F.lit("")), stem))
    return b.drop("_new").withColumn("sent_id", F.col("attrs")["sent_id"]).withColumn("text", F.col("attrs")["text"])


def _token(f: Column) -> Column:
    at = lambda i: F.coalesce(F.get(f, F.lit(i)), F.lit("_"))
    value = lambda i: F.when((at(i) != "_") & (at(i) != ""), at(i))
    misc = at(9)
    key = lambda k: F.nullif(extract_misc(misc, k), F.lit(""))
    return F.struct(
        F.regexp_extract(at(0), r"^\d+", 0).try_cast("int").alias("tok_id"),
        F.regexp_extract(at(0), r"^\d+-(\d+)$", 1).try_cast("int").alias("mwt_end"),
        at(1).alias("form"), value(2).alias("lemma"), value(3).alias("upos"), value(4).alias("xpos"), value(5).alias("feats"),
        F.coalesce(at(6).try_cast("int"), F.lit(0)).alias("head"), value(7).alias("deprel"), value(8).alias("deps"), value(9).alias("misc"),
        (~misc.rlike(r"(^|[|])SpaceAfter=No($|[|])")).alias("space_after"),
        F.coalesce(key("Normalization"), key("ModernForm")).alias("reg"), key("Expansion").alias("expan"), key("TokId").alias("tokid"), key("LTransLit").alias("ltranslit"),
    )


def read_conllu(files: DataFrame, strip_newdoc_ids: bool = False) -> DataFrame:
    """A row for each token: file, doc_ord, doc_id, sent_ord, sent_id, tok_ord and fields.

    A range line is one token (is_mwt) whose ``subtokens`` are its words; words
    outside ranges are tokens by themselves, with empty ``subtokens``.
    """
    b = sentence_blocks(files, strip_newdoc_ids)
    number = lambda x, k: F.regexp_extract(x, r"^(\d+)(?:-(\d+))?\t", k).try_cast("int")
    kept = F.filter("lines", lambda x: x.rlike(r"^\d+(-\d+)?\t"))
    b = b.select("file", "block_ord", "doc_ord", "doc_id", "sent_id", kept.alias("_l")).filter(F.size("_l") > 0)
    ranges = F.transform(F.filter("_l", lambda x: x.rlike(r"^\d+-")), lambda x: F.struct(number(x, 1).alias("a"), number(x, 2).alias("b")))
    b = b.withColumn("_r", ranges)
    covered = lambda x: F.exists("_r", lambda r: (number(x, 1) >= r["a"]) & (number(x, 1) <= r["b"]))
    top = F.when(F.size("_r") > 0, F.filter("_l", lambda x: x.rlike(r"^\d+-") | ~covered(x))).otherwise(F.col("_l"))
    w = Window.partitionBy("file", "doc_ord").orderBy("block_ord")
    b = b.withColumn("_top", top).withColumn("sent_ord", (F.row_number().over(w) - 1).cast("int"))
    words = F.when(F.size("_r") > 0, F.col("_l")).otherwise(F.slice("_l", 1, 0))  # only ranges need the other lines
    keep = ["file", "doc_ord", "doc_id", "sent_ord", "sent_id"]
    t = b.select(*keep, words.alias("_words"), F.size("_top").alias("_n"), F.posexplode("_top").alias("tok_ord", "_line"))
    t = t.withColumn("_f", F.split("_line", "\t")).withColumn("t", _token(F.col("_f")))
    is_mwt = F.col("t.mwt_end").isNotNull()
    inside = F.filter("_words", lambda x: ~x.rlike(r"^\d+-") & (number(x, 1) >= F.col("t.tok_id")) & (number(x, 1) <= F.col("t.mwt_end")))
    parts = F.transform(inside, lambda x: _token(F.split(x, "\t")))
    last = F.col("tok_ord") == F.col("_n") - 1
    return t.select(
        *keep, "tok_ord", "t.tok_id", is_mwt.alias("is_mwt"),
        "t.form", "t.lemma", "t.upos", "t.xpos", "t.feats", "t.head", "t.deprel", "t.deps", "t.misc",
        F.when(last & F.col("t.space_after"), None).otherwise(F.col("t.space_after")).alias("space_after"),
        "t.reg", "t.expan", "t.tokid", "t.ltranslit", parts.alias("subtokens"),
    )


def explode_atomic(tokens: DataFrame) -> DataFrame:
    """Words: a token's subtokens if it has any, else the token."""
    one = F.array(F.struct("tok_id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel"))
    names = ("tok_id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel")
    words = F.transform("subtokens", lambda s: F.struct(*[s[n].alias(n) for n in names]))
    out = tokens.select("file", "doc_ord", "doc_id", "sent_ord", F.explode(F.when(F.size("subtokens") > 0, words).otherwise(one)).alias("w"))
    return out.select("file", "doc_ord", "doc_id", "sent_ord", "w.*")


def format_misc(pairs: list[Column]) -> Column:
    """``K=V`` columns joined; nulls are left out; nothing: ``_``."""
    return escape(F.array_join(F.filter(F.array(*pairs), lambda x: x.isNotNull()), "|"))


def standard_misc(reg="reg", space_after="space_after", tokid=None, last=None) -> Column:
    reg, space_after = (F.col(c) if isinstance(c, str) else c for c in (reg, space_after))
    no_space = ~space_after if last is None else ~space_after & ~last
    parts = [F.when(F.coalesce(reg, F.lit("")) != "", F.concat(F.lit("Normalization="), reg))]
    if tokid is not None:
        t = F.col(tokid) if isinstance(tokid, str) else tokid
        parts.append(F.when(t.isNotNull() & ~t.rlike(r"^s\d+-t\d+$"), F.concat(F.lit("TokId="), t)))
    parts.append(F.when(no_space, F.lit("SpaceAfter=No")))
    return format_misc(parts)


def format_token_line(tok_id, form, lemma, upos, xpos, feats, head, deprel, deps, misc) -> Column:
    """Ten tab-joined columns; nulls and empty strings are ``_``."""
    cells = [F.col(c) if isinstance(c, str) else c for c in (tok_id, form, lemma, upos, xpos, feats, head, deprel, deps, misc)]
    return F.concat_ws("\t", *[F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("_")) for c in cells])


def nest_sentences(tokens: DataFrame) -> DataFrame:
    """doc_id, sents of a token table: one shuffle by document. Tables that still have their
    documents' arrays need none (``sents`` is the same there)."""
    g = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_ord", "tok_ord", *[c for c in tokens.columns if c not in ("doc_id", "sent_ord", "tok_ord")]))).alias("ts"))
    ords = F.array_sort(F.array_distinct(F.col("ts.sent_ord")))
    return g.select("doc_id", F.transform(ords, lambda o: F.struct(o.alias("sent_ord"), F.filter("ts", lambda t: t["sent_ord"] == o).alias("ts"))).alias("sents"))


def sentence_block(doc_id, sent) -> Column:
    """Comments and token lines of a sentence (sent_ord, ts)."""
    def line(t):
        cells = [(t["tok_ord"] + 1).cast("string"), *[t[c].cast("string") for c in ("form", "lemma", "tag", "xpos", "feats", "head", "deprel")], F.lit(None), standard_misc(t["reg"], t["space_after"])]
        return format_token_line(*cells)

    ts = sent["ts"]
    text = F.trim(F.array_join(F.transform(ts, lambda t: F.concat(t["form"], F.when(t["space_after"], " ").otherwise(""))), ""))
    sent_id = F.concat_ws("-", F.col(doc_id).cast("string"), (sent["sent_ord"] + 1).cast("string"))
    return F.concat(F.lit("# sent_id = "), sent_id, F.lit("\n# text = "), text, F.lit("\n"), F.array_join(F.transform(ts, line), "\n"))


def format_sentences(nested: DataFrame) -> DataFrame:
    """doc_id, sent_ord, block: comments and token lines of each sentence of (doc_id, sents)."""
    s = nested.select("doc_id", F.explode("sents").alias("s"))
    return s.select("doc_id", F.col("s.sent_ord").alias("sent_ord"), sentence_block("doc_id", F.col("s")).alias("block"))


def write_conllu(nested: DataFrame) -> DataFrame:
    """doc_id, value: each document's CoNLL-U text, made in its own row of (doc_id, sents)."""
    body = F.array_join(F.transform("sents", lambda s: sentence_block("doc_id", s)), "\n\n")
    return nested.select("doc_id", F.concat(F.lit("# newdoc id = "), F.col("doc_id").cast("string"), F.lit("\n"), body, F.lit("\n\n")).alias("value"))


def detag_lines(lines: Column) -> Column:
    """Token lines with columns 3 to 9 blanked, but range lines and comments."""
    blank = lambda x: F.array_join(F.transform(F.split(x, "\t"), lambda c, i: F.when((i >= 2) & (i <= 8), "_").otherwise(c)), "\t")
    return F.transform(lines, lambda x: F.when(x.startswith("#") | x.rlike(r"^\d+-\d+\t") | (x == ""), x).otherwise(blank(x)))


def with_normalized_form(lines: Column) -> Column:
    """Token lines whose FORM is the MISC Normalization, where there is one."""
    def one(x):
        norm = F.nullif(F.nullif(extract_misc(F.get(F.split(x, "\t"), F.lit(9)), "Normalization"), F.lit("")), F.lit("_"))
        return F.array_join(F.transform(F.split(x, "\t"), lambda c, i: F.when((i == 1) & norm.isNotNull(), norm).otherwise(c)), "\t")

    return F.transform(lines, lambda x: F.when(x.startswith("#") | (x == ""), x).otherwise(one(x)))
