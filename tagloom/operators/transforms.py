"""Row-shape transforms of token tables: filters, fills, merges, ids."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import missing

ANNOTATED = ("lemma", "tag", "xpos", "feats", "deprel")


def detag(tokens: DataFrame, columns=ANNOTATED) -> DataFrame:
    return tokens.withColumns({c: F.lit("_") for c in columns})


def filter_by_tasks(tokens: DataFrame, tasks: set[str]) -> DataFrame:
    """Columns of tasks that weren't asked for become null."""
    owner = {"lemma": "lemmatize", "tag": "tag", "xpos": "tag", "feats": "tag", "head": "parse", "deprel": "parse", "reg": "normalize"}
    drop = {c: F.lit(None).cast(tokens.schema[c].dataType) for c, t in owner.items() if t not in tasks and c in tokens.columns}
    return tokens.withColumns(drop) if drop else tokens


def has_annotation(tokens: DataFrame, column: str) -> DataFrame:
    return tokens.groupBy("doc_id", "sent_ord").agg(F.coalesce(F.bool_or(missing(column).isNotNull()), F.lit(False)).alias("has"))


def detect_tasks(tokens: DataFrame, columns=("lemma", "tag", "feats", "deprel", "reg")) -> DataFrame:
    return tokens.groupBy("doc_id").agg(*[F.coalesce(F.bool_or(missing(c).isNotNull()), F.lit(False)).alias(f"has_{c}") for c in columns])


def effective_form(form="form", reg="reg"):
    return F.coalesce(missing(reg), F.col(form))


def apply_form_strategy(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("form", effective_form())


def propagate_sentence_ids(target: DataFrame, source: DataFrame) -> DataFrame:
    """target sentences (doc_id, sent_ord) get source's sent_id where both have as many."""
    n = lambda t, name: t.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    same = n(target, "a").join(n(source, "b"), "doc_id").filter("a = b").select("doc_id")
    ids = source.join(same, "doc_id", "left_semi").select("doc_id", "sent_ord", "sent_id")
    return target.join(ids, ["doc_id", "sent_ord"], "left")


def propagate_token_ids(target: DataFrame, source: DataFrame) -> DataFrame:
    return target.join(source.select("doc_id", "sent_ord", "tok_ord", "tokid"), ["doc_id", "sent_ord", "tok_ord"], "left")


def dedupe_ids(tokens: DataFrame, order=("sent_ord", "tok_ord")) -> DataFrame:
    """The n-th of a repeated id in a document gets ``-n``."""
    w = Window.partitionBy("doc_id", "tokid").orderBy(*order)
    k = F.row_number().over(w)
    return tokens.withColumn("tokid", F.when(k > 1, F.concat_ws("-", "tokid", k.cast("string"))).otherwise(F.col("tokid")))


def duplicate_ordinal(tokens: DataFrame, order=("sent_ord", "tok_ord")) -> DataFrame:
    return tokens.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id", "tokid").orderBy(*order)))


def sentence_correspondence(sentences: DataFrame, tokens: DataFrame) -> DataFrame:
    """tokid, sent_ord: tokens pulled by ``corresp`` lists (``#w-1 #w-2``); the last claim wins."""
    claims = sentences.select("doc_id", "sent_ord", F.explode(F.split(F.trim("corresp"), "[ ,]+")).alias("ref"))
    claims = claims.select("doc_id", "sent_ord", F.regexp_replace("ref", "^#", "").alias("tokid"))
    last = claims.groupBy("doc_id", "tokid").agg(F.max("sent_ord").alias("claimed"))
    t = tokens.join(last, ["doc_id", "tokid"], "left")
    return t.withColumn("sent_ord", F.coalesce("claimed", "sent_ord")).drop("claimed")


def infer_space_after(tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """space_after by where forms are found in the sentence's text: followed by a space."""
    from .spans import token_offsets

    o = token_offsets(tokens, texts)
    follow = F.substring(F.col("text"), F.col("end").cast("int") + 1, F.lit(1))
    j = o.join(texts, ["doc_id", "sent_ord"])
    return j.select("doc_id", "sent_ord", "tok_ord", F.when((follow != "") & F.col("end").isNotNull(), follow.rlike(r"^\s")).alias("space_after"))


def _runs(tokens: DataFrame, rule) -> DataFrame:
    import pandas as pd

    g = tokens.groupBy("doc_id", "sent_ord").agg(F.array_sort(F.collect_list(F.struct("tok_ord", "form", "space_after"))).alias("ts"))

    def run(frames):
        for f in frames:
            rows = []
            for r in f.itertuples():
                ts = list(r.ts)
                for a, b in rule(ts):
                    rows.append((r.doc_id, r.sent_ord, ts[a]["tok_ord"], ts[b]["tok_ord"], "".join(t["form"] for t in ts[a : b + 1])))
            yield pd.DataFrame(rows, columns=["doc_id", "sent_ord", "first", "last", "form"])

    return g.mapInPandas(run, "doc_id bigint, sent_ord int, first int, last int, form string")


def _punct(s: str) -> bool:
    return not any(c.isalnum() for c in s)


def implicit_mwt(tokens: DataFrame) -> DataFrame:
    """doc_id, sent_ord, first, last, form: runs of two or more tokens without space
    between them. A run with punctuation counts only as two tokens around an
    apostrophe or as words around inner hyphens; else the next token starts anew."""

    def rule(ts):
        i = 0
        while i < len(ts):
            j = i
            while j + 1 < len(ts) and ts[j]["space_after"] is not None and not ts[j]["space_after"]:
                j += 1
            if j > i:
                forms = [t["form"] for t in ts[i : j + 1]]
                marks = [_punct(x) for x in forms]
                hyphens = not marks[0] and not marks[-1] and all(x == "-" for x, m in zip(forms, marks) if m)
                apostrophe = len(forms) == 2 and any(x[:1] in "'’" or x[-1:] in "'’" for x in forms) and not all(marks)
                if not any(marks) or hyphens or apostrophe:
                    yield i, j
                    i = j + 1
                    continue
            i += 1

    return _runs(tokens, rule)


def merge_contractions(tokens: DataFrame) -> DataFrame:
    """Greedy pairs, from the left, of neighbouring words without space between them."""

    def rule(ts):
        i = 0
        while i + 1 < len(ts):
            glued = ts[i]["space_after"] is not None and not ts[i]["space_after"]
            if glued and not _punct(ts[i]["form"]) and not _punct(ts[i + 1]["form"]):
                yield i, i + 1
                i += 2
            else:
                i += 1

    return _runs(tokens, rule)


def preserve_existing_tags(candidates: DataFrame) -> DataFrame:
    """Candidates (tag, feats) that agree with the token's own (own_tag, own_feats)."""
    own = F.coalesce(missing("own_tag"), F.col("tag")) == F.col("tag")
    feats = F.size(F.array_except(F.filter(F.split(F.coalesce("own_feats", F.lit("")), r"\|"), lambda x: (x != "") & (x != "_")), F.split(F.col("feats"), r"\|"))) == 0
    return candidates.filter(own & feats)


def doc_id_from_path(path):
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def validate(tokens: DataFrame) -> DataFrame:
    """doc_id, sent_ord, problem: repeated ids, heads out of range, roots other than one."""
    g = tokens.groupBy("doc_id", "sent_ord").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("tok_ord").alias("ids"), F.count_if(F.col("head") == 0).alias("roots"), F.max("head").alias("top"), F.min("head").alias("low")
    )
    problems = F.array(
        F.when(F.col("ids") != F.col("n"), "repeated id"), F.when((F.col("top") > F.col("n")) | (F.col("low") < 0), "head out of range"), F.when(F.col("roots") != 1, "not one root")
    )
    return g.select("doc_id", "sent_ord", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))
