"""Training: lexicon, transitions, endings and other counts from annotated tokens.

Every count is a grouped aggregate with partial aggregation before the shuffle.
Tokens are rows with doc_id, sent_ord, tok_ord, form, tag and so on.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import form_case

ENTRY = ("form", "lemma", "xpos", "tag", "feats", "reg")


def n(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


def vocab_counts(tokens: DataFrame, by=ENTRY) -> DataFrame:
    return tokens.groupBy(*by).agg(n())


def with_previous_tag(tokens: DataFrame) -> DataFrame:
    """prev_tag: the tag before, in the sentence; null for the first."""
    w = Window.partitionBy("doc_id", "sent_ord").orderBy("tok_ord")
    return tokens.withColumn("prev_tag", F.lag("tag").over(w))


def transition_counts(tokens: DataFrame) -> DataFrame:
    """(prev, next, n) over neighbours in a sentence; pairs with an empty side are dropped."""
    pairs = with_previous_tag(tokens).filter("prev_tag IS NOT NULL AND prev_tag <> '' AND tag <> ''")
    return pairs.groupBy(F.col("prev_tag").alias("prev"), F.col("tag").alias("next")).agg(n())


def start_counts(tokens: DataFrame) -> DataFrame:
    return tokens.filter("tok_ord = 0").groupBy("tag").agg(n())


def case_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("tag", form_case("form").alias("wcase")).agg(n())


def vocab_stats(tokens: DataFrame) -> DataFrame:
    return tokens.agg(
        F.count_distinct("form").alias("total_entries"),
        F.count_distinct("doc_id", "sent_ord").alias("sentences"),
        n("tokens"),
    )


def ending_index(entries: DataFrame, longest: int = 6) -> DataFrame:
    """(ending, tag, n): for each suffix of 1 to ``longest`` characters, the entries
    (types, not tokens) of each tag that have it. Built from the lexicon."""
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.char_length("form")))
    return entries.select("tag", F.explode(F.transform(sizes, lambda k: F.right("form", k))).alias("ending")).groupBy("ending", "tag").agg(n())


def type_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("tag").agg(F.count_distinct("form").alias("n_types"))


def form_frequency(entries: DataFrame) -> DataFrame:
    return entries.groupBy("form").agg(F.sum("n").alias("freq"))


def dominant_reg(entries: DataFrame, share: float = 0.2) -> DataFrame:
    """The top regularised form of each form that has one, if it outnumbers the plain
    uses, or the plain uses are under ``share`` of all."""
    by = entries.groupBy("form", "reg").agg(F.sum("n").alias("n"))
    plain = F.sum(F.when(F.col("reg") == "", F.col("n")).otherwise(0))
    top = F.max(F.when(F.col("reg") != "", F.struct("n", "reg")))
    g = by.groupBy("form").agg(plain.alias("plain"), top.alias("top"), F.sum("n").alias("total"))
    return g.filter((F.col("top.n") > F.col("plain")) | (F.col("plain") < share * F.col("total"))).filter("top IS NOT NULL").select("form", F.col("top.reg").alias("reg"), F.col("top.n").alias("n"))


def suffix_evidence(pairs: DataFrame, least: int = 5) -> DataFrame:
    """Suffixes of 1 to 4 characters that form and reg share over different stems."""
    sizes = F.sequence(F.lit(1), F.lit(4))
    s = pairs.select("form", "reg", F.explode(sizes).alias("k")).filter(
        (F.char_length("form") > F.col("k")) & (F.char_length("reg") > F.col("k")) & (F.right("form", F.col("k")) == F.right("reg", F.col("k")))
    )
    stem = lambda c: F.left(c, F.char_length(c) - F.col("k"))
    return s.filter(stem("form") != stem("reg")).groupBy(F.right("form", F.col("k")).alias("suffix")).agg(n()).filter(F.col("n") >= least)


def substitution_patterns(pairs: DataFrame, least: int = 10) -> DataFrame:
    """(old, new, n): character differences, place by place, of equally long pairs."""
    same = pairs.filter(F.char_length("form") == F.char_length("reg"))
    z = F.arrays_zip(F.split("form", "").alias("old"), F.split("reg", "").alias("new"))
    d = same.select(F.explode(z).alias("z")).select("z.old", "z.new").filter("old <> new")
    return d.groupBy("old", "new").agg(n()).filter(F.col("n") >= least)


def merge_lexicons(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts add up; a's columns decide."""
    keys = [c for c in a.columns if c != "n"]
    return a.unionByName(b.select(*a.columns)).groupBy(*keys).agg(F.sum("n").alias("n"))


def tag_mapping_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("xpos", "tag", "feats").agg(F.sum(F.greatest(F.col("n"), F.lit(1))).alias("n"))


def xpos_histogram(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("xpos").agg(n())


def most_common(counts: DataFrame, key: str, value: str, count: str = "n") -> DataFrame:
    """The value of greatest count for each key; ties go to the greatest value."""
    return counts.groupBy(key).agg(F.max_by(value, F.struct(count, value)).alias(value), F.max(count).alias(count))


def emission_probabilities(entries: DataFrame, smooth: float = 0.1) -> DataFrame:
    """P(tag | form), add-``smooth`` over the tags of the form."""
    by = entries.groupBy("form", "tag").agg(F.sum("n").alias("n"))
    total = by.groupBy("form").agg(F.sum("n").alias("total"), n("tags"))
    p = (F.col("n") + smooth) / (F.col("total") + smooth * F.col("tags"))
    return by.join(total, "form").select("form", "tag", p.alias("p"))


def transition_probabilities(transitions: DataFrame) -> DataFrame:
    w = Window.partitionBy("prev")
    return transitions.select("prev", "next", (F.col("n") / F.sum("n").over(w)).alias("p"))


def train_model(tokens: DataFrame) -> dict[str, DataFrame]:
    """The model tables: lexicon, transitions, starts, cases, endings, types."""
    lexicon = vocab_counts(tokens)
    return {
        "lexicon": lexicon, "transitions": transition_counts(tokens), "starts": start_counts(tokens),
        "cases": case_counts(tokens), "endings": ending_index(lexicon), "types": type_counts(lexicon),
    }


def mwt_parts(contractions: DataFrame) -> DataFrame:
    """form, parts, n: the ways a form was split, with counts."""
    return contractions.groupBy("form", "parts").agg(n())
