"""Lemma rules: star patterns that turn a word into its lemma."""
from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def make_rule(word: str, lemma: str) -> str:
    """``word#lemma`` patterns in which ``*`` is what both share: walked, walk: ``*ed#*``."""
    if word == lemma:
        return "*#*"
    w_mark, l_mark = list(word), list(lemma)
    at = 0
    for i, c in enumerate(lemma):
        j = word.find(c, at)
        if j >= 0:
            w_mark[j] = l_mark[i] = "*"
            at = j + 1
    squeeze = lambda s: re.sub(r"\*+", "*", "".join(s))
    return f"{squeeze(w_mark)}#{squeeze(l_mark)}"


def apply_rule(word: str, rule: str) -> str:
    """The lemma that a rule gives for a word; empty where it doesn't fit."""
    pattern, _, lemma = rule.partition("#")
    if pattern == lemma == "*":
        return word
    parts = pattern.split("*")
    m = re.fullmatch("(.+)".join(map(re.escape, parts)), word, re.S)
    if not m:
        return ""
    stems = iter(m.groups())
    out = []
    for k, p in enumerate(lemma.split("*")):
        if k:
            stem = next(stems, None)
            if stem is None:
                return ""
            out.append(stem)
        out.append(p)
    return "" if next(stems, None) is not None else "".join(out)


@F.pandas_udf(StringType())
def make_lemma_rule(word: pd.Series, lemma: pd.Series) -> pd.Series:
    return pd.Series([make_rule(w, x) if w and x else None for w, x in zip(word, lemma)])


@F.pandas_udf(StringType())
def apply_lemma_rule(word: pd.Series, rule: pd.Series) -> pd.Series:
    return pd.Series([apply_rule(w, r) if w and r else "" for w, r in zip(word, rule)])


def rule_table(entries: DataFrame, longest: int = 6) -> DataFrame:
    """ending, tag, rule, n: rules of the lexicon's entries by their endings."""
    r = entries.select("tag", "form", make_lemma_rule(F.lower("form"), "lemma").alias("rule"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.char_length("form")))
    e = r.select("tag", "rule", F.explode(F.transform(sizes, lambda k: F.right(F.lower("form"), k))).alias("ending"))
    return e.groupBy("ending", "tag", "rule").agg(F.count(F.lit(1)).alias("n"))


def refine_lemma(forms: DataFrame, rules: DataFrame, longest: int = 6) -> DataFrame:
    """form, tag, guess: by the most frequent applicable rule (ties: by its text) of the
    longest proper suffix that has rules for the tag; else the lower case."""
    low = F.lower("form")
    sizes = F.filter(F.sequence(F.lit(1), F.lit(longest)), lambda k: k < F.char_length("form"))
    s = forms.select("form", "tag", F.explode(F.transform(sizes, lambda k: F.right(low, k))).alias("ending"))
    known = s.join(rules.select("ending", "tag").distinct(), ["ending", "tag"])
    w = Window.partitionBy("form", "tag").orderBy(F.desc(F.char_length("ending")))
    best = known.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")
    tried = best.join(rules, ["ending", "tag"]).withColumn("made", apply_lemma_rule(F.lower("form"), "rule")).filter("made <> ''")
    w2 = Window.partitionBy("form", "tag").orderBy(F.desc("n"), "rule")
    top = tried.withColumn("k", F.row_number().over(w2)).filter("k = 1").select("form", "tag", "made")
    return forms.join(top, ["form", "tag"], "left").select("form", "tag", F.coalesce("made", low).alias("guess"))
