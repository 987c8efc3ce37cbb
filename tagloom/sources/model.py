"""Lexicon models as JSON documents, in and out."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRY = "array<struct<lemma:string,xpos:string,upos:string,feats:string,count:bigint,reg:string>>"
SCHEMA = f"vocab map<string,{ENTRY}>, transitions map<string,map<string,map<string,bigint>>>, settings map<string,string>"


def vocab_lines(entries: DataFrame) -> DataFrame:
    """value: a JSON line ``{form, entries}`` of each form. A model of any size is
    many lines, written in parallel, not one object."""
    e = F.struct("lemma", "xpos", F.col("tag").alias("upos"), "feats", F.col("n").alias("count"), "reg")
    g = entries.groupBy("form").agg(F.array_sort(F.collect_list(e)).alias("entries"))
    return g.select(F.to_json(F.struct("form", "entries")).alias("value"))


def read_vocab_lines(lines: DataFrame) -> DataFrame:
    """form, lemma, xpos, tag, feats, reg, n; entries without a tag are dropped, and of
    entries with equal tag and lemma the most frequent stays."""
    v = lines.select(F.from_json("value", f"form string, entries {ENTRY}").alias("v")).select("v.form", F.explode("v.entries").alias("e"))
    t = v.select("form", "e.lemma", "e.xpos", F.col("e.upos").alias("tag"), "e.feats", "e.reg", F.col("e.count").alias("n")).filter("tag IS NOT NULL AND tag <> ''")
    best = t.groupBy("form", "tag", "lemma").agg(F.max_by(F.struct("xpos", "feats", "reg", "n"), F.struct("n", "xpos", "feats", "reg")).alias("b"))
    return best.select("form", "lemma", "b.xpos", "tag", "b.feats", "b.reg", "b.n")


def read_model_json(documents: DataFrame) -> DataFrame:
    """Lexicon rows of whole-model JSON objects in ``value``."""
    v = documents.select(F.from_json("value", SCHEMA).alias("m")).select(F.explode("m.vocab").alias("form", "es"))
    return v.select("form", F.explode("es").alias("e")).select("form", "e.lemma", "e.xpos", F.col("e.upos").alias("tag"), "e.feats", "e.reg", F.col("e.count").alias("n"))


def read_model_xml(documents: DataFrame, path: str = "./lexicon/item") -> DataFrame:
    """key, attrs of the entries of XML models in ``value``: the elements at ``path`` and,
    nested in them, their analyses; broken XML has none."""
    import pandas as pd

    def run(frames):
        import xml.etree.ElementTree as ET

        for f in frames:
            rows = []
            for xml in f["value"]:
                try:
                    root = ET.fromstring(xml)
                except ET.ParseError:
                    continue
                for item in root.findall(path):
                    for e in list(item) or [item]:
                        rows.append((item.get("key"), {k: v for k, v in e.attrib.items() if k != "key" or e is not item}))
            yield pd.DataFrame(rows, columns=["key", "attrs"])

    return documents.select("value").mapInPandas(run, "key string, attrs map<string,string>")
