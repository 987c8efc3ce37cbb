"""From text to annotated tokens: segment, tokenize, normalise, split, tag and lemmatise in one plan."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOKEN, segment_sentences, space_after_from_next
from ..storage import stored
from . import lexicon as L
from . import lookup as LU
from . import normalize as N
from . import tagger as TA


def train_tables(tokens: DataFrame, parts: DataFrame | None = None) -> dict:
    """What ``process_text`` needs, from annotated tokens (form, tag, lemma, reg, ...) and parts of
    contractions (form, parts, n). Written once: jobs run while this is built."""
    e = stored(L.vocab_counts(tokens, ["form", "tag", "lemma", "reg"]), "lexicon")
    return {
        "entries": e, "endings": stored(L.ending_index(e), "endings"), "types": stored(L.type_counts(e), "types"),
        "parts": parts, "model": TA.tag_model(L.transition_counts(tokens), L.case_counts(tokens), L.start_counts(tokens)),
    }


def process_text(
    docs: DataFrame, tables: dict, text: str = "text", settings: TA.Settings | None = None, normalise: bool = True, split: bool = True,
) -> DataFrame:
    """doc_id, sent_ord, tok_ord, form, space_after, norm, parts, tag, lemma: a row for each token.

    ``norm`` is the regular form, which lookups, tags and lemmas go by; ``parts`` are those of a
    contraction, joined by +. All lookups run over distinct forms and join back once.
    """
    sents = docs.select("doc_id", F.posexplode(segment_sentences(text)).alias("sent_ord", "sent"))
    s = sents.select("doc_id", "sent_ord", F.regexp_extract_all("sent", F.lit(TOKEN), F.lit(0)).alias("_f"))
    pairs = F.transform("_f", lambda x, i: F.struct(x.alias("form"), F.get("_f", i + 1).alias("nxt")))
    t = s.select("doc_id", "sent_ord", F.posexplode(pairs).alias("tok_ord", "t")).select("doc_id", "sent_ord", "tok_ord", "t.form", space_after_from_next("t.nxt").alias("space_after"))
    forms = stored(t.select("form").distinct(), "forms")
    none = F.lit(None).cast("string")
    about = forms.join(N.normalize_words(forms, tables["entries"]).select("form", "reg"), "form", "left") if normalise else forms.withColumn("reg", none)
    about = about.select("form", F.coalesce("reg", "form").alias("norm"))
    if split and tables.get("parts") is not None:
        about = about.join(LU.split_contraction(forms, tables["parts"]), "form", "left")
    else:
        about = about.withColumn("parts", none)
    about = stored(about, "about-forms")
    known = tables["entries"].groupBy("form", "tag").agg(F.sum("n").alias("n"))
    cells = LU.candidate_lattice(about.select(F.col("norm").alias("form")).distinct(), known, tables["endings"], tables["types"])
    words = t.join(about, "form").select("doc_id", "sent_ord", "tok_ord", F.col("norm").alias("form"), F.col("form").alias("surface"), "space_after", "parts")
    tagged = TA.viterbi_tag(words, cells, tables["model"], settings, carry=("surface", "space_after", "parts")).withColumnRenamed("pred", "tag")
    tagged = stored(tagged, "tagged")
    lemmas = LU.lemma_lookup(tagged, tables["entries"].groupBy("form", "tag", "lemma").agg(F.sum("n").alias("n")))
    out = tagged.join(lemmas, ["form", "tag"], "left")
    return out.select("doc_id", "sent_ord", "tok_ord", F.col("surface").alias("form"), "space_after", F.col("form").alias("norm"), "parts", "tag", F.col("guess").alias("lemma"))
