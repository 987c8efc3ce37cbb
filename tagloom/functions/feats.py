"""Features, tags and other key-value strings as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def feats_array(c) -> Column:
    """The well-formed, trimmed pairs of ``K=V|K=V``; ``_`` and null have none."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), r"\|"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: (p != "_") & p.contains("="))


def normalize_feats(c) -> Column:
    """Sorted pairs; duplicates stay; ``_`` if there are none."""
    return F.coalesce(F.nullif(F.array_join(F.array_sort(feats_array(c)), "|"), F.lit("")), F.lit("_"))


def feats_to_map(c) -> Column:
    """map<string,string>; of a repeated key the last value wins."""
    pairs = F.transform(feats_array(c), lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("k"), F.substring(p, F.locate("=", p) + 1, F.length(p)).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def feats_partial_match(gold, pred) -> Column:
    """pred is a subset of gold; both empty: true; only pred empty: false."""
    g, p = feats_array(gold), feats_array(pred)
    return F.when(F.size(p) == 0, F.size(g) == 0).otherwise(F.size(F.array_except(p, g)) == 0)


def feats_match_script(gold, pred) -> Column:
    """The opposite direction: gold is a subset of pred; empty gold: true."""
    return F.size(F.array_except(feats_array(gold), feats_array(pred))) == 0


def subset_of(target, candidate) -> Column:
    return F.size(F.array_except(feats_array(target), feats_array(candidate))) == 0


def compose_tag(xpos, upos, feats, attribute: str = "utot") -> Column:
    if attribute in ("xpos", "upos"):
        return col(xpos if attribute == "xpos" else upos)
    return F.concat_ws("#", col(upos), F.nullif(col(feats), F.lit("_")))


def extract_misc(misc, key: str) -> Column:
    return F.regexp_extract(col(misc), rf"(?:^|[|]){key}=([^|]*)", 1)


def parse_key_values(c, sep: str = ",") -> Column:
    return F.map_from_entries(
        F.transform(
            F.filter(F.split(col(c), sep), lambda p: p.contains("=")),
            lambda p: F.struct(F.trim(F.split_part(p, F.lit("="), F.lit(1))), F.trim(F.split_part(p, F.lit("="), F.lit(2)))),
        )
    )


#: UniMorph codes and the UPOS tags and features they stand for.
UNIMORPH_POS = {
    "N": "NOUN", "PROPN": "PROPN", "V": "VERB", "V.PTCP": "VERB", "V.CVB": "VERB", "V.MSDR": "VERB", "ADJ": "ADJ",
    "ADV": "ADV", "PRO": "PRON", "DET": "DET", "ADP": "ADP", "AUX": "AUX", "NUM": "NUM", "PART": "PART",
    "CONJ": "CCONJ", "INTJ": "INTJ",
}
UNIMORPH_FEATS = {
    "SG": "Number=Sing", "PL": "Number=Plur", "DU": "Number=Dual", "NOM": "Case=Nom", "ACC": "Case=Acc", "GEN": "Case=Gen",
    "DAT": "Case=Dat", "LOC": "Case=Loc", "INS": "Case=Ins", "VOC": "Case=Voc", "ABL": "Case=Abl", "MASC": "Gender=Masc",
    "FEM": "Gender=Fem", "NEUT": "Gender=Neut", "1": "Person=1", "2": "Person=2", "3": "Person=3", "PST": "Tense=Past",
    "PRS": "Tense=Pres", "FUT": "Tense=Fut", "IND": "Mood=Ind", "SBJV": "Mood=Sub", "IMP": "Mood=Imp", "COND": "Mood=Cnd",
    "NFIN": "VerbForm=Inf", "FIN": "VerbForm=Fin", "V.PTCP": "VerbForm=Part", "V.CVB": "VerbForm=Conv", "ACT": "Voice=Act",
    "PASS": "Voice=Pass", "CMPR": "Degree=Cmp", "SPRL": "Degree=Sup", "PFV": "Aspect=Perf", "IPFV": "Aspect=Imp",
    "DEF": "Definite=Def", "INDF": "Definite=Ind", "NEG": "Polarity=Neg", "POS": "Polarity=Pos",
}


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def unimorph_to_ud(codes) -> Column:
    """struct<upos, feats> of ``;``-separated codes; unknown: upos X, feats ``_``."""
    parts = F.transform(F.split(col(codes), ";"), lambda p: F.upper(F.trim(p)))
    upos = F.element_at(F.filter(F.transform(parts, lambda p: _lookup(UNIMORPH_POS)[p]), lambda p: p.isNotNull()), 1)
    feats = F.filter(F.transform(parts, lambda p: _lookup(UNIMORPH_FEATS)[p]), lambda p: p.isNotNull())
    first = F.when(F.size(F.filter(F.transform(parts, lambda p: _lookup(UNIMORPH_POS)[p]), lambda p: p.isNotNull())) > 0, upos).otherwise(F.lit("X"))
    joined = F.coalesce(F.nullif(F.array_join(F.array_sort(F.array_distinct(feats)), "|"), F.lit("")), F.lit("_"))
    return F.struct(first.alias("upos"), joined.alias("feats"))


#: Feature names of tag sets in four languages, and their UD names.
FEATURE_NAMES = {
    "gender": "Gender", "número": "Number", "number": "Number", "género": "Gender", "gênero": "Gender", "rod": "Gender",
    "číslo": "Number", "case": "Case", "caso": "Case", "pád": "Case", "person": "Person", "persona": "Person",
    "pessoa": "Person", "osoba": "Person", "tense": "Tense", "tiempo": "Tense", "tempo": "Tense", "čas": "Tense",
    "mood": "Mood", "modo": "Mood", "způsob": "Mood", "degree": "Degree", "grado": "Degree", "grau": "Degree",
    "stupeň": "Degree", "voice": "Voice", "voz": "Voice", "aspect": "Aspect", "aspecto": "Aspect", "vid": "Aspect",
}


def map_feature(name) -> Column:
    return _lookup(FEATURE_NAMES)[F.lower(F.trim(col(name)))]


def model_ratings(name) -> Column:
    """struct<speed, accuracy>: ratings by what a model's name contains."""
    n = F.lower(col(name))
    rated = lambda trf, lg, md, sm, other: (
        F.when(n.contains("trf"), trf).when(n.contains("lg"), lg).when(n.contains("md"), md).when(n.contains("sm"), sm).otherwise(other)
    )
    return F.struct(rated(2, 3, 4, 5, 3).alias("speed"), rated(5, 4, 3, 2, 3).alias("accuracy"))


#: Aliases of tasks and formats.
TASKS = {
    "seg": "segment", "segmentation": "segment", "tok": "tokenize", "tokenization": "tokenize", "tokenise": "tokenize",
    "pos": "tag", "tagging": "tag", "lemma": "lemmatize", "lemmatization": "lemmatize", "dep": "parse",
    "parsing": "parse", "norm": "normalize", "normalization": "normalize", "named-entities": "ner", "conll-u": "conllu",
    "conllu-ne": "conllu-ne", "tei": "teitok", "xml": "teitok", "txt": "raw", "text": "raw",
}


def normalize_task(c) -> Column:
    t = F.lower(F.trim(col(c)))
    return F.coalesce(_lookup(TASKS)[t], t)
