"""Queries: segmentation, tokenization and scalar functions (groups C, D, J)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import feats as FE
from ..functions import text as T
from .corpus import GOLD_SQL, SENT_SQL, TOK_SQL, explode_sentences, gold, read, tokens
from .registry import query

def n_rows():
    return F.count(F.lit(1)).alias("n")


@query("segment_sentences", SENT_SQL + "SELECT doc_id, sent_ord, sent FROM sen")
def _(spark, d):
    return explode_sentences(read(spark, d, "documents")).select("doc_id", F.col("sent_ord").cast("bigint").alias("sent_ord"), "sent")


@query("segment_sentences_quoted", r"""
WITH x AS (SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]+["''”’»]*)( |$)', '\1' || chr(10), 'g'), chr(10)) AS a FROM documents)
SELECT doc_id, CAST(len(list_filter(a, lambda s: s <> '')) AS BIGINT) AS n_sentences FROM x""")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(T.segment_sentences_quoted("text")).cast("bigint").alias("n_sentences"))


@query("tokenize_ud", r"""SELECT form, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}\p{M}''_-]+|[^\s]')) AS form FROM documents) GROUP BY form""")
def _(spark, d):
    return read(spark, d, "documents").select(F.explode(T.tokenize_ud("text")).alias("form")).groupBy("form").agg(n_rows())


@query("tokenize_whitespace", r"""SELECT form, count(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS form FROM documents) GROUP BY form""")
def _(spark, d):
    return read(spark, d, "documents").select(F.explode(T.tokenize_whitespace("text")).alias("form")).groupBy("form").agg(n_rows())


@query("peel_trailing_punct", r"""
WITH w AS (SELECT unnest(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS w FROM documents),
p AS (SELECT regexp_extract(w, '^(.+?)([.!?]+)$', 1) AS form FROM w WHERE regexp_matches(w, '^.+?[.!?]+$')
      UNION ALL SELECT regexp_extract(w, '^(.+?)([.!?]+)$', 2) FROM w WHERE regexp_matches(w, '^.+?[.!?]+$')
      UNION ALL SELECT w FROM w WHERE NOT regexp_matches(w, '^.+?[.!?]+$'))
SELECT form, count(*) AS n FROM p GROUP BY form""")
def _(spark, d):
    words = T.peel_trailing_punct(T.tokenize_whitespace("text"))
    return read(spark, d, "documents").select(F.explode(words).alias("form")).groupBy("form").agg(n_rows())


@query("infer_space_from_next", GOLD_SQL + "SELECT doc_id, count(*) FILTER (WHERE space_after) AS n_space, count(*) FILTER (WHERE NOT space_after) AS n_none, count(*) FILTER (WHERE space_after IS NULL) AS n_last FROM gold GROUP BY doc_id")
def _(spark, d):
    s = T.space_after_from_next("nxt")
    return tokens(spark, d).groupBy("doc_id").agg(F.count_if(s).alias("n_space"), F.count_if(~s).alias("n_none"), F.count_if(s.isNull()).alias("n_last"))


CASE_SQL = r"CASE WHEN form = '' THEN 'll' WHEN regexp_matches(form, '^\p{Lu}') AND regexp_matches(form, '\p{Lu}$') AND length(form) > 1 THEN 'UU' WHEN regexp_matches(form, '^\p{Lu}') THEN 'Ul' WHEN regexp_matches(form, '^\p{Ll}') THEN 'll' ELSE '??' END"


@query("form_case", TOK_SQL + f"SELECT {CASE_SQL} AS wcase, count(*) AS n FROM tok GROUP BY 1")
def _(spark, d):
    return tokens(spark, d).groupBy(T.form_case("form").alias("wcase")).agg(n_rows())


@query("normalize_form", TOK_SQL + r"SELECT coalesce(nullif(regexp_replace(lower(form), '[^\p{L}\p{N}]', '', 'g'), ''), lower(form)) AS norm, count(*) AS n FROM tok GROUP BY 1")
def _(spark, d):
    return tokens(spark, d).groupBy(T.normalize_form("form").alias("norm")).agg(n_rows())


@query("word_ending", TOK_SQL + "SELECT right(form, 3) AS suffix, left(form, 2) AS prefix, count(*) AS n FROM tok GROUP BY 1, 2")
def _(spark, d):
    return tokens(spark, d).groupBy(T.word_ending("form", 3).alias("suffix"), T.word_ending("form", -2).alias("prefix")).agg(n_rows())


_RAW_FEATS = "concat(' Num=', CASE WHEN length(form) % 2 = 0 THEN 'Plur' ELSE 'Sing' END, ' |', feats, '|junk|Abbr=', CASE WHEN length(form) < 3 THEN 'Yes' ELSE 'No' END)"


@query("normalize_feats", GOLD_SQL + f"""SELECT coalesce(nullif(array_to_string(list_sort(list_filter(list_transform(string_split({_RAW_FEATS}, '|'), lambda p: trim(p)), lambda p: p <> '_' AND contains(p, '='))), '|'), ''), '_') AS feats, count(*) AS n FROM gold GROUP BY 1""")
def _(spark, d):
    return gold(spark, d).withColumn("raw", F.expr(_RAW_FEATS)).groupBy(FE.normalize_feats("raw").alias("feats")).agg(n_rows())


@query("feats_to_map", GOLD_SQL + "SELECT regexp_extract(feats, 'Cap=([^|]*)', 1) AS cap, regexp_extract(feats, 'Len=([^|]*)', 1) AS len, count(*) AS n FROM gold WHERE feats <> '_' GROUP BY 1, 2")
def _(spark, d):
    m = FE.feats_to_map("feats")
    return gold(spark, d).filter("feats <> '_'").groupBy(m["Cap"].alias("cap"), m["Len"].alias("len")).agg(n_rows())


@query("compose_tag", GOLD_SQL + "SELECT concat_ws('#', tag, nullif(feats, '_')) AS utot, count(*) AS n FROM gold GROUP BY 1")
def _(spark, d):
    return gold(spark, d).groupBy(FE.compose_tag("xpos", "tag", "feats").alias("utot")).agg(n_rows())


@query("unimorph_to_ud", """
SELECT * FROM (VALUES ('V;PST;3;SG', 'VERB', 'Number=Sing|Person=3|Tense=Past'), ('N;NOM;PL', 'NOUN', 'Case=Nom|Number=Plur'),
 ('ADJ;CMPR', 'ADJ', 'Degree=Cmp'), ('V.PTCP;PST', 'VERB', 'Tense=Past|VerbForm=Part'), ('ZZ', 'X', '_')) t(codes, upos, feats)""")
def _(spark, d):
    df = spark.createDataFrame([(c,) for c in ("V;PST;3;SG", "N;NOM;PL", "ADJ;CMPR", "V.PTCP;PST", "ZZ")], "codes string")
    return df.select("codes", FE.unimorph_to_ud("codes").alias("u")).select("codes", "u.upos", "u.feats")


@query("map_feature", """SELECT * FROM (VALUES ('Género', 'Gender'), ('číslo', 'Number'), ('Tempo', 'Tense'), ('nothing', NULL)) t(name, ud)""")
def _(spark, d):
    df = spark.createDataFrame([("Género",), ("číslo",), ("Tempo",), ("nothing",)], "name string")
    return df.select("name", FE.map_feature("name").alias("ud"))


_KEYS = "CASE p_partkey % 8 WHEN 0 THEN '##' || p_brand || '[x]' WHEN 1 THEN p_brand || '(88)' WHEN 2 THEN p_brand || '-13' WHEN 3 THEN p_brand WHEN 4 THEN p_type || '.5' WHEN 5 THEN 'é' || p_brand WHEN 6 THEN 'Field_2' ELSE '--' || p_type || '_' END"


@query("clean_misc_key", rf"""
WITH r AS (SELECT DISTINCT {_KEYS} AS raw FROM part), a AS (SELECT raw, trim(regexp_replace(regexp_replace(trim(regexp_replace(raw, '^#+', '')), '[\[(].*$', ''), '[-_.]\d+$', '')) AS k FROM r)
SELECT raw, CASE WHEN NOT regexp_matches(k, '[^\x00-\x7F]') THEN nullif(trim(regexp_replace(k, '[^A-Za-z0-9]+', '_', 'g'), '_'), '') END AS key FROM a""")
def _(spark, d):
    return read(spark, d, "part").selectExpr(f"{_KEYS} AS raw").distinct().select("raw", T.clean_misc_key("raw").alias("key"))


_MISC = "concat('Translit=', lower(form), CASE WHEN space_after THEN '' ELSE '|SpaceAfter=No' END, '|Len=', CAST(length(form) AS STRING))"


@query("extract_misc", GOLD_SQL + "SELECT CASE WHEN space_after THEN '' ELSE 'No' END AS space_after_misc, CAST(length(form) AS VARCHAR) AS len, count(*) AS n FROM gold GROUP BY 1, 2")
def _(spark, d):
    g = gold(spark, d).withColumn("misc", F.expr(_MISC))
    return g.groupBy(FE.extract_misc("misc", "SpaceAfter").alias("space_after_misc"), FE.extract_misc("misc", "Len").alias("len")).agg(n_rows())


def sentences_of(df, *extra):
    """Rows collected to one array of structs a sentence, in order."""
    t = F.struct("tok_ord", "form", "space_after", *extra)
    return df.groupBy("doc_id", "sent_ord").agg(F.array_sort(F.collect_list(t)).alias("toks"))


@query("rebuild_text", GOLD_SQL + "SELECT doc_id, CAST(sent_ord AS BIGINT) AS sent_ord, trim(string_agg(form || CASE WHEN space_after THEN ' ' ELSE '' END, '' ORDER BY tok_ord)) AS text FROM gold GROUP BY doc_id, sent_ord")
def _(spark, d):
    s = sentences_of(gold(spark, d))
    return s.select("doc_id", F.col("sent_ord").cast("bigint").alias("sent_ord"), T.rebuild_text(F.col("toks.form"), F.col("toks.space_after")).alias("text"))


@query("rebuild_text_heuristic", TOK_SQL + r"""
SELECT doc_id, CAST(sent_ord AS BIGINT) AS sent_ord, regexp_replace(regexp_replace(regexp_replace(string_agg(form, ' ' ORDER BY tok_ord), ' ([.,;:!?)\]}»%])', '\1', 'g'), '([(\[{«]) ', '\1', 'g'), ' - ', '-', 'g') AS text FROM tok GROUP BY doc_id, sent_ord""")
def _(spark, d):
    s = sentences_of(gold(spark, d))
    return s.select("doc_id", F.col("sent_ord").cast("bigint").alias("sent_ord"), T.rebuild_text_heuristic(F.array_join("toks.form", " ")).alias("text"))


@query("capitalization_only", TOK_SQL + "SELECT count(*) FILTER (WHERE lower(form) = lower(prev)) AS n_same, count(*) AS n FROM tok")
def _(spark, d):
    return tokens(spark, d).agg(F.count_if(T.capitalization_only("form", "prev")).alias("n_same"), n_rows())


@query("punctuation_only", TOK_SQL + r"SELECT form, prev, count(*) AS n FROM tok WHERE regexp_matches(form, '^[\p{Po}\p{Pi}\p{Pf}]$') AND regexp_matches(prev, '^[\p{Po}\p{Pi}\p{Pf}]$') GROUP BY 1, 2")
def _(spark, d):
    return tokens(spark, d).filter(T.punctuation_only("form", "prev")).groupBy("form", "prev").agg(n_rows())


_LANGS = ("Sorbian (Upper)", "lower sorbian", "French (GSD)", "Church Slavonic (PROIEL)", "English", " Sami (Northern) ", "Sanskrit (Vedic)", "Latin (ITTB) x")


@query("clean_language_name", """SELECT * FROM (VALUES ('Sorbian (Upper)', 'Upper Sorbian'), ('lower sorbian', 'Lower Sorbian'), ('French (GSD)', 'French (GSD)'),
 ('Church Slavonic (PROIEL)', 'Church Slavonic'), ('English', 'English'), (' Sami (Northern) ', 'Sami (Northern)'), ('Sanskrit (Vedic)', 'Sanskrit'), ('Latin (ITTB) x', 'Latin (ITTB) x')) t(name, cleaned)""")
def _(spark, d):
    return spark.createDataFrame([(x,) for x in _LANGS], "name string").select("name", T.clean_language_name("name").alias("cleaned"))


@query("escape", GOLD_SQL + "SELECT coalesce(nullif(reg, ''), '_') AS reg, count(*) AS n FROM gold GROUP BY 1")
def _(spark, d):
    return gold(spark, d).groupBy(T.escape("reg").alias("reg")).agg(n_rows())


@query("json_encode", GOLD_SQL + """SELECT doc_id, CAST(sent_ord AS BIGINT) AS sent_ord, CAST(tok_ord AS BIGINT) AS tok_ord,
 '{"form":"' || replace(replace(form, '\\', '\\\\'), '"', '\\"') || '"' || CASE WHEN reg <> '' THEN ',"reg":"' || replace(replace(reg, '\\', '\\\\'), '"', '\\"') || '"' ELSE '' END || ',"tag":"' || tag || '"}' AS json FROM gold""")
def _(spark, d):
    return gold(spark, d).select("doc_id", F.col("sent_ord").cast("bigint").alias("sent_ord"), F.col("tok_ord").cast("bigint").alias("tok_ord"), F.to_json(F.struct("form", F.nullif("reg", F.lit("")).alias("reg"), "tag")).alias("json"))


@query("parse_key_values", "SELECT CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    flat = F.regexp_replace(F.regexp_replace("props", r'[{}" ]', ""), ":", "=")
    return read(spark, d, "events").groupBy(FE.parse_key_values(flat)["k"].alias("k")).agg(n_rows())


@query("model_ratings", """SELECT * FROM (VALUES ('en_core_web_sm', 5, 2), ('en_core_web_md', 4, 3), ('de_core_news_lg', 3, 4), ('en_core_web_trf', 2, 5), ('other', 3, 3)) t(name, speed, accuracy)""")
def _(spark, d):
    names = ("en_core_web_sm", "en_core_web_md", "de_core_news_lg", "en_core_web_trf", "other")
    return spark.createDataFrame([(x,) for x in names], "name string").select("name", FE.model_ratings("name").alias("r")).select("name", "r.speed", "r.accuracy")


@query("normalize_task", """SELECT * FROM (VALUES ('POS', 'tag'), ('conll-u', 'conllu'), ('Lemma', 'lemmatize'), ('ner', 'ner')) t(alias, task)""")
def _(spark, d):
    return spark.createDataFrame([("POS",), ("conll-u",), ("Lemma",), ("ner",)], "alias string").select("alias", FE.normalize_task("alias").alias("task"))


@query("safe_log", "SELECT p_partkey, round(CASE WHEN p_size - 25 <= 0 THEN -1e6 ELSE ln(p_size - 25) END, 6) AS lg FROM part")
def _(spark, d):
    return read(spark, d, "part").select("p_partkey", F.round(T.safe_log(F.col("p_size") - 25), 6).alias("lg"))


@query("wcase_lemma", GOLD_SQL + "SELECT lemma, count(*) AS n FROM gold GROUP BY lemma")
def _(spark, d):
    return gold(spark, d).groupBy("lemma").agg(n_rows())  # the transfer of case to a lemma is the identity


@query("annotation_attr_norm", GOLD_SQL + "SELECT nfc_normalize(lemma) AS lemma, count(*) AS n FROM gold GROUP BY 1")
def _(spark, d):
    from ..operators.unicode import normalize_unicode

    return normalize_unicode(gold(spark, d).groupBy("lemma").agg(n_rows()), ["lemma"]).groupBy("lemma").agg(F.sum("n").alias("n"))


@query("normalize_unicode", TOK_SQL + "SELECT nfc_normalize(form) AS form, count(*) AS n FROM tok GROUP BY 1")
def _(spark, d):
    from ..operators.unicode import normalize_unicode

    return normalize_unicode(tokens(spark, d).groupBy("form").agg(n_rows()), ["form"]).groupBy("form").agg(F.sum("n").alias("n"))


@query("sanitize_utf8", "SELECT doc_id, text FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.make_valid_utf8("text").alias("text"))


@query("is_oov", TOK_SQL + """, voc AS (SELECT DISTINCT form FROM tok WHERE doc_id % 2 = 0)
SELECT form, count(*) AS n, form NOT IN (SELECT form FROM voc) AND lower(form) NOT IN (SELECT form FROM voc) AS oov FROM tok GROUP BY form""")
def _(spark, d):
    """All forms against the vocabulary of the even documents."""
    t = tokens(spark, d)
    voc = t.filter("doc_id % 2 = 0").select("form").distinct()
    forms = t.groupBy("form").agg(n_rows())
    exact, low = voc.select(F.col("form").alias("_a")), voc.select(F.col("form").alias("_b"))
    j = forms.join(exact, F.col("form") == F.col("_a"), "left").join(low, F.lower("form") == F.col("_b"), "left")
    return j.select("form", "n", (F.col("_a").isNull() & F.col("_b").isNull()).alias("oov"))


@query("natural_sort", r"""
SELECT p_partkey, CAST(row_number() OVER (ORDER BY regexp_replace(CAST(p_size AS VARCHAR), '^', repeat('0', 20 - length(CAST(p_size AS VARCHAR)))), lower(p_name), p_partkey) AS BIGINT) AS rank FROM part""")
def _(spark, d):
    from ..operators.catalog import ranked

    key = T.natural_sort_key(F.concat(F.col("p_size").cast("string"), F.lit(" ")))
    p = read(spark, d, "part").select("p_partkey", F.trim(key).alias("k"), F.lower("p_name").alias("l"))
    return ranked(p, "k", "l", "p_partkey").select("p_partkey", "rank")


@query("detect_input_format", r"""
SELECT fmt, count(*) AS n FROM (
 SELECT CASE WHEN regexp_matches(left(t, 4096), '<tok[ >/]|<TEI[ >]') THEN 'teitok'
             WHEN regexp_matches(left(t, 4096), '(^|\n)# (text|sent_id|newdoc|newpar)') OR regexp_matches(left(t, 4096), '(^|\n)([^\t\n]*\t){9}') THEN 'conllu' ELSE 'raw' END AS fmt
 FROM (SELECT text AS t FROM documents UNION ALL SELECT html FROM pages)) GROUP BY fmt""")
def _(spark, d):
    t = read(spark, d, "documents").select("text").union(read(spark, d, "pages").select("html"))
    return t.groupBy(T.detect_input_format("text").alias("fmt")).agg(n_rows())


_DROP = "html"
for _n in ("note", "script", "style"):
    _DROP = f"regexp_replace({_DROP}, '(?is)<{_n}[ >].*?</{_n}>', '', 'g')"
_PLAIN = f"regexp_replace(regexp_replace({_DROP}, '(?i)</?(p|div)( [^>]*)?>', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g')"
_PLAIN = rf"regexp_replace(regexp_replace({_PLAIN}, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g')"


@query("extract_xml_plain_text", rf"SELECT page_id, regexp_replace(regexp_replace({_PLAIN}, '\n\n+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages")
def _(spark, d):
    return read(spark, d, "pages").select("page_id", T.extract_plain_text("html").alias("text"))


@query("teitok_has_tokens", "SELECT page_id, contains(html, '<tok') AS has_tokens FROM pages")
def _(spark, d):
    return read(spark, d, "pages").select("page_id", F.col("html").contains("<tok").alias("has_tokens"))


@query("verify_structure", r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '</?(s|tok|dtok|name)( [^>]*)?/?>', '', 'g'), ' (id|xml:id)="[^"]*"', '', 'g'), '\s+', ' ', 'g')) =
 trim(regexp_replace(regexp_replace(html, ' (id|xml:id)="[^"]*"', '', 'g'), '\s+', ' ', 'g')) AS preserved FROM pages""")
def _(spark, d):
    tagged = F.col("html")
    plain = T.collapse_spaces(F.regexp_replace("html", r" (id|xml:id)=\"[^\"]*\"", ""))
    return read(spark, d, "pages").select("page_id", (T.strip_structure(tagged) == plain).alias("preserved"))


@query("verify_char_alignment", TOK_SQL + r"""
SELECT doc_id, regexp_replace(string_agg(form, '' ORDER BY sent_ord, tok_ord), '\s+', '', 'g') = regexp_replace(any_value(text), '\s+', '', 'g') AS aligned
FROM tok JOIN documents USING (doc_id) GROUP BY doc_id""")
def _(spark, d):
    s = sentences_of(gold(spark, d)).select("doc_id", "sent_ord", F.array_join("toks.form", "").alias("s"))
    whole = s.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_ord", "s"))), lambda x: x["s"]), "").alias("t"))
    docs = read(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"\s+", "").alias("o"))
    return whole.join(docs, "doc_id").select("doc_id", (F.regexp_replace("t", r"\s+", "") == F.col("o")).alias("aligned"))
