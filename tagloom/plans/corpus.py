"""Token tables derived from the ``documents`` table, in Spark and in DuckDB SQL.

No table carries annotations, so a context-dependent pseudo-annotation stands in:
it is a test device, not a linguistic claim. Everything is projection: sentences
and tokens explode from arrays, neighbours come from the array, nothing shuffles.
"""
from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TOKEN, segment_sentences
from ..sources import tei

VOWEL_END = "[aeiouyàâäéèêëîïôöùûüñ]$"
VOWELS = VOWEL_END[1:-2]
ACCENTS, PLAIN = "àâäáéèêëíîïóôöúùûüñç", "aaaaeeeeiiiooouuuunc"
_PLAIN = str.maketrans(ACCENTS, PLAIN)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def explode_sentences(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """``keep``, sent_ord (from 0), sent."""
    return docs.select(*keep, F.posexplode(segment_sentences(text)).alias("sent_ord", "sent"))


def explode_tokens(sentences: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "sent_ord")) -> DataFrame:
    """``keep``, tok_ord (from 0), form, prev, nxt, n_tok: a row for each token."""
    f = F.regexp_extract_all("sent", F.lit(TOKEN), F.lit(0))
    s = sentences.select(*keep, f.alias("_f")).filter(F.size("_f") > 0)
    neighbours = F.arrays_zip(
        F.col("_f").alias("form"),
        F.concat(F.array(F.lit(None).cast("string")), F.slice("_f", 1, F.size("_f") - 1)).alias("prev"),
        F.concat(F.slice("_f", 2, F.size("_f")), F.array(F.lit(None).cast("string"))).alias("nxt"),
    )
    out = s.select(*keep, F.size("_f").alias("n_tok"), F.posexplode(neighbours).alias("tok_ord", "t"))
    return out.select(*keep, "tok_ord", "t.form", "t.prev", "t.nxt", "n_tok")


#: Whether a form begins with an ASCII letter: spares most regular expressions below.
ASCII = "((form >= 'a' AND form < '{') OR (form >= 'A' AND form < '['))"
#: Column -> expression, in a notation that ``dialect`` turns into either SQL.
ANNOTATIONS = {
    "tag": r"""CASE WHEN NOT (%W OR M(form, R'[\p{L}\p{N}]')) THEN 'PUNCT' WHEN NOT %W AND M(form, R'^\p{N}+$') THEN 'NUM'
       ELSE concat(CASE WHEN M(lower(form), '%V') THEN 'V' ELSE 'C' END,
                   CASE WHEN M(lower(coalesce(prev, '')), '%V') THEN 'v' ELSE 'c' END) END""",
    "lemma": r"""CASE WHEN length(form) > 1 THEN regexp_replace(lower(form), '%V', '') ELSE lower(form) END""",
    "feats": r"""CASE WHEN NOT (%W OR M(form, R'[\p{L}\p{N}]')) THEN '_'
       ELSE concat('Cap=', CASE WHEN (form >= 'A' AND form < '[') OR (NOT %W AND M(form, R'^\p{Lu}')) THEN 'Yes' ELSE 'No' END, '|Len=',
                   CASE WHEN length(form) < 4 THEN 'S' WHEN length(form) < 8 THEN 'M' ELSE 'L' END) END""",
    "reg": r"""CASE WHEN form <> translate(form, '%A', '%P') THEN translate(form, '%A', '%P') ELSE '' END""",
    "space_after": r"""CASE WHEN nxt IS NOT NULL THEN (nxt >= 'a' AND nxt < '{') OR (nxt >= 'A' AND nxt < '[') OR M(nxt, R'^[\p{L}\p{N}]') END""",
    "head": "tok_ord",
    "deprel": r"""CASE WHEN tok_ord = 0 THEN 'root' WHEN NOT (%W OR M(form, R'[\p{L}\p{N}]')) THEN 'punct'
       WHEN length(form) < 4 THEN 'case' ELSE 'dep' END""",
}


def dialect(sql: str, duck: bool) -> str:
    """``M(`` is the regular-expression test, ``R'`` a raw string."""
    sql = sql.replace("%W", ASCII).replace("%V", VOWEL_END).replace("%A", ACCENTS).replace("%P", PLAIN)
    if duck:
        return sql.replace("M(", "regexp_matches(").replace("R'", "'")
    return sql.replace("M(", "regexp_like(").replace("R'", "r'")


def annotate(tokens: DataFrame) -> DataFrame:
    """Tokens with tag, lemma, feats, reg, space_after, head (0: root), deprel, xpos."""
    out = tokens.selectExpr("*", *[f"{dialect(x, False)} AS {name}" for name, x in ANNOTATIONS.items()])
    return out.withColumn("xpos", F.concat_ws(".", "tag", F.when(F.col("form").rlike(r"^\p{Lu}"), "U").otherwise("l")))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_tokens(explode_sentences(read(spark, sf_dir, "documents")))


def nested(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, sents: for each document an array of sentences, each (sent_ord, ts), ts an
    array of pseudo-annotated tokens. Everything stays in the document's row: no shuffle."""
    docs = read(spark, sf_dir, "documents").filter(F.col("text").rlike(r"\S"))  # not on sents: that would make them twice
    f = words(docs, keep).withColumnRenamed("f", "_f")
    here = lambda x: re.sub(r"\btok_ord\b", "i", re.sub(r"\bnxt\b", "get(f, i + 1)", re.sub(r"\bprev\b", "get(f, i - 1)", dialect(x, False))))
    plain = ", ".join(f"'{k}', {here(x)}" for k, x in ANNOTATIONS.items())
    upper = "(form >= 'A' AND form < '[') OR regexp_like(form, r'^\\p{Lu}')"
    token = f"named_struct('tok_ord', i, 'form', form, {plain}, 'xpos', concat_ws('.', {here(ANNOTATIONS['tag'])}, CASE WHEN {upper} THEN 'U' ELSE 'l' END))"
    sents = F.expr(f"filter(transform(_f, (f, j) -> named_struct('sent_ord', j, 'ts', transform(f, (form, i) -> {token}))), s -> size(s.ts) > 0)")
    return f.select(*keep, sents.alias("sents"))


def words(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, f: an array of the tokens of each sentence, in the document's row."""
    return docs.select(*keep, F.transform(segment_sentences("text"), lambda s: F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0))).alias("f"))


def annotated_form(form: str) -> dict:
    """``ANNOTATIONS`` of a form as far as they don't depend on its neighbours: the tag lacks its second letter."""
    first, low = form[:1], form.lower()
    ascii_ = "a" <= first < "{" or "A" <= first < "["
    kinds = [unicodedata.category(c) for c in form]
    word = ascii_ or any(k[0] in "LN" for k in kinds)
    vowel = low[-1:] in VOWELS and low != ""
    upper = "A" <= first < "[" or kinds[:1] == ["Lu"]
    size = "S" if len(form) < 4 else "M" if len(form) < 8 else "L"
    plain = form.translate(_PLAIN)
    return {
        "tag": "PUNCT" if not word else "NUM" if not ascii_ and all(k[0] == "N" for k in kinds) else "V" if vowel else "C",
        "lemma": low[:-1] if len(form) > 1 and vowel else low, "feats": f"Cap={'Yes' if upper else 'No'}|Len={size}" if word else "_",
        "reg": plain if plain != form else "", "deprel": "punct" if not word else "case" if len(form) < 4 else "dep",
        "upper": upper, "vowel": vowel, "starts_word": ascii_ or kinds[:1] != [] and kinds[0][0] in "LN",
    }


def _tei_pieces(form: str):
    """The parts of a <tok> that stay the same wherever ``form`` stands: by whether a vowel comes before."""
    if form.isascii() and form.isalpha():  # most forms: nothing to escape or look up
        low, upper, size = form.lower(), form[0] < "[", "S" if len(form) < 4 else "M" if len(form) < 8 else "L"
        vowel = low[-1] in VOWELS
        lemma = f' lemma="{low[:-1] if vowel and len(low) > 1 else low}" upos="{"V" if vowel else "C"}'
        after = f'.{"U" if upper else "l"}" feats="Cap={"Yes" if upper else "No"}|Len={size}" head="'
        heads = [f'{lemma}{b}" xpos="{"V" if vowel else "C"}{b}{after}' for b in "cv"]
        return *heads, f'" deprel="{"case" if size == "S" else "dep"}">{form}</tok>', f'" deprel="root">{form}</tok>', vowel, " "
    esc = lambda v: v if v.isalnum() else v.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    attr = lambda n, v, keep=False: f' {n}="{esc(v)}"' if v and (keep or v != "_") else ""
    a = annotated_form(form)
    heads = []
    for before in "cv":
        tag = a["tag"] + (before if len(a["tag"]) == 1 else "")
        heads.append(attr("lemma", a["lemma"], True) + attr("upos", tag) + attr("xpos", f"{tag}.{'U' if a['upper'] else 'l'}") + attr("feats", a["feats"]) + ' head="')
    end = f"{attr('reg', a['reg'])}>{esc(form)}</tok>"
    return *heads, f'" deprel="{a["deprel"]}"{end}', f'" deprel="root"{end}', a["vowel"], " " if a["starts_word"] else ""


#: Tokens of documents that are formatted at once.
FORMATTED = 100_000


def _formatted(ids, sents, known: dict[str, tuple]) -> pa.Array:
    """A TEI document of each id and its list of lists of tokens."""
    of_sent, of_doc = pc.list_value_length(sents.flatten()).to_numpy(zero_copy_only=False), pc.list_value_length(sents).to_numpy(zero_copy_only=False)
    coded = sents.flatten().flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if len(known) > 200_000:
        known.clear()
    pieces = []
    for form in coded.dictionary.to_pylist():
        if (k := known.get(form)) is None:
            k = known[form] = _tei_pieces(form)
        pieces.append(k)
    heads = pa.array(['"' + x for k in pieces for x in k[:2]], pa.string())
    ends = pa.array([x for k in pieces for x in k[2:4]], pa.string())
    vowel, word = np.array([k[4] for k in pieces], bool), np.array([k[5] == " " for k in pieces], bool)
    full = of_sent > 0
    number = np.arange(len(of_sent)) - np.repeat(np.cumsum(of_doc) - of_doc, of_doc)  # of a sentence in its document
    place = np.arange(len(code)) - np.repeat(np.cumsum(of_sent) - of_sent, of_sent)
    most = max(number.max(initial=0), place.max(initial=0)) + 2
    text = pa.array(np.arange(most)).cast(pa.string())
    first = place == 0
    before = np.append(False, vowel[code[:-1]])[: len(code)] & ~first
    lead = pa.array(['<tok id="w-', ' <tok id="w-']).take(pa.array((word[code] & ~first).astype(np.int8)))
    at = text.take(pa.array(np.repeat(number, of_sent) + 1))
    toks = pc.binary_join_element_wise(
        lead, at, "-", text.take(pa.array(place + 1)), heads.take(pa.array(2 * code + before)), text.take(pa.array(place)), ends.take(pa.array(2 * code + first)), ""
    )
    listed = lambda sizes, values: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)
    body = pc.binary_join(listed(of_sent[full], toks), "")
    body = pc.binary_join_element_wise('<s id="s-', text.take(pa.array(number[full] + 1)), '">', body, "</s>", "")
    per_doc = np.bincount(np.repeat(np.arange(len(of_doc)), of_doc)[full], minlength=len(of_doc))
    return pc.binary_join_element_wise('<TEI><text id="', ids.cast(pa.string()), '">\n', pc.binary_join(listed(per_doc, body), "\n"), "\n</text></TEI>", "")


def _tei_batches(batches):
    """Batches of ``doc_id, value`` from those of ``doc_id, f``, ``FORMATTED`` tokens at once or one document."""
    known: dict[str, tuple] = {}
    for b in batches:
        ids, sents = b.column("doc_id"), b.column("f")
        tokens_of = np.diff(np.append(0, np.cumsum(pc.list_value_length(sents.flatten()).to_numpy(zero_copy_only=False)))[np.append(0, np.cumsum(pc.list_value_length(sents).to_numpy(zero_copy_only=False)))])
        part = (np.cumsum(tokens_of) - tokens_of) // FORMATTED
        edges = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [b.num_rows]
        for i, j in zip(edges[:-1], edges[1:]):
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), _formatted(ids.slice(i, j - i), sents.slice(i, j - i), known)], ["doc_id", "value"])


def _with_words(docs: DataFrame) -> DataFrame:
    return words(docs.filter(F.col("text").rlike(r"\S")))


def tei_documents(docs: DataFrame) -> DataFrame:
    """doc_id, value: what ``write_tei`` makes of ``nested``, with each form annotated and formatted once a worker.

    Rows without a visible character have no document. Interpreted per-token expressions would be
    most of the time of the queries that only read these documents.
    """
    return _with_words(docs).mapInArrow(_tei_batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, value string")


def tei_tokens(docs: DataFrame, wanted=None) -> DataFrame:
    """What ``read_tei`` reads of ``tei_documents``, as files named by their ids: in the worker that made
    them, since the documents are much larger than the input (about 110 bytes a token) and would cross to the JVM and back."""

    def run(batches):
        made = _tei_batches(batches)
        files = (pa.RecordBatch.from_arrays([pc.binary_join_element_wise("/x/", b.column("doc_id").cast(pa.string()), ".xml", ""), b.column("value")], ["file", "value"]) for b in made)
        yield from tei.token_batches(files, wanted=wanted)

    return _with_words(docs).mapInArrow(run, tei.schema_of(wanted))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pseudo-annotated tokens of all documents."""
    return annotate(tokens(spark, sf_dir))


def gold_transitions(tokens: DataFrame) -> DataFrame:
    """prev, next, n: what ``transition_counts`` counts in the annotated ``tokens``. The pseudo-tag of the next token follows
    from the two forms in the row, so no token is shuffled or sorted to meet its neighbour."""
    tag = dialect(ANNOTATIONS["tag"], False)
    after = re.sub(r"\b(form|prev)\b", lambda m: {"form": "nxt", "prev": "form"}[m[0]], tag)
    return tokens.filter("nxt IS NOT NULL").selectExpr(f"{tag} AS prev", f"{after} AS next").groupBy("prev", "next").agg(F.count(F.lit(1)).alias("n"))


#: DuckDB: sentences (``sen``), tokens (``tok``) and pseudo-annotated tokens (``gold``).
SENT_SQL = r"""
WITH sx AS (SELECT doc_id, lang, string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')),
              '([.!?]+)( |$)', '\1' || chr(10), 'g'), chr(10)) AS a FROM documents),
sf AS (SELECT doc_id, lang, list_filter(a, lambda s: s <> '') AS a FROM sx),
sen AS (SELECT doc_id, lang, unnest(a) AS sent, generate_subscripts(a, 1) - 1 AS sent_ord FROM sf)"""
TOK_SQL = SENT_SQL + r""",
sz AS (SELECT doc_id, lang, sent_ord, regexp_extract_all(sent, '[\p{L}\p{N}\p{M}''_-]+|[^\s]') AS f FROM sen),
tok AS (SELECT doc_id, lang, sent_ord, i - 1 AS tok_ord, f[i] AS form,
               CASE WHEN i > 1 THEN f[i - 1] END AS prev, CASE WHEN i < len(f) THEN f[i + 1] END AS nxt, len(f) AS n_tok
        FROM (SELECT *, unnest(generate_series(1, len(f))) AS i FROM sz))"""
GOLD_SQL = TOK_SQL + ",\ngold AS (SELECT *, concat_ws('.', tag, CASE WHEN regexp_matches(form, '^\\p{Lu}') THEN 'U' ELSE 'l' END) AS xpos FROM (SELECT *, " + ", ".join(f"{dialect(x, True)} AS {name}" for name, x in ANNOTATIONS.items()) + " FROM tok))\n"
SENT_SQL += "\n"
TOK_SQL += "\n"
