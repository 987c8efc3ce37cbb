"""Segmentation, tokenization and string functions as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word (letters, digits, marks, ' _ -), or any other visible character.
TOKEN = r"[\p{L}\p{N}\p{M}'_-]+|[^\s]"
SENTENCE_END = r"([.!?]+)( |$)"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_spaces(c) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def segment_sentences(c) -> Column:
    """array<string>: sentences end after ``.!?`` runs before a space or the end."""
    cut = F.split(F.regexp_replace(collapse_spaces(c), SENTENCE_END, "$1\n"), "\n")
    return F.filter(cut, lambda s: s != "")


def segment_sentences_quoted(c) -> Column:
    """As ``segment_sentences``; a closing quote right after the end goes with it."""
    cut = F.split(F.regexp_replace(collapse_spaces(c), r"([.!?]+[\"'”’»]*)( |$)", "$1\n"), "\n")
    return F.filter(cut, lambda s: s != "")


def tokenize_ud(c) -> Column:
    return F.regexp_extract_all(col(c), F.lit(TOKEN), F.lit(0))


def tokenize_whitespace(c) -> Column:
    return F.filter(F.split(col(c), r"\s+"), lambda w: w != "")


def peel_trailing_punct(words) -> Column:
    """Words ending in ``.!?`` become the word and its ending."""
    peeled = lambda w: F.array(F.regexp_extract(w, r"^(.+?)([.!?]+)$", 1), F.regexp_extract(w, r"^(.+?)([.!?]+)$", 2))
    return F.flatten(F.transform(col(words), lambda w: F.when(w.rlike(r"^.+?[.!?]+$"), peeled(w)).otherwise(F.array(w))))


def space_after_from_next(nxt) -> Column:
    """False iff the next token starts with no letter or digit; null for the last."""
    n = col(nxt)
    return F.when(n.isNotNull(), n.rlike(r"^[\p{L}\p{N}]"))


def form_case(c) -> Column:
    """UU first and last letter upper (two characters at least), Ul first upper, ll first lower, ?? else; empty: ll."""
    f = col(c)
    first = f.rlike(r"^\p{Lu}")
    return (
        F.when(f == "", "ll")
        .when(first & f.rlike(r"\p{Lu}$") & (F.char_length(f) > 1), "UU")
        .when(first, "Ul")
        .when(f.rlike(r"^\p{Ll}"), "ll")
        .otherwise("??")
    )


def normalize_form(c) -> Column:
    low = F.lower(col(c))
    kept = F.regexp_replace(low, r"[^\p{L}\p{N}]", "")
    return F.coalesce(F.nullif(kept, F.lit("")), low)


def word_ending(c, n: int) -> Column:
    """Last n characters, for a negative n the first; the word if it is shorter."""
    return F.right(col(c), F.lit(n)) if n >= 0 else F.left(col(c), F.lit(-n))


def escape(c) -> Column:
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit("_"))


def missing(c) -> Column:
    """Null for the ways of writing "no value": empty, ``_`` and ``--``."""
    return F.when(~col(c).isin("", "_", "--"), col(c))


def is_punctuation(form, upos=None) -> Column:
    one = col(form).rlike(r"^[!-/:-@\[-`{-~]$")
    return one if upos is None else (F.coalesce(col(upos), F.lit("")) == "PUNCT") | one


def rebuild_text(forms, spaces) -> Column:
    """Forms with a space where the flag is true; a null flag adds none."""
    return F.trim(F.array_join(F.zip_with(col(forms), col(spaces), lambda f, s: F.concat(f, F.when(s, " ").otherwise(""))), ""))


def rebuild_text_heuristic(text_with_spaces) -> Column:
    """Spacing by punctuation class, for tokens joined by spaces."""
    t = F.regexp_replace(col(text_with_spaces), r" ([.,;:!?)\]}»%])", "$1")
    t = F.regexp_replace(t, r"([(\[{«]) ", "$1")
    return F.regexp_replace(t, r" - ", "-")


def capitalization_only(a, b) -> Column:
    return F.lower(col(a)) == F.lower(col(b))


def punctuation_only(a, b) -> Column:
    p = r"^[\p{Po}\p{Pi}\p{Pf}]$"
    return col(a).rlike(p) & col(b).rlike(p)


def natural_sort_key(c) -> Column:
    """A string that sorts with digit runs as numbers."""
    parts = F.regexp_extract_all(F.lower(col(c)), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def clean_misc_key(c) -> Column:
    """Key names: no leading #; what follows a bracket goes, then one suffix of -, _ or . and digits;
    other characters become single underscores, none at the ends. Null if nothing or no ASCII is left."""
    k = F.trim(F.regexp_replace(col(c), r"^#+", ""))
    k = F.trim(F.regexp_replace(k, r"[\[(].*$", ""))
    k = F.trim(F.regexp_replace(k, r"[-_.]\d+$", ""))
    plain = F.regexp_replace(F.regexp_replace(k, r"[^A-Za-z0-9_]+", "_"), "_+", "_")
    return F.when(~k.rlike(r"[^\x00-\x7F]"), F.nullif(F.regexp_replace(plain, "^_|_$", ""), F.lit("")))


#: Names of projects in parentheses, which go, and of languages whose qualifier comes first.
PROJECTS = ("proiel", "ittb", "vedic", "ufal")
QUALIFIED = {"sorbian (upper)": "Upper Sorbian", "upper sorbian": "Upper Sorbian", "sorbian (lower)": "Lower Sorbian", "lower sorbian": "Lower Sorbian"}


def clean_language_name(c) -> Column:
    """``Sorbian (Upper)`` is ``Upper Sorbian``; known projects in final parentheses go; all else stays."""
    n = F.trim(col(c))
    match = r"^(.+?)\s*\(([^)]+)\)$"
    base, inside = F.trim(F.regexp_extract(n, match, 1)), F.lower(F.trim(F.regexp_extract(n, match, 2)))
    known = F.create_map(*[F.lit(x) for pair in QUALIFIED.items() for x in pair])
    qualified = F.coalesce(F.try_element_at(known, F.lower(n)), F.try_element_at(known, F.concat(F.lower(base), F.lit(" ("), inside, F.lit(")"))))
    return F.coalesce(qualified, F.when(n.rlike(match) & inside.isin(*PROJECTS), base), n)


def safe_log(c) -> Column:
    return F.when(col(c) <= 0, F.lit(-1e6)).otherwise(F.log(col(c)))


def detect_input_format(c) -> Column:
    head = F.substring(col(c), 1, 4096)
    return (
        F.when(head.rlike(r"<tok[ >/]|<TEI[ >]"), "teitok")
        .when(head.rlike(r"(^|\n)# (text|sent_id|newdoc|newpar)") | head.rlike(r"(^|\n)([^\t\n]*\t){9}"), "conllu")
        .otherwise("raw")
    )


def extract_plain_text(markup) -> Column:
    """Text of markup: notes and scripts go, blocks break lines, tags go."""
    t = col(markup)
    for name in ("note", "script", "style"):
        t = F.regexp_replace(t, rf"(?is)<{name}[ >].*?</{name}>", "")
    t = F.regexp_replace(t, r"(?i)</?(p|div)( [^>]*)?>", "\n\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n\n+", "\n\n"), r"^\s+|\s+$", "")


def strip_structure(markup) -> Column:
    """Markup without sentence and token tags and ids, for comparing structures."""
    t = F.regexp_replace(col(markup), r"</?(s|tok|dtok|name)( [^>]*)?/?>", "")
    t = F.regexp_replace(t, r" (id|xml:id)=\"[^\"]*\"", "")
    return collapse_spaces(t)
