"""Secret scan: fixed patterns, and dictionary-primed zstandard novelty.

Three patterns give base spans. Beyond them, every long token that stands in a
sensitive context (a word such as ``key`` or ``auth`` shortly before it, or in its
name where it is a value after ``=``, or the user part of a URL) is a candidate. Its
novelty is its marginal compressed size, that is zstandard's output for surrounding
text plus candidate, less that for the surrounding text alone, both primed with a
dictionary of identifiers, per candidate byte. What the surroundings and the
dictionary can't predict is reported as ``novel``. The novelty of base spans is
measured as well; they stay, whatever it is.
"""
from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import fresh_names, process_cache, sliced, table

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORD = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
#: Candidates of the novelty measure, and the words that make a context sensitive.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}", re.A)
SENSITIVE = re.compile(
    r"pass|secret|token|key|auth|bearer|credential|private|signature|pwd|cert|session|://[^\s/:@]{1,64}:", re.I | re.A
)
_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
BEFORE, AFTER, MIN_LENGTH = 96, 256, 16
MIN_NOVELTY = 0.6
#: Common identifiers, which prime the compressor.
IDENTIFIERS = """
access account action address admin alias allow amount application argument array attribute author backend
base64 batch begin binary block body boolean branch buffer build bytes cache callback catalog category channel
charset class client cluster code column command comment commit compile component config configuration connection
console const constructor container content context continue control controller convert cookie count create
credential currency current customer cursor data database date datetime debug default define delete dependency
description destination device directory document domain driver element email enable encode encoding endpoint
entity enum environment error event example exception execute export extension factory false field file filter
final float folder format function gateway generate global group handler header height hidden history hostname
http https identifier image implements import include index initialize input insert instance integer interface
internal iterator javascript json kernel keyword label language latitude length library limit listener local
localhost location logger lookup manager mapping master matrix maximum member memory message metadata method
minimum model module monitor namespace network node null number object offset operation operator option order
output owner package page parameter parent parse password path pattern payload payment pending permission pipeline
platform plugin pointer policy port position prefix previous primary private process product profile project
property protected protocol provider proxy public python query queue random receive record reference region
register release remote render replace report repository request resource response result return route router
schema schedule scope script search secret section security select sender sequence serial server service session
setting signature socket source static status storage stream string struct style subject submit subscribe suffix
summary switch symbol synchronize system table target task template temporary terminal thread throw timeout
timestamp title token topic transaction transform trigger true tuple type undefined unique update upload username
utils validate value variable vector version virtual visible volume warning webhook widget width window worker
wrapper write abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 1234567890abcdef
""".strip()


def _compressor():
    def make():
        import zstandard as zstd

        words = IDENTIFIERS.split()
        joined = " ".join(words + [w.upper() for w in words] + [w.title() for w in words])
        d = zstd.ZstdCompressionDict(joined.encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=3)
        return zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    return process_cache("identifier-zstd", make)


def novelty(context: str, candidate: str) -> float:
    """Marginal compressed bytes of a candidate after its context, per byte of it."""
    z, c = _compressor(), context.encode()
    return max(0, len(z.compress(c + candidate.encode())) - len(z.compress(c))) / max(1, len(candidate))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order of start, then kind; ends are exclusive."""
    out = []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if KEYWORD.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out.sort()
    return out


def _values(candidate: str):
    """Where a candidate's value may start: after its last inner '=', after each one before, at 0."""
    at = candidate.rstrip("=").rfind("=")
    while at >= 0:
        yield at + 1
        at = candidate.rfind("=", 0, at)
    yield 0


def _joined_from(text: str, a: int, least: int) -> int:
    """The start of the parts joined by single '.' of which one starts at ``a``; not before ``least``."""
    while a > least and (text[a - 1] in _PART or text[a - 1] == "." and a > 1 and text[a - 2] in _PART):
        a -= 1
    return a


def _looks_random(s: str) -> bool:
    """Letters with digits, or letters of which a third or more is of either case, unlike in names."""
    if any("0" <= c <= "9" for c in s):
        return any(c.isalpha() for c in s)
    return 3 * min(sum(map(str.isupper, s)), sum(map(str.islower, s))) >= len(s)


def _around(text: str, a: int, b: int) -> str:
    return text[max(0, a - AFTER) : a] + " " + text[b : b + AFTER]


def novel_spans(text: str, known, min_novelty: float = MIN_NOVELTY) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, novelty) of incompressible strings in sensitive context, none over a span of ``known``.

    Of name=value only the value is judged and reported, and the name is context;
    where no value passes, the whole is. Parts joined by '.', and lines of candidates
    one after another (as in PEM blocks), share the context of the first.
    """
    out = []
    ends = sorted(e for _, _, e in known)
    low = [0] * (len(ends) + 1)  # the least start of the spans that end there or later
    low[-1] = len(text) + 1
    starts = [a for a, _, e in sorted(known, key=lambda x: x[2])]
    for i in range(len(ends) - 1, -1, -1):
        low[i] = min(low[i + 1], starts[i])
    first, last = 0, 0  # of the joined parts so far: start, end
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        start = _joined_from(text, a, last)
        joined = start == last and a > last or 0 < last < a and text[last:a].strip("\r\n") == ""
        first, last = (first if joined and last else start), b
        word = SENSITIVE.search(text, max(0, first - BEFORE), b)
        if not word:
            continue
        for v in (a + k for k in _values(m.group())):
            s = text[v:b]
            if v < word.end() or b - v < MIN_LENGTH or not _looks_random(s):
                continue
            if low[bisect_left(ends, v + 1)] < b:  # a known span that ends after v starts before b
                continue
            n = novelty(_around(text, v, b), s)
            if n >= min_novelty:
                out.append((v, 3, b, n))
                break
    return out


def measured_spans(text: str | None, min_novelty: float = MIN_NOVELTY) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, novelty) of all spans, by start, then kind."""
    if not text:
        return []
    base = base_spans(text)
    extra = novel_spans(text, base, min_novelty) if SENSITIVE.search(text) else []
    return sorted([(a, k, e, novelty(_around(text, a, e), text[a:e])) for a, k, e in base] + extra)


def all_spans(text: str | None, min_novelty: float = MIN_NOVELTY) -> list[tuple[int, int, int]]:
    if not text:
        return []
    base = base_spans(text)
    extra = novel_spans(text, base, min_novelty) if SENSITIVE.search(text) else []
    return sorted(base + [x[:3] for x in extra])


def find_secrets(
    docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), min_novelty: float = MIN_NOVELTY
) -> DataFrame:
    """``keep`` and secrets array<struct<kind,start,end,value,novelty>>, by start, then kind.

    Positions are code points, ends exclusive; novelty is in compressed bytes a byte. One
    row per row of ``docs``; null and empty texts have no secrets; very long texts are
    searched whole; equal starts go by kind, as KINDS lists them. Empty tables give no
    rows. Extra columns are ignored.
    """
    kinds = {k: docs.schema[k].dataType.simpleString() for k in keep}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", secrets array<struct<kind:string,start:int,end:int,value:string,novelty:double>>"
    element = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("novelty", pa.float64())])

    def run(batches):
        for b in sliced(batches):
            found = []
            for t in b.column(len(keep)).to_pylist():
                found.append(
                    [{"kind": KINDS[k], "start": a, "end": e, "value": t[a:e], "novelty": n} for a, k, e, n in measured_spans(t, min_novelty)]
                )
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keep)], pa.array(found, pa.list_(element))], [*keep, "secrets"]
            )

    last = fresh_names(keep, ["secret_text"])["secret_text"]
    return docs.select(*keep, docs[text].cast("string").alias(last)).mapInArrow(run, schema)


def redact_secrets(docs: DataFrame, text: str = "text", min_novelty: float = MIN_NOVELTY, mask: str = "[{kind}]") -> DataFrame:
    """``docs`` with each secret span of the text replaced by its kind in brackets.

    Overlapping spans become one, named for the first. Nulls and empty texts stay; repeated
    rows are treated alike; all columns stay, whatever their names.
    """
    names = docs.columns
    at = names.index(text)

    def run(batches):
        for b in sliced(batches):
            out = []
            for t in b.column(at).to_pylist():
                spans = all_spans(t, min_novelty)
                if spans:
                    parts, last = [], 0
                    for a, k, e in spans:
                        if a >= last:
                            parts += [t[last:a], mask.format(kind=KINDS[k])]
                        last = max(last, e)
                    t = "".join([*parts, t[last:]])
                out.append(t)
            columns = list(b.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def _digests(df: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    shown = lambda kinds: F.array_join(
        F.transform(
            F.filter("secrets", lambda s: s["kind"].isin(*kinds)),
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
    n = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")
    return df.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(shown(KINDS[:3]), 256).alias("base_sha256"),
        shown(KINDS).alias("spans"),
        n("novel").alias("n_novel"),
        # The measure of each span, in thousandths.
        F.array_join(F.transform("secrets", lambda s: F.round(s["novelty"] * 1000).cast("int").cast("string")), ",").alias("novelty"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(find_secrets(table(spark, sf_dir, "documents")))
