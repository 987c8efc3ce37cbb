"""TEI XML in and out: a file is a row; nested markup is parsed in Arrow batches."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col

TOKENS = (
    "file string, doc_id string, sent_ord int, sent_id string, tok_ord int, tokid string, form string, lemma string, upos string, "
    "xpos string, feats string, head int, deprel string, reg string, expan string, space_after boolean, entity string, n_dtok int"
)
_COLUMNS = [tuple(f.split()) for f in TOKENS.split(",")]
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
#: Values of an attribute that are none.
NONE = (None, "", "--")
#: Token rows in a batch that leaves the reader.
ROWS = 10_000
#: Bytes of documents that are scanned at once.
SCANNED = 1 << 22
#: White space of XML.
BLANK = " \t\r\n"
#: The attributes that may hold a field, in order.
FALLBACKS = {"xpos": ("xpos", "msd", "pos"), "reg": ("reg", "nform"), "expan": ("expan", "fform"), "lemma": ("lemma",)}


def attr_fallback(*columns):
    """The first value that is neither empty nor ``--``."""
    return F.coalesce(*[F.nullif(F.nullif(col(c), F.lit("")), F.lit("--")) for c in columns])


def _first(get, names):
    for n in names:
        if (v := get(n)) not in NONE:
            return v
    return None


class _Tokens:
    """Target of an XML parser: collects the token rows of one document, without a tree.

    ``rows`` has a list for each token, in the order of ``TOKENS`` from ``sent_ord`` on. Only what follows
    an element (its tail) counts as white space or text between tokens.
    """

    def __init__(self, fallbacks):
        self.rows: list[list] = []
        self.lemma, self.xpos, self.reg, self.expan = (fallbacks[k] for k in ("lemma", "xpos", "reg", "expan"))
        self.seen: dict[str, int] = {}
        self.sent, self.tok, self.sid = -1, 0, None
        self.doc_id = None
        self.open: list = []  # entity outside each open element
        self.entity = None
        self.depth = 0  # of open elements from the token on; 0 outside of tokens
        self.tail: list[str] | None = None  # text since the last end of an element outside of tokens
        self.found = False

    def _between(self):
        text = "".join(self.tail)
        if text[0].isspace() or text.strip():
            self._spaced(text[0].isspace())

    def _spaced(self, blank):
        rows = self.rows
        if rows and rows[-1][13] is None and rows[-1][0] == self.sent:
            rows[-1][13] = blank

    def start(self, tag, attrs):
        if self.depth:
            if tag == "dtok" and self.depth == 1:
                self.n_dtok += 1
            if tag == "text" and not self.found:
                self.found, self.doc_id = True, attrs.get("id")
            self.depth += 1
            return
        if self.tail:
            self._between()
        self.tail = None
        if tag == "tok":
            if self.open:
                self._spaced(False)
            self.depth, self.attrs, self.text, self.n_dtok = 1, attrs, [], 0
            return
        if tag == "text" and not self.found:
            self.found, self.doc_id = True, attrs.get("id")
        self.open.append(self.entity)
        if tag == "s":
            self.sent, self.tok, self.sid = self.sent + 1, 0, attrs.get("id") or attrs.get("sent_id")
        elif tag == "name":
            self.entity = attrs.get("type") or "name"

    def end(self, tag):
        if self.depth:
            self.depth -= 1
            if not self.depth:
                self._token()
                self.tail = []
            return
        if self.tail:
            self._between()
        self.tail = None
        self.entity = self.open.pop()
        self.tail = []

    def data(self, text):
        if self.depth:
            self.text.append(text)
        elif self.tail is not None:
            self.tail.append(text)

    def _token(self):
        if self.sent < 0:
            self.sent = 0
        get = self.attrs.get
        form = get("form") or "".join(self.text).strip(BLANK)
        if form == "--":
            return
        i = get("id")
        if i:  # the n-th of a repeated id gets a suffix
            n = self.seen[i] = self.seen.get(i, 0) + 1
            i = i if n == 1 else f"{i}-{n}"
        upos, feats, deprel, head = get("upos"), get("feats"), get("deprel"), get("head") or "0"
        self.rows.append(
            [self.sent, self.sid, self.tok, i, form, _first(get, self.lemma), upos if upos not in NONE else None, _first(get, self.xpos), feats if feats not in NONE else None,
             int(head) if head.isdigit() else 0, deprel if deprel not in NONE else None, _first(get, self.reg), _first(get, self.expan), None, self.entity, self.n_dtok]
        )
        self.tok += 1

    def close(self):
        rows = self.rows
        for k in {r[0]: k for k, r in enumerate(rows)}.values():
            rows[k][13] = None
        return self


def parse(file: str, xml: str, fallbacks=FALLBACKS) -> list[tuple]:
    """Token rows of one document; broken XML has none; ``form="--"`` drops a token."""
    import xml.etree.ElementTree as ET

    parser = ET.XMLParser(target=_Tokens(fallbacks))
    try:
        parser.feed(xml)
        found = parser.close()
    except ET.ParseError:
        return []
    doc_id = found.doc_id or file.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return [(file, doc_id, *r) for r in found.rows]


def _key(name: str) -> int:
    return int.from_bytes(name.encode(), "little")


#: Tags as ``scan`` knows them, and which may come after which: TEI > text > s > tok, no other level.
_TAGS = [_key(x) for x in ("TEI", "text id=", "s id=", "tok id=", "/tok", "/s", "/text", "/TEI")]
_TEI, _TEXT, _S, _TOK, _TOK_END, _S_END, _TEXT_END, _TEI_END = range(8)
_NEXT = np.zeros((8, 8), bool)
for _a, _b in ((0, 1), (1, 2), (1, 6), (2, 3), (2, 5), (3, 4), (4, 3), (4, 5), (5, 2), (5, 6), (6, 7), (7, 0)):
    _NEXT[_a, _b] = True
_ENTITIES = ("&amp;", "&lt;", "&gt;", "&quot;")
#: Masks for the first bytes of a word.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _table(known):
    """A multiplier, a shift, and for each slot of 64 the key and its place: no two keys share a slot."""
    keys = np.array(known, np.uint64)
    for m in range(0x9E3779B97F4A7C15, 1 << 64, 0x100000002):
        slots = keys * np.uint64(m) >> np.uint64(58)
        if len(set(slots.tolist())) == len(known):
            break
    at, place = np.zeros(64, np.uint64), np.zeros(64, np.int8)
    at[slots], place[slots] = keys, np.arange(len(known))
    return np.uint64(m), np.uint64(58), at, place


def _codes(keys, table):
    """The place of each key in what ``table`` was made of, or None if one is not there."""
    m, shift, at, place = table
    slots = (keys * m >> shift).astype(np.int64)
    return place[slots] if (at[slots] == keys).all() else None


def scan(data: bytes, starts, fallbacks=FALLBACKS, wanted=None):
    """Columns of the token rows of many documents at once, and the document of each row; None if one of them
    is not of the plain form that writers give (then ``parse`` has to read them one by one).

    ``data`` has the documents end to end from ``starts``. The plain form: TEI > text > s > tok and nothing else,
    an id in each but TEI, known attributes after it, no white space in tags, four entities; whatever else XML
    allows, and whatever it forbids, gives None.
    """
    n = len(data)
    whole = np.frombuffer(data + bytes(8), np.uint8)
    buf, eight = whole[:n], np.ndarray((n + 1,), "<u8", whole, 0, (1,))
    pos = np.flatnonzero((buf == 60) | (buf == 62) | (buf == 34))
    kind = buf[pos]
    lt, gt = np.flatnonzero(kind == 60), np.flatnonzero(kind == 62)
    if not len(lt) or len(lt) != len(gt) or lt[0] != 0 or (lt > gt).any() or (gt[:-1] + 1 != lt[1:]).any() or gt[-1] != len(kind) - 1:
        return None
    held = gt - lt - 1  # quotes in each tag
    if (held & 1).any():
        return None
    length = pos[lt + 1] - pos[lt] - 1
    if (length > 8).any():
        return None
    tag = _codes(eight[pos[lt] + 1] & _LOW[length], _table(_TAGS))
    if tag is None:
        return None
    first, last = np.searchsorted(pos[lt], starts), np.searchsorted(pos[lt], np.append(starts[1:], n)) - 1
    if (pos[lt[first]] != starts).any() or (pos[gt[last]] + 1 != np.append(starts[1:], n)).any() or (tag[first] != _TEI).any() or (tag[last] != _TEI_END).any():
        return None
    if (tag == _TEI).sum() != len(starts) or not _NEXT[tag[:-1], tag[1:]].all():
        return None
    named = (tag == _TEXT) | (tag == _S) | (tag == _TOK)
    if ((held > 0) != named).any() or (held[named & (tag != _TOK)] != 2).any():
        return None
    odd = np.flatnonzero(buf < 32)
    if len(odd) and ((buf[odd] != 10) | (whole[odd - 1] != 62) | (whole[odd + 1] != 60)).any():
        return None
    odd = np.flatnonzero(buf == 0xEF)
    if len(odd) and ((whole[odd + 1] == 0xBF) & (whole[odd + 2] >= 0xBE)).any():
        return None
    amp = np.flatnonzero(buf == 38)
    if len(amp) and not np.logical_or.reduce([eight[amp] & _LOW[len(x)] == _key(x) for x in _ENTITIES]).all():
        return None

    toks = np.flatnonzero(tag == _TOK)
    opening = np.zeros(len(kind), bool)
    opening[np.flatnonzero(kind == 34)[::2]] = True
    opening[lt[named] + 1] = False
    o = np.flatnonzero(opening)  # of second and later attributes: only tokens have them
    size = pos[o] - pos[o - 1] - 1
    names = list(dict.fromkeys(["lemma", "upos", "feats", "head", "deprel", *(x for v in fallbacks.values() for x in v)]))
    short = [x for x in names if len(x.encode()) <= 6 and x not in ("id", "form")]
    if (size > 8).any() or (pos[gt[named]] - pos[gt[named] - 1] != 1).any() or len(short) > 30:
        return None
    name = _codes(eight[pos[o - 1] + 1] & _LOW[size], _table([_key(f" {x}=") for x in short])) if len(o) else np.zeros(0, np.int64)
    if name is None:
        return None
    if len(o):  # an attribute once in a token
        count = (held[toks] >> 1) - 1
        segments, bits = (np.cumsum(count) - count)[count > 0], np.int32(1) << name.astype(np.int32)
        if (np.add.reduceat(bits, segments) != np.bitwise_or.reduceat(bits, segments)).any():
            return None

    begin, end = pos[gt[toks]] + 1, pos[lt[toks + 1]]
    full = begin < end
    if (full & ((whole[begin] <= 32) | (whole[end - 1] <= 32) | (end - begin == 2) & (whole[begin] == 45) & (whole[begin + 1] == 45))).any():
        return None
    tail = pos[lt[toks + 2]] - pos[gt[toks + 1]] - 1
    if (tail > 1).any() or (whole[pos[gt[toks + 1]] + 1][tail == 1] != 32).any():
        return None

    cuts = np.empty(2 * len(pos), np.int32)
    cuts[::2], cuts[1::2] = pos, pos + 1
    pieces = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data))

    def text(at, mask=None):
        out = pieces.take(pa.array(2 * at + 1, mask=mask))
        if len(amp) and pc.any(pc.match_substring(out, "&")).as_py():
            for x, y in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
                out = pc.replace_substring(out, x, y)
        return out

    tok_of = np.repeat(np.arange(len(toks)), (held[toks] >> 1) - 1)

    def attribute(x):
        sel = np.flatnonzero(name == short.index(x)) if x in short else ()
        if not len(sel):
            return None
        at = np.full(len(toks), -1, np.int64)
        at[tok_of[sel]] = o[sel]
        begin, size = pos[at] + 1, pos[np.minimum(at + 1, len(pos) - 1)] - pos[at] - 1
        none = (at < 0) | (size == 0) | (size == 2) & (whole[begin] == 45) & (whole[begin + 1] == 45)
        return text(at, none)

    def value(field):
        found = [c for x in fallbacks.get(field, (field,)) if (c := attribute(x)) is not None]
        return pc.coalesce(*found) if len(found) > 1 else found[0] if found else pa.nulls(len(toks), pa.string())

    doc, sent = (np.cumsum(tag == _TEI) - 1)[toks], (np.cumsum(tag == _S) - 1)[toks]
    ids = lambda k: text(lt[np.flatnonzero(tag == k)] + 1)
    doc_ids = ids(_TEXT)
    if len(doc_ids) and pc.min(pc.binary_length(doc_ids)).as_py() == 0:
        return None
    out = {}
    for column, kind_ in _COLUMNS:
        if wanted is not None and column not in wanted or column == "file":
            continue
        if column == "doc_id":
            c = doc_ids.take(pa.array(doc))
        elif column == "sent_ord":
            before = np.concatenate([[0], np.cumsum(tag == _S)])[first]
            c = pa.array((sent - before[doc]).astype(np.int32))
        elif column == "tok_ord":
            new = np.append(True, sent[1:] != sent[:-1])[: len(sent)]
            c = pa.array((np.arange(len(sent)) - np.flatnonzero(new)[np.cumsum(new) - 1]).astype(np.int32))
        elif column == "sent_id":
            c = ids(_S).take(pa.array(sent))
            c = pc.if_else(pc.equal(c, ""), None, c)
        elif column == "tokid":
            c = text(lt[toks] + 1)
            if len(toks) and (pc.min(pc.binary_length(c)).as_py() == 0 or len(set(zip(doc.tolist(), c.to_pylist()))) < len(toks)):
                return None
        elif column == "form":
            c = text(gt[toks])
        elif column == "head":
            c = attribute("head")
            if c is not None and pc.all(pc.match_substring_regex(c, "^[0-9]{1,9}$")).as_py() is False:
                return None
            c = pa.array(np.zeros(len(toks), np.int32)) if c is None else pc.fill_null(c, "0").cast(pa.int32())
        elif column == "space_after":
            c = pa.array(tail == 1, mask=tag[toks + 2] != _TOK)
        elif column == "entity":
            c = pa.nulls(len(toks), pa.string())
        elif column == "n_dtok":
            c = pa.array(np.zeros(len(toks), np.int32))
        else:
            c = value(column)
        out[column] = c
    return out, doc


def token_batches(batches, fallbacks=FALLBACKS, wanted=None):
    """Record batches of token rows of batches with ``file, value``: documents of the plain form by ``scan``, others by ``parse``."""
    columns = [(c, k) for c, k in _COLUMNS if wanted is None or c in wanted]
    schema = pa.schema([(c, _ARROW[k]) for c, k in columns])
    keep = [i for i, (c, _) in enumerate(_COLUMNS) if wanted is None or c in wanted]

    def read(docs):
        if not docs:
            return
        starts = np.cumsum([0, *(len(x) for _, x in docs[:-1])])
        if (got := scan(b"".join(x for _, x in docs), starts, fallbacks, wanted)) is not None:
            found, doc = got
            if "file" in schema.names:
                found["file"] = pa.array([f for f, _ in docs], pa.string()).take(pa.array(doc))
            whole = pa.RecordBatch.from_arrays([found[c] for c in schema.names], schema=schema)
            yield from (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS))
        elif len(docs) > 1:
            yield from read(docs[: len(docs) // 2])
            yield from read(docs[len(docs) // 2 :])
        else:
            rows = parse(docs[0][0], docs[0][1].decode(), fallbacks)
            for i in range(0, len(rows), ROWS):
                cut = list(zip(*rows[i : i + ROWS]))
                yield pa.RecordBatch.from_arrays([pa.array(cut[k], f.type) for k, f in zip(keep, schema)], schema=schema)

    docs, size = [], 0
    for b in batches:
        for file, xml in zip(b.column("file").to_pylist(), b.column("value").cast(pa.binary()).to_pylist()):
            if xml:
                docs.append((file or "", xml))
                size += len(xml)
                if size >= SCANNED:
                    yield from read(docs)
                    docs, size = [], 0
    yield from read(docs)


def schema_of(wanted=None) -> str:
    return ", ".join(f"{c} {k}" for c, k in _COLUMNS if wanted is None or c in wanted)


def read_tei(files: DataFrame, fallbacks=FALLBACKS, wanted=None) -> DataFrame:
    """Tokens of ``file, value`` rows, in the normalised model; ``wanted``: only these columns of it."""
    return files.select("file", "value").mapInArrow(lambda batches: token_batches(batches, fallbacks, wanted), schema_of(wanted))


def read_tei_files(spark: SparkSession, path: str, **options) -> DataFrame:
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").text(path)
    return read_tei(files.select(F.col("_metadata.file_path").alias("file"), "value"), **options)


def xml_escape(c):
    out = F.replace(F.replace(F.replace(col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;"))


def write_tei(nested: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """doc_id, value: a TEI document of each row of (doc_id, sents); ``names`` renames attributes.

    Null, empty and ``_`` values are left out, but for lemma.
    """
    names = names or {}
    attr = lambda n, c, keep=False: F.when(
        c.isNotNull() & (c != "") & (F.lit(keep) | (c != "_")), F.concat(F.lit(f' {names.get(n, n)}="'), xml_escape(c), F.lit('"'))
    ).otherwise("")

    def sentence(s):
        def token(t):
            place = F.concat_ws("-", F.lit("w"), (s["sent_ord"] + 1).cast("string"), (t["tok_ord"] + 1).cast("string"))
            values = [("upos", t["tag"]), ("xpos", t["xpos"]), ("feats", t["feats"]), ("head", t["head"].cast("string")), ("deprel", t["deprel"]), ("reg", t["reg"])]
            return F.concat(
                F.lit("<tok"), attr("id", place), attr("lemma", t["lemma"], True), *[attr(n, c) for n, c in values],
                F.lit(">"), xml_escape(t["form"]), F.lit("</tok>"), F.when(t["space_after"], " ").otherwise(""),
            )

        return F.concat(F.lit('<s id="s-'), (s["sent_ord"] + 1).cast("string"), F.lit('">'), F.array_join(F.transform(s["ts"], token), ""), F.lit("</s>"))

    body = F.array_join(F.transform("sents", sentence), "\n")
    return nested.select("doc_id", F.concat(F.lit('<TEI><text id="'), F.col("doc_id").cast("string"), F.lit('">\n'), body, F.lit("\n</text></TEI>")).alias("value"))


def insert_tokens(texts: DataFrame, offsets: DataFrame) -> DataFrame:
    """doc_id, sent_ord, value: ``text`` with <tok> around the ranges of ``offsets``."""
    o = offsets.filter("start IS NOT NULL").groupBy("doc_id", "sent_ord").agg(F.array_sort(F.collect_list(F.struct("start", "end", "tok_ord"))).alias("os"))

    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples():
                parts, last = [], 0
                for x in r.os:
                    if x["start"] >= last:
                        parts += [r.text[last : x["start"]], f'<tok id="w-{x["tok_ord"] + 1}">', r.text[x["start"] : x["end"]], "</tok>"]
                        last = x["end"]
                out.append((r.doc_id, r.sent_ord, "".join(["<s>", *parts, r.text[last:], "</s>"])))
            yield pd.DataFrame(out, columns=["doc_id", "sent_ord", "value"])

    return texts.join(o, ["doc_id", "sent_ord"]).mapInPandas(run, "doc_id bigint, sent_ord int, value string")


def writeback(files: DataFrame, updates: DataFrame, attribute: str = "upos") -> DataFrame:
    """file, value: XML whose tokens, found by id, get ``value`` of updates (file, tokid,
    value) as an attribute; text stays as it was, else the file is left alone."""
    u = updates.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("tokid", "value"))).alias("us"))
    j = files.join(u, "file", "left").select("file", F.col("value").alias("xml"), F.col("us"))

    def run(frames):
        import xml.etree.ElementTree as ET

        for f in frames:
            out = []
            for r in f.itertuples():
                new = r.xml
                us = dict(r.us) if r.us is not None else {}
                try:
                    root = ET.fromstring(r.xml)
                    before = "".join(root.itertext())
                    for t in root.iter("tok"):
                        if t.get("id") in us:
                            t.set(attribute, us[t.get("id")])
                    if "".join(root.itertext()) == before:
                        new = ET.tostring(root, encoding="unicode")
                except ET.ParseError:
                    pass
                out.append((r.file, new))
            yield pd.DataFrame(out, columns=["file", "value"])

    return j.mapInPandas(run, "file string, value string")


def read_tagset(xml: str) -> list[tuple[str, int, str, str, str]]:
    """(category, position, character, feature, value) rows of a positional tag set."""
    import xml.etree.ElementTree as ET

    rows = []
    for main in ET.fromstring(xml).findall(".//positions/item"):
        for pos in main.findall("item"):
            for v in pos.findall("item"):
                rows.append((main.get("key"), int(pos.get("pos")), v.get("key"), pos.get("display"), v.get("display")))
    return rows


def decode_positional(tags: DataFrame, tagset: DataFrame) -> DataFrame:
    """xpos, feats of positional tags, by a join of their characters with ``tagset``."""
    chars = tags.select("xpos", F.left("xpos", F.lit(1)).alias("category"), F.posexplode(F.split("xpos", "")).alias("position", "character"))
    hit = chars.join(tagset, ["category", "position", "character"])
    feats = hit.groupBy("xpos").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "feature", "value"))), "|").alias("feats"))
    return tags.select("xpos").distinct().join(feats, "xpos", "left").select("xpos", F.coalesce("feats", F.lit("_")).alias("feats"))
