"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

Validated values are replaced by a keyed permutation within their own format:
payment cards (Luhn holds before and after), IBANs (mod 97 likewise), phone and
social-security numbers, IPv4 addresses, dates, and the local parts of e-mail
addresses. A permutation is a bijection, so equal values get equal pseudonyms in
every document, different values different ones, and the key undoes it. What
fails validation stays as it is. Separators and letters' places stay too.

Digits are read as a pair (l, r) of residues modulo a and b, and eight rounds add
a keyed hash of the one to the other in turn; any domain of a * b values works.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KEY = "tagloom"
ROUNDS = 8
KINDS = ("email", "phone", "ssn", "card", "iban", "ip", "date")
#: 400 Gregorian years are 146,097 = 27 * 5411 days; dates permute within them.
_EPOCH, _DATE_A, _DATE_B = "1800-01-01", 27, 5411

_NOT_IN_WORD, _WORD_ENDS = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_BYTE = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?<=\.[A-Za-z]{2,24})",
    "phone": r"(?<![A-Za-z0-9_+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}" + _WORD_ENDS
    + r"|(?<![A-Za-z0-9_+-])(?:\+[0-9]{1,3}[ .-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}" + _WORD_ENDS,
    "ssn": _NOT_IN_WORD + r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}" + _WORD_ENDS,
    "card": r"(?<![A-Za-z0-9_.-])[0-9](?:[ -]?[0-9]){12,18}" + _WORD_ENDS,
    "iban": _NOT_IN_WORD + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _WORD_ENDS,
    "ip": r"(?<![A-Za-z0-9_.])" + rf"{_BYTE}(?:\.{_BYTE}){{3}}" + r"(?!\.?[0-9A-Za-z_])",
    "date": _NOT_IN_WORD + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})" + _WORD_ENDS,
}
_ANY = "|".join(f"(?:{PATTERNS[k]})" for k in ("email", "date", "phone", "ssn", "iban", "ip", "card"))


def _number(c) -> Column:
    return c.try_cast("bigint")


def permute(value: Column, a, b, tweak: Column, key: str = KEY) -> Column:
    """A keyed permutation of 0 .. a * b - 1; ``tweak`` names an independent one."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("bigint") for x in (a, b))

    def noise(i, half, modulus):
        said = F.concat_ws(":", F.lit(key), tweak, i.cast("string"), half.cast("string"))
        return F.pmod(_number(F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10)), modulus)

    def step(s, i):
        even = i % 2 == 0
        left = F.when(even, (s["l"] + noise(i, s["r"], a)) % a).otherwise(s["l"])
        right = F.when(even, s["r"]).otherwise((s["r"] + noise(i, s["l"], b)) % b)
        return F.struct(left.alias("l"), right.alias("r"))

    quotient = F.floor((value - F.pmod(value, b)).cast("decimal(20,0)") / b).cast("bigint")
    start = F.struct(quotient.alias("l"), F.pmod(value, b).alias("r"))
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, start, step, lambda s: s["l"] * b + s["r"])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _power(base: int, n: Column) -> Column:
    return F.pow(F.lit(float(base)), n).cast("bigint")


def permute_digits(s: Column, tweak: Column, key: str = KEY) -> Column:
    """A string of up to 18 digits, permuted among those of its length."""
    n = F.length(s)
    u = F.floor(n / 2)
    moved = permute(_number(s), _power(10, u), _power(10, n - u), F.concat(tweak, n.cast("string")), key)
    return F.lpad(moved.cast("string"), n, "0")


def _laid_over(s: Column, new: Column, char: str) -> Column:
    """``s`` with its characters of class ``char`` replaced, in order, by those of ``new``."""
    at = lambda i: F.length(F.regexp_replace(F.substring(s, F.lit(1), i + 1), f"[^{char}]", ""))
    put = lambda c, i: F.when(c.rlike(f"[{char}]"), F.substring(new, at(i), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(s, ""), put), "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum, the last digit not doubled."""
    n = F.length(digits)
    value = lambda c, i: F.when((n - i) % 2 == 0, F.element_at(F.array(*[F.lit(2 * d - 9 * (d > 4)) for d in range(10)]), _number(c).cast("int") + 1)).otherwise(_number(c).cast("int"))
    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda s, x: s + x)


def _mod97(s: Column) -> Column:
    """An alphanumeric string, letters as 10 to 35, modulo 97."""
    value = lambda c: _number(F.conv(c, 36, 10))
    add = lambda m, c: F.when(value(c) > 9, (m * 100 + value(c)) % 97).otherwise((m * 10 + value(c)) % 97)
    return F.aggregate(F.split(s, ""), F.lit(0).cast("bigint"), add)


def _card(s: Column, key: str) -> Column:
    d = _digits(s)
    body = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), F.lit("card"), key)
    check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    return _laid_over(s, F.concat(body, check.cast("string")), "0-9")


def _iban(s: Column, key: str) -> Column:
    flat = F.regexp_replace(s, " ", "")
    country, bban = F.substring(flat, F.lit(1), F.lit(2)), F.substring(flat, F.lit(5), F.length(flat))
    d = _digits(bban)
    chunks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(d) - 1) / 15).cast("int"))),
        lambda i: permute_digits(F.substring(d, i * 15 + 1, F.lit(15)), F.concat(F.lit("iban"), country, i.cast("string")), key),
    )
    moved = F.when(F.length(d) > 0, _laid_over(bban, F.array_join(chunks, ""), "0-9")).otherwise(bban)
    check = 98 - _mod97(F.concat(moved, country, F.lit("00")))
    return _laid_over(s, F.concat(country, F.lpad(check.cast("string"), 2, "0"), moved), "A-Z0-9")


def _ssn(s: Column, key: str) -> Column:
    area, group, serial = (_number(F.substring(s, a, n)) for a, n in ((1, 3), (5, 2), (8, 4)))
    area = area - 1 - F.when(area > 666, 1).otherwise(0)
    moved = permute((area * 99 + group - 1) * 9999 + serial - 1, 898, 99 * 9999, F.lit("ssn"), key)
    high = F.floor(moved / (99 * 9999)).cast("bigint")
    new_area = high + 1 + F.when(high >= 665, 1).otherwise(0)
    new_group = F.floor(F.pmod(moved, F.lit(99 * 9999)) / 9999).cast("bigint") + 1
    return F.format_string("%03d-%02d-%04d", new_area, new_group, F.pmod(moved, F.lit(9999)) + 1)


def _phone(s: Column, key: str) -> Column:
    d = _digits(s)
    prefix = F.substring(d, F.lit(1), F.length(d) - 10)  # the country's code stays
    moved = permute_digits(F.substring(d, F.length(d) - 9, F.lit(10)), F.concat(F.lit("phone"), prefix), key)
    return _laid_over(s, F.concat(prefix, moved), "0-9")


def _ip(s: Column, key: str) -> Column:
    part = lambda i: _number(F.element_at(F.split(s, r"\."), i))
    n = ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4)
    moved = permute(n, 65536, 65536, F.lit("ip"), key)
    byte = lambda k: F.shiftright(moved, k).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", byte(24), byte(16), byte(8), byte(0))


_FORMATS = {r"-": "yyyy-MM-dd", r"\.": "dd.MM.yyyy", r"/": "MM/dd/yyyy", r"/ ": "dd/MM/yyyy"}


def _days(s: Column, form: str) -> Column:
    """Days since 1800-01-01 if ``s`` is a day of 1800 to 2199 in that format, else null."""
    day = F.try_to_timestamp(s, F.lit(form)).cast("date")
    n = F.datediff(day, F.to_date(F.lit(_EPOCH))).cast("bigint")
    return F.when((F.date_format(day, form) == s) & (n >= 0) & (n < _DATE_A * _DATE_B), n)


def _date(s: Column, key: str) -> Column:
    out = F.lit(None).cast("string")
    for sign, form in reversed(_FORMATS.items()):
        n = _days(s, form)
        moved = permute(n, _DATE_A, _DATE_B, F.lit("date"), key)
        day = F.date_add(F.to_date(F.lit(_EPOCH)), moved.cast("int"))
        out = F.when(s.rlike(sign.strip()) & n.isNotNull(), F.date_format(day, form)).otherwise(out)
    return out


def _email(s: Column, key: str) -> Column:
    local, domain = F.substring_index(s, "@", 1), F.substring_index(s, "@", -1)
    flat = F.lower(F.regexp_replace(local, "[^A-Za-z0-9]", ""))

    def chunk(i):
        c = F.substring(flat, i * 10 + 1, F.lit(10))
        n = F.length(c)
        u = F.floor(n / 2)
        tweak = F.concat(F.lit("email"), F.lower(domain), i.cast("string"), n.cast("string"))
        moved = permute(_number(F.conv(c, 36, 10)), _power(36, u), _power(36, n - u), tweak, key)
        return F.lpad(F.lower(F.conv(moved.cast("string"), 10, 36)), n, "0")

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.length(flat) - 1) / 10).cast("int")), chunk)
    return F.concat(_laid_over(local, F.array_join(chunks, ""), "A-Za-z0-9"), F.lit("@"), domain)


_MAKE = {"email": _email, "phone": _phone, "ssn": _ssn, "card": _card, "iban": _iban, "ip": _ip, "date": _date}


def _kind(m: Column) -> Column:
    """The kind of a match, null if it isn't valid."""
    whole = lambda k: m.rlike(f"^(?:{PATTERNS[k]})$")
    d = _digits(m)
    flat = F.regexp_replace(m, " ", "")
    moved = F.concat(F.substring(flat, F.lit(5), F.length(flat)), F.substring(flat, F.lit(1), F.lit(4)))
    a_date = F.coalesce(*[F.when(m.rlike(s.strip()), _days(m, f)) for s, f in _FORMATS.items()]).isNotNull()
    return (
        F.when(F.instr(m, "@") > 0, F.when(F.substring_index(m, "@", 1).rlike("[A-Za-z0-9]"), F.lit("email")))
        .when(whole("date"), F.when(a_date, F.lit("date")))
        .when(whole("ip"), F.lit("ip"))
        .when(whole("ssn"), F.lit("ssn"))
        .when(whole("phone"), F.lit("phone"))
        .when(whole("iban"), F.when((F.length(flat) >= 15) & (_mod97(moved) == 1), F.lit("iban")))
        .when(whole("card"), F.when((luhn_sum(d) % 10 == 0) & d.rlike("[1-9]"), F.lit("card")))
    )


def pseudonymise(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and ``_pii``: what was found.

    ``_pii`` is array<struct<kind, value, pseudonym>>, in order of place. Null
    texts stay null with an empty array; other columns stay. One row per row.
    """
    t = F.col(text).cast("string")
    found = F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.lit(_ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def made(p):
        out = F.lit(None).cast("string")
        for k, make in _MAKE.items():
            out = F.when(p["kind"] == k, make(p["value"], key)).otherwise(out)
        return F.struct(p["kind"].alias("kind"), p["value"].alias("value"), out.alias("pseudonym"))

    hits = docs.withColumn("_hits", F.coalesce(found, F.array().cast("array<string>")))
    typed = F.transform("_hits", lambda m: F.struct(_kind(m).alias("kind"), m.alias("value")))
    marked = hits.withColumn("_made", F.transform(typed, made))
    between = F.split(t, _ANY, -1)
    shown = F.transform("_made", lambda p: F.coalesce(p["pseudonym"], p["value"]))
    joined = F.array_join(F.zip_with(between, shown, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    out = marked.withColumn("_new", F.when(F.size("_hits") > 0, joined).otherwise(t))
    pii = F.filter("_made", lambda p: p["kind"].isNotNull())
    return out.select(*[F.col("_new").alias(text) if c == text else F.col(c) for c in docs.columns], pii.alias("_pii"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("_pii", lambda p: p["kind"] == k)).cast("bigint")
    return out.select("doc_id", "text", F.size("_pii").cast("bigint").alias("n_pii"), *[n(k).alias(f"n_{k}") for k in KINDS])
