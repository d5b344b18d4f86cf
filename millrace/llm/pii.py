"""Personal data replaced by format-preserving pseudonyms, in DataFrame functions only.

A text is cut at everything that looks like personal data; what is valid of its
kind is permuted by a keyed Feistel network within its format, so that equal
values stay equal across documents, different ones stay different, and check
digits and calendars stay valid:

card     Luhn-valid digits, also in groups: all but the last are permuted, the last recomputed
ssn      social security numbers, within the valid areas, groups and serials
iban     with or without blanks, of its country's length: the digits after the check digits
         are permuted, these recomputed; letters stay
ip       IPv4 addresses
ip6      IPv6 addresses, all but the first group, colons in place
phone    the digits after the country code, or after 0 and the next digit
date     ISO, dotted and slashed (month first) dates from 1900 to 2099, within these years
email    letters and digits of the local part and of the domain but its last label, in
         lower case; addresses of one domain stay in one domain
secret   32 to 512 hexadecimal digits of one case
key      access keys with a known beginning, which stays

What has the looks but not the validity (a date of month 13, an address part over
255, a social security number of area 000, 16 digits with a wrong check digit)
stays as it is.

A network alternates over a pair (a, b): of remainders, a += f(b), b += f(a); of
strings, each sign of a moves on in its alphabet by a stream drawn from b, and the
other way round. The round function is a keyed SHA-256. Its secret comes from the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KEY = "replace this key in production"

_EDGE = r"(?<![A-Za-z0-9])"
_END = r"(?![A-Za-z0-9])"
_DAY, _MONTH, _YEAR = r"(?:0[1-9]|[12][0-9]|3[01])", r"(?:0[1-9]|1[0-2])", r"(?:19|20)[0-9]{2}"
#: The length of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
_IBAN_FORMS = "|".join(f"(?:{'|'.join(lands.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, lands in IBAN_LENGTHS.items())
_H4 = "[0-9a-fA-F]{1,4}"
#: What each kind looks like. Earlier kinds win where two begin at one place. All repetitions are bounded or possessive.
LOOKS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,63}",
    "iban": _EDGE + rf"(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN_FORMS})" + _END,
    "key": _EDGE + r"(?:A[KS]IA[A-Z0-9]{16}|gh[opsur]_[A-Za-z0-9]{36}|sk[-_](?:live[-_]|test[-_]|proj-)?[A-Za-z0-9]{20,64}+)" + _END,
    "secret": _EDGE + r"(?:[0-9a-f]{32,512}+|[0-9A-F]{32,512}+)" + _END,
    "iso date": _EDGE + f"{_YEAR}-{_MONTH}-{_DAY}" + _END,
    "dotted date": _EDGE + rf"{_DAY}\.{_MONTH}\.{_YEAR}" + _END,
    "slashed date": _EDGE + f"{_MONTH}/{_DAY}/{_YEAR}" + _END,
    "ip": r"(?<![A-Za-z0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[A-Za-z0-9])",
    "ip6": rf"(?<![A-Za-z0-9:.])(?:(?:{_H4}:){{7}}{_H4}|(?:[23][0-9a-fA-F]{{3}}|[fF][dD][0-9a-fA-F]{{2}}|[fF][eE]80)(?::{_H4}){{0,5}}::(?:{_H4}(?::{_H4}){{0,5}})?)(?![A-Za-z0-9:])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "card": _EDGE + r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5})" + _END,
    "phone": r"(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|0[1-9][0-9]{1,3} [0-9]{3,4} [0-9]{3,4}|07[0-9]{3} [0-9]{6})(?![0-9])",
}
PATTERN = "|".join(LOOKS.values())
DATES = {"iso date": "yyyy-MM-dd", "dotted date": "dd.MM.yyyy", "slashed date": "MM/dd/yyyy"}
_HEX, _ALNUM = "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyz"
#: 1900-01-01 to 2099-12-31 has 17 * 4297 days.
_DAYS = (17, 4297)
#: Areas 001 to 899 without 666; groups 01 to 99 with serials 0001 to 9999.
_SSN = (898, 99 * 9999)


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts, F.lit(key)), 256)


def _number(digest: Column) -> Column:
    """The first 60 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(key: str, kind: str, a: Column, b: Column, a_size: Column, b_size: Column) -> Column:
    """The pair (a, b), 0 <= a < a_size and 0 <= b < b_size, permuted."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def step(pair: Column, k: Column) -> Column:
        even = k % 2 == 0
        other = F.when(even, pair["b"]).otherwise(pair["a"])
        drawn = _number(_digest(key, F.lit(kind), a_size.cast("string"), b_size.cast("string"), k.cast("string"), other.cast("string")))
        return F.struct(
            F.when(even, (pair["a"] + drawn % a_size) % a_size).otherwise(pair["a"]).alias("a"),
            F.when(even, pair["b"]).otherwise((pair["b"] + drawn % b_size) % b_size).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _with(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """A string of 2 to 36 digits, permuted among those of its length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    pair = feistel(key, kind, F.substr(digits, F.lit(1), half), F.substr(digits, half + 1, n - half), power(half), power(n - half))
    return _with(pair, lambda p: F.concat(F.lpad(p["a"].cast("string"), half, F.lit("0")), F.lpad(p["b"].cast("string"), n - half, F.lit("0"))))


def _signs(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def permuted_text(key: str, kind: str, text: Column, letters: Column) -> Column:
    """A string over the alphabet ``letters``, permuted among those of its length."""
    half = F.floor(F.length(text) / 2).cast("int")

    def moved(mine: Column, other: Column, k: Column) -> Column:
        # a digest draws 16 numbers of four hexadecimal digits
        blocks = F.sequence(F.lit(0), F.floor(F.length(mine) / 16).cast("int"))
        stream = F.array_join(F.transform(blocks, lambda j: _digest(key, F.lit(kind), F.length(mine).cast("string"), k.cast("string"), j.cast("string"), other)), "")

        def letter(drawn: Column) -> Column:
            step = lambda i: F.conv(F.substr(drawn, i * 4 + 1, F.lit(4)), 16, 10).cast("int")
            at = lambda c, i: (F.instr(letters, c) - 1 + step(i)) % F.length(letters) + 1
            return F.array_join(F.transform(_signs(mine), lambda c, i: F.substr(letters, at(c, i), F.lit(1))), "")

        return _with(stream, letter)

    def step(pair: Column, k: Column) -> Column:
        even = k % 2 == 0
        turn = F.struct(F.when(even, pair["a"]).otherwise(pair["b"]).alias("mine"), F.when(even, pair["b"]).otherwise(pair["a"]).alias("other"))
        closed = lambda new, other: F.struct(F.when(even, new).otherwise(other).alias("a"), F.when(even, other).otherwise(new).alias("b"))
        return _with(turn, lambda t: _with(moved(t["mine"], t["other"], k), lambda new: closed(new, t["other"])))

    start = F.struct(F.substr(text, F.lit(1), half).alias("a"), F.substr(text, half + 1, F.length(text) - half).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda pair: F.concat(pair["a"], pair["b"]))


def refilled(form: Column, fill: Column, letters: bool = False) -> Column:
    """``form`` with its digits, and its lower-case letters if told, replaced in order by the signs of ``fill``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(state: Column, c: Column) -> Column:
        slot = c.between("0", "9") | c.between("a", "z") if letters else c.between("0", "9")
        return F.struct(
            F.concat(state["out"], F.when(slot, F.substr(fill, state["at"], F.lit(1))).otherwise(c)).alias("out"),
            (state["at"] + slot.cast("int")).alias("at"),
        )

    return F.aggregate(_signs(form), start, step, lambda s: s["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of all digits; valid numbers give a multiple of 10."""

    def step(total: Column, k: Column) -> Column:
        d = F.substr(digits, F.length(digits) - k, F.lit(1)).cast("int") * (1 + k % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step)


def _card(key: str, value: Column) -> Column:
    def change(digits: Column) -> Column:
        head = permuted_digits(key, "card", F.substr(digits, F.lit(1), F.length(digits) - 1))
        closed = _with(head, lambda h: F.concat(h, F.pmod(-luhn_sum(F.concat(h, F.lit("0"))), F.lit(10)).cast("string")))
        return F.when(luhn_sum(digits) % 10 == 0, refilled(value, closed))

    return _with(_digits(value), change)


def _ip(key: str, value: Column) -> Column:
    def change(parts: Column) -> Column:
        pair = feistel(key, "ip", parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], F.lit(65536), F.lit(65536))
        octet = lambda x, high: (F.floor(x / 256) if high else x % 256).cast("string")
        joined = _with(pair, lambda p: F.concat_ws(".", octet(p["a"], True), octet(p["a"], False), octet(p["b"], True), octet(p["b"], False)))
        return F.when(F.array_max(parts) <= 255, joined)

    return _with(F.transform(F.split(value, "[.]"), lambda c: c.cast("long")), change)


def _ssn(key: str, value: Column) -> Column:
    part = lambda at, n: F.substring(value, at, n).cast("long")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    pair = feistel(key, "ssn", area - 1 - (area > 666).cast("long"), (group - 1) * 9999 + serial - 1, F.lit(_SSN[0]), F.lit(_SSN[1]))

    def written(p: Column) -> Column:
        new = p["a"] + 1 + (p["a"] >= 665).cast("long")
        pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return F.concat_ws("-", pad(new, 3), pad(F.floor(p["b"] / 9999) + 1, 2), pad(p["b"] % 9999 + 1, 4))

    return F.when(valid, _with(pair, written))


def _mod97(value: Column) -> Column:
    """The remainder by 97 of an IBAN in its check order, letters as 10 to 35."""
    turned = F.concat(F.substring(value, 5, 64), F.substring(value, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)


def _iban(key: str, value: Column) -> Column:
    def check(land: Column, body: Column) -> Column:
        return F.lpad((98 - _mod97(F.concat(land, F.lit("00"), body))).cast("string"), 2, "0")

    def change(plain: Column) -> Column:
        land, body = F.substring(plain, 1, 2), F.substring(plain, 5, 64)
        digits = _digits(body)
        valid = (check(land, body) == F.substring(plain, 3, 2)) & (F.length(digits) >= 2)
        closed = lambda new: refilled(value, F.concat(check(land, refilled(body, new)), new))
        return F.when(valid, _with(permuted_digits(key, "iban", digits), closed))

    return _with(F.regexp_replace(value, " ", ""), change)


def _ip6(key: str, value: Column) -> Column:
    low = F.lower(value)
    first = F.regexp_extract(low, "^[^:]*", 0)
    rest = F.substr(low, F.length(first) + 1, F.length(low))
    new = permuted_text(key, "ip6", F.regexp_replace(rest, ":", ""), F.lit(_HEX))
    return F.concat(first, refilled(rest, new, letters=True))


def _phone(key: str, value: Column) -> Column:
    land = F.regexp_extract(value, r"^(?:\+[0-9]{1,3}(?=[^0-9])|0[1-9](?=[0-9]* ))", 0)
    rest = F.substr(value, F.length(land) + 1, F.length(value))
    return F.concat(land, refilled(rest, permuted_digits(key, "phone", _digits(rest))))


def _date(key: str, value: Column, form: str) -> Column:
    day = F.try_to_timestamp(value, F.lit(form)).cast("date")
    index = F.datediff(day, F.lit("1900-01-01").cast("date"))
    pair = feistel(key, "date", F.floor(index / _DAYS[1]), index % _DAYS[1], F.lit(_DAYS[0]), F.lit(_DAYS[1]))
    moved = _with(pair, lambda p: F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), (p["a"] * _DAYS[1] + p["b"]).cast("int")), form))
    return F.when(index.isNotNull(), moved)


def _email(key: str, value: Column) -> Column:
    low = F.lower(value)
    local, domain = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)
    last = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    name = F.substr(domain, F.lit(1), F.length(domain) - F.length(last))
    new = lambda kind, part: refilled(part, permuted_text(key, kind, F.regexp_replace(part, "[^a-z0-9]", ""), F.lit(_ALNUM)), letters=True)
    return F.when(F.length(domain) <= 253, F.concat(new("email", local), F.lit("@"), new("domain", name), last))


def _secret(key: str, value: Column) -> Column:
    new = permuted_text(key, "secret", F.lower(value), F.lit(_HEX))
    return F.when(value.rlike("[A-F]"), F.upper(new)).otherwise(new)


def _key(key: str, value: Column) -> Column:
    head = F.regexp_extract(value, "^(?:A[KS]IA|gh[opsur]_|sk[-_](?:live[-_]|test[-_]|proj-)?)", 0)
    rest = F.substr(value, F.length(head) + 1, F.length(value))
    upper = _ALNUM[10:].upper()
    signs = F.when(value.startswith("A"), F.lit(_ALNUM[:10] + upper)).otherwise(F.lit(_ALNUM + upper))
    return F.concat(head, permuted_text(key, "key", rest, signs))


_CHANGE = {"email": _email, "iban": _iban, "secret": _secret, "key": _key, "ip": _ip, "ip6": _ip6, "ssn": _ssn, "phone": _phone, "card": _card}


def kind_of(value: Column) -> Column:
    """The name of the first kind that the whole of ``value`` looks like."""
    out = None
    for kind, look in LOOKS.items():
        fits = value.rlike(f"^(?:{look})$")
        out = F.when(fits, F.lit(kind)) if out is None else out.when(fits, F.lit(kind))
    return out


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """What stands for ``value`` of ``kind``; null if it isn't valid."""
    out = None
    for name in LOOKS:
        new = _date(key, value, DATES[name]) if name in DATES else _CHANGE[name](key, value)
        out = F.when(kind == name, new) if out is None else out.when(kind == name, new)
    return out


def pseudonymised(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text with pseudonyms, n_found, kinds.

    ``n_found`` counts the valid values, which are all replaced (a permutation
    may map one to itself), ``kinds`` names their kinds in the text's order. A
    null text stays null with nothing found. Equal rows give equal rows, an
    empty table an empty result; further columns are not looked at.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    maybe = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))
    found = F.when(maybe, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    marked = own.withColumn("values", F.transform(found, lambda v: F.struct(v.alias("old"), kind_of(v).alias("kind"))))
    changed = marked.withColumn("values", F.transform("values", lambda v: F.struct(v["old"], v["kind"], pseudonym(v["old"], v["kind"], key).alias("new"))))
    between = F.split("text", PATTERN, -1)
    text = F.array_join(F.zip_with(between, F.transform("values", lambda v: F.coalesce(v["new"], v["old"])), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    valid = F.filter("values", lambda v: v["new"].isNotNull())
    return changed.select(
        "doc_id",
        F.when(F.size("values") > 0, text).otherwise(F.col("text")).alias("text"),
        F.size(valid).alias("n_found"),
        F.transform(valid, lambda v: F.when(v["kind"].endswith("date"), F.lit("date")).otherwise(v["kind"])).alias("kinds"),
    )
