"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Numbers and dates that pass their validation are permuted within their format by a keyed
Feistel network, so equal values stay equal across documents, different ones stay different,
and the result passes the same validation:

====== ============================================ =====================================
kind   found as                                     permuted
====== ============================================ =====================================
iban   two letters, two check digits, 11 to 30      the digits after the check digits
       more, or in groups of four; remainder 1      (and new check digits)
       modulo 97
date   YYYY-MM-DD, YYYY/MM/DD, DD/MM/YYYY,          the day within 1700-01-01..2099-12-31,
       DD.MM.YYYY, DD-MM-YYYY, MM/DD/YYYY where     which are 189 * 773 days
       DD/MM is no date, zeros or not; those that
       exist in 1700 to 2099
ip     four octets up to 255                        the upper and the lower 16 bits
ssn    AAA-GG-SSSS with a valid area, group, serial (area, group) and serial
card   13 to 19 digits, plain or grouped            all digits but the last; the last is
       (4-4-4-4, 4-6-5), passing Luhn               the new check digit
phone  +C or 00C and 6 to 14 digits in any groups,  the last 10 digits at most of what
       (AAA) BBB-CCCC and the like, 0A and groups   follows the country code or the 0
       (06 12 34 56 78, 030 1234567)
====== ============================================ =====================================

So a value gets one pseudonym however it is written: an IBAN with or without spaces, a day in any order, a
phone with its country code or with 0.

A value is a pair (a, b) with a < A and b < B; a round maps (a, b) to (b, a + F(b) mod A)
with F from SHA-256 over the key, the kind and the round, and the two swap roles each round.
That is a bijection for any A and B, so no walk outside the format is needed.  An e-mail
address has no fixed format; it becomes a keyed name, the same for equal addresses.
A 16-digit run that fails Luhn is no card and stays.

The key is the caller's; queries take it from the session (``brindle.pseudonyms.key``), and where
that is unset draw one for the application, which links values within it and is then gone.

Texts are split at the matches of one pattern and joined again around the pseudonyms, so a
text is scanned whole; every repetition in the pattern is bounded, so the time is linear.

A very long text is split at its matches, so it is held a few times over.  Nulls: a null text stays null with nothing found, an empty one stays empty; repeated rows get
the same pseudonyms; null ids and extra columns are kept as they are.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.session import fresh, plain

#: The session's setting that has the key.
KEY = "brindle.pseudonyms.key"
ROUNDS = 8
FIRST_DAY, DAYS = "1700-01-01", (189, 773)

#: The patterns by kind, in order of preference.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "date": r"(?<![0-9])(?<![0-9][./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})(?![0-9])(?![./-][0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9])(?!\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9+])(?:[0-9]{13,19}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])|(?<![0-9+])\+[1-9][0-9]{0,14}(?:[ ./-]?\([0-9]{1,4}\)[0-9]{0,8})?(?:[ ./-][0-9]{1,10}){0,6}(?![0-9])|(?<![0-9+])00[1-9][0-9]{0,12}(?:[ ./-]?\([0-9]{1,4}\)[0-9]{0,8})?(?:[ ./-][0-9]{1,10}){1,6}(?![0-9])|(?<![0-9.,/+-])0[1-9](?:[ .-][0-9]{2}){4}(?![0-9])|(?<![0-9.,/+-])0[1-9][0-9]{1,4}[ /-][0-9]{3,8}(?:[ -][0-9]{2,4}){0,3}(?![0-9])",
}
#: Country codes of one digit and of two; all others have three.
ONE_DIGIT, TWO_DIGITS = "^[17]", "^(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CARD_FORM = f"^(?:{PATTERNS['card']})$"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _int(x: Column) -> Column:
    return F.try_to_number(x, F.lit("9" * 19)).cast("long")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _pad(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), n, F.lit("0")) if isinstance(n, Column) else F.lpad(x.cast("string"), n, "0")


def luhn_sum(digits: Column, from_right: int) -> Column:
    """The sum of digits, every second one doubled; from_right is 1 if the last digit stands at the check place."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when((n - i + 1 - from_right) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _step97(r: Column, c: Column) -> Column:
    """The remainder modulo 97 after one more digit or letter, A as 10 to Z as 35."""
    code = F.ascii(c)
    return F.when(code >= 65, (r * 100 + code - 55) % 97).otherwise((r * 10 + code - 48) % 97)


def _mod97(letters: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.length(letters)), F.lit(0), lambda r, i: _step97(r, F.substr(letters, i, F.lit(1))))


def _iban_end(m: Column) -> Column:
    """How many characters of a match are an IBAN: up to the last end of a group at which the remainder is 1, or 0."""
    code = lambda i: F.ascii(F.substring(m, i, 1)) - 55
    head = code(1) * 10000 + code(2) * 100 + F.substring(m, 3, 2).cast("int")

    def add(s: Column, i: Column) -> Column:
        c = F.substr(m, i, F.lit(1))
        r = F.when(c == " ", s["r"]).otherwise(_step97(s["r"], c))
        n = s["n"] + (c != " ").cast("int")
        ends = (c != " ") & ((i == F.length(m)) | (F.substr(m, i + 1, F.lit(1)) == " "))
        return F.struct(r.alias("r"), n.alias("n"), F.when(ends & (n >= 11) & ((r.cast("long") * 1000000 + head) % 97 == 1), i).otherwise(s["end"]).alias("end"))

    return F.aggregate(F.sequence(F.lit(5), F.length(m)), F.struct(F.lit(0).alias("r"), F.lit(0).alias("n"), F.lit(0).alias("end")), add, lambda s: s["end"])


def _kind(m: Column) -> Column:
    kind = F.lit("none")  # never null, so that conditions on it decide
    for k in reversed(PATTERNS):
        kind = F.when(F.rlike(m, F.lit(f"^(?:{PATTERNS[k]})$")), F.lit(k)).otherwise(kind)
    return kind


def _core(x: Column) -> Column:
    """struct<lead, m, trail, kind> of a match: what of it is the value, which is less than all only where groups follow
    an IBAN, or where what is no IBAN has a card's number after its first group."""
    m, end = x["m"], F.when(x["kind"] == "iban", _iban_end(x["m"]))
    rest = F.substr(m, F.lit(6), F.length(m))
    part = lambda lead, core, trail, kind: F.struct(lead.alias("lead"), core.alias("m"), trail.alias("trail"), kind.alias("kind"))
    none = F.lit("")
    return F.when(end > 0, part(none, F.substr(m, F.lit(1), end), F.substr(m, end + 1, F.length(m)), x["kind"])).when((end == 0) & F.rlike(rest, F.lit(CARD_FORM)), part(F.substring(m, 1, 5), rest, none, F.lit("card"))).otherwise(part(none, m, none, x["kind"]))


def _date(m: Column) -> Column:
    """struct<day, order, short> of a date: days from FIRST_DAY, null if there is no such day; the order of its parts; whether without zeros."""
    p = [F.coalesce(F.get(F.split(m, "[-/.]"), F.lit(i)), F.lit("")) for i in range(3)]
    try_day = lambda y, month, d: F.datediff(F.try_to_date(F.concat_ws("-", y, month, d), "yyyy-M-d"), F.lit(FIRST_DAY).cast("date"))
    year_first = F.length(p[0]) == 4
    usual = try_day(p[2], p[1], p[0])
    other = F.when(F.contains(m, F.lit("/")), try_day(p[2], p[0], p[1]))
    order = F.when(year_first, "ymd").when(usual.isNull() & other.isNotNull(), "mdy").otherwise("dmy")
    short = F.when(year_first, F.least(F.length(p[1]), F.length(p[2]))).otherwise(F.least(F.length(p[0]), F.length(p[1]))) == 1
    return F.struct(F.when(year_first, try_day(p[0], p[1], p[2])).otherwise(F.coalesce(usual, other)).alias("day"), order.alias("order"), short.alias("short"))


def _number(m: Column) -> Column:
    """The digits of a phone that do not depend on how it is written: at most 10 after the country code or the 0; null if it is none."""
    d = _digits(m)
    abroad = F.when(F.startswith(m, F.lit("+")), d).when(F.startswith(m, F.lit("00")), F.substr(d, F.lit(3), F.length(d)))
    code = F.when(F.rlike(abroad, F.lit(ONE_DIGIT)), 1).when(F.rlike(abroad, F.lit(TWO_DIGITS)), 2).otherwise(3)
    own = F.when(abroad.isNotNull(), F.regexp_replace(F.substr(abroad, code + 1, F.length(abroad)), "^0", "")).when(F.startswith(d, F.lit("0")), F.substr(d, F.lit(2), F.length(d))).otherwise(d)
    fits = F.when(abroad.isNotNull(), F.length(abroad).between(8, 15) & (F.length(own) >= 6)).when(F.startswith(d, F.lit("0")), F.length(d).between(9, 12)).otherwise(F.length(d) >= 10)
    return F.when(fits, F.substr(own, F.greatest(F.lit(1), F.length(own) - 9), F.lit(10)))


def _pair(m: Column, kind: Column) -> Column:
    """(a, b, ma, mb) of a value that passes its validation, else null."""
    d = _digits(m)
    n = F.length(d)
    part = lambda a, b, ma, mb: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), ma.cast("long").alias("ma"), mb.cast("long").alias("mb"))
    half = lambda x, k: part(_int(F.substr(x, F.lit(1), k)), _int(F.substr(x, k + 1, F.length(x) - k)), F.pow(F.lit(10), k), F.pow(F.lit(10), F.length(x) - k))
    body = F.substr(d, F.lit(1), n - 1)
    tail = _digits(F.substr(m, F.lit(5), F.length(m)))
    tail = F.substr(tail, F.greatest(F.lit(1), F.length(tail) - 17), F.lit(18))
    octet = lambda i: F.try_to_number(F.get(F.split(m, "\\."), F.lit(i)), F.lit("999")).cast("int")
    octets = [octet(i) for i in range(4)]
    area, group, serial = (F.substring(d, *x).cast("int") for x in ((1, 3), (4, 2), (6, 4)))
    day, phone = _date(m)["day"], _number(m)
    lit = F.lit
    return (
        F.when((kind == "card") & (luhn_sum(d, 1) % 10 == 0), half(body, F.floor((n - 1) / 2).cast("int")))
        .when((kind == "iban") & (F.length(tail) >= 2) & (_iban_end(m) == F.length(m)), half(tail, F.floor(F.length(tail) / 2).cast("int")))
        .when((kind == "phone") & phone.isNotNull(), half(phone, F.floor(F.length(phone) / 2).cast("int")))
        .when((kind == "ip") & (F.greatest(*octets) <= 255), part(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], lit(65536), lit(65536)))
        .when((kind == "ssn") & area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), part((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1, serial - 1, lit(898 * 99), lit(9999)))
        .when((kind == "date") & day.between(0, DAYS[0] * DAYS[1] - 1), part(F.floor(day / DAYS[1]), day % DAYS[1], lit(DAYS[0]), lit(DAYS[1])))
    )


def feistel(pair: Column, kind: Column, key: str) -> Column:
    def turn(s: Column, r: Column) -> Column:
        f = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), kind, r.cast("string"), s["b"].cast("string")), 256), 1, 14), 16, 10).cast("long")
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + f % s["ma"], s["ma"]).alias("b"), s["mb"].alias("ma"), s["ma"].alias("mb"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), pair, turn)


def _overlay(m: Column, digits: Column) -> Column:
    """m with its last digits replaced by those given, other characters kept."""
    skip = F.length(_digits(m)) - F.length(digits)

    def add(s: Column, i: Column) -> Column:
        c = F.substr(m, i, F.lit(1))
        is_digit = c.between("0", "9")
        put = is_digit & (s["k"] >= skip)
        return F.struct(F.concat(s["t"], F.when(put, F.substr(digits, s["k"] - skip + 1, F.lit(1))).otherwise(c)).alias("t"), (s["k"] + is_digit.cast("int")).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.length(m)), F.struct(F.lit("").alias("t"), F.lit(0).alias("k")), add, lambda s: s["t"])


def _joined(sign: Column, day: Column, *letters: str) -> Column:
    parts = [F.date_format(day, x) for x in letters]
    return F.concat(parts[0], sign, parts[1], sign, parts[2])


def _written(m: Column, kind: Column, p: Column, key: str) -> Column:
    """The pseudonym of a match, from its permuted pair; a match that failed validation stays."""
    width = lambda x: F.length((x - 1).cast("string")).cast("int")
    both = F.concat(_pad(p["a"], width(p["ma"])), _pad(p["b"], width(p["mb"])))
    check = (10 - luhn_sum(both, 0) % 10) % 10
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (p["a"] * DAYS[1] + p["b"]).cast("int"))
    told, sign = _date(m), F.regexp_extract(m, "[-/.]", 0)
    orders = lambda month, d: F.when(told["order"] == "ymd", _joined(sign, day, "yyyy", month, d)).when(told["order"] == "mdy", _joined(sign, day, month, d, "yyyy")).otherwise(_joined(sign, day, d, month, "yyyy"))
    form = F.when(told["short"], orders("M", "d")).otherwise(orders("MM", "dd"))
    area = F.floor(p["a"] / 99) + 1
    area = F.when(area >= 666, area + 1).otherwise(area)
    ssn = F.concat_ws("-", _pad(area, 3), _pad(p["a"] % 99 + 1, 2), _pad(p["b"] + 1, 4))
    ip = F.concat_ws(".", *[x.cast("int").cast("string") for x in (F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)])
    account = _overlay(F.substr(m, F.lit(5), F.length(m)), both)
    iban = F.concat(F.substring(m, 1, 2), _pad(98 - _mod97(F.concat(F.replace(account, F.lit(" "), F.lit("")), F.substring(m, 1, 2), F.lit("00"))), 2), account)
    name = F.sha2(F.concat_ws(":", F.lit(key), F.lit("email"), F.lower(m)), 256)
    email = F.concat(F.lit("user-"), F.substring(name, 1, 16), F.lit("@mail-"), F.substring(name, 17, 6), F.lit(".example"))
    return (
        F.when(kind == "email", email)
        .when(p.isNull(), m)
        .when(kind == "card", _overlay(m, F.concat(both, check.cast("string"))))
        .when(kind == "phone", _overlay(m, both))
        .when(kind == "iban", iban)
        .when(kind == "ip", ip)
        .when(kind == "ssn", ssn)
        .when(kind == "date", form)
        .otherwise(m)
    )


_drawn: dict[str, str] = {}


def session_key(spark: SparkSession) -> str:
    """The session's key, or one that is drawn for the application."""
    own = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    return own or _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def pseudonymise(docs: DataFrame, key: str, column: str = "text", into: str = "pii") -> DataFrame:
    """docs with pseudonyms in ``column``, and ``into`` array<struct<kind, replaced boolean>> for what was found."""
    if not key:
        raise ValueError("pseudonyms need a key")
    text, pii = F.col(f"`{column}`"), fresh(docs, "__found")
    hits = F.when(F.rlike(text, F.lit("[0-9@]")), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    d = docs.withColumn(pii, F.coalesce(hits, F.array().cast("array<string>")))
    d = d.withColumn(pii, F.transform(pii, lambda m: F.struct(m.alias("m"), _kind(m).alias("kind"))))
    d = d.withColumn(pii, F.transform(pii, _core))
    ends = lambda x: (x["lead"].alias("lead"), x["trail"].alias("trail"))
    d = d.withColumn(pii, F.transform(pii, lambda x: F.struct(*ends(x), x["m"].alias("m"), x["kind"].alias("kind"), _pair(x["m"], x["kind"]).alias("p"))))
    moved = lambda x: F.when(x["p"].isNotNull(), feistel(x["p"], x["kind"], key))
    d = d.withColumn(pii, F.transform(pii, lambda x: F.struct(*ends(x), x["m"].alias("m"), x["kind"].alias("kind"), moved(x).alias("p"))))
    d = d.withColumn(pii, F.transform(pii, lambda x: F.struct(x["kind"].alias("kind"), ((x["kind"] == "email") | x["p"].isNotNull()).alias("replaced"), F.concat(x["lead"], _written(x["m"], x["kind"], x["p"], key), x["trail"]).alias("new"))))
    parts = F.split(text, ANY, -1)
    joined = F.array_join(F.zip_with(parts, F.transform(pii, lambda x: x["new"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    d = d.withColumn(column, F.when(F.size(pii) > 0, joined).otherwise(text))
    told = F.transform(pii, lambda x: F.struct(x["kind"].alias("kind"), x["replaced"].alias("replaced")))
    return d.select(*plain([c for c in docs.columns if c != into]), told.alias(into))


def pseudonym_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_replaced, and a count by kind): the whole documents with pseudonyms."""
    out = pseudonymise(docs.select("doc_id", "text"), session_key(docs.sparkSession))
    count = lambda k=None: F.size(F.filter("pii", lambda x: x["replaced"] if k is None else x["replaced"] & (x["kind"] == k))).cast("long")
    return out.select("doc_id", "text", count().alias("n_replaced"), *[count(k).alias(f"n_{k}") for k in PATTERNS])
