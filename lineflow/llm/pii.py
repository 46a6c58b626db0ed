"""Operator 1: personal data replaced by format-preserving Feistel pseudonyms, with built-in functions alone.

A validated value is ranked into left x right, two numbers with moduli A and B; ROUNDS keyed rounds add a digest of one
half to the other, alternately, which permutes the whole format; the result is unranked into the same notation.  So
equal values get equal pseudonyms in every document, different values different ones, and a valid value stays valid.

    card    13 to 19 digits that pass Luhn: first digit stays, check digit is computed, the rest is permuted
    phone   North American notation with any area and exchange; country code and punctuation stay, and each of the two
            codes keeps its side of 200, so that a number that can be assigned (2 to 9 first) gets one that can
    ip      IPv4, all 32 bits
    ssn     area 001-899 without 666, group 01-99, serial 0001-9999
    date    y-m-d, y/m/d, m/d/y and d.m.y of 1900 to 2099, permuted as day numbers
    email   local part: letters stay letters of their case, digits stay digits; the domain stays

Anything else, such as a digit run that fails Luhn or a day that no calendar has, is left as it is.  Who has the key can
undo the permutation, so a production run sets its own.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: Session setting that holds the key, and the key of runs that don't set it, which hides nothing from readers of this file.
KEY_SETTING, DEMO_KEY = "spark.lineflow.pii.key", "change-me"

#: Loops over labels are possessive: the matcher runs them without recursion, so a name of any length fits its stack.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.(?=[A-Za-z]{2}|[A-Za-z0-9-]++\.))++[A-Za-z]{2,}+"
IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
DATE = r"(?<![\d/.-])(?:(?:19|20)\d\d-\d\d-\d\d|(?:19|20)\d\d/\d\d/\d\d|\d\d/\d\d/(?:19|20)\d\d|\d\d\.\d\d\.(?:19|20)\d\d)(?![\d/-]|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\w+.-])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d|[.-]\d)"
CARD = r"(?<![\d-])(?:\d{4} \d{4} \d{4} \d{1,7}|\d{4}-\d{4}-\d{4}-\d{1,7}|\d{4} \d{6} \d{4,5}|\d{4}-\d{6}-\d{4,5}|\d{13,19})(?![\d]|-\d)"
ANY = "|".join((EMAIL, IP, DATE, SSN, PHONE, CARD))
KINDS = ("email", "ip", "date", "ssn", "phone", "card")

#: Days from 1900-01-01 to 2099-12-31, 17 x 4297.
_DAYS = (17, 4297)


def _digest(key: str, tag: Column, turn: Column, value: Column, width: int = 12) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lit(key), tag, turn.cast("string"), value).cast("binary"), 256), 1, width)


def _turns() -> Column:
    return F.array(*[F.lit(i) for i in range(ROUNDS)])


def feistel(left: Column, right: Column, a: Column | int, b: Column | int, tag: str, key: str) -> Column:
    """struct(l, r): a keyed permutation of [0, a) x [0, b)."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))

    def step(s: Column, i: Column) -> Column:
        add = lambda x: F.conv(_digest(key, F.lit(tag), i, x.cast("string")), 16, 10).cast("long")
        return F.when(i % 2 == 0, F.struct(((s["l"] + add(s["r"])) % a).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), ((s["r"] + add(s["l"])) % b).alias("r")))

    return F.aggregate(_turns(), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; a lambda's body would compute it for every item."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shift(text: Column, hexes: Column) -> Column:
    """Every letter and digit of `text` moved within its class by the hex pairs, reused in turn."""

    def moved(by: Column) -> Column:
        def move(c: Column, i: Column) -> Column:
            code = F.ascii(c)
            turn = lambda base, size: F.char(F.pmod(code - base + F.get(by, i % 32), F.lit(size)) + base)
            return F.when(c.between("0", "9"), turn(48, 10)).when(c.between("a", "z"), turn(97, 26)).when(c.between("A", "Z"), turn(65, 26)).otherwise(c)

        return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), move), "")

    pairs = lambda h: F.transform(F.array(*[F.substring(h, 2 * k + 1, 2) for k in range(32)]), lambda x: F.conv(x, 16, 10).cast("int"))
    return _let(_let(hexes, pairs), moved)


def feistel_text(text: Column, tag: str, key: str) -> Column:
    """A keyed permutation of the strings with the classes (digit, small, capital, other) of `text`."""
    half = F.length(text).bitwiseAND(F.lit(-2)) / 2
    half = half.cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))

    def step(s: Column, i: Column) -> Column:
        by = lambda x: _digest(key, F.lit(tag), i, x, 64)
        return F.when(i % 2 == 0, F.struct(_shift(s["l"], by(s["r"])).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), _shift(s["r"], by(s["l"])).alias("r")))

    return F.aggregate(_turns(), start, step, lambda s: F.concat(s["l"], s["r"]))


def _padded(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), n if isinstance(n, Column) else F.lit(n), F.lit("0"))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, its last digit counted single."""

    def one(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), one)


def _card(m: Column, key: str) -> Column:
    def made(digits: Column) -> Column:
        n = F.length(digits) - 2
        a = (n / 2).cast("int")
        b = n - a
        ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
        mixed = feistel(F.substring(digits, F.lit(2), a), F.substring(digits, a + 2, b), ten(a), ten(b), "card", key)
        body = _let(mixed, lambda s: F.concat(F.substring(digits, 1, 1), _padded(s["l"], a), _padded(s["r"], b)))
        full = _let(body, lambda s: F.concat(s, F.pmod(F.lit(10) - luhn_sum(F.concat(s, F.lit("0"))) % 10, F.lit(10)).cast("string")))
        fours = lambda sep: F.regexp_replace(full, r"^(\d{4})(\d{4})(\d{4})", f"$1{sep}$2{sep}$3{sep}")
        spaced = lambda sep: F.when(m.rlike(r"^\d{4}\D\d{6}\D"), F.regexp_replace(full, r"^(\d{4})(\d{6})", f"$1{sep}$2{sep}")).otherwise(fours(sep))
        return F.when(luhn_sum(digits) % 10 != 0, m).when(F.contains(m, F.lit(" ")), spaced(" ")).when(F.contains(m, F.lit("-")), spaced("-")).otherwise(full)

    return _let(F.regexp_replace(m, "[^0-9]", ""), made)


def _phone(m: Column, key: str) -> Column:
    parts = r"^((?:\+?1[ .-]?)?\(?)(\d{3})(\)? ?|[ .-])(\d{3})([ .-])(\d{4})$"
    g = lambda k: F.regexp_extract(m, parts, k)
    low = lambda k: F.when(g(k) < "200", 0).otherwise(200).cast("long")
    size = lambda k: F.when(g(k) < "200", 200).otherwise(800).cast("long")
    mixed = feistel((g(2).cast("long") - low(2)) * size(4) + g(4).cast("long") - low(4), g(6), size(2) * size(4), 10_000, "phone", key)
    return _let(mixed, lambda s: F.concat(g(1), _padded(F.floor(s["l"] / size(4)) + low(2), 3), g(3), _padded(s["l"] % size(4) + low(4), 3), g(5), _padded(s["r"], 4)))


def _ip(m: Column, key: str) -> Column:
    o = [F.split_part(m, F.lit("."), F.lit(k)).cast("long") for k in (1, 2, 3, 4)]
    mixed = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip", key)
    made = _let(mixed, lambda s: F.concat_ws(".", *[x.cast("string") for k in "lr" for x in (F.floor(s[k] / 256), s[k] % 256)]))
    return F.when((o[0] < 256) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256), made).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.split_part(m, F.lit("-"), F.lit(k)).cast("long") for k in (1, 2, 3))
    rank = area - F.when(area > 666, 2).otherwise(1)
    mixed = feistel(rank, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn", key)
    back = lambda x: x + F.when(x >= 665, 2).otherwise(1)
    made = _let(mixed, lambda s: F.concat_ws("-", _padded(back(s["l"]), 3), _padded(F.floor(s["r"] / 9999) + 1, 2), _padded(s["r"] % 9999 + 1, 4)))
    return F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), made).otherwise(m)


def _date(m: Column, key: str) -> Column:
    form = F.when(F.contains(m, F.lit("-")), "yyyy-MM-dd").when(m.rlike("^../"), "MM/dd/yyyy").when(F.contains(m, F.lit("/")), "yyyy/MM/dd").otherwise("dd.MM.yyyy")
    iso = F.when(F.contains(m, F.lit(".")), F.regexp_replace(m, r"^(\d\d)\.(\d\d)\.(\d{4})$", "$3-$2-$1")).when(form == "MM/dd/yyyy", F.regexp_replace(m, r"^(\d\d)/(\d\d)/(\d{4})$", "$3-$1-$2")).otherwise(F.replace(m, F.lit("/"), F.lit("-")))
    day = F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), F.lit("1900-01-01").cast("date"))

    def made(d: Column) -> Column:
        mixed = feistel(F.floor(d / _DAYS[1]), d % _DAYS[1], _DAYS[0], _DAYS[1], "date", key)
        new = _let(mixed, lambda s: F.date_add(F.lit("1900-01-01").cast("date"), (s["l"] * _DAYS[1] + s["r"]).cast("int")).cast("string"))
        turned = lambda to: F.regexp_replace(new, r"^(\d{4})-(\d\d)-(\d\d)$", to)
        back = F.when(form == "yyyy/MM/dd", turned("$1/$2/$3")).when(form == "MM/dd/yyyy", turned("$2/$3/$1")).when(form == "dd.MM.yyyy", turned("$3.$2.$1")).otherwise(new)
        return F.when(d.isNull(), m).otherwise(back)

    return _let(day, made)


def _email(m: Column, key: str) -> Column:
    local = F.split_part(m, F.lit("@"), F.lit(1))
    return F.concat(_let(local, lambda x: feistel_text(x, "email", key)), F.lit("@"), F.split_part(m, F.lit("@"), F.lit(2)))


def kind_of(m: Column) -> Column:
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return F.when(F.contains(m, F.lit("@")), "email").when(whole(r"(?:\d{1,3}\.){3}\d{1,3}"), "ip").when(whole(r"\d{4}([-/])\d\d\1\d\d|\d\d([./])\d\d\2\d{4}"), "date").when(whole(r"\d{3}-\d\d-\d{4}"), "ssn").when(whole(r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"), "phone").otherwise("card")


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one matched value."""
    kind = kind_of(m)
    out = F.when(kind == "email", _email(m, key)).when(kind == "ip", _ip(m, key)).when(kind == "date", _date(m, key))
    return out.when(kind == "ssn", _ssn(m, key)).when(kind == "phone", _phone(m, key)).otherwise(_card(m, key))


def session_key(spark: SparkSession) -> str:
    """The key that the session names; a demonstration key, with a warning, where it names none."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms can be undone by anyone", stacklevel=2)
    return key or DEMO_KEY


def pseudonymise(docs: DataFrame, key: str, text: str = "text", into: str = "pii") -> DataFrame:
    """`docs` with personal data in `text` replaced, and `into` array<struct<kind,pseudonym>> of what was replaced.

    Every other column stays; one named `into` is replaced.  Null text stays null with no entries, empty text stays
    empty; matches do not overlap, the leftmost goes first; repeated rows come back repeated.  Texts and matches may be
    of any length: the time grows in proportion, and no pattern recurses.  Row-local: no shuffle, no Python.
    """
    t = F.col(text)
    found = F.regexp_extract_all(t, F.lit(ANY), F.lit(0))
    pairs = F.transform(found, lambda m: F.struct(kind_of(m).alias("kind"), m.alias("old"), pseudonym(m, key).alias("pseudonym")))
    some = t.rlike("[0-9]|@")
    none = F.array().cast("array<struct<kind:string,old:string,pseudonym:string>>")
    out = docs.withColumn(into, F.when(some, pairs).otherwise(none))
    gaps = F.split(t, ANY, -1)
    whole = F.array_join(F.zip_with(gaps, F.concat(F.transform(into, lambda p: p["pseudonym"]), F.array(F.lit(""))), lambda g, p: F.concat(g, p)), "")
    out = out.withColumn(text, F.when(F.size(into) > 0, whole).otherwise(t))
    changed = F.filter(into, lambda p: p["old"] != p["pseudonym"])
    return out.withColumn(into, F.transform(changed, lambda p: F.struct(p["kind"].alias("kind"), p["pseudonym"].alias("pseudonym"))))


def digest(done: DataFrame) -> DataFrame:
    """(doc_id, text, n_<kind>...) of pseudonymise()."""
    count = lambda kind: F.size(F.filter("pii", lambda p: p["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return done.select(F.col("doc_id").cast("long"), "text", *map(count, KINDS))
