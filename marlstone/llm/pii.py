"""PII: validated numbers and dates become keyed Feistel pseudonyms of the same format, by native expressions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import free_name, quoted

ROUNDS = 8
# Days of any 400 years of the calendar, and two factors of that number.
CYCLE_DAYS, CYCLE_FACTORS = 146_097, (189, 773)

# Digits never start or end inside a longer number: a dot, hyphen or slash before them bars only behind a digit.
_START, _END = r"(?<![0-9A-Za-z])(?<![0-9][.-])", r"(?![0-9A-Za-z]|[.-][0-9])"
# What may be private: the first kind that fits a match decides.  A day may be followed by its time.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "phone": r"(?<![0-9A-Za-z+])(?<![0-9][.-])(?:(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-]|\+1[2-9][0-9]{2}[2-9][0-9]{2})[0-9]{4}" + _END,
    "card": rf"{_START}[0-9](?:[ -]?[0-9]){{12,18}}{_END}",
    "ip": r"(?<![0-9A-Za-z])(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z])(?<![0-9]-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "date": r"(?<![0-9A-Za-z])(?<![0-9][/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})"
            r"(?:(?=T[0-9]{2}:)|(?![0-9A-Za-z]|[./-][0-9]))",
}
# Card numbers as they are printed, wherever one may start; which of them are valid is known before a text is cut up.
_CARD_START, _CARD_END = _START, _END
PRINTED_CARDS = rf"{_CARD_START}(?=([0-9]{{13,19}}{_CARD_END}|[0-9]{{4}}(?:[ -][0-9]{{4}}){{3}}{_CARD_END}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{4,5}}{_CARD_END}))"
_OTHERS = "|".join(f"(?:{p})" for kind, p in PATTERNS.items() if kind != "card")
# Forms of a day, told apart by their shape; single digits stay single where they can.
DATE_FORMATS = {r"[0-9]{4}-[0-9]{2}-[0-9]{2}": "yyyy-MM-dd", r"[0-9]{2}/[0-9]{2}/[0-9]{4}": "MM/dd/yyyy", r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}": "dd.MM.yyyy",
                r"[0-9]{4}/[0-9]{2}/[0-9]{2}": "yyyy/MM/dd", r"[0-9]{4}/[0-9/]+": "yyyy/M/d", r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}": "M/d/yyyy", r"[0-9.]+": "d.M.yyyy"}


def _given(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, as a lambda's argument."""
    return F.element_at(F.transform(F.array(value), use), 1)


def feistel(value: Column, a: Column | int, b: Column | int, key: Column, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of 0 .. a * b - 1 (long).

    ``value`` is split into halves modulo a and b; each round adds to one half the SHA-256 of key, round
    and other half.  As every round can be undone, two values never meet, and equal ones always do.
    """
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))

    def digest(i: Column, half: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("|", key, i.cast("string"), half.cast("string")), 256), 1, 14), 16, 10).cast("long")

    def step(halves: Column, i: Column) -> Column:
        left, right = halves["left"], halves["right"]
        return F.when(i % 2 == 0, F.struct(F.pmod(left + F.pmod(digest(i, right), a), a).alias("left"), right.alias("right"))).otherwise(
            F.struct(left.alias("left"), F.pmod(right + F.pmod(digest(i, left), b), b).alias("right")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)),
                       F.struct(_div(value, b).alias("left"), F.pmod(value, b).alias("right")), step, lambda h: h["left"] * b + h["right"])


def _div(value: Column, by: Column) -> Column:
    """Whole quotient of non-negative longs."""
    return F.call_function("div", value, by)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _ten_to(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def _relay(text: Column, digits: Column) -> Column:
    """``text`` with its digits replaced in order by those of ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(
            F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))

    return F.aggregate(F.split(text, ""), start, step, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """Check sum of a digit string whose last digit is the check digit."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _card(text: Column, key: Column) -> Column:
    """A number that passes the Luhn check keeps its first digit and gets a new check digit; others are null."""
    def checked(new: Column) -> Column:
        check = F.pmod(10 - F.pmod(luhn_sum(F.concat(new, F.lit("0"))), F.lit(10)), F.lit(10))
        return _relay(text, F.concat(new, check.cast("string")))

    def permuted(d: Column) -> Column:
        n = F.length(d) - 2
        low = (n / 2).cast("int")
        new = F.concat(F.substring(d, F.lit(1), F.lit(1)),
                       F.lpad(feistel(F.substring(d, F.lit(2), n).cast("long"), _ten_to(n - low), _ten_to(low), key).cast("string"), n, "0"))
        return F.when(F.pmod(luhn_sum(d), F.lit(10)) == 0, _given(new, checked))

    return _given(_digits(text), permuted)


def _phone(text: Column, key: Column) -> Column:
    """Area and exchange stay in 200-999, so 800 * 800 * 10,000 numbers are permuted; a leading 1 stays."""
    def permuted(d: Column) -> Column:
        ten = F.substring(d, F.length(d) - 9, F.lit(10))
        area, exchange, line = (F.substring(ten, F.lit(p), F.lit(n)).cast("long") for p, n in ((1, 3), (4, 3), (7, 4)))

        def written(x: Column) -> Column:
            head = _div(x, F.lit(10_000).cast("long"))
            new = F.concat(_div(head, F.lit(800).cast("long")) + 200, F.pmod(head, F.lit(800)) + 200, F.lpad(F.pmod(x, F.lit(10_000)).cast("string"), 4, "0"))
            return _relay(text, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), new))

        return _given(feistel(((area - 200) * 800 + exchange - 200) * 10_000 + line, 80_000, 80_000, key), written)

    return _given(_digits(text), permuted)


def _ip(text: Column, key: Column) -> Column:
    """Four numbers up to 255 without leading zeros; others are null."""
    number = [F.split_part(text, F.lit("."), F.lit(i)).cast("long") for i in (1, 2, 3, 4)]
    good = (number[0] <= 255) & (number[1] <= 255) & (number[2] <= 255) & (number[3] <= 255) & ~text.rlike(r"(?:^|\.)0[0-9]")
    x = feistel(((number[0] * 256 + number[1]) * 256 + number[2]) * 256 + number[3], 65_536, 65_536, key)
    return F.when(good, _given(x, lambda x: F.concat_ws(".", *[F.pmod(F.shiftright(x, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])))


def _ssn(text: Column, key: Column) -> Column:
    """Areas 001-899 but 666, groups 01-99, serials 0001-9999; others are null."""
    area, group, serial = (F.split_part(text, F.lit("-"), F.lit(i)).cast("long") for i in (1, 2, 3))
    good = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1)

    def written(x: Column) -> Column:
        head = _div(x, F.lit(9_999).cast("long"))
        index = _div(head, F.lit(99).cast("long"))
        return F.concat_ws("-", F.lpad(F.when(index >= 665, index + 2).otherwise(index + 1).cast("string"), 3, "0"),
                           F.lpad((F.pmod(head, F.lit(99)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(x, F.lit(9_999)) + 1).cast("string"), 4, "0"))

    return F.when(good, _given(feistel((index * 99 + group - 1) * 9_999 + serial - 1, 898 * 99, 9_999, key), written))


def _date(text: Column, key: Column) -> Column:
    """A day of the calendar becomes another of the same 400 years; what is no day is null."""
    def start(day: Column) -> Column:
        return F.make_date(F.greatest(F.year(day) - F.pmod(F.year(day), F.lit(400)), F.lit(1)), F.lit(1), F.lit(1))

    def moved(day: Column) -> Column:
        days = feistel(F.pmod(F.datediff(day, start(day)).cast("long"), F.lit(CYCLE_DAYS)), *CYCLE_FACTORS, key)
        return F.when(F.year(day) >= 400, F.date_add(start(day), days.cast("int")))

    def as_written(make: Callable[[str], Column]) -> Column:
        out = F.lit(None)
        for shape, form in reversed(DATE_FORMATS.items()):
            out = F.when(text.rlike(f"^(?:{shape})$"), make(form)).otherwise(out)
        return out

    day = as_written(lambda form: F.try_to_timestamp(text, F.lit(form)).cast("date"))
    return _given(_given(day, moved), lambda new: as_written(lambda form: F.date_format(new, form)))


def _email(text: Column, key: Column) -> Column:
    """No number: the name becomes 13 characters of a keyed digest; the domain stays."""
    name = F.lower(F.split_part(text, F.lit("@"), F.lit(1)))
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", key, name), 256), 1, 12), F.lit("@"), F.split_part(text, F.lit("@"), F.lit(2)))


_MAKERS: dict[str, Callable[[Column, Column], Column]] = {"email": _email, "phone": _phone, "card": _card, "ip": _ip, "ssn": _ssn, "date": _date}


def _alone(text: Column, kind: str) -> Column:
    """Whether a match is one of this kind; what stood behind it is no longer there."""
    return text.rlike(f"^(?:{PATTERNS[kind]})$")


def pseudonym(text: Column, key: str) -> Column:
    """(kind, text) for one match; null for a number that is not valid."""
    def named(kind: str, made: Column) -> Column:
        # One argument: a second one would be taken for the index.
        return _given(made, lambda m: F.when(m.isNotNull(), F.struct(F.lit(kind).alias("kind"), m.alias("text"))))

    out = F.lit(None)
    for kind, make in reversed(_MAKERS.items()):
        out = F.when(_alone(text, kind), named(kind, make(text, F.lit(f"{key}|{kind}")))).otherwise(out)
    return out


def _private(text: Column) -> Column:
    """The pattern of one text: all kinds, of the printed card numbers only those that pass the Luhn check."""
    cards = F.array_distinct(F.regexp_extract_all(text, F.lit(PRINTED_CARDS), F.lit(1)))
    valid = F.filter(cards, lambda c: F.pmod(luhn_sum(_digits(c)), F.lit(10)) == 0)
    return F.element_at(F.transform(F.array(valid), lambda v: F.when(F.size(v) == 0, F.lit(_OTHERS)).otherwise(
        F.concat(F.lit(f"{_OTHERS}|{_CARD_START}(?:"), F.array_join(v, "|"), F.lit(f"){_CARD_END}")))), 1)


def _pieces(text: Column, pattern: Column, key: str) -> Column:
    """``text`` as an array of (original, new), ``new`` being null for what stays."""
    nothing = F.lit(None).cast("struct<kind:string,text:string>")
    # The struct goes into the lambda as its argument, so that it is computed once.
    cut = F.array(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("found")))
    return F.flatten(F.flatten(F.transform(cut, lambda w: F.transform(w["gaps"], lambda g, i: F.array(
        F.struct(g.alias("original"), nothing.alias("new")),
        F.struct(F.coalesce(F.get(w["found"], i), F.lit("")).alias("original"), pseudonym(F.get(w["found"], i), key).alias("new")))))))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with a last column ``private``: (clean_text, found: (kind, original, text) in order).

    Card numbers must pass the Luhn check, IP addresses and social security numbers lie in their ranges,
    dates be days of the calendar and telephone numbers follow the North American plan; what fails is
    left as it stands.  A valid value is permuted within its format by a Feistel network under ``key``:
    the same value has the same pseudonym in every document, and no two values share one.  The name
    part of an e-mail address, which is no number, becomes a keyed digest.

    Cards as printed (13-19 digits unbroken, groups of 4-4-4-4, 4-6-5 or 4-6-4) are validated before a text
    is cut up, so an invalid or longer stretch of digits hides nothing.  What no kind takes is then
    searched for 13-19 digits in any other groups.

    One projection, no shuffle and no Python.  A null text stays null with nothing found; texts without
    digits and @ are not searched; ties cannot occur, as matches do not overlap and the first kind that
    fits decides.  The column is named ``private_`` and so on where needed; an empty table stays empty.
    """
    text, name, work, pattern = quoted(text_col), free_name(docs, "private"), free_name(docs, "work"), free_name(docs, "pattern")
    searched = docs.withColumn(pattern, F.when(text.rlike("[0-9@]"), _private(text)))
    loose = F.lit(PATTERNS["card"])
    pieces = F.flatten(F.transform(_pieces(text, quoted(pattern), key), lambda p: F.when(
        p["new"].isNull() & p["original"].rlike(PATTERNS["card"]), _pieces(p["original"], loose, key)).otherwise(F.array(p))))
    searched = searched.withColumn(work, F.when(quoted(pattern).isNotNull(), pieces))
    rebuilt = F.element_at(F.transform(F.array(quoted(work)), lambda w: F.struct(
        F.array_join(F.transform(w, lambda p: F.coalesce(p["new"]["text"], p["original"])), "").alias("clean_text"),
        F.transform(F.filter(w, lambda p: p["new"].isNotNull()), lambda p: F.struct(p["new"]["kind"].alias("kind"), p["original"].alias("original"), p["new"]["text"].alias("text"))).alias("found"))), 1)
    empty = F.array().cast("array<struct<kind:string,original:string,text:string>>")
    return searched.withColumn(name, F.when(quoted(work).isNull(), F.struct(text.alias("clean_text"), empty.alias("found"))).otherwise(rebuilt)).drop(work, pattern)
