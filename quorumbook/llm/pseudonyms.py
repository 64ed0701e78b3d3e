"""Format-preserving pseudonyms by a keyed Feistel network, in DataFrame expressions only.

Validated values are replaced by others of the same format, always the same one
for the same key, so equal values stay linked across documents:

=========  ==========================================  =====================================
kind       validated by                                permuted within
=========  ==========================================  =====================================
card       13 to 19 digits with a right Luhn digit     all but the last digit, which is set anew
phone      ten digits with separators, or + and 8-15   the last ten digits
ssn        area, group and serial that are given out   the same areas, groups and serials
ip         four octets up to 255                       four octets
date       a day of the calendar, years 1800 to 2199   the 146,097 days of those years
email      a local part and a dotted domain            letters and digits of the local part
key        hexadecimal of 16 to 64 with letters and    digits and letters a-f, or upper-case
           digits, or an access key                    letters and digits
=========  ==========================================  =====================================

A value is a list of symbols, each with its number of possible values.  In every
round one half of the list is shifted by a hash of the key, the kind, the round
and the other half; each shift can be undone, so the whole is a permutation of
the format, and there is no walk until a result fits.  A date written with the
year last is read day first and, only if that is no date, month first.

Defined results: a null text stays null, an empty one empty; a value that fails
its validation stays as it is; other columns keep their names and values, also
those with the names of this module's outputs where only the text is replaced;
repeated rows give equal results; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
KINDS = ("card", "phone", "ssn", "ip", "date", "email", "key")

# Shapes of the values; a match is validated afterwards.
EMAIL = (r"(?<![0-9A-Za-z._%+-])[0-9A-Za-z][0-9A-Za-z._%+-]{0,63}@[0-9A-Za-z-]{1,63}(?:\.[0-9A-Za-z-]{1,63}){0,6}"
         r"\.[A-Za-z]{2,24}(?![0-9A-Za-z])")
KEY = r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|(?=[0-9]{0,63}[a-f])(?=[a-f]{0,63}[0-9])[0-9a-f]{16,64})(?![0-9A-Za-z])"
IP = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.[0-9])"
DATE = (r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}"
        r"|[0-9]{2}\.[0-9]{2}\.[0-9]{4}")
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
CARD = r"(?:[0-9]{4}[ -]){3}[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19}"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[0-9]{8,15}"
ANY = f"{EMAIL}|{KEY}|(?<![0-9A-Za-z.])(?:{IP}|{DATE}|{SSN}|{CARD}|{PHONE})(?![0-9A-Za-z])"

_FIRST_YEAR, _YEARS = 1800, 400
#: The days of 400 years are 773 * 189.
_DAYS = (773, 189)
_DIGIT, _LOWER, _UPPER, _FIXED = 10, 26, 26, 1


def _whole(shape: str) -> str:
    return f"^(?:{shape})$"


def _number(text: Column) -> Column:
    return text.cast("int")


def _chars(text: Column) -> Column:
    return F.split(text, "")


def _digits(text: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(text, "[^0-9]", "")), _number)


def _luhn_sum(digits: Column, double_from_end: int) -> Column:
    """Sum of digits, those at even distance from ``double_from_end`` places before the end doubled."""
    n = F.size(digits)

    def part(d: Column, i: Column) -> Column:
        twice = F.when((n - 1 - i) % 2 == double_from_end, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(digits, part), F.lit(0), lambda a, d: a + d)


def _day_of(year: Column, month: Column, day: Column) -> Column:
    """Days since the first of the cycle, null for no date of these years."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    sound = (year >= _FIRST_YEAR) & (year < _FIRST_YEAR + _YEARS) & month.between(1, 12) & (day >= 1) & (day <= last)
    first = F.make_date(F.lit(_FIRST_YEAR), F.lit(1), F.lit(1))
    return F.when(sound, F.datediff(F.make_date(year, month, day), first))


def _date_order(value: Column) -> tuple[Column, Column]:
    """(order, day number): ymd, dmy or mdy."""
    at = [_number(F.substring(value, 1, 4)), _number(F.substring(value, 6, 2)), _number(F.substring(value, 9, 2))]
    late = [_number(F.substring(value, 1, 2)), _number(F.substring(value, 4, 2)), _number(F.substring(value, 7, 4))]
    year_first = value.rlike("^[0-9]{4}")
    ymd = F.when(year_first, _day_of(at[0], at[1], at[2]))
    dmy = F.when(~year_first, _day_of(late[2], late[1], late[0]))
    mdy = F.when(~year_first, _day_of(late[2], late[0], late[1]))
    order = F.when(ymd.isNotNull(), "ymd").when(dmy.isNotNull(), "dmy").when(mdy.isNotNull(), "mdy")
    return order, F.coalesce(ymd, dmy, mdy)


def _ssn_parts(value: Column) -> list[Column]:
    return [_number(p) for p in (F.substring(value, 1, 3), F.substring(value, 5, 2), F.substring(value, 8, 4))]


def _kind(value: Column) -> Column:
    octets = F.transform(F.split(value, r"\."), _number)
    area, group, serial = _ssn_parts(value)
    return (
        F.when(value.rlike(_whole(EMAIL)), "email")
        .when(value.rlike(_whole(KEY)), "key")
        .when(value.rlike(_whole(IP)), F.when(F.forall(octets, lambda o: o <= 255), "ip"))
        .when(value.rlike(_whole(DATE)), F.when(_date_order(value)[0].isNotNull(), "date"))
        .when(value.rlike(_whole(SSN)), F.when(
            (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), "ssn"))
        .when(value.rlike(_whole(CARD)), F.when(_luhn_sum(_digits(value), 1) % 10 == 0, "card"))
        .when(value.rlike(_whole(PHONE)), "phone")
    )


def _class(char: Column, hexadecimal: Column) -> Column:
    return (
        F.when(char.between("0", "9"), _DIGIT)
        .when(char.between("a", "z"), F.when(hexadecimal, 6).otherwise(_LOWER))
        .when(char.between("A", "Z"), _UPPER).otherwise(_FIXED)
    )


def _base(char: Column) -> Column:
    return F.when(char.between("0", "9"), 48).when(char.between("a", "z"), 97).otherwise(65)


def _places(value: Column, kind: Column) -> Column:
    """Characters with the number of values of each, 1 for a character that stays."""
    digits_left = F.length(F.regexp_replace(value, "[^0-9]", ""))
    hexadecimal = (kind == "key") & ~value.startswith("AKIA")
    at = F.when(kind == "email", F.instr(value, "@") - 1).otherwise(F.length(value))

    def place(char: Column, i: Column) -> Column:
        rest = F.length(F.regexp_replace(F.substring(value, i + 1, F.length(value)), "[^0-9]", ""))
        moves = (
            F.when(kind == "card", rest > 1)
            .when(kind == "phone", (rest <= 10) & ((rest < digits_left) | ~value.startswith("+")))
            .when(kind == "key", hexadecimal | (i >= 4)).otherwise(True)
        )
        free = (i < at) & moves
        return F.struct(char.alias("char"), F.when(free, _class(char, hexadecimal)).otherwise(_FIXED).alias("of"))

    return F.transform(_chars(value), place)


def _symbols(value: Column, kind: Column, places: Column) -> Column:
    """(value, number of values) of every symbol that is permuted."""
    def pair(x: Column, of) -> Column:
        return F.struct(x.cast("int").alias("x"), (F.lit(of) if isinstance(of, int) else of).cast("int").alias("of"))

    area, group, serial = _ssn_parts(value)
    day = _date_order(value)[1]
    moving = F.filter(places, lambda p: p["of"] > 1)
    return (
        F.when(kind == "ip", F.transform(F.split(value, r"\."), lambda o: pair(o, 256)))
        .when(kind == "date", F.array(pair(F.floor(day / _DAYS[1]), _DAYS[0]), pair(day % _DAYS[1], _DAYS[1])))
        .when(kind == "ssn", F.array(
            pair(F.when(area < 666, area - 1).otherwise(area - 2), 898), pair(group - 1, 99), pair(serial - 1, 9999)))
        .otherwise(F.transform(moving, lambda p: pair(F.ascii(p["char"]) - _base(p["char"]), p["of"])))
    )


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def feistel(symbols: Column, key: str, tweak: Column, rounds: int = ROUNDS) -> Column:
    """Permute a list of (x, of) by shifting its halves in turn; returns the new values."""
    n = F.size(symbols)
    half = F.floor(n / 2).cast("int")

    def turn(state: Column, number: Column) -> Column:
        even = number % 2 == 0
        other = F.when(even, F.slice(state, half + 1, n)).otherwise(F.slice(state, F.lit(1), half))
        other = F.array_join(other.cast("array<string>"), ",")

        def shifted(seed: Column) -> Column:
            def shift(x: Column, i: Column) -> Column:
                drawn = F.conv(F.substring(F.sha2(F.concat_ws(":", seed, i.cast("string")), 256), 1, 12), 16, 10)
                moved = F.pmod(x + drawn.cast("bigint"), F.get(symbols, i)["of"]).cast("int")
                return F.when((i < half) == even, moved).otherwise(x)

            return F.transform(state, shift)

        return _let(F.concat_ws(":", F.lit(key), tweak, number.cast("string"), other), shifted)

    start = F.transform(symbols, lambda s: s["x"])
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, turn)


def _ssn_text(moved: Column) -> Column:
    area, group, serial = (F.get(moved, F.lit(i)) for i in range(3))
    area = F.when(area < 665, area + 1).otherwise(area + 2)
    return F.concat(F.lpad(area.cast("string"), 3, "0"), F.lit("-"), F.lpad((group + 1).cast("string"), 2, "0"),
                    F.lit("-"), F.lpad((serial + 1).cast("string"), 4, "0"))


def _date_text(value: Column, moved: Column) -> Column:
    first = F.make_date(F.lit(_FIRST_YEAR), F.lit(1), F.lit(1))
    day = F.date_add(first, F.get(moved, F.lit(0)) * _DAYS[1] + F.get(moved, F.lit(1)))
    y, m, d = F.date_format(day, "yyyy"), F.date_format(day, "MM"), F.date_format(day, "dd")
    early, late = F.substring(value, 5, 1), F.substring(value, 3, 1)
    return _let(_date_order(value)[0], lambda order: (
        F.when(order == "ymd", F.concat(y, early, m, early, d)).when(order == "dmy", F.concat(d, late, m, late, y))
        .otherwise(F.concat(m, late, d, late, y))))


def _char_text(places: Column, moved: Column) -> Column:
    def put(state: Column, p: Column) -> Column:
        new = F.char(F.get(moved, state["next"]) + _base(p["char"]))
        free = p["of"] > 1
        return F.struct(F.concat(state["text"], F.when(free, new).otherwise(p["char"])).alias("text"),
                        (state["next"] + free.cast("int")).alias("next"))

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("next"))
    return F.aggregate(places, start, put, lambda s: s["text"])


def _card_text(text: Column) -> Column:
    return _let(F.substring(text, F.lit(1), F.length(text) - 1), lambda body: F.concat(
        body, ((10 - _luhn_sum(_digits(body), 0) % 10) % 10).cast("string")))


def pseudonyms(values: Column, key: str, rounds: int = ROUNDS) -> Column:
    """For each of an array of values (value, kind, pseudonym); without a kind the value itself."""
    # One pass over the array per step: a step reads what the one before has made, and nothing is computed twice.
    kinds = F.transform(values, lambda v: F.struct(v.alias("value"), _kind(v).alias("kind")))
    placed = F.transform(kinds, lambda m: F.struct(
        m["value"], m["kind"], F.when(m["kind"].isNotNull(), _places(m["value"], m["kind"])).alias("places")))
    listed = F.transform(placed, lambda m: F.struct(
        m["value"], m["kind"], m["places"], _symbols(m["value"], m["kind"], m["places"]).alias("symbols"),
        F.concat(m["kind"], F.when(m["kind"] == "date", _date_order(m["value"])[0])
                 .when(m["kind"] == "email", F.substring_index(m["value"], "@", -1)).otherwise("")).alias("tweak")))
    moved = F.transform(listed, lambda m: F.struct(
        m["value"], m["kind"], m["places"],
        F.when(m["kind"].isNotNull(), feistel(m["symbols"], key, m["tweak"], rounds)).alias("moved")))

    def text(m: Column) -> Column:
        kind = m["kind"]
        new = (
            F.when(kind == "ip", F.array_join(m["moved"].cast("array<string>"), "."))
            .when(kind == "date", _date_text(m["value"], m["moved"])).when(kind == "ssn", _ssn_text(m["moved"]))
            .when(kind == "card", _let(_char_text(m["places"], m["moved"]), _card_text))
            .otherwise(_char_text(m["places"], m["moved"]))
        )
        return F.struct(m["value"], kind, F.when(kind.isNull(), m["value"]).otherwise(new).alias("pseudonym"))

    return F.transform(moved, text)


def _times(values: Column, kind: str) -> Column:
    return F.when(values.isNull(), 0).otherwise(F.size(F.filter(values, lambda m: m["kind"] == kind))).cast("bigint")


def replace_personal(docs: DataFrame, key: str, text_col: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with the values in the text column replaced; with ``counts`` also n_<kind> for each kind.

    Existing columns named n_<kind> give way to the counts.
    """
    names = {f"n_{kind}" for kind in KINDS} if counts else set()
    kept = [c for c in docs.columns if c not in names]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    row = row.withColumn("found", pseudonyms(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)), key))
    parts = F.zip_with(F.split("text", ANY, -1), "found", lambda a, m: F.concat(a, F.coalesce(m["pseudonym"], F.lit(""))))
    new = F.when(F.exists("found", lambda m: m["kind"].isNotNull()), F.array_join(parts, "")).otherwise(F.col("text"))
    added = [_times(F.col("found"), kind).alias(f"n_{kind}") for kind in KINDS] if counts else []
    return row.select(*[new.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in kept], *added)
