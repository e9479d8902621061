"""Format-preserving pseudonyms of personal numbers and dates, with DataFrame expressions only.

Candidates are found by one pattern, validated by kind, and permuted by a keyed Feistel network over just the values
that are valid for the kind: a card number becomes another one with a right check digit, a date another date in the
same layout. The permutation depends on the key and the value alone, so equal values get equal pseudonyms in all
documents, however they are punctuated, and different values of a kind stay different. Nothing is looked up or
shuffled. What a candidate's kind does not validate is left as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import ref, require

FEISTEL_ROUNDS = 10

#: kind -> pattern of candidates, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "date": r"(?<![\d.\-/])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d\-/]|\.\d)",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){2}[ \-]\d{1,7}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d)",
    "phone": r"(?<![\d+])(?:\+?\d{1,3}[ .\-]?)?(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)",
}
ANY = "|".join(f"(?:{pattern})" for pattern in PATTERNS.values())

DATE_LAYOUTS = {r"^\d{4}-": "yyyy-MM-dd", r"^\d{2}/": "MM/dd/yyyy", r"^\d{2}\.": "dd.MM.yyyy"}
#: The Gregorian calendar repeats after 400 years of 146,097 days, which is 189 times 773.
FIRST_DAY, DATE_PARTS = "1800-01-01", (189, 773)


def feistel(x: Column, y: Column, parts: tuple[Column | int, Column | int], key: str, kind: str) -> Column:
    """The pair (x, y) in Z_a times Z_b, permuted: in turn one part has a keyed hash of the other added to it."""
    a, b = (F.lit(part).cast("long") if isinstance(part, int) else part.cast("long") for part in parts)

    def noise(turn: Column, value: Column) -> Column:
        text = F.concat_ws("|", F.lit(key), F.lit(kind), a.cast("string"), b.cast("string"), turn.cast("string"), value.cast("string"))
        return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")

    def step(state: Column, turn: Column) -> Column:
        first = F.when(turn % 2 == 0, F.pmod(state["x"] + F.pmod(noise(turn, state["y"]), a), a)).otherwise(state["x"])
        second = F.when(turn % 2 == 1, F.pmod(state["y"] + F.pmod(noise(turn, state["x"]), b), b)).otherwise(state["y"])
        return F.struct(first.alias("x"), second.alias("y"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(FEISTEL_ROUNDS - 1)), start, step)


def _with(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A digit string (up to 19) permuted among those of its length."""
    length = F.length(digits)
    half = F.floor(length / 2).cast("int")
    parts = (F.pow(F.lit(10), half), F.pow(F.lit(10), length - half))
    pair = feistel(F.substr(digits, F.lit(1), half), F.substr(digits, half + 1, length), parts, key, kind)
    return _with(pair, lambda p: F.concat(F.lpad(p["x"].cast("string"), half, "0"), F.lpad(p["y"].cast("string"), length - half, "0")))


def check_digit(digits: Column) -> Column:
    """The Luhn digit that belongs behind a digit string."""
    length = F.length(digits)

    def add(total: Column, back: Column) -> Column:
        digit = F.substr(digits, length - back + 1, F.lit(1)).cast("int")
        doubled = F.when(back % 2 == 1, digit * 2).otherwise(digit)
        return total + F.when(doubled > 9, doubled - 9).otherwise(doubled)

    total = F.aggregate(F.sequence(F.lit(1), length), F.lit(0), add)
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits`` in turn, all other characters where they are."""
    return F.array_join(
        F.transform(
            F.split(shape, ""),
            lambda sign, i: F.when(
                sign.rlike("[0-9]"), F.substr(digits, F.length(digits_of(F.substr(shape, F.lit(1), i + 1))), F.lit(1))
            ).otherwise(sign),
        ),
        "",
    )


def _padded(value: Column, length: int) -> Column:
    return F.lpad(value.cast("string"), length, "0")


def _card(value: Column, key: str) -> Column:
    def renew(digits: Column) -> Column:
        body = F.substr(digits, F.lit(1), F.length(digits) - 1)
        valid = check_digit(body) == F.substr(digits, F.length(digits), F.lit(1))
        new = _with(permuted_digits(body, key, "card"), lambda fresh: F.concat(fresh, check_digit(fresh)))
        return F.when(valid, refilled(value, new)).otherwise(value)

    return _with(digits_of(value), renew)


def _phone(value: Column, key: str) -> Column:
    def renew(digits: Column) -> Column:
        country = F.substr(digits, F.lit(1), F.length(digits) - 10)
        national = F.right(digits, F.lit(10))
        area, rest = F.substring(national, 1, 3).cast("int"), F.substring(national, 4, 7).cast("int")
        american = (area >= 200) & (rest >= 2_000_000)
        pair = feistel(area - 200, rest - 2_000_000, (800, 8_000_000), key, "phone")
        valid = _with(pair, lambda p: F.concat(_padded(p["x"] + 200, 3), _padded(p["y"] + 2_000_000, 7)))
        return refilled(value, F.concat(country, F.when(american, valid).otherwise(permuted_digits(national, key, "phone"))))

    return _with(digits_of(value), renew)


def _ip(value: Column, key: str) -> Column:
    def renew(parts: Column) -> Column:
        octets = [F.get(parts, i).cast("int") for i in range(4)]
        pair = feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], (65_536, 65_536), key, "ip")
        new = _with(
            pair,
            lambda p: F.concat_ws(".", *[F.floor(p[half] / 256).cast("string") if high else F.pmod(p[half], F.lit(256)).cast("string") for half in ("x", "y") for high in (True, False)]),
        )
        return F.when(F.forall(parts, lambda part: part.cast("int") <= 255), new).otherwise(value)

    return _with(F.split(value, "\\."), renew)


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = F.substring(value, 1, 3).cast("int"), F.substring(value, 5, 2).cast("int"), F.substring(value, 8, 4).cast("int")
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - F.when(area > 666, 2).otherwise(1)  # among the 898 areas in use
    pair = feistel(place, (group - 1) * 9_999 + serial - 1, (898, 99 * 9_999), key, "ssn")
    new = _with(
        pair,
        lambda p: F.concat_ws(
            "-", _padded(p["x"] + F.when(p["x"] >= 665, 2).otherwise(1), 3),
            _padded(F.floor(p["y"] / 9_999) + 1, 2), _padded(F.pmod(p["y"], F.lit(9_999)) + 1, 4),
        ),
    )
    return F.when(valid, new).otherwise(value)


def _date(value: Column, key: str) -> Column:
    found = value
    a, b = DATE_PARTS
    for pattern, layout in DATE_LAYOUTS.items():
        day = F.try_to_timestamp(value, F.lit(layout)).cast("date")
        number = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
        pair = feistel(F.floor(number / b), F.pmod(number, F.lit(b)), (a, b), key, "date")
        new = _with(pair, lambda p: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (p["x"] * b + p["y"]).cast("int")), layout))
        inside = day.isNotNull() & number.between(0, a * b - 1)
        found = F.when(value.rlike(pattern), F.when(inside, new).otherwise(value)).otherwise(found)
    return found


def _email(value: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(value)), 256), 1, 12), F.lit("@example.invalid"))


RENEW = {"email": _email, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card, "phone": _phone}


def pseudonym(value: Column, key: str) -> Column:
    """What takes the place of a candidate; the candidate itself if its kind does not validate it."""
    found = value
    for kind, pattern in reversed(PATTERNS.items()):
        whole = "^(?:" + pattern + ")$"
        found = F.when(value.rlike(whole), RENEW[kind](value, key)).otherwise(found)
    return found


def pseudonymised(docs: DataFrame, key: str, text_column: str = "text", count_column: str | None = None) -> DataFrame:
    """``docs`` with personal numbers, dates and addresses in its texts replaced; all columns stay, in their order.

    Kinds: e-mail addresses (a keyed name in a reserved domain), dates of 1800 to 2199 (ISO, month/day/year,
    day.month.year), IPv4 addresses, US social security numbers, card numbers with a right check digit, and phone
    numbers of ten national digits. ``count_column`` adds the number of values replaced. Null texts stay null and
    texts without candidates stay as they are. Texts of any length are read whole; repeated rows come back repeated.
    """
    require(docs, text_column)
    text = ref(text_column).cast("string")
    packed = docs.select(F.struct(*[ref(name) for name in docs.columns]).alias("row"), text.alias("text"))
    packed = packed.withColumn("found", F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))))
    renewed = F.transform("found", lambda value: pseudonym(value, key))
    packed = packed.withColumn("renewed", F.when(F.size("found") > 0, renewed))
    between = F.split(F.col("text"), ANY, -1)
    pieces = F.when(F.col("renewed").isNotNull(), between)
    packed = packed.withColumn("pieces", pieces)
    joined = F.concat(
        F.get("pieces", F.lit(0)),
        F.array_join(F.zip_with(F.col("renewed"), F.slice("pieces", 2, F.size("renewed")), lambda new, piece: F.concat(new, piece)), ""),
    )
    changed = F.size(F.filter(F.arrays_zip("found", "renewed"), lambda pair: pair["found"] != pair["renewed"]))
    whole = F.when(F.col("renewed").isNotNull(), joined).otherwise(F.col("text"))
    columns = [whole.alias(name) if name == text_column else F.col("row").getField(name).alias(name) for name in docs.columns]
    count = F.when(F.col("renewed").isNotNull(), changed).otherwise(0).cast("long")
    return packed.select(*columns, *([count.alias(count_column)] if count_column else []))
