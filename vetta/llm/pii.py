"""Format-preserving pseudonyms for personal numbers and dates (DataFrame functions only).

Found and validated: payment cards (Luhn), North American phone numbers, US social security
numbers, IPv4 addresses, calendar dates (1800-2199) and the local part of e-mail addresses.
Each value is permuted within its own format by a Feistel network keyed with SHA-256, so an
equal value gets an equal pseudonym in every document and with any separators, and the key
holder could invert it. Separators, lengths, letter case, the Luhn digit, the octet range
and the validity of a date survive. What fails validation is left alone; a card is tried from
and to every separator, so numbers beside it do not hide it.

Everything is an expression on the row: no shuffle, no Python. Work beyond one pattern scan
grows with the values found.

Cases: very long texts are scanned whole in time linear in their length (but for the names of
the cards in them, which a text of many numbers may hold by the thousand); a null text stays null with nothing found; a text without digits or ``@`` is returned
as it is; repeated rows get equal results; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
# The written formats looked for. An e-mail comes first, as it may hold digits.
# Its local part has at most 32 parts and its domain 127 labels of 63 characters, as the standards
# say; parts are tried from their starts only and never given back, so the scan is linear.
EMAIL = (r"(?<![A-Za-z0-9_%+-])[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++){0,31}+"
         r"@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){0,125}\.[A-Za-z]{2,}")
IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
DATE = r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![/.-]?\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
CARD = r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"
OTHER = "|".join([EMAIL, IP, DATE, SSN, PHONE])
ANY = "|".join([OTHER, CARD])
#: At every group of digits, the longest reading of a card that starts there (captured, not consumed).
READINGS = r"(?<!\d)(?=(\d(?:[ -]?\d){12,18}(?!\d)))\d"
KINDS = ["email", "ip", "date", "ssn", "phone", "card"]
CYCLE = 146097                          # days of 400 years: 189 * 773
WIDE, NARROW = 189, 773
EPOCH = "1800-01-01"


def _number(*parts: Column, digits: int = 12) -> Column:
    """A pseudo-random number from the key and the parts."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, digits), 16, 10).cast("long")


def _shift(half: Column, other: Column, turn: Column, key: str, kind: str, sign: int) -> Column:
    """Every letter or digit of ``half`` moved within its class by a stream keyed by ``other``."""
    def move(c: Column, i: Column) -> Column:
        step = sign * _number(F.lit(key), F.lit(kind), turn, i, other, digits=8)
        code = F.ascii(c)
        out = c
        for low, size in ((48, 10), (65, 26), (97, 26)):
            moved = F.char((F.lit(low) + F.pmod(code - low + step, F.lit(size))).cast("long"))
            out = F.when(code.between(low, low + size - 1), moved).otherwise(out)
        return out
    return F.array_join(F.transform(F.split(half, ""), move), "")


def _turns(decrypt: bool) -> Column:
    return F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if decrypt else F.sequence(F.lit(1), F.lit(ROUNDS))


def permute_text(value: Column, key: str, kind: str, decrypt: bool = False) -> Column:
    """A keyed permutation of strings that keeps length and the class of each character."""
    cut = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), cut).alias("a"),
                     F.substring(value, cut + 1, F.length(value)).alias("b"))

    def turn(s: Column, r: Column) -> Column:
        # odd turns move the left half, even turns the right one
        sign = -1 if decrypt else 1
        left = F.struct(_shift(s["a"], s["b"], r, key, kind, sign).alias("a"), s["b"].alias("b"))
        right = F.struct(s["a"].alias("a"), _shift(s["b"], s["a"], r, key, kind, sign).alias("b"))
        return F.when(r % 2 == 1, left).otherwise(right)

    return F.aggregate(_turns(decrypt), start, turn, lambda s: F.concat(s["a"], s["b"]))


def permute_pair(a: Column, b: Column, size_a: int, size_b: int, key: str, kind: str, decrypt: bool = False) -> Column:
    """A keyed permutation of number pairs (a < size_a, b < size_b), as a struct."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(s: Column, r: Column) -> Column:
        sign = -1 if decrypt else 1
        left = F.struct(F.pmod(s["a"] + sign * _number(F.lit(key), F.lit(kind), r, s["b"]), F.lit(size_a)).alias("a"),
                        s["b"].alias("b"))
        right = F.struct(s["a"].alias("a"),
                         F.pmod(s["b"] + sign * _number(F.lit(key), F.lit(kind), r, s["a"]), F.lit(size_b)).alias("b"))
        return F.when(r % 2 == 1, left).otherwise(right)

    return F.aggregate(_turns(decrypt), start, turn)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum of a digit string; positions counted from the right, odd ones doubled when
    ``doubled`` is 1 and even ones when it is 0."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
        i % 2 == doubled, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))
        .otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def with_digits(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

    def put(s: Column, c: Column) -> Column:
        taken = F.struct(F.concat(s["out"], F.substring(digits, s["next"], F.lit(1))).alias("out"),
                         (s["next"] + 1).alias("next"))
        kept = F.struct(F.concat(s["out"], c).alias("out"), s["next"].alias("next"))
        return F.when(F.ascii(c).between(48, 57), taken).otherwise(kept)

    return F.aggregate(F.split(value, ""), start, put, lambda s: s["out"])


def date_of(value: Column) -> Column:
    """The calendar date of a written date, or null."""
    parts = F.split(value, "[-/.]")
    iso = F.concat_ws("-", parts[0], parts[1], parts[2])
    month_first = F.concat_ws("-", F.get(parts, F.lit(2)), parts[0], parts[1])
    day_first = F.concat_ws("-", F.get(parts, F.lit(2)), parts[1], parts[0])
    text = F.when(value.rlike(r"^\d{4}"), iso).when(value.contains("/"), month_first).otherwise(day_first)
    return F.when(F.length(text) == 10, F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def _written_like(value: Column, day: Column) -> Column:
    out = F.when(value.contains("/"), F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "dd.MM.yyyy"))
    return F.when(value.rlike(r"^\d{4}-"), F.date_format(day, "yyyy-MM-dd")) \
        .when(value.rlike(r"^\d{4}/"), F.date_format(day, "yyyy/MM/dd")).otherwise(out)


def is_card(digits: Column) -> Column:
    return F.length(digits).between(13, 19) & (luhn_sum(digits, 1) % 10 == 0) & (digits.cast("decimal(20,0)") > 0)


def cards_of(text: Column) -> Column:
    """The valid cards that begin and end at digit groups, whatever numbers stand beside them,
    the longest first. A reading has at most 19 digits, so at most seven ends are tried."""
    readings = F.array_distinct(F.regexp_extract_all(text, F.lit(READINGS), F.lit(1)))

    def ends(reading: Column) -> Column:
        cut = F.filter(F.sequence(F.lit(13), F.length(reading)),
                       lambda k: ~F.substring(reading, k + 1, F.lit(1)).rlike(r"\d") & F.substring(reading, k, F.lit(1)).rlike(r"\d"))
        return F.filter(F.transform(cut, lambda k: F.substring(reading, F.lit(1), k)), lambda v: is_card(digits_of(v)))

    found = F.array_distinct(F.flatten(F.transform(readings, ends)))
    return F.reverse(F.array_sort(F.transform(found, lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))))).getField("v")


def kind_of(value: Column) -> Column:
    """The validated kind of a found string, or null."""
    digits = digits_of(value)
    octets = F.split(value, r"\.")
    in_range = F.forall(octets, lambda o: o.cast("int") <= 255)
    year = F.year(date_of(value))
    ssn = digits.rlike(r"^(?!000|666|9)\d{3}(?!00)\d{2}(?!0000)\d{4}$")
    return F.when(value.contains("@"), F.lit("email")) \
        .when(value.rlike(f"^{IP}$"), F.when(in_range, F.lit("ip"))) \
        .when(value.rlike(f"^{DATE}$"), F.when(year.between(1800, 2199), F.lit("date"))) \
        .when(value.rlike(f"^{SSN}$"), F.when(ssn, F.lit("ssn"))) \
        .when(value.rlike(f"^{PHONE}$"), F.lit("phone")) \
        .when(is_card(digits), F.lit("card"))


def pseudonym(value: Column, kind: Column, key: str, decrypt: bool = False) -> Column:
    """The pseudonym of a value of the given kind; the value itself where the kind is null."""
    digits = digits_of(value)
    size = F.length(digits)
    local = F.regexp_extract(value, r"^(.*)@", 1)
    email = F.concat(permute_text(local, key, "email", decrypt), F.regexp_extract(value, r"(@.*)$", 1))
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("long"))
    pair = permute_pair(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], 65536, 65536, key, "ip", decrypt)
    ip = F.concat_ws(".", *[x.cast("string") for x in (F.floor(pair["a"] / 256), pair["a"] % 256,
                                                        F.floor(pair["b"] / 256), pair["b"] % 256)])
    day = F.datediff(date_of(value), F.lit(EPOCH).cast("date"))
    moved = permute_pair(F.floor(day / NARROW), day % NARROW, WIDE, NARROW, key, "date", decrypt)
    date = _written_like(value, F.date_add(F.lit(EPOCH).cast("date"), (moved["a"] * NARROW + moved["b"]).cast("int")))
    ssn = with_digits(value, permute_text(digits, key, "ssn", decrypt))
    front = F.substring(digits, F.lit(1), size - 10)
    phone = with_digits(value, F.concat(front, permute_text(F.substring(digits, size - 9, F.lit(10)), key, "phone", decrypt)))
    body = permute_text(F.substring(digits, F.lit(1), size - 1), key, "card", decrypt)
    check = F.pmod(-luhn_sum(body, 0), F.lit(10)).cast("string")
    card = with_digits(value, F.concat(body, check))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "date", date).when(kind == "ssn", ssn) \
        .when(kind == "phone", phone).when(kind == "card", card).otherwise(value)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text",
                 decrypt: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_found, n_email .. n_card, changed, text``."""
    text = F.col(text_col)
    some = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    none = F.array().cast("array<string>")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"),
                       F.when(text.rlike(CARD), cards_of(text)).otherwise(none).alias("cards"), some.alias("some"))
    # valid cards are looked for by name, so a reading that fails validation consumes nothing;
    # names with the same start share it, so that few alternatives are tried at a place
    starts = F.array_distinct(F.transform("cards", lambda c: F.substring(c, 1, 4)))
    rows = rows.withColumn("starts", starts)
    names = F.transform("starts", lambda p: F.concat(p, F.lit("(?:"), F.array_join(F.transform(
        F.filter("cards", lambda c: F.startswith(c, p)), lambda c: F.substring(c, 5, 64)), "|"), F.lit(")")))
    pattern = F.when(F.size("cards") > 0, F.concat(F.lit(OTHER + r"|(?<!\d)(?:"), F.array_join(names, "|"), F.lit(r")(?!\d)"))) \
        .otherwise(F.lit(OTHER))
    rows = rows.withColumn("pattern", pattern) \
        .withColumn("found", F.when(F.col("some"), F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).otherwise(none))
    rows = rows.withColumn("kinds", F.transform("found", kind_of))
    new = F.zip_with("found", "kinds", lambda v, k: pseudonym(v, k, key, decrypt))
    pieces = F.split("text", F.col("pattern"), -1)
    built = F.array_join(F.zip_with(pieces, new, lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")
    def count(kind: str) -> Column:
        return F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", F.size(F.filter("kinds", lambda k: k.isNotNull())).cast("long").alias("n_found"), *map(count, KINDS),
                       F.exists("kinds", lambda k: k.isNotNull()).alias("changed"),
                       F.when(F.exists("kinds", lambda k: k.isNotNull()), built).otherwise(F.col("text")).alias("text"))
