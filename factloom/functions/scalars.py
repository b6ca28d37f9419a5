"""Scalars as Column expressions: names, identifiers, decimals, dates, check digits, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms at the end of organisation names; lengths of IBANs by country (ISO 13616 registry, common countries).
LEGAL_FORMS = ("gmbh", "ag", "kg", "eg", "se", "co", "ohg", "ug", "mbh", "ltd", "inc", "llc", "plc", "sa", "sarl", "sl")
IBAN_LENGTHS = {"DE": 22, "AT": 20, "CH": 21, "FR": 27, "ES": 24, "IT": 27, "NL": 18, "BE": 16, "LU": 20, "GB": 22, "IE": 22, "PT": 25, "PL": 28, "CZ": 24, "SE": 24, "DK": 18, "NO": 15, "FI": 18, "LI": 21, "HU": 28, "GR": 27, "SK": 24}
LOCATION_ALIASES = {"strasse": "street", "straße": "street", "street": "street", "adresse": "street", "address": "street", "plz": "postal_code", "postleitzahl": "postal_code", "zip": "postal_code", "ort": "city", "stadt": "city", "city": "city"}


def normalize_name(x: Column) -> Column:
    """Lower case, German umlauts spelled out, other signs to single blanks (V1)."""
    y = F.lower(x)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        y = F.replace(y, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(y, r"[^\p{L}\p{N}]+", " "))


def normalize_organization(x: Column) -> Column:
    """V1 without legal forms at the end, but never without any word (V2)."""
    n = normalize_name(x)
    return F.regexp_replace(n, "(?<=.)( (" + "|".join(LEGAL_FORMS) + "))+$", "")


def normalize_identifier(x: Column) -> Column:
    """Letters and digits in upper case (V3)."""
    return F.upper(F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))


def canonical_decimal(x: Column) -> Column:
    """A decimal text in its one form: no sign plus, no leading or trailing zeros, no negative zero; null if it is none or longer than 80 signs (V6)."""
    ok = x.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$") & (F.length(x) <= 80)
    y = F.regexp_replace(x, r"^\+", "")
    y = F.regexp_replace(y, r"(\.[0-9]*?)0+$", "$1")
    y = F.regexp_replace(y, r"\.$", "")
    y = F.regexp_replace(y, r"^(-?)0+(?=[0-9])", "$1")
    return F.when(ok, F.when(y == "-0", "0").otherwise(y))


def parse_date(x: Column) -> Column:
    """ISO or D.M.YYYY as a date, null for days that do not exist (V7)."""
    iso = F.when(x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(x, "yyyy-MM-dd"))
    german = F.when(x.rlike(r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$"), F.try_to_date(x, "d.M.yyyy"))
    return F.coalesce(iso, german)


def month_period(day: Column) -> Column:
    """First and last day of a day's month (V9)."""
    return F.struct(F.trunc(day, "month").alias("first"), F.last_day(day).alias("last"))


def whole_period(first: Column, last: Column) -> Column:
    """month or year where the days are exactly one, else null (V9)."""
    year = (F.trunc(first, "year") == first) & (F.add_months(first, 12) == F.date_add(last, 1))
    return F.when(year, "year").when((F.trunc(first, "month") == first) & (F.last_day(first) == last), "month")


def mod97(x: Column) -> Column:
    """Remainder by 97 of letters and digits read as a number, letters as 10 to 35, digit by digit (ISO 7064)."""
    chars = F.split(F.upper(x), "")
    number = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).when(c.rlike("[A-Z]"), F.ascii(c) - 55)
    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0), lambda acc, c: F.when(number(c) >= 10, (acc * 100 + number(c)) % 97).otherwise((acc * 10 + number(c)) % 97))


def valid_iban(x: Column) -> Column:
    """Whether a text is an IBAN: its country's length and remainder 1 (V10). Null is none."""
    y = F.upper(F.regexp_replace(x, r"\s", ""))
    length = F.create_map(*[F.lit(v) for kv in IBAN_LENGTHS.items() for v in kv])
    fits = y.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$") & (F.length(y) == F.element_at(length, F.substring(y, 1, 2)))
    return F.coalesce(F.when(fits, mod97(F.concat(F.substr(y, F.lit(5)), F.substring(y, 1, 4))) == 1), F.lit(False))


def valid_tax_id(x: Column) -> Column:
    """Whether a text is a German tax number of a person: 11 digits, the first not 0, among the first ten just one digit
    twice or three times but not three in a row, check digit by ISO 7064 MOD 11,10 (V11)."""
    y = F.regexp_replace(x, r"[\s/-]", "")
    digits = F.transform(F.split(F.substring(y, 1, 10), ""), lambda c: c.cast("int"))
    digits = F.filter(digits, lambda d: d.isNotNull())
    counts = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.size(F.filter(digits, lambda e: e == d)))
    more = F.filter(counts, lambda n: n > 1)
    check = F.aggregate(digits, F.lit(10), lambda p, d: (F.when((d + p) % 10 == 0, 10).otherwise((d + p) % 10) * 2) % 11)
    want = F.when(11 - check == 10, 0).otherwise((11 - check) % 10)
    fine = y.rlike("^[1-9][0-9]{10}$") & (F.size(more) == 1) & (F.array_max(more) <= 3) & ~F.substring(y, 1, 10).rlike(r"([0-9])\1\1")
    return F.coalesce(F.when(fine, want == F.substring(y, 11, 1).cast("int")), F.lit(False))


def mrz_digit(x: Column) -> Column:
    """Check digit of a machine-readable field: weights 7, 3, 1; letters from 10, filler 0 (ICAO 9303; V13)."""
    chars = F.filter(F.split(x, ""), lambda c: c != "")
    value = lambda c: F.when(c == "<", 0).when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    weighted = F.transform(chars, lambda c, i: value(c) * F.element_at(F.array(F.lit(7), F.lit(3), F.lit(1)), (i % 3 + 1).cast("int")))
    return F.aggregate(weighted, F.lit(0), lambda a, b: a + b) % 10


def mrz_year(two: Column, birth: bool, reference: int) -> Column:
    """Four digits of a two-digit year: births after the reference year lie a century back, expiries in this one."""
    return F.when(F.lit(birth) & (two > reference % 100), 1900 + two).otherwise(2000 + two)


def semantic_key(*columns: Column) -> Column:
    """SHA-256 of the values as one JSON array-like text; nulls count."""
    return F.sha2(F.to_json(F.struct(*[c.cast("string").alias(f"c{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"}), 256)


def hex_distance(q1: Column, r1: Column, q2: Column, r2: Column) -> Column:
    """Steps between two cells in axial coordinates."""
    return ((F.abs(q1 - q2) + F.abs(r1 - r2) + F.abs(q1 + r1 - q2 - r2)) / 2).cast("int")


def quick_note(text: Column) -> Column:
    """Title (first line, at most 60 signs) and body of a note."""
    line = F.substring_index(text, "\n", 1)
    return F.struct(F.substring(line, 1, 60).alias("title"), F.when(F.contains(text, F.lit("\n")), F.substr(text, F.length(line) + 2)).otherwise("").alias("body"))


def url_host(url: Column) -> Column:
    """Host of a URL in lower case without www, null without one."""
    return F.nullif(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:www\.)?([a-z0-9.-]+)", 1), F.lit(""))


def standard_field(label: Column) -> Column:
    """Standard field of a label, null if it has none."""
    key = F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}]", "")
    return F.element_at(F.create_map(*[F.lit(v) for kv in LOCATION_ALIASES.items() for v in kv]), key)
