"""Numbers, months, quarters and fiscal years written in text, as built-in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells that hold no number.
BLANKS = ("", "-", "–", "—", "--", "n/a", "na", "nil", "none", "null", "nan", "tbd")
#: Factors of number words.
FACTORS = {"thousand": 1e3, "k": 1e3, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5, "million": 1e6, "mn": 1e6, "crore": 1e7, "crores": 1e7, "cr": 1e7, "billion": 1e9, "bn": 1e9}
#: Months by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once a row, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_number(cell: Column) -> Column:
    """The number a cell holds, else null.

    Accepts currency signs and names, grouping commas, a sign, parentheses for negatives, a percent sign (12% is 12),
    a unit after the number, and factors such as lakh or crore. Two numbers, words or blanks give null.
    """
    money = r"^(-?)\s*(?:(?:rs\.?|inr|usd|eur|gbp|[₹$€£])\s*)+"
    shape = r"^([+-]?(?:\d[\d,]*\.?\d*|\.\d+))\s*(%|[a-z°µ/²³]{0,12}\.?)$"
    factors = F.create_map(*[F.lit(x) for kv in FACTORS.items() for x in kv])

    def plain(inner: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(inner, shape, 1), "[,+]", "")
        return digits.try_cast("double") * F.coalesce(F.try_element_at(factors, F.regexp_extract(inner, shape, 2)), F.lit(1.0))

    def read(bare: Column) -> Column:
        inner = F.btrim(F.regexp_replace(F.btrim(F.substring(bare, F.lit(2), F.length(bare) - 2)), money, "$1"))
        return F.when(bare.isin(*BLANKS), F.lit(None).cast("double")).when(bare.startswith("(") & bare.endswith(")"), -let(inner, plain)).otherwise(plain(bare))

    return let(F.btrim(F.regexp_replace(F.lower(F.btrim(cell)), money, "$1")), read)


def indian_grouping(amount: Column) -> Column:
    """A whole amount with the last three digits, then pairs, set off by commas."""
    digits = F.abs(amount).cast("long").cast("string")
    head = F.when(F.length(digits) > 3, F.expr("1 = 1"))
    front = F.substring(digits, F.lit(1), F.length(digits) - 3)
    pairs = F.reverse(F.regexp_replace(F.reverse(front), r"(\d{2})(?=\d)", "$1,"))
    text = F.when(head, F.concat(pairs, F.lit(","), F.right(digits, F.lit(3)))).otherwise(digits)
    return F.when(amount < 0, F.concat(F.lit("-"), text)).otherwise(text)


def month_of(text: Column) -> Column:
    """Month 1 to 12 of a date in text: ISO, day first with / - or ., or a month's name; else null."""
    iso = F.regexp_extract(text, r"\b\d{4}-(\d{1,2})(?:-\d{1,2})?\b", 1)
    day_first = F.regexp_extract(text, r"\b\d{1,2}[/.-](\d{1,2})[/.-]\d{4}\b", 1)
    name = F.regexp_extract(F.lower(text), r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b", 1)
    month = F.coalesce(F.nullif(iso, F.lit("")), F.nullif(day_first, F.lit(""))).cast("int")
    return F.when(month.between(1, 12), month).when(name != "", F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("int"))


def year_of(text: Column) -> Column:
    """The year 1900 to 2099 in a text, else null."""
    return F.nullif(F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int")


def fiscal_year(year: Column, month: Column) -> Column:
    """The fiscal year, April to March, named after the year it ends in."""
    return F.when(month >= 4, year + 1).otherwise(year)


def fiscal_quarter(month: Column) -> Column:
    """1 for April to June, to 4 for January to March."""
    return (F.floor(F.pmod(month - 4, F.lit(12)) / 3) + 1).cast("int")
