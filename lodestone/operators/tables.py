"""Table question answering: typed cells, a small query form, exact arithmetic with its workings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.numbers import FACTORS, MONTHS, fiscal_year, month_of, parse_number, year_of

#: Words that name an operation, in the order in which they are tried; "mean" counts as a noun only.
OPERATIONS = {
    "max": r"max|maximum|highest|largest|biggest|greatest|peak|most expensive|dearest|top|tallest|longest|heaviest|oldest|latest|fastest",
    "min": r"min|minimum|lowest|smallest|cheapest|least expensive|least|shortest|lightest|earliest|slowest",
    "avg": r"average|avg|mean of|mean value|the mean|per month|per invoice|per row|per item|per unit|per vendor",
    "diff": r"difference|differences|delta|variance|spread|range|gap|change",
    "count": r"how many|count|number of|no\.? of|nos\.? of",
    "sum": r"total|totals|sum|summed|combined|altogether|aggregate|overall|how much|spend|spent|spending|expenditure|paid|billed",
}
#: Words that say a comparison, in the order in which they are tried.
COMPARISONS = {
    ">=": "at least|no less than|minimum of|from",
    "<=": "at most|no more than|up to|maximum of",
    ">": "above|more than|greater than|over|exceeds?|exceeding|higher than|bigger than",
    "<": "below|less than|under|fewer than|lower than|smaller than|cheaper than",
}
#: Words of a question that ask for money or for a quantity, and words of a header that name such a column.
ASKS_MONEY = frozenset("spend spent spending expenditure expense expenses amount amt cost costs price prices value paid pay pays paying payment payments total revenue sales salary fee fees charge charges billing billed bill bills invoiced purchase purchases purchased money rupees inr rs budget turnover".split())
ASKS_QUANTITY = frozenset("qty quantity quantities units unit nos no pieces pcs volume count number headcount strength".split())
MONEY_HEADERS = frozenset("amount amt cost price value total spend expenditure expense invoice revenue sales salary fee fees charge charges payment paid billing gst tax rs inr rupees budget premium".split())
QUANTITY_HEADERS = frozenset("qty quantity units unit nos pieces pcs count number strength headcount".split())
#: The first cells that mark a table's own total.
TOTALS = ("total", "grand total", "sub total", "subtotal", "totals")


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: Any


@dataclass
class TableQuery:
    operation: str
    column: str | None
    filters: list[Filter] = field(default_factory=list)


def numeric_columns(df: DataFrame, share: float = 0.6) -> list[str]:
    """Columns of text of which at least a share of the filled cells are numbers; row numbers don't count. One pass."""
    texts = [c for c, t in df.dtypes if t == "string" and c.strip().lower() not in ("#", "no", "no.", "s.no", "sr", "sl")]
    filled = lambda c: F.count_if(F.coalesce(F.btrim(c), F.lit("")) != "")
    row = df.agg(*[x for c in texts for x in (filled(c).alias(f"f_{c}"), F.count(parse_number(F.col(c))).alias(f"n_{c}"))]).first() if texts else {}
    return [c for c in texts if row[f"f_{c}"] and row[f"n_{c}"] >= share * row[f"f_{c}"]]


def without_totals(df: DataFrame, label: str) -> DataFrame:
    """Rows but a table's own totals, told by their label."""
    return df.where(~F.coalesce(F.lower(F.btrim(label)).isin(*TOTALS), F.lit(False)))


def condition(f: Filter) -> Column:
    """A filter as a predicate. Periods are read from the column's text; numbers are parsed."""
    c = F.col(f.column)
    number = parse_number(c.cast("string"))
    if f.op == "equals":
        return F.lower(F.btrim(c.cast("string"))) == str(f.value).lower()
    if f.op == "word":
        return F.regexp_replace(F.lower(c.cast("string")), r"[^0-9a-z₹]+", " ").rlike(rf"(?:^| ){re.escape(str(f.value))}(?: |$)")
    if f.op == "contains":
        return F.lower(c.cast("string")).contains(str(f.value).lower())
    if f.op == "month":
        return month_of(c.cast("string")) == f.value
    if f.op == "year":
        return year_of(c.cast("string")) == f.value
    if f.op == "quarter":
        return F.ceil(month_of(c.cast("string")) / 3) == f.value
    if f.op == "fy":
        return fiscal_year(year_of(c.cast("string")), month_of(c.cast("string"))) == f.value
    if f.op == "between":
        return number.between(*f.value)
    return {">": number > f.value, ">=": number >= f.value, "<": number < f.value, "<=": number <= f.value, "=": number == f.value}[f.op]


def execute(df: DataFrame, query: TableQuery, label: str | None = None) -> DataFrame:
    """operation, value, rows_used: exact arithmetic over the rows that pass every filter, totals left out."""
    rows = without_totals(df, label) if label else df
    for f in query.filters:
        rows = rows.where(condition(f))
    value = parse_number(F.col(query.column).cast("string")) if query.column else F.lit(None).cast("double")
    made = {"sum": F.sum(value), "avg": F.avg(value), "max": F.max(value), "min": F.min(value), "diff": F.max(value) - F.min(value), "count": F.count("*").cast("double")}[query.operation]
    return rows.agg(F.lit(query.operation).alias("operation"), F.round(made, 4).alias("value"), F.count("*").alias("rows_used"))


def evidence_row(df: DataFrame, column: str, tie: str, greatest: bool = True) -> DataFrame:
    """The row that holds the extreme of a column, ties to the smallest ``tie``."""
    order = F.struct(F.col(column) if greatest else -F.col(column), -F.col(tie))
    return df.agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


_NUMBER = r"(?:rs\.?|inr|[₹$€£])?\s*(\d[\d,]*(?:\.\d+)?)\s*(lakhs?|lacs?|crores?|cr)?\b"


def _amount(digits: str, factor: str | None) -> float:
    return float(digits.replace(",", "")) * (FACTORS[factor] if factor else 1.0)


def _words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z₹]+", text.lower())


def _named_column(question: str, numeric: list[str]) -> str | None:
    """The numeric column a question names best: its whole name (10), each word of it (4), money or a quantity asked for
    (3); the only one if none is named. None if two are named as well as each other, or none of several is."""
    asked = _words(question)
    whole = " " + " ".join(asked) + " "

    def score(name: str) -> int:
        own = [w for w in _words(name) if len(w) >= 3]
        kind = 3 * bool(MONEY_HEADERS & {*own} and ASKS_MONEY & {*asked}) + 3 * bool(QUANTITY_HEADERS & {*own} and ASKS_QUANTITY & {*asked})
        return 10 * (f" {' '.join(_words(name))} " in whole) + 4 * sum(any(q == w or q == w + "s" or q + "s" == w for q in asked) for w in own) + kind

    marks = sorted(((score(c), c) for c in numeric), reverse=True)
    if marks and marks[0][0] and (len(marks) == 1 or marks[0][0] > marks[1][0]):
        return marks[0][1]
    return numeric[0] if len(numeric) == 1 else None


def _comparisons(question: str, numeric: list[str], column: str | None) -> list[Filter] | None:
    """All comparisons with numbers. Each belongs to the column named last before it, else to the question's, else to the
    only column of money; None if one has no column."""
    money = [c for c in numeric if MONEY_HEADERS & {*_words(c)} and not QUANTITY_HEADERS & {*_words(c)}]
    column = column or (money[0] if len(money) == 1 else None)
    found: list[tuple[int, int, str, Any]] = []
    for m in re.finditer(rf"\bbetween\s+{_NUMBER}\s*(?:and|to|-|–)\s*{_NUMBER}", question):
        found.append((m.start(), m.end(), "between", tuple(sorted((_amount(m[1], m[2]), _amount(m[3], m[4]))))))
    for op, wording in COMPARISONS.items():
        for m in re.finditer(rf"\b(?:{wording})\s+{_NUMBER}", question):
            if all(m.end() <= a or b <= m.start() for a, b, *_ in found):
                found.append((m.start(), m.end(), op, _amount(m[1], m[2])))
    out, before = [], 0
    for start, end, op, value in sorted(found):
        said = " ".join(_words(question[before:start]))
        near = [(said.rfind(" ".join(_words(c))), c) for c in numeric]
        at, name = max(near, default=(-1, None))
        target = name if at >= 0 else column
        if target is None:
            return None
        out.append(Filter(target, op, value))
        before = end
    return out


def plan_question(question: str, columns: list[str], numeric: list[str]) -> TableQuery | None:
    """Reads a question in plain words into a TableQuery; None where no operation is named, or no one column, or where a
    comparison belongs to no column.

    Months by name, years, "Q1" (calendar), "Q1 FY26" and "FY26" (April to March; two digits from 70 on are 19xx) are read
    from the first column named like a date or month; a period without such a column is None too. "may" is a month only
    after a preposition or before a year.
    """
    q = question.lower()
    said = re.sub(rf"\b(?:{'|'.join(COMPARISONS.values())})\s+{_NUMBER}", " ", q)  # "at least 5" asks for no minimum
    operation = next((o for o, wording in OPERATIONS.items() if re.search(rf"\b(?:{wording})\b", said)), None)
    if operation is None:
        return None
    column = _named_column(q, numeric)
    if column is None and operation != "count":
        return None
    out = TableQuery(operation, column)
    when = next((c for c in columns if re.search(r"date|month|period", c.lower())), None)
    fiscal = re.search(r"\bfy\s*[-'’]?\s*(\d{4}|\d{2})\b", q)
    quarter = re.search(r"\bq([1-4])\b", q)
    month = re.search(r"\b(" + "|".join(m for m in MONTHS if m != "may") + r")[a-z]*\b", q) or re.search(r"(?<=\b(?:in|of|by)\s)(may)\b|(?<=\bfor\s)(may)\b|\b(may)(?=\s+(?:19|20)\d{2}\b)", q)
    year = re.search(r"\b((?:19|20)\d{2})\b", re.sub(r"\bfy\s*[-'’]?\s*\d{4}\b", "", q))
    if (fiscal or quarter or month or year) and when is None:
        return None
    if fiscal:
        named = int(fiscal[1])
        out.filters.append(Filter(when, "fy", named if named > 99 else named + (2000 if named < 70 else 1900)))
        if quarter:  # the first fiscal quarter is the second of the calendar
            out.filters.append(Filter(when, "quarter", int(quarter[1]) % 4 + 1))
    else:
        if quarter:
            out.filters.append(Filter(when, "quarter", int(quarter[1])))
        if month:
            out.filters.append(Filter(when, "month", MONTHS.index(next(g for g in month.groups() if g)) + 1))
        if year:
            out.filters.append(Filter(when, "year", int(year[1])))
    compared = _comparisons(q, numeric, column)
    if compared is None:
        return None
    out.filters += compared
    return out


#: Words of a question that never name a cell.
INTENT = frozenset("total sum average mean count number how much many highest largest lowest smallest maximum minimum difference list show which what who when where give all any the for from and with between above below over under more less than most least amount value values rows table column per are was were that this may due".split())


def label_filters(df: DataFrame, question: str, numeric: list[str], skip: list[str] = ()) -> list[Filter] | None:
    """Filters on cells the question names, at most two columns; None if it names, in capitals, what the table doesn't hold.

    A cell with a digit counts if the question quotes all of it; else a word of a cell, of three letters at least, that is
    in the question. A column's best word is the longest, of equal ones that in fewer rows. One pass over the table counts
    the question's words; only counts, a few for each word and column, come to the driver.
    """
    texts = [c for c, t in df.dtypes if t == "string" and c not in numeric and c not in skip]
    headers = {w for c in df.columns for w in _words(c)}
    asked = [w for w in dict.fromkeys(_words(question)) if len(w) >= 3 and w not in INTENT and w not in headers and not w.isdigit() and w[:3] not in MONTHS and not re.fullmatch(r"q[1-4]|fy\d*", w)]
    plain = lambda c: F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(F.col(c)), r"[^0-9a-z₹]+", " ")), F.lit(" "))
    whole = F.lit(" " + " ".join(_words(question)) + " ")
    if not texts:
        return []
    counts = [F.count_if(plain(c).contains(f" {w} ")).alias(f"{i}_{j}") for i, c in enumerate(texts) for j, w in enumerate(asked)]
    quoted = [F.max_by(F.when(plain(c).rlike("[0-9]") & (F.length(plain(c)) >= 5) & whole.contains(plain(c)), F.col(c)), F.when(plain(c).rlike("[0-9]") & (F.length(plain(c)) >= 5) & whole.contains(plain(c)), F.length(c))).alias(f"q_{i}") for i, c in enumerate(texts)]
    row = df.agg(F.count("*").alias("n"), *counts, *quoted).first()
    exact = max(((len(row[f"q_{i}"]), c, row[f"q_{i}"]) for i, c in enumerate(texts) if row[f"q_{i}"]), default=None)
    best = []
    for i, c in enumerate(texts):
        hits = [(len(w) + 4.0 * (1 - row[f"{i}_{j}"] / row["n"]), w) for j, w in enumerate(asked) if row[f"{i}_{j}"]]
        if hits:
            best.append((*max(hits), c))
    held = {w for j, w in enumerate(asked) if any(row[f"{i}_{j}"] for i in range(len(texts)))} | set(_words(exact[2]) if exact else ())
    names = {w for token in question.split()[1:] if token[:1].isupper() for w in _words(token)}
    if any(w in names and w not in held for w in asked):
        return None
    out = [Filter(c, "word", w) for _, w, c in sorted(best, reverse=True)[:2]]
    return [Filter(exact[1], "equals", exact[2].strip()), *(f for f in out if f.column != exact[1])] if exact else out


def ask_table(df: DataFrame, question: str, label: str | None = None) -> DataFrame | None:
    """The question answered over a table (see ``execute``); None where it can't be read as a whole."""
    rows = without_totals(df, label) if label else df
    numeric = numeric_columns(rows)
    plan = plan_question(question, df.columns, numeric)
    named = label_filters(rows, question, numeric, [f.column for f in plan.filters]) if plan else None
    if named is None:
        return None
    plan.filters += named
    return execute(df, plan, label)
