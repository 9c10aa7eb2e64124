"""Entities, relations and labelled facts in text, by patterns in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of entities and their patterns.
PATTERNS = {
    "code": r"\b[A-Z]{2,6}[-/][0-9]+(?:-[0-9]+)*\b",
    "email": r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b",
    "money": r"(?:INR|Rs\.?|USD|EUR|[₹$€£])\s?[0-9][0-9,]*(?:\.[0-9]+)?",
    "date": r"\b(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{4})\b",
    "percent": r"\b[0-9]+(?:\.[0-9]+)?%",
    "duration": r"\b[0-9]+ (?:days?|weeks?|months?|years?)\b",
    "gstin": r"\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]\b",
    "pan": r"\b[A-Z]{5}[0-9]{4}[A-Z]\b",
}

#: Words whose full stop ends no sentence.
ABBREVIATIONS = "no|nos|inc|ltd|pvt|co|corp|mr|mrs|ms|dr|prof|shri|smt|sri|st|rd|vs|etc|approx|dept|govt|fig|eg|ie|jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec|sq|ext|min|max|ref|hon|llp|plc|gmbh|pp|vol|al|rs|inv|gst|pan|tan|cin"
#: Entities of a sentence that may be related without a name for it.
POOL = 12


def entities(text: Column) -> Column:
    """array<struct<kind, value>>: each kind's distinct values."""

    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    return F.concat(*[of(k, p) for k, p in PATTERNS.items()])


def entity_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, value, norm): norm is the value in small letters without spaces and commas."""
    rows = docs.select(id_col, F.explode(entities(F.col(text_col))).alias("e")).select(id_col, "e.kind", "e.value")
    return rows.withColumn("norm", F.regexp_replace(F.lower("value"), r"[\s,]+", ""))


def cut(text: Column, pattern: str) -> Column:
    """The text between the matches of a pattern, as by ``split``, which compiles its pattern anew for each row."""
    mark = "\0"
    return F.when(text.contains(mark), F.split(text, pattern, -1)).otherwise(F.split(F.regexp_replace(text, pattern, mark), mark, -1))


def sentences(text: Column) -> Column:
    """Sentences: cut at line feeds and after full stops, exclamation and question marks, not after abbreviations or single letters."""
    # the mark is looked for first: what stands before it takes long to tell
    return cut(text, rf"(?=[.!?])(?<![.!?])(?<!(?<![A-Za-z])(?<![A-Za-z]\.)(?i:{ABBREVIATIONS}|[a-z]))[.!?]+[\s\u00a0]+|\n+")


def relations(docs: DataFrame, id_col: str, subject: str, links: dict[str, str], text_col: str = "text") -> DataFrame:
    """(src, rel, dst, place), each once: what is said together in a sentence.

    Every entity of the subject's kind relates to every one of the kinds in ``links``, which names the relation. Other
    pairs of the first POOL entities of a sentence have ``co_occurs_with``, the smaller (kind, norm) first, but for
    amounts and dates among themselves.
    """
    norm = lambda v: F.regexp_replace(F.lower(v), r"[\s,]+", "")
    placed = F.sort_array(F.transform(entities(F.col("s")), lambda x: F.struct(F.position(x["value"], F.col("s")).alias("at"), x["kind"].alias("kind"), norm(x["value"]).alias("norm"))))
    # by their first place, each (kind, norm) once; the generator keeps the optimizer from working the array out for each use
    once = F.array_distinct(F.transform(placed, lambda x: F.struct(x["kind"].alias("kind"), x["norm"].alias("norm"))))
    said = docs.select(id_col, F.explode(sentences(F.col(text_col))).alias("s")).select(id_col, F.explode(F.array(once)).alias("e")).where(F.size("e") > 1)
    a, b = F.col("a"), F.col("b")
    pairs = said.select(id_col, F.col("e"), F.posexplode("e").alias("i", "a")).select(id_col, "i", "a", F.posexplode("e").alias("j", "b")).where("i != j")
    names = F.create_map(*[F.lit(x) for kv in links.items() for x in kv])
    named = lambda x, y: (x["kind"] == subject) & y["kind"].isin(*links)
    loose = a["kind"].isin("money", "date") & b["kind"].isin("money", "date")
    beside = (F.struct(a["kind"], a["norm"]) < F.struct(b["kind"], b["norm"])) & (F.greatest("i", "j") < POOL) & ~loose & ~named(b, a)
    rel = F.when(named(a, b), F.try_element_at(names, b["kind"])).when(beside, "co_occurs_with")
    return pairs.select(a["norm"].alias("src"), rel.alias("rel"), b["norm"].alias("dst"), F.col(id_col).alias("place")).where(F.col("rel").isNotNull()).distinct()


def labelled_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, value): lines of the form ``Label: value``."""
    lines = docs.select(id_col, F.explode(F.split(text_col, "\n")).alias("line"))
    shape = r"^\s*([A-Z][A-Za-z .()/-]{1,40}?)\s*:\s*(\S.*?)\s*$"
    return lines.where(F.col("line").rlike(shape)).select(id_col, F.regexp_extract("line", shape, 1).alias("label"), F.regexp_extract("line", shape, 2).alias("value"))


def conflicts(facts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one distinct value: how many, the least and the greatest."""
    return facts.groupBy(*keys).agg(F.countDistinct(value).alias("n_values"), F.min(value).alias("low"), F.max(value).alias("high")).where("n_values > 1")
