"""Hybrid retrieval: ranked lists fused, missing cosines filled in, hits re-ranked by what the question asks for."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.search import dot

#: Wording of passages that describe a test rather than state a fact.
META_MARKS = ("expected behavior", "expected behaviour", "should abstain", "should return", "a robust system", "evaluation questions", "adversarial test", "test corpus", "ground truth", "what a robust system", "use these queries")

TERM = r"[a-z0-9][\p{L}\p{N}_-]{2,}"
_PYTHON_TERM = re.compile(r"[a-z0-9][\w-]{2,}")


@dataclass(frozen=True)
class Question:
    """A question, what it names, what it asks for, how a wanted value looks (a Java regex) and whether it wants numbers."""

    text: str
    entities: Sequence[str] = ()
    attributes: Sequence[str] = ()
    value_pattern: str | None = None
    numeric: bool = False


def _count(conditions: Sequence[Column]) -> Column:
    return sum((F.coalesce(c, F.lit(False)).cast("int") for c in conditions), F.lit(0))


def _sum_of(conditions: Mapping[float, Column]) -> Column:
    return sum((F.when(c, F.lit(weight)).otherwise(0.0) for weight, c in conditions.items()), F.lit(0.0))


def rerank_score(question: Question) -> Column:
    """The score of a hit, to 4 places, from text, heading, content_type, vector_score, rrf, keyword_rank (from 0, or null), exact and graph."""
    text = F.coalesce("text", F.lit(""))
    low = F.lower(text)
    terms = sorted(set(_PYTHON_TERM.findall(question.text.lower())))
    overlap = F.size(F.array_intersect(F.regexp_extract_all(low, F.lit(TERM), F.lit(0)), F.array(*map(F.lit, terms)))) if terms else F.lit(0)
    marks, asked = _count([low.contains(m) for m in META_MARKS]), F.length(low) - F.length(F.replace(low, F.lit("?"), F.lit("")))
    meta = F.when((marks > 0) | (asked >= 4), 0.5 * F.least(F.lit(3), marks) + 0.1 * F.least(F.lit(5), asked)).otherwise(0.0)
    bare = F.regexp_replace(low, "[^a-z0-9]", "")
    named = _count([bare.contains(re.sub("[^a-z0-9]", "", e.lower())) for e in question.entities]) > 0
    value = F.when(F.regexp_like(text, F.lit(question.value_pattern)), 0.55).otherwise(-0.35) if question.value_pattern else F.lit(0.0)
    score = (
        1.6 * F.coalesce("vector_score", F.lit(0.0))
        + 1.2 * F.coalesce("rrf", F.lit(0.0))
        + _sum_of({1.0: F.col("exact"), 0.35: F.col("graph"), 0.8: named})
        + F.when(F.col("keyword_rank").isNotNull(), F.greatest(F.lit(0.0), 0.5 - 0.02 * F.col("keyword_rank"))).otherwise(0.0)
        - meta
        + 0.25 * F.least(F.lit(3), _count([low.contains(a) for a in question.attributes]))
        + F.least(F.lit(0.6), 0.05 * overlap)
        + value
        + F.when(F.lit(question.numeric) & (F.col("content_type") == "table"), 0.3).otherwise(0.0)
        + F.when(_count([F.lower("heading").contains(a) for a in question.attributes]) > 0, 0.3).otherwise(0.0)
    )
    return F.round(score, 4)


def rerank(hits: DataFrame, question: Question, k: int, id_col: str = "doc_id") -> DataFrame:
    """The k best hits by ``rerank_score``; ties to the greater rrf, then the smaller id."""
    return hits.withColumn("rerank_score", rerank_score(question)).orderBy(F.desc("rerank_score"), F.desc("rrf"), id_col).limit(k)


def hybrid(chunks: DataFrame, vectors: DataFrame, query: Sequence[float], lists: Mapping[str, tuple[DataFrame, float]], pool: int = 30, content_types: Sequence[str] | None = None, constant: int = 60, id_col: str = "doc_id", vector_col: str = "embedding") -> DataFrame:
    """The pool of hits that ranked lists (id, score; bounded by their own limits) give together.

    ``lists`` maps ``vector``, ``keyword``, ``exact`` and ``graph``, as far as there are any, to a list and its weight; a
    list's part is weight / (constant + rank), rank from 1, ties to the smaller id. Columns: id, rrf (5 places),
    vector_score (4 places; the cosine, also of hits that the vector list lacks; 0 without a vector), keyword_rank
    (from 0), exact, graph, and those of ``chunks``. Only the pool's chunks and vectors are fetched.
    """
    ranked = None
    for name, (df, weight) in lists.items():
        one = df.select(id_col, F.lit(name).alias("list"), F.lit(float(weight)).alias("weight"), F.col("score").cast("double").alias("score"))
        ranked = one if ranked is None else ranked.unionByName(one)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("list").orderBy(F.desc("score"), id_col)))
    of = lambda name: F.col("list") == name
    fused = ranked.groupBy(id_col).agg(
        F.round(F.sum(F.col("weight") / (constant + F.col("rank"))), 5).alias("rrf"),
        F.min(F.when(of("keyword"), F.col("rank") - 1)).alias("keyword_rank"),
        F.max(of("exact")).alias("exact"),
        F.max(of("graph")).alias("graph"),
    )
    if content_types:
        kept = chunks.where(F.col("content_type").isin(*content_types)).select(id_col)
        fused = kept.join(F.broadcast(fused), id_col)  # as many rows as the lists have
    best = fused.orderBy(F.desc("rrf"), id_col).limit(pool)
    near = vectors.join(F.broadcast(best.select(id_col)), id_col, "left_semi").select(id_col, F.round(dot(F.col(vector_col), F.array(*[F.lit(float(x)) for x in query])), 4).alias("vector_score"))
    hits = chunks.join(F.broadcast(best), id_col)  # at most ``pool`` rows
    return hits.join(F.broadcast(near), id_col, "left").withColumn("vector_score", F.coalesce("vector_score", F.lit(0.0)))
