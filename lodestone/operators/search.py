"""Lexical and dense retrieval, rank fusion and word features of hits as DataFrame plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores in small letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, tf). Terms combine within a task before they are shuffled."""
    return docs.select(id_col, F.explode(tokens(F.col(text_col))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, F.size(tokens(F.col(text_col))).cast("long").alias("len"))


def bm25(docs: DataFrame, query: Sequence[str], fields: Mapping[str, float] | None = None, k: int = 20, k1: float = 1.2, b: float = 0.75, id_col: str = "doc_id") -> DataFrame:
    """The k best documents by Okapi BM25 over weighted fields: (id, score), ties to the smaller id.

    Only occurrences of the query's terms leave a task: term counts are taken per document by array functions, so the
    shuffle carries one row for each partition, not the postings. The corpus statistics are over all documents; only
    documents that hold a term as a substring are split into words again for the scores.
    """
    fields = dict(fields or {"text": 1.0})
    terms = sorted(set(query))
    length = sum((F.size(f"t_{c}") for c in fields), F.lit(0))
    times = lambda c, term: F.size(f"t_{c}") - F.size(F.array_remove(f"t_{c}", term))
    counts = [[times(c, t) for c in fields] for t in terms]
    marked = lambda df: df.select(id_col, *[tokens(F.col(c)).alias(f"t_{c}") for c in fields])
    counted = lambda df: marked(df).select(id_col, length.cast("long").alias("len"), *[sum((F.lit(w) * n for w, n in zip(fields.values(), ns, strict=True)), F.lit(0.0)).alias(f"w{i}") for i, ns in enumerate(counts)])
    stats = counted(docs).agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"w{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    holds = reduce(or_, [F.lower(F.col(c)).contains(t) for c in fields for t in terms])
    joined = counted(docs.where(holds)).crossJoin(F.broadcast(stats))  # one row of statistics
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)))
        tf = F.col(f"w{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    # every idf is positive; the condition names both sides and takes nulls, so no part of it is pushed below to split the texts again
    return joined.where(F.coalesce(score, F.lit(0.0)) > 0).select(id_col, F.round(score, 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense(vectors: DataFrame, query: Sequence[float], k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest unit vectors by cosine: (id, score), ties to the smaller id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, F.round(dot(F.col(vector_col), q), 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def reciprocal_rank_fusion(lists: Sequence[tuple[DataFrame, float]], id_col: str, k: int = 20, constant: int = 60) -> DataFrame:
    """Fuses ranked lists (id, score) of at most some dozens of rows each: sum of weight / (constant + rank), rank from 1."""
    ranked = None
    for df, weight in lists:
        w = Window.orderBy(F.desc("score"), id_col)
        one = df.select(id_col, (F.lit(weight) / (F.lit(constant) + F.row_number().over(w))).alias("part"))
        ranked = one if ranked is None else ranked.unionByName(one)
    return ranked.groupBy(id_col).agg(F.round(F.sum("part"), 8).alias("rrf")).orderBy(F.desc("rrf"), id_col).limit(k)


def term_overlap(left: Column, right: Column) -> Column:
    """The share of the right side's distinct words that the left side has."""
    a, b = F.array_distinct(left), F.array_distinct(right)
    return F.when(F.size(b) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(b))


def rerank(hits: DataFrame, terms: Sequence[str], text_col: str = "text") -> DataFrame:
    """Word features on hits: share of terms, phrase, early first place, and ``rerank``, a weighted sum of its own, not the reference's re-ranking."""
    words = tokens(F.col(text_col))
    wanted = F.array(*map(F.lit, terms))
    share = F.size(F.array_intersect(F.array_distinct(words), wanted)) / F.lit(float(len(set(terms))))
    phrase = F.lower(F.col(text_col)).contains(" ".join(terms)).cast("double")
    early = (F.array_position(words, terms[0]).between(1, 50)).cast("double")
    score = F.round(share + 0.5 * phrase + 0.25 * early + 0.25 * (share == 1.0).cast("double"), 6)
    return hits.withColumn("share", F.round(share, 6)).withColumn("phrase", phrase).withColumn("early", early).withColumn("rerank", score)


def exact_codes(text: Column) -> Column:
    """Codes such as INV-123 or AB/12-3: capitals, a joint, then digits."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z]{2,6}[-/][0-9]+(?:-[0-9]+)*\b"), F.lit(0)))
