"""Store-style relational operators: scoping, upserts, counters and graph tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scoped(df: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the allowed."""
    return df.join(allowed.select(key), key, "left_semi")


def new_rows(arrivals: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Arrivals not yet known, each key once; null keys are equal."""
    fresh = arrivals.dropDuplicates(list(keys)).alias("a")
    condition = [F.col(f"a.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys]
    return fresh.join(known.alias("k"), condition, "left_anti")


def latest(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row of the greatest version for each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def wrong_counts(parents: DataFrame, children: DataFrame, key: str, counter: str) -> DataFrame:
    """Parents whose counter differs from their children's number: key, stored, actual."""
    actual = children.groupBy(key).agg(F.count("*").alias("actual"))
    joined = parents.select(key, F.col(counter).cast("long").alias("stored")).join(actual, key, "left")
    return joined.withColumn("actual", F.coalesce("actual", F.lit(0)).cast("long")).where(~F.col("stored").eqNullSafe(F.col("actual")))


def upsert_nodes(mentions: DataFrame, order: Column) -> DataFrame:
    """(kind, norm, name, mentions): the first name; the counter starts at 0."""
    return mentions.groupBy("kind", "norm").agg(F.min_by("name", order).alias("name"), (F.count("*") - 1).alias("mentions"))


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row for each (src, rel, dst): how many, and the smallest place. Loops go."""
    return edges.where("src <> dst").groupBy("src", "rel", "dst").agg(F.count("*").alias("weight"), F.min("place").alias("place"))


def neighbours(edges: DataFrame, start: Sequence[str], hops: int = 2, per_node: int = 60) -> DataFrame:
    """(node, hop): what is reached in at most so many hops, either way, over at most ``per_node`` edges of a node (a feature's limit)."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    w = Window.partitionBy("src").orderBy("dst")
    both = both.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_node).drop("_rn")
    seen = edges.sparkSession.createDataFrame([(s, 0) for s in start], "node string, hop int")
    front = seen
    for hop in range(1, hops + 1):
        step = front.join(both, front["node"] == both["src"]).select(F.col("dst").alias("node")).distinct()
        front = step.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
    return seen


def replaced(stored: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored rows with all of the keys that ``rows`` brings taken out, and ``rows`` put in; null keys are equal."""
    return without(stored, rows, keys).unionByName(rows.select(*stored.columns))


def without(stored: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored rows whose keys aren't among those gone; null keys are equal."""
    keyed = gone.select(*keys).distinct().alias("g")
    return stored.alias("s").join(keyed, [F.col(f"s.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys], "left_anti")


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table that belongs to a parent, without the rows of the parents that go."""
    return {name: without(df, gone, [key]) for name, df in tables.items()}


def repaired(parents: DataFrame, children: DataFrame, key: str, counter: str) -> DataFrame:
    """The parents, all columns, with their counter set to their children's number."""
    actual = children.groupBy(key).agg(F.count("*").alias("_actual"))
    return parents.join(actual, key, "left").withColumn(counter, F.coalesce("_actual", F.lit(0)).cast(parents.schema[counter].dataType)).drop("_actual").select(*parents.columns)


def still_used(docs: DataFrame, gone: DataFrame, path: str, key: str) -> DataFrame:
    """The paths of documents that go which other documents still name."""
    going = docs.join(gone.select(key), key, "left_semi").select(path).distinct()
    return going.join(without(docs, gone, [key]), path, "left_semi")


def ready_totals(docs: DataFrame, chunks: DataFrame, key: str, pages: str, ready: Column) -> DataFrame:
    """One row: documents that are ready, their pages, and the chunks of all documents in scope."""
    counted = docs.agg(F.count_if(ready).alias("documents"), F.coalesce(F.sum(F.when(ready, F.col(pages))), F.lit(0)).cast("long").alias("pages"))
    return counted.crossJoin(scoped(chunks, docs, key).agg(F.count("*").alias("chunks")))  # one row each


def graph_totals(mentions: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """One row: distinct nodes mentioned, edges, mentions."""
    return mentions.agg(F.countDistinct(node).alias("nodes"), F.count("*").alias("mentions")).crossJoin(edges.agg(F.count("*").alias("edges")))


def find_nodes(nodes: DataFrame, text: str, k: int = 10) -> DataFrame:
    """The k most mentioned nodes whose norm or name holds the text, whatever its case; ties by name, then norm."""
    holds = F.lower("norm").contains(text.lower()) | F.lower("name").contains(text.lower())
    return nodes.where(holds).orderBy(F.desc("mentions"), "name", "norm").limit(k)


def ranked_in_scope(ranked: DataFrame, allowed: DataFrame, key: str, k: int) -> DataFrame:
    """The k best of a ranked list (key, score) that are in scope, in its order; ties to the smaller key."""
    return scoped(ranked, allowed, key).orderBy(F.desc("score"), key).limit(k)


def mention_documents(mentions: DataFrame) -> DataFrame:
    """(doc_id, doc_name, pages): each document mentioned, with its sorted distinct pages."""
    return mentions.groupBy("doc_id").agg(F.min("doc_name").alias("doc_name"), F.sort_array(F.collect_set("page")).alias("pages"))
