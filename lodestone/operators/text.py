"""Text preparation: cleaning, pages, chunks, running headers, page types and near-duplicate keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def clean(text: Column) -> Column:
    """Drops soft hyphens, joins words broken and sentences wrapped at a line's end, makes runs of spaces one and of blank
    lines two, trims. A line that ends in a full stop, exclamation or question mark or colon isn't joined to the next."""
    text = F.replace(F.regexp_replace(text, r"\r\n?", "\n"), F.lit("\u00ad"), F.lit(""))
    text = F.regexp_replace(text, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r"([^.!?:\n])\n(?!\n)", "$1 ")
    return F.btrim(F.regexp_replace(text, r"\n{3,}", "\n\n"), F.lit(" \n"))


def text_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, line): the lines that aren't blank."""
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n"))).select(id_col, F.col("pos").cast("long").alias("pos"), F.btrim("col").alias("line")).where("line <> ''")


def running_headers(docs: DataFrame, group: str, share: float = 0.02, most: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(group, line, n_docs): short first or last lines that recur in a share of a group's documents, numbers ignored."""
    edge = docs.select(group, id_col, F.split(F.btrim(F.col(text_col), F.lit("\n")), "\n").alias("x"))
    edge = edge.select(group, id_col, F.explode(F.array_distinct(F.array(F.get("x", F.lit(0)), F.element_at("x", -1)))).alias("line"))
    edge = edge.where(F.length("line").between(1, most)).withColumn("line", F.regexp_replace("line", "[0-9]+", "#"))
    found = edge.select(group, id_col, "line").distinct().groupBy(group, "line").agg(F.count("*").alias("n_docs"))
    size = docs.groupBy(group).agg(F.count("*").alias("n"))
    return found.join(F.broadcast(size), group).where((F.col("n_docs") >= 2) & (F.col("n_docs") >= share * F.col("n"))).select(group, "line", "n_docs")


def page_type(n_chars: Column, has_table: Column, has_image: Column) -> Column:
    return F.when(has_table, "table").when(has_image & (n_chars < 200), "image").when(n_chars < 30, "blank").when(n_chars < 200, "sparse").otherwise("text")


def paginate(text: str, limit: int = 3000) -> list[str]:
    """Pages of whole paragraphs; a page that holds something takes no paragraph that would bring it over the limit."""
    pages, page = [], ""
    for paragraph in text.split("\n\n"):
        if page and len(page) + len(paragraph) > limit:
            pages.append(page.strip())
            page = ""
        page += paragraph + "\n\n"
    return [*pages, page.strip()] if page.strip() else pages


def chunk(docs: DataFrame, size: int = 120, overlap: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ord, n_words, text): windows of whole sentences of at most ``size`` words that share up to ``overlap`` words.

    A sentence over the size is cut into windows of words.
    """
    import re

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf[id_col], pdf[text_col], strict=True):
                parts = [s.split() for s in re.split(r"(?<=[.!?])\s+", text or "")]
                parts = [p[i : i + size] for p in parts for i in range(0, len(p), size)]
                now: list[str] = []
                k = 0
                for p in parts:
                    if now and len(now) + len(p) > size:
                        rows.append((key, k, len(now), " ".join(now)))
                        k += 1
                        now = now[-overlap:] if overlap and len(p) + overlap <= size else []
                    now = now + p
                if now:
                    rows.append((key, k, len(now), " ".join(now)))
            yield pd.DataFrame(rows, columns=[id_col, "ord", "n_words", "text"])

    return docs.select(id_col, text_col).mapInPandas(pack, f"{id_col} long, ord long, n_words long, text string")


def same_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sha, first_id, copies): texts that occur more than once."""
    return docs.groupBy(F.sha2(text_col, 256).alias("sha")).agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies")).where("copies > 1")


def bit_distance(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hashes, half by half."""
    half = lambda c, at: F.conv(F.substring(c, at, 8), 16, 10).cast("long")
    return (F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))).cast("long")


def near_hashes(hashes: DataFrame, distance: int, id_col: str = "doc_id", hash_col: str = "phash") -> DataFrame:
    """(a, b, bits): pairs of 16-digit hashes at most ``distance`` bits apart.

    By the pigeonhole principle such a pair agrees in one of ``distance + 1`` bands, so bands are joined and then checked.
    """
    bands = distance + 1
    width = 64 // bands
    half = lambda at: F.lpad(F.conv(F.substring(hash_col, at, 8), 16, 2), 32, "0")
    bits = F.concat(half(1), half(9))
    cut = F.array(*[F.concat(F.lit(f"{i}:"), F.substring(bits, 1 + i * width, width if i + 1 < bands else 64 - i * width)) for i in range(bands)])
    rows = hashes.select(id_col, hash_col, F.explode(cut).alias("band"))
    left = rows.select(F.col(id_col).alias("a"), F.col(hash_col).alias("ha"), "band")
    right = rows.select(F.col(id_col).alias("b"), F.col(hash_col).alias("hb"), "band")
    pairs = left.join(right, "band").where("a < b").select("a", "b", bit_distance(F.col("ha"), F.col("hb")).alias("bits"))
    return pairs.where(F.col("bits") <= distance).distinct()


def evenly_spaced(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """n rows of each group at even distances in an order: places floor(j * rows / n) for j from 0; all, if fewer."""
    w = Window.partitionBy(by)
    placed = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    # the first j whose place isn't before this row must have this place
    return placed.where(F.expr(f"((_i * {n} + _n - 1) div _n) * _n div {n} = _i AND (_i * {n} + _n - 1) div _n < {n}")).drop("_i", "_n")
