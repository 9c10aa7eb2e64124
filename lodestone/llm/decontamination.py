"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is a window of words under a fixed mask that ignores some positions, so a substituted word under an ignored
position leaves its hash unchanged. Hashes of the benchmark's windows are joined to those of every document's windows;
around each hit the aligned words are compared, and an item counts as found where enough of them agree. The masks follow
from how many words may differ: whichever they are, one mask at least lies on words that agree, so nothing is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import BROADCAST_ROWS, Workspace, checked_broadcast


def masks(n: int, agree: float) -> list[str]:
    """Masks, a 1 is a word that counts, of which one fits into any ``n`` aligned words of which a share of ``agree`` agrees.

    Where k words may differ, two of k + 2 blocks of the same length agree, in one of k + 1 distances; or one of k + 1
    longer blocks, where that holds as many words.
    """
    differ = n - next((a for a in range(n + 1) if a >= agree * n), n + 1)
    if differ < 0:
        return []
    if differ >= n:
        raise ValueError("agree must be so large that at least one word has to agree")
    one, two = n // (differ + 1), n // (differ + 2)
    if one >= 2 * two:
        return ["1" * one]
    return ["1" * two + "0" * (two * (d - 1)) + "1" * two for d in range(1, differ + 2)]


def word_list(text: Column) -> Column:
    """Runs of letters and digits, in small letters."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def seeds(df: DataFrame, by_mask: dict[str, Column | None], *keep: str) -> DataFrame:
    """A row for each window and mask of ``words``: ``keep``, ``at`` (first word, from 0), ``seed`` and ``span``.

    ``by_mask`` tells of each mask which rows need it, None for all.
    """
    shortest = min(map(len, by_mask))
    hashed = df.where(F.size("words") >= shortest).select(*keep, "words", F.transform("words", lambda x: F.xxhash64(x)).alias("h"))
    windows = hashed.select(*keep, "words", "h", F.explode(F.sequence(F.lit(0), F.size("h") - shortest)).alias("at"))
    found = []
    for m, (mask, needed) in enumerate(by_mask.items()):
        fits = F.col("at") + len(mask) <= F.size("h")
        one = F.struct(F.xxhash64(F.lit(m), *[F.get("h", F.col("at") + i) for i, c in enumerate(mask) if c == "1"]).alias("seed"), F.lit(len(mask)).alias("span"))
        found.append(F.when(fits if needed is None else fits & needed, one))
    return windows.select(*keep, "words", "at", F.explode(F.array(*found)).alias("x")).where(F.col("x").isNotNull()).select(*keep, "words", "at", "x.seed", "x.span")


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 15, agree: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and benchmark item found in it: doc_id, item_id, n_agree, n_compared, doc_start, item_start.

    An item is found where, in some window of ``window`` aligned words (the whole item, if that is shorter), a share of at
    least ``agree`` agrees word by word; items of any length are searched. The row tells the best window: most words that
    agree, then the earliest in the document, then in the item. Null texts and those without words neither find nor are
    found. Rows of null ids take no part. Rows that repeat an id count as one document or item with several texts. An
    empty table on either side gives no rows; other columns are not read.

    The benchmark's seeds are broadcast in blocks of at most BROADCAST_ROWS rows; more blocks mean more scans.
    """
    work = Workspace(docs.sparkSession, "overlaps")
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), word_list(F.col(item_text)).alias("words")).distinct()
    items = work.write(items.where(F.size("words") >= 1).withColumn("item_words", F.col("words")).select("item_id", "words", F.xxhash64("words").alias("item_key")), "items")
    n = F.least(F.lit(window), F.size("words"))
    lengths: dict[str, list[int]] = {}  # mask: the numbers of compared words that need it
    for size in [r[0] for r in items.select(n).distinct().collect()] or [window]:
        for mask in masks(size, agree):
            lengths.setdefault(mask, []).append(size)
    if not lengths:  # nothing can agree so far
        lengths, items = {"1": [window]}, items.limit(0)
    probes = seeds(items, {mask: n.isin(*sizes) for mask, sizes in lengths.items()}, "item_id", "item_key")
    probes = probes.select("item_id", "item_key", "seed", "span", F.size("words").alias("item_size"), F.col("at").alias("item_at")).distinct()
    blocks = max(1, -(-probes.count() // (BROADCAST_ROWS // 2)))
    found = None
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), word_list(F.col(text_col)).alias("words"))
    known = checked_broadcast(items.select("item_id", "item_key", F.col("words").alias("item_words")), BROADCAST_ROWS // 10)
    for b in range(blocks):
        own = probes.where(F.pmod(F.xxhash64("seed"), F.lit(blocks)) == b) if blocks > 1 else probes
        hits = seeds(texts, dict.fromkeys(lengths), "doc_id").drop("span").join(F.broadcast(own), "seed")
        # the aligned words around the hit, cut out before anything is moved
        n = F.least(F.lit(window), F.col("item_size"))
        before = F.least(F.col("at"), F.col("item_at"), n - F.col("span"))
        hits = hits.select("doc_id", "item_id", "item_key", (F.col("at") - before).alias("doc_from"), (F.col("item_at") - before).alias("item_from"), before.alias("before"), F.slice("words", F.col("at") - before + 1, before + n).alias("near"))
        found = hits if found is None else found.unionByName(hits)
    found = found.distinct().join(known, ["item_id", "item_key"])
    n = F.least(F.lit(window), F.size("item_words"))
    scored = F.transform(
        F.sequence(F.lit(0), F.col("before")),
        lambda i: F.when(
            (F.size("near") >= i + n) & (F.size("item_words") >= F.col("item_from") + i + n),
            F.struct(
                F.size(F.filter(F.zip_with(F.slice("near", i + 1, n), F.slice("item_words", F.col("item_from") + i + 1, n), lambda a, b: a == b), lambda x: x)).alias("n_agree"),
                (-(F.col("doc_from") + i)).alias("doc_place"),
                (-(F.col("item_from") + i)).alias("item_place"),
                n.alias("n_compared"),
            ),
        ),
    )
    best = found.select("doc_id", "item_id", F.array_max(scored).alias("best")).where(F.col("best.n_agree") >= agree * F.col("best.n_compared"))
    best = best.groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
    return best.select("doc_id", "item_id", F.col("best.n_agree").cast("long").alias("n_agree"), F.col("best.n_compared").cast("long").alias("n_compared"), (-F.col("best.doc_place")).cast("long").alias("doc_start"), (-F.col("best.item_place")).cast("long").alias("item_start"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, all columns, in which no item of the benchmark is found; null ids stay."""
    key, work = options.get("id_col", "doc_id"), Workspace(docs.sparkSession, "decontaminate")
    bad = work.write(overlaps(docs, benchmark, **options).select("doc_id").distinct(), "bad")
    bad = checked_broadcast(bad)
    return docs.join(bad, docs[key] == bad["doc_id"], "left_anti")
