"""Line dedup by winnowing, in DataFrame functions only.

A text's lines are its lines and, within them, its sentences: it is cut after line feeds and after a full stop,
exclamation or question mark with a space. A sentence of over LONG bytes is cut after commas, semicolons and
colons too, and what is still longer after words that end in e, so a passage of over 50 words holds whole lines wherever
it stands. Blank lines don't count. Hashes of pairs of neighbouring lines are winnowed:
of any two neighbouring pairs the smaller hash is selected, so any three lines in a row hold a selected fingerprint.
Fingerprints that occur more than once are joined to their places; around each, the three lines to the left and to the
right are looked up by their own hash, so a match grows both ways as long as three lines in a row occurred before.
Repeated runs that overlap or touch make one run, and runs of enough words are deleted. The first occurrence, by
document id and place, stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import BROADCAST_ROWS, Workspace, checked_broadcast

#: Lines in a row whose repetition counts: two neighbouring pairs.
RUN = 3


#: Bytes beyond which a sentence, or a part of one, is cut further.
LONG = 120
#: What ends a piece of a text, of a long sentence and of a part that is long still.
ENDS, LONG_ENDS, LAST_ENDS = ("\n", ". ", "! ", "? "), (", ", "; ", ": "), ("e ",)
_MARK = "\x01"


def _bind(value: Column, use) -> Column:
    """use(value), with the value worked out once for all its uses."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _cut(text: Column, ends: tuple[str, ...]) -> Column:
    """The text cut after each of ``ends``: by plain replacements and a split at one character, unless that is in the text."""
    marked = text
    for x in ends:
        marked = F.replace(marked, F.lit(x), F.lit(x + _MARK))
    regex = "|".join(f"(?<={x})" for x in ends).replace(". ", "[.] ").replace("? ", "[?] ")
    return F.when(F.contains(text, F.lit(_MARK)), F.split(text, regex, -1)).otherwise(F.split(marked, _MARK, -1))


def lines(text: Column) -> Column:
    """The pieces of a text; joined they are the text."""

    def finer(pieces: Column, ends: tuple[str, ...]) -> Column:
        long = lambda x: F.octet_length(x) > LONG
        return F.when(F.exists(pieces, long), F.flatten(F.transform(pieces, lambda x: F.when(long(x), _cut(x, ends)).otherwise(F.array(x))))).otherwise(pieces)

    return _bind(_cut(text, ENDS), lambda x: _bind(finer(x, LONG_ENDS), lambda y: finer(y, LAST_ENDS)))


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\n"))


def _hashes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and the hashes of its lines that aren't blank."""
    text = F.col(text_col)
    # without tabs and carriage returns, plain replacements do what trimming of four characters does
    bare = F.when(F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r")), F.transform(lines(text), _bare)).otherwise(F.transform(lines(text), lambda x: F.trim(F.replace(x, F.lit("\n"), F.lit("")))))
    full = F.filter(bare, lambda x: x != "")
    return df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.transform(full, lambda x: F.xxhash64(x)).alias("h"))


#: A key of more rows than this is hot: its row of the other side is broadcast.
HOT = 20_000


def _split_join(rows: DataFrame, counted: DataFrame, key: str, work: Workspace) -> DataFrame:
    """``rows`` joined to ``counted`` (written; a row for each key, ``n`` how often it is in ``rows``), hot keys apart.

    There are at most rows / HOT hot keys; where even these are too many to broadcast, Spark shuffles them too.
    """
    hot = counted.where(F.col("n") > HOT)
    if hot.isEmpty():
        return rows.join(counted, key)
    hot = checked_broadcast(hot)
    usual = rows.join(hot.select(key), key, "left_anti").join(counted.where(F.col("n") <= HOT), key)
    return usual.unionByName(rows.join(hot, key))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``runs``: the repeated runs of a document as (first, last), numbers of its lines that aren't blank, from 0."""
    work = Workspace(docs.sparkSession, "lines")
    # no filter stands on the arrays: it would be moved below them and work them out a second time
    hashed = _hashes(docs, id_col, text_col)
    hashed = hashed.select("doc_id", "h", F.transform(F.when(F.size("h") >= RUN, F.sequence(F.lit(0), F.size("h") - 2)), lambda i: F.xxhash64(F.get("h", i), F.get("h", i + 1))).alias("p"))

    def mark(pair: Column, i: Column) -> Column:
        """A pair that is the smaller one of a run of three lines, of equal ones the left, with the runs that have it so; else null."""
        run = lambda chosen, at: F.when(chosen, F.xxhash64(F.get("h", at), F.get("h", at + 1), F.get("h", at + 2)))
        left, right = F.coalesce(pair < F.get("p", i - 1), F.lit(False)), F.coalesce(pair <= F.get("p", i + 1), F.lit(False))
        return F.when(left | right, F.struct(pair.alias("pair"), i.alias("at"), run(left, i - 1).alias("run_left"), run(right, i).alias("run_right")))

    marks = hashed.select("doc_id", F.explode_outer(F.filter(F.transform("p", mark), lambda x: x.isNotNull())).alias("x")).where(F.col("x").isNotNull()).select("x.pair", "doc_id", "x.at", "x.run_left", "x.run_right")
    marks = work.write(marks, "marks")
    again = marks.groupBy("pair").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    joined = _split_join(marks, work.write(again, "again"), "pair", work)
    runs = joined.select("doc_id", F.explode(F.array(F.struct((F.col("at") - 1).alias("start"), F.col("run_left").alias("run")), F.struct(F.col("at").alias("start"), F.col("run_right").alias("run")))).alias("x")).select("doc_id", "x.start", "x.run").where(F.col("run").isNotNull())
    runs = work.write(runs, "runs")
    for name in ("marks", "again"):
        work.drop(name)
    first = runs.groupBy("run").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where(F.col("n") > 1)
    later = _split_join(runs, work.write(first, "first"), "run", work).where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") >= F.col("first.start") + RUN)).select("doc_id", "start").distinct()
    by = Window.partitionBy("doc_id").orderBy("start")
    begins = F.when(F.col("start") <= F.lag("start").over(by) + RUN, 0).otherwise(1)
    islands = later.withColumn("begins", begins).withColumn("island", F.sum("begins").over(by)).groupBy("doc_id", "island").agg(F.min("start").alias("first"), (F.max("start") + RUN - 1).alias("last"))
    return islands.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def _outside(x: Column) -> Column:
    """Of ``pieces`` whose ``solid`` ones (not blank, by place) have ``runs``: how many solid ones are in runs, and the text outside."""
    n, k = F.size(x["pieces"]), F.size(x["solid"])
    begin = lambda i: F.coalesce(F.get(x["solid"], i), n)
    starts = F.concat(F.array(F.lit(0)), F.transform(x["runs"], lambda run: begin(run["last"] + 1)))
    ends = F.concat(F.transform(x["runs"], lambda run: begin(run["first"])), F.array(n))
    text = F.array_join(F.zip_with(starts, ends, lambda a, b: F.array_join(F.slice(x["pieces"], a + 1, b - a), "")), "")
    gone = F.aggregate(x["runs"], F.lit(0), lambda total, run: total + F.greatest(F.lit(0), F.least(run["last"], k - 1) - run["first"] + 1))
    return F.struct(gone.alias("gone"), text.alias("text"))


def dedup_lines(docs: DataFrame, min_words: int = 25, drop_emptied: bool = True, count_as: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, without the later repeats of runs of lines; ``text`` is what is left.

    A run is deleted if it has at least RUN lines and ``min_words`` words (words are counted by spaces). A document of
    which only blank lines are left is dropped, unless ``drop_emptied`` is off; one that was empty before stays. Null texts
    and rows of null ids stay as they are. Rows that repeat an id share the places of their runs: a run found in one
    is deleted from each. An empty table gives no rows. ``count_as`` names a column to add: how many lines went.
    Columns of any other names pass through.
    """
    mark = uuid.uuid4().hex
    key, found, left = (f"{x}_{mark}" for x in ("id", "runs", "left"))
    work = Workspace(docs.sparkSession, "cut")
    runs = work.write(repeated_runs(docs, id_col, text_col).select(F.col("doc_id").alias(key), F.col("runs").alias(found)), "runs")
    bare_words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1
    n_words = lambda x, run: F.aggregate(F.slice(x["solid"], run["first"] + 1, run["last"] - run["first"] + 1), F.lit(0), lambda n, i: n + bare_words(_bare(F.get(x["pieces"], i))))

    def cut(pieces: Column) -> Column:
        """How many lines go and the text left: what stands outside of the runs, each piece met once."""
        solid = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: F.ltrim(F.get(pieces, i), F.lit(" \t\r\n")) != "")
        with_runs = lambda x: F.struct(x["pieces"].alias("pieces"), x["solid"].alias("solid"), F.filter(found, lambda run: n_words(x, run) >= min_words).alias("runs"))
        return _bind(F.struct(pieces.alias("pieces"), solid.alias("solid")), lambda x: _bind(with_runs(x), _outside))

    def without(rows: DataFrame) -> DataFrame:
        # the generator keeps the optimizer from working the cut out once for each use
        result = F.when(F.size(found) > 0, _bind(lines(F.col(text_col)), cut))
        rows = rows.withColumn(left, F.explode(F.array(result)))
        count = F.coalesce(F.col(f"{left}.gone"), F.lit(0)).cast("long")
        rows = rows.withColumn(text_col, F.coalesce(F.col(f"{left}.text"), F.col(text_col)))
        if drop_emptied:
            rows = rows.where((count == 0) | ~F.col(text_col).rlike(r"\A\s*\z"))
        return (rows.withColumn(count_as, count) if count_as else rows).drop(key, found, left)

    ids = runs.select(key)
    if ids.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return without(docs.join(runs, docs[id_col] == runs[key], "left"))
    # only documents that have runs are moved to them
    ids = F.broadcast(ids)
    plain = docs.join(ids, docs[id_col] == ids[key], "left_anti")
    repeating = docs.join(ids, docs[id_col] == ids[key], "left_semi")
    repeating = repeating.join(runs.hint("merge"), repeating[id_col] == runs[key])
    return (plain.withColumn(count_as, F.lit(0).cast("long")) if count_as else plain).unionByName(without(repeating))
