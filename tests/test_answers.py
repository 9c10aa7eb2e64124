"""Routes and citations on small rows."""

from pyspark.sql import functions as F

from lodestone.operators.answers import attach_citations, check_citations, expand_ranges, primary, routes
from lodestone.operators.entities import PATTERNS, cut


def test_routes(spark):
    rows = [("What changed between the two drafts?", False), ("total amount in March", False), ("show the photo", False), ("a calm walk", True), (None, None), ("who is linked to INV-12", False)]
    df = spark.createDataFrame(rows, "q string, i boolean").select("q", routes(F.col("q"), F.col("i")).alias("r"))
    got = [(r[0], r[1]) for r in df.select("r", primary(F.col("r"))).collect()]
    assert got == [(["compare", "semantic"], "compare"), (["table", "semantic"], "table"), (["image"], "image"), (["image", "multimodal"], "image"), (["semantic"], "semantic"), (["entity", "keyword", "semantic"], "entity")]


def test_citation_ranges_and_checks(spark):
    texts = ["So it is [1-3].", "No [5-2] and [1-30], yes [2].", "plain", "", None, "Pay [1, 9] now [99999999999999999999] ."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(expand_ranges(F.col("t"))).collect()][:5] == ["So it is [1][2][3].", "No [5] and [1], yes [2].", "plain", "", None]
    last = df.select(check_citations(F.col("t"), F.lit(3)).alias("c")).select("c.*").collect()[5]
    assert (last["text"], last["valid"], last["invalid"]) == ("Pay [1] now.", [1], [9, None])


def test_attach_citations(spark):
    sources = ["The pump needs a torque of forty newton metres.", None, "INV-12 asks for INR 5,000 within 60 days."]
    rows = [("The pump needs forty newton metres torque. INV-12 asks for INR 5,000. INV-99 asks for USD 7. Thanks. Known [2].", sources), ("Any text.", []), (None, None)]
    out = [r[0] for r in spark.createDataFrame(rows, "a string, s array<string>").select(attach_citations(F.col("a"), F.col("s"))).collect()]
    assert out[0]["text"] == "The pump needs forty newton metres torque. [1] INV-12 asks for INR 5,000. [3] Thanks. Known [2]."
    assert out[0]["dropped"] == ["INV-99 asks for USD 7."]
    assert out[1]["text"] == "Any text." and out[2]["text"] == "" and out[2]["dropped"] == []


def test_attach_citations_reads_each_text_once(spark):
    rows = spark.createDataFrame([("It costs INR 5.", ["INR 5"])], "a string, s array<string>").select(attach_citations(F.col("a"), F.col("s")).alias("c"))
    for used in (rows, rows.select("c.text"), rows.select("c.dropped")):
        plan = used._jdf.queryExecution().optimizedPlan().expressions().toString()
        assert plan.count(PATTERNS["email"]) == 1
        assert plan.count(r"[\p{L}\p{N}_]+") == 2  # of a source, and of a sentence


def test_cut_is_split(spark):
    texts = ["a. b", "", None, ". a.  b! ", "a\0. b. c", "a.\n\nb?\0"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in (r"(?<=[.!?])\s+", r"[.!?]\s+|\n+"):
        got = [tuple(r) for r in df.select(cut(F.col("t"), pattern), F.split("t", pattern, -1)).collect()]
        assert all(a == b for a, b in got) and got[0][0] and got[2] == (None, None)
