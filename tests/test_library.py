import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.functions.numbers import fiscal_quarter, fiscal_year, indian_grouping, month_of, parse_number, year_of
from lodestone.operators import entities as E
from lodestone.operators import relational as R
from lodestone.operators import search as S
from lodestone.operators import tables as T
from lodestone.operators import text as X
from lodestone.operators.evaluate import p95
from lodestone.sources import files


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


@pytest.mark.parametrize(
    ("cell", "value"),
    [("1,23,456.78", 123456.78), ("Rs. 500", 500), ("₹ 2,000", 2000), ("(1,200)", -1200), ("-45", -45), ("12%", 12), ("40 Nm", 40), ("2 lakh", 200000), ("1.5 crore", 15000000), (".5", 0.5), ("", None), ("-", None), ("—", None), ("N/A", None), ("nil", None), ("Q1", None), ("abc", None), ("12 and 13", None), (None, None)],
)
def test_parse_number(spark, cell, value):
    assert one(spark, parse_number(F.col("x")), x=cell) == (None if value is None else pytest.approx(value))


@pytest.mark.parametrize(("amount", "text"), [("0", "0"), ("999", "999"), ("1000", "1,000"), ("123456", "1,23,456"), ("-12345678", "-1,23,45,678")])
def test_indian_grouping(spark, amount, text):
    assert one(spark, indian_grouping(F.col("x").cast("long")), x=amount) == text


@pytest.mark.parametrize(("date", "year", "month"), [("2026-04-03", 2026, 4), ("03/04/2026", 2026, 4), ("3 April 2026", 2026, 4), ("Mar 2025", 2025, 3), ("nothing", None, None)])
def test_periods(spark, date, year, month):
    row = spark.createDataFrame([(date,)], "x string").select(year_of(F.col("x")), month_of(F.col("x")), fiscal_year(year_of(F.col("x")), month_of(F.col("x"))), fiscal_quarter(month_of(F.col("x")))).first()
    assert row[:2] == (year, month)
    if year:
        assert row[2] == year + (month >= 4) and row[3] == ((month - 4) % 12) // 3 + 1


def register(spark):
    rows = [("I-1", "Acme", "March", "5", "1,00,000"), ("I-2", "Acme", "March", "3", "1,35,000"), ("I-3", "Beta", "March", "10", "75,000"), ("I-4", "Acme", "April", "7", "60,000"), ("I-5", "Beta", "May", "2", "40,000"), ("TOTAL", "", "", "27", "4,10,000")]
    return spark.createDataFrame(rows, "Invoice string, Vendor string, Month string, Qty string, Amount string")


@pytest.mark.parametrize(
    ("question", "filters", "value"),
    [("total amount", [], 410000), ("average amount", [], 82000), ("difference in amount", [], 95000), ("total amount in March", [], 310000), ("sum of amount in Q1", [], 310000), ("total amount above 50,000", [], 370000), ("how many with qty between 5 and 10", [], 3), ("total amount", [T.Filter("Vendor", "equals", "acme")], 295000), ("total amount in March", [T.Filter("Vendor", "contains", "acm")], 235000), ("highest amount", [], 135000), ("lowest qty", [], 2)],
)
def test_table_questions(spark, question, filters, value):
    df = register(spark)
    assert T.numeric_columns(df) == ["Qty", "Amount"]
    plan = T.plan_question(question, df.columns, ["Qty", "Amount"])
    if "amount" in question:
        assert plan.column == "Amount"
    plan.filters += filters
    assert T.execute(df, plan, "Invoice").first()["value"] == value


@pytest.mark.parametrize(
    ("question", "value"),
    [("total amount for Acme", 295000), ("What is the total amount for Acme in March?", 235000), ("amount of I-3 in total", 75000), ("total amount from Gamma", None), ("highest total", 135000), ("how many with qty more than 4 and amount less than 80,000", 2), ("total amount at least 1.35 lakh", 135000), ("total amount that may be due", 410000), ("total amount in May", 40000), ("how many rows over 50,000", 4), ("how many in March have qty between 10 and 5", 2), ("who wrote this", None)],
)
def test_questions_read_as_a_whole(spark, question, value):
    found = T.ask_table(register(spark), question, "Invoice")
    assert (found and found.first()["value"]) == value


def test_plans_of_questions():
    plan = lambda q, numeric=("Qty", "Amount"): T.plan_question(q, ["Vendor", "Month", *numeric], list(numeric))
    assert [plan(q).operation for q in ("average total amount", "highest total amount", "maximum amount sum", "how much amount was the mean of it", "the difference in total amount")] == ["avg", "max", "max", "avg", "diff"]
    assert plan("average unit price", ("Unit", "Price")) is None and plan("highest", ("Qty", "Amount")) is None
    years = [plan(f"total amount in FY{y}").filters[0].value for y in ("97", "1997", "26", "2026", "69", "70")]
    assert years == [1997, 1997, 2026, 2026, 2069, 1970]
    assert T.plan_question("total amount in 2020", ["Amount"], ["Amount"]) is None


def test_spacing_and_percentiles(spark):
    rows = spark.createDataFrame([(g, i) for g, n in (("a", 7), ("b", 1), ("c", 20)) for i in range(n)], "g string, i long")
    for n in (2, 3, 5):
        got = {(r["g"], r["i"]) for r in X.evenly_spaced(rows, "g", "i", n).collect()}
        assert got == {(g, j * size // n) for g, size in (("a", 7), ("b", 1), ("c", 20)) for j in range(n)}
    assert {tuple(r) for r in p95(rows, "g", "i").collect()} == {("a", 7, 5), ("b", 1, 0), ("c", 20, 18)}


def test_clean(spark):
    text = "A soft\u00adhyphen and a bro-\nken word\nwrapped here.\nNext:\nlist  item\r\n\r\n\r\n\r\nend"
    assert one(spark, X.clean(F.col("x")), x=text) == "A softhyphen and a broken word wrapped here.\nNext:\nlist item\n\nend"


def test_question_without_operation(spark):
    assert T.plan_question("who wrote this", ["Amount"], ["Amount"]) is None


def test_pages_and_grids():
    assert files.paginate("a" * 2000 + "\n\n" + "b" * 2000, 3000) == ["a" * 2000, "b" * 2000]
    assert files.clean_grid([["", "a", ""], ["", "", ""], ["", "1"]]) == [["a"], ["1"]]
    assert files.headers(["A", "", "a"]) == ["A", "col2", "a_2"]
    assert files.delimiter("a;b\n1;2\n") == ";"


def test_file_sources(spark, tmp_path):
    (tmp_path / "n.txt").write_text("first page\n\nstill first")
    (tmp_path / "t.csv").write_text("A;B\n1;2\n;\n3;4\n")
    (tmp_path / "skip.bin").write_bytes(b"x")
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>Hello</w:t></w:p><w:p/></w:document>')
    (tmp_path / "d.docx").write_bytes(body.getvalue())
    found = files.folder(spark, str(tmp_path))
    assert {r["family"] for r in found.collect()} == {"text", "sheet", "docx"}
    assert sorted(r["text"] for r in files.pages(found).collect()) == ["Hello", "first page\n\nstill first"]
    assert sorted((r["row"], r["column"], r["text"]) for r in files.cells(found).collect()) == [(1, "A", "1"), (1, "B", "2"), (2, "A", "3"), (2, "B", "4")]


def test_chunks_cover_words(spark):
    text = " ".join(f"word{i}." for i in range(300))
    rows = X.chunk(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), 50, 10).collect()
    assert all(r["n_words"] <= 50 for r in rows) and {w for r in rows for w in r["text"].split()} == set(text.split())


def test_near_hashes_against_all_pairs(spark):
    import random

    random.seed(3)
    base = [random.getrandbits(64) for _ in range(30)]
    values = base + [b ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for b in base]
    df = spark.createDataFrame([(i, f"{v:016x}") for i, v in enumerate(values)], "doc_id long, phash string")
    want = {(i, j, (values[i] ^ values[j]).bit_count()) for i in range(60) for j in range(i + 1, 60) if (values[i] ^ values[j]).bit_count() <= 3}
    assert {tuple(r) for r in X.near_hashes(df, 3).collect()} == want


def test_relational(spark):
    known = spark.createDataFrame([("a", None), ("b", 1)], "sha string, project long")
    arrivals = spark.createDataFrame([("a", None), ("c", 1), ("c", 1)], "sha string, project long")
    assert [r["sha"] for r in R.new_rows(arrivals, known, ["sha", "project"]).collect()] == ["c"]
    edges = spark.createDataFrame([("x", "r", "y", 2), ("x", "r", "y", 1), ("x", "r", "x", 1)], "src string, rel string, dst string, place long")
    assert [tuple(r) for r in R.merge_edges(edges).collect()] == [("x", "r", "y", 2, 1)]


def test_bm25_plan_stays_in_the_jvm(spark):
    df = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, "cat"), (4, "cow"), (5, "owl")], "doc_id long, text string")
    found = S.bm25(df, ["red"])
    assert [r["doc_id"] for r in found.collect()] == [2, 1]
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_entities(spark):
    text = "Invoice INV-12 dated 3 April 2026 for INR 1,200 by a.b@c.org within 60 days"
    rows = E.entity_rows(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert {(r["kind"], r["value"]) for r in rows} == {("code", "INV-12"), ("date", "3 April 2026"), ("money", "INR 1,200"), ("email", "a.b@c.org"), ("duration", "60 days")}


def test_relations_of_several_subjects(spark):
    text = "Invoice No. INV-12 dated 3 April 2026 for Rs. 500 and INV-13 of 2026-05-01.\nPaid INR 1,200 for INV-14 to a.b@c.org. INV-15 was late! USD 7 is open"
    rows = E.relations(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), "doc_id", "code", {"date": "dated", "money": "has_amount"}).collect()
    first = {(c, r, x, 1) for c in ("inv-12", "inv-13") for r, x in (("dated", "3april2026"), ("dated", "2026-05-01"), ("has_amount", "rs.500"))}
    second = {("inv-14", "has_amount", "inr1200", 1), ("inv-14", "co_occurs_with", "a.b@c.org", 1), ("a.b@c.org", "co_occurs_with", "inr1200", 1), ("inv-12", "co_occurs_with", "inv-13", 1)}
    assert {tuple(r) for r in rows} == first | second and len(rows) == len(first | second)


def test_relations_look_for_entities_once(spark):
    rows = E.relations(spark.createDataFrame([(1, "INV-12 of 2026-05-01")], "doc_id long, text string"), "doc_id", "code", {"date": "dated"})
    assert rows._jdf.queryExecution().optimizedPlan().toString().count(E.PATTERNS["email"]) == 1
    assert [tuple(r) for r in rows.collect()] == [("inv-12", "dated", "2026-05-01", 1)]


def test_sentences(spark):
    texts = ["Mr. A. B. Roy paid Rs. 5. Then? No!! e.g. this.\n\nInv. 7.\u00a0So\0. it is", "", ". ! a", "J.R. no. x.  Etc. Done...  ok", None, "x" * 50 + ".\n\n.\n"]
    rule = rf"(?<![.!?])(?<!(?<![A-Za-z])(?<![A-Za-z]\.)(?i:{E.ABBREVIATIONS}|[a-z]))[.!?]+[\s\u00a0]+|\n+"
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(E.sentences(F.col("t")), F.split("t", rule, -1)).collect()]
    assert all(a == b for a, b in got) and len(got[0][0]) > 3 and got[4] == (None, None)


def test_stream_registration(spark, tmp_path):
    from lodestone.streaming.events import register as run
    from lodestone.streaming.events import stream

    schema = "sha256 string, arrived timestamp"
    spark.sql("SELECT 'a' AS sha256, timestamp'2026-01-01' AS arrived UNION ALL SELECT 'a', timestamp'2026-01-02' UNION ALL SELECT 'b', timestamp'2026-01-02'").write.parquet(str(tmp_path / "in"))
    run(stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["sha256"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
