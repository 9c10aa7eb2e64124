"""Queries over the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.numbers import fiscal_quarter, fiscal_year, indian_grouping, month_of, parse_number, year_of
from lodestone.operators import answers as A
from lodestone.operators import entities as E
from lodestone.operators import hybrid as H
from lodestone.operators import relational as R
from lodestone.operators import search as S
from lodestone.operators import tables as T
from lodestone.operators import text as X
from lodestone.operators import verify as Y
from lodestone.operators.evaluate import p95, precision_recall
from lodestone.sources.files import table
from lodestone.streaming import events as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BM25_TERMS = ("the", "thonea", "eauouan")
TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _bm25_sql(fields: dict[str, float]) -> str:
    tok = {c: TOKENS.format(c) for c in fields}
    length = " + ".join(f"len({t})" for t in tok.values())
    w = [" + ".join(f"{w} * len(list_filter({tok[c]}, lambda x: x = '{t}'))" for c, w in fields.items()) for t in sorted(set(BM25_TERMS))]
    score = " + ".join(f"greatest(1e-6, ln((n - df{i} + 0.5) / (df{i} + 0.5))) * w{i} * 2.2 / (w{i} + 1.2 * (0.25 + 0.75 * len / avg))" for i in range(len(w)))
    return f"WITH r AS (SELECT doc_id, {length} AS len, {', '.join(f'{x} AS w{i}' for i, x in enumerate(w))} FROM documents), s AS (SELECT count(*) AS n, avg(len) AS avg, {', '.join(f'count(*) FILTER (w{i} > 0) AS df{i}' for i in range(len(w)))} FROM r) SELECT doc_id, round({score}, 6) AS score FROM r, s WHERE {' OR '.join(f'w{i} > 0' for i in range(len(w)))} ORDER BY score DESC, doc_id LIMIT 20"


@query(_bm25_sql({"text": 1.0}))
def bm25_topk(spark, d):
    return S.bm25(table(spark, d, "documents", spread=True), BM25_TERMS)


@query(_bm25_sql({"text": 1.0, "source": 0.3}))
def bm25_two_field(spark, d):
    return S.bm25(table(spark, d, "documents", spread=True), BM25_TERMS, {"text": 1.0, "source": 0.3})


def _vector(spark, d, vec_id: int = 0) -> list[float]:
    return list(table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


DENSE = "SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {})), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20"


@query(DENSE.format(0))
def dense_topk(spark, d):
    return S.dense(table(spark, d, "embeddings"), _vector(spark, d))


@query(f"WITH a AS ({DENSE.format(0)}), b AS ({DENSE.format(1)}), r AS (SELECT vec_id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, vec_id)) AS part FROM a UNION ALL SELECT vec_id, 1.2 / (60 + row_number() OVER (ORDER BY score DESC, vec_id)) FROM b) SELECT vec_id, round(sum(part), 8) AS rrf FROM r GROUP BY vec_id ORDER BY rrf DESC, vec_id LIMIT 20")
def rrf_fusion(spark, d):
    v = table(spark, d, "embeddings")
    return S.reciprocal_rank_fusion([(S.dense(v, _vector(spark, d, 0)), 1.0), (S.dense(v, _vector(spark, d, 1)), 1.2)], "vec_id")


@query(
    f"WITH t AS (SELECT doc_id, text, list_distinct({TOKENS.format('text')}) AS u, {TOKENS.format('text')} AS w FROM documents), f AS (SELECT doc_id, len(list_intersect(u, ['of', 'the', 'ea'])) / 3.0 AS share, contains(lower(text), 'of the ea')::DOUBLE AS phrase, (coalesce(list_position(w, 'of'), 0) BETWEEN 1 AND 50)::INT::DOUBLE AS early FROM t) SELECT doc_id, round(share, 6) AS share, phrase, early, round(share + 0.5 * phrase + 0.25 * early + 0.25 * (share = 1.0)::INT, 6) AS rerank FROM f ORDER BY rerank DESC, doc_id LIMIT 50"
)
def rerank_features(spark, d):
    return S.rerank(table(spark, d, "documents", spread=True).select("doc_id", "text"), ["of", "the", "ea"]).drop("text").orderBy(F.desc("rerank"), "doc_id").limit(50)


@query("SELECT o_orderkey, code FROM (SELECT o_orderkey, unnest(regexp_extract_all('Order ' || o_orderkey || ' billed as INV-' || o_orderkey || ' and PO/' || o_custkey || '.', '\\b[A-Z]{2,6}[-/][0-9]+(?:-[0-9]+)*\\b')) AS code FROM orders) WHERE code LIKE 'INV-1%'")
def exact_code_lookup(spark, d):
    text = F.concat(F.lit("Order "), "o_orderkey", F.lit(" billed as INV-"), "o_orderkey", F.lit(" and PO/"), "o_custkey", F.lit("."))
    return table(spark, d, "orders").select("o_orderkey", F.explode(S.exact_codes(text)).alias("code")).where("code LIKE 'INV-1%'")


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders SEMI JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') c ON o_custkey = c_custkey")
def scope_semi(spark, d):
    allowed = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return R.scoped(table(spark, d, "orders"), allowed, "o_custkey").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_missing(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return R.new_rows(table(spark, d, "customer").select("c_custkey"), urgent, ["c_custkey"])


@query("SELECT o_orderpriority, n, v[1 + floor(0.95::DOUBLE * (n - 1))::BIGINT] AS p95 FROM (SELECT o_orderpriority, count(*) AS n, list_sort(list(o_totalprice)) AS v FROM orders GROUP BY o_orderpriority)")
def eval_p95(spark, d):
    return p95(table(spark, d, "orders"), "o_orderpriority", "o_totalprice")


@query("SELECT 'avg' AS operation, round(avg(p_retailprice::DECIMAL(18, 2)::DOUBLE), 4) AS value, count(*) AS rows_used FROM part WHERE p_type = 'PROMO' AND p_size BETWEEN 10 AND 20 AND p_retailprice::DECIMAL(18, 2) > 950")
def table_label_and_two_comparisons(spark, d):
    parts = table(spark, d, "part").select(F.col("p_type").alias("Type"), F.col("p_size").cast("string").alias("Size"), F.col("p_retailprice").cast("decimal(18,2)").cast("string").alias("Price"))
    return T.ask_table(parts, "Average price of Promo with size between 10 and 20 and price above 950")


@query("SELECT c_custkey, coalesce(count(o_orderkey), 0) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def left_coalesce(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 45)")
def exists_semi(spark, d):
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.scoped(table(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey")


@query("SELECT n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name")
def project_rollup_counts(spark, d):
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    customers = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(per, "c_custkey", "left")
    by = customers.groupBy("n_nationkey").agg(F.count("*").alias("customers"), F.coalesce(F.sum("n"), F.lit(0)).alias("orders"))
    return table(spark, d, "nation").join(by, "n_nationkey", "left").select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("orders", F.lit(0)).alias("orders"))


@query("SELECT CASE WHEN contains(html, '<table') THEN 'table' WHEN contains(html, '<img') AND length(html) < 200 THEN 'image' WHEN length(html) < 30 THEN 'blank' WHEN length(html) < 200 THEN 'sparse' ELSE 'text' END AS kind, count(*) AS n FROM pages GROUP BY kind")
def content_type_counts(spark, d):
    kind = X.page_type(F.length("html"), F.col("html").contains("<table"), F.col("html").contains("<img"))
    return table(spark, d, "pages").select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey % 8 AS stored, coalesce(n, 0) AS actual FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey WHERE o_custkey % 8 <> coalesce(n, 0)")
def repair_counts_diff(spark, d):
    parents = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 8).alias("c"))
    return R.wrong_counts(parents, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "c")


@query("SELECT l_orderkey, l_linenumber, l_quantity AS plain, -l_quantity AS minus, l_quantity AS percent, l_quantity * 100000 AS lakhs, CAST(floor(l_extendedprice * 100) AS DOUBLE) AS grouped FROM lineitem")
def parse_number_roundtrip(spark, d):
    q = F.col("l_quantity").cast("int").cast("string")
    money = F.concat(F.lit("Rs. "), indian_grouping(F.floor(F.col("l_extendedprice") * 100)))
    return table(spark, d, "lineitem", spread=True).select("l_orderkey", "l_linenumber", parse_number(q).alias("plain"), parse_number(F.concat(F.lit("("), q, F.lit(")"))).alias("minus"), parse_number(F.concat(q, F.lit("%"))).alias("percent"), parse_number(F.concat(q, F.lit(" lakh"))).alias("lakhs"), parse_number(money).alias("grouped"))


@query("SELECT o_orderkey, year(o_orderdate)::INT AS y1, month(o_orderdate)::INT AS m1, month(o_orderdate)::INT AS m2, month(o_orderdate)::INT AS m3 FROM orders")
def year_month_extract(spark, d):
    iso, long, slash = (F.date_format("o_orderdate", f) for f in ("yyyy-MM-dd", "d MMMM yyyy", "dd/MM/yyyy"))
    return table(spark, d, "orders").select("o_orderkey", year_of(iso).alias("y1"), month_of(iso).alias("m1"), month_of(long).alias("m2"), month_of(slash).alias("m3"))


@query("SELECT fy, fq, round(sum(o_totalprice::DECIMAL(18, 2)), 2)::DOUBLE AS total, count(*) AS n FROM (SELECT (year(o_orderdate) + CASE WHEN month(o_orderdate) >= 4 THEN 1 ELSE 0 END)::INT AS fy, (((month(o_orderdate) + 8) % 12) // 3 + 1)::INT AS fq, o_totalprice FROM orders) GROUP BY fy, fq")
def fiscal_year_sum(spark, d):
    text = F.date_format("o_orderdate", "d MMM yyyy")
    fy, fq = fiscal_year(year_of(text), month_of(text)), fiscal_quarter(month_of(text))
    rows = table(spark, d, "orders").select(fy.alias("fy"), fq.alias("fq"), F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    return rows.groupBy("fy", "fq").agg(F.sum("p").cast("double").alias("total"), F.count("*").alias("n"))


@query("SELECT quarter(o_orderdate)::INT AS q, round(sum(o_totalprice::DECIMAL(18, 2)), 2)::DOUBLE AS total FROM orders GROUP BY q")
def quarter_sum(spark, d):
    rows = table(spark, d, "orders").select(F.ceil(month_of(F.date_format("o_orderdate", "d MMMM yyyy")) / 3).cast("int").alias("q"), F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    return rows.groupBy("q").agg(F.sum("p").cast("double").alias("total"))


@query("SELECT unnest(['size_text', 'price']) AS column_name")
def numeric_col_inference(spark, d):
    cells = table(spark, d, "part").select("p_name", "p_brand", F.concat("p_size", F.lit(" cm")).alias("size_text"), F.when(F.col("p_partkey") % 7 == 0, "-").otherwise(F.concat(F.lit("₹"), F.format_number("p_retailprice", 2))).alias("price"))
    return spark.createDataFrame([(c,) for c in T.numeric_columns(cells)], "column_name string")


def _orders_as_text(spark, d):
    return table(spark, d, "orders", spread=True).select("o_orderkey", F.date_format("o_orderdate", "d MMMM yyyy").alias("Order Date"), F.col("o_orderpriority").alias("Priority"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("Amount"))


def _ask(spark, d, question: str) -> DataFrame:
    rows = _orders_as_text(spark, d)
    return T.execute(rows, T.plan_question(question, rows.columns, ["Amount"]))


def _table_query(name: str, question: str, aggregate: str, where: str) -> None:
    def run(spark, d):
        return _ask(spark, d, question)

    run.__name__ = name
    query(f"SELECT '{name.removeprefix('table_').split('_')[0]}' AS operation, round(({aggregate})::DOUBLE, 4) AS value, count(*) AS rows_used FROM (SELECT o_totalprice::DECIMAL(18, 2)::DOUBLE AS amount, o_orderdate FROM orders) WHERE {where}")(run)


_table_query("table_sum", "What is the total amount in March 1996?", "sum(amount)", "month(o_orderdate) = 3 AND year(o_orderdate) = 1996")
_table_query("table_avg", "Average amount above 100,000", "avg(amount)", "amount > 100000")
_table_query("table_max", "Highest amount in 1997", "max(amount)", "year(o_orderdate) = 1997")
_table_query("table_min", "Lowest amount in Q1", "min(amount)", "quarter(o_orderdate) = 1")
_table_query("table_diff", "Difference in amount for FY97", "max(amount) - min(amount)", "o_orderdate >= DATE '1996-04-01' AND o_orderdate < DATE '1997-04-01'")
_table_query("table_count_between", "How many have an amount between 50,000 and 100,000?", "count(*)", "amount BETWEEN 50000 AND 100000")
_table_query("table_sum_q1_fy", "Sum of amount in Q1 FY1997", "sum(amount)", "o_orderdate >= DATE '1996-04-01' AND o_orderdate < DATE '1996-07-01'")


@query("SELECT 'sum' AS operation, round(sum(l_quantity), 4) AS value, count(*) AS rows_used FROM lineitem")
def table_total_row_excluded(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("label"), F.col("l_quantity").cast("string").alias("Qty"))
    total = rows.agg(F.lit("TOTAL").alias("label"), F.sum(F.col("Qty").cast("double")).cast("string").alias("Qty"))
    return T.execute(rows.unionByName(total), T.TableQuery("sum", "Qty"), "label")


@query("SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1")
def argmax_evidence_row(spark, d):
    return T.evidence_row(table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"), "p_retailprice", "p_partkey")


@query("SELECT l_returnflag AS part, sum(l_quantity) AS amount, round(sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem), 6) AS share FROM lineitem GROUP BY l_returnflag")
def donut_parts_whole(spark, d):
    parts = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("part")).agg(F.sum("l_quantity").alias("amount"))
    whole = parts.agg(F.sum("amount").alias("whole"))
    return parts.crossJoin(F.broadcast(whole)).select("part", "amount", F.round(F.col("amount") / F.col("whole"), 6).alias("share"))


@query("SELECT p_brand, count(DISTINCT p_type) AS kinds, round(avg(p_retailprice), 4) AS average FROM part GROUP BY p_brand HAVING count(*) >= 3")
def comparable_series(spark, d):
    out = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.countDistinct("p_type").alias("kinds"), F.round(F.avg("p_retailprice"), 4).alias("average"))
    return out.where("n >= 3").drop("n")


@query("SELECT l_orderkey, l_returnflag, count(DISTINCT l_linestatus) AS n_values, min(l_linestatus) AS low, max(l_linestatus) AS high FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_linestatus) > 1")
def fact_merge_conflicts(spark, d):
    return E.conflicts(table(spark, d, "lineitem"), ["l_orderkey", "l_returnflag"], "l_linestatus")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 40")
def timeline_events(spark, d):
    return table(spark, d, "orders").orderBy("o_orderdate", "o_orderkey").limit(40).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderstatus")


@query("WITH x AS (SELECT source, doc_id, unnest(list_distinct([string_split(trim(text, chr(10)), chr(10))[1], string_split(trim(text, chr(10)), chr(10))[-1]])) AS line FROM documents), y AS (SELECT DISTINCT source, doc_id, regexp_replace(line, '[0-9]+', '#', 'g') AS line FROM x WHERE length(line) BETWEEN 1 AND 80), s AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT source, line, count(*) AS n_docs FROM y JOIN s USING (source) GROUP BY source, line, n HAVING count(*) >= 2 AND count(*) >= 0.02 * n")
def running_header_detect(spark, d):
    return X.running_headers(table(spark, d, "documents", spread=True), "source")


@query("SELECT doc_id, md5(trim(regexp_replace(replace(regexp_replace(replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(173), ''), '([\\p{L}\\p{N}_])-\\n([\\p{L}\\p{N}_])', '\\1\\2', 'g'), '[ \\t]+', ' ', 'g'), chr(10) || chr(10), chr(1) || chr(1)), '([^.!?:\\x01\\n])\\n', '\\1 ', 'g'), chr(1), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS digest FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents", spread=True).select("doc_id", F.md5(X.clean(F.col("text"))).alias("digest"))


@query("WITH e AS (SELECT o_custkey AS a, c_nationkey AS n FROM orders JOIN customer ON c_custkey = o_custkey) SELECT n_name AS node, 'customer' AS rel, count(DISTINCT a) AS weight FROM e JOIN nation ON n_nationkey = n GROUP BY n_name")
def graph_degree(spark, d):
    edges = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    merged = R.merge_edges(edges.select(F.col("n_name").alias("src"), F.lit("customer").alias("rel"), F.col("c_custkey").cast("string").alias("dst"), F.col("o_orderkey").alias("place")))
    return merged.groupBy(F.col("src").alias("node"), "rel").agg(F.count("*").alias("weight"))


@query("WITH e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier), b AS (SELECT * FROM e UNION SELECT dst, src FROM e), k AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= 60), h1 AS (SELECT DISTINCT dst AS node FROM k WHERE src = 'r1'), h2 AS (SELECT DISTINCT k.dst AS node FROM k JOIN h1 ON k.src = h1.node WHERE k.dst <> 'r1' AND k.dst NOT IN (SELECT node FROM h1)) SELECT 'r1' AS node, 0 AS hop UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2")
def graph_two_hop(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    edges = n.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst")).unionByName(s.select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst")))
    return R.neighbours(edges, ["r1"])


@query("SELECT c_mktsegment AS kind, c_nationkey::VARCHAR AS norm, min_by(c_name, c_custkey) AS name, count(*) - 1 AS mentions FROM customer GROUP BY ALL")
def node_mentions(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("kind"), F.col("c_nationkey").cast("string").alias("norm"), F.col("c_name").alias("name"), "c_custkey")
    return R.upsert_nodes(rows, F.col("c_custkey"))


@query("WITH h AS (SELECT doc_id, substr(sha256(text), 1, 16) AS p FROM documents) SELECT a.doc_id AS a, b.doc_id AS b, (bit_count(xor(('0x' || substr(a.p, 1, 8))::BIGINT, ('0x' || substr(b.p, 1, 8))::BIGINT)) + bit_count(xor(('0x' || substr(a.p, 9, 8))::BIGINT, ('0x' || substr(b.p, 9, 8))::BIGINT)))::BIGINT AS bits FROM h a JOIN h b ON a.doc_id < b.doc_id WHERE bits <= 3")
def phash_hamming(spark, d):
    hashes = table(spark, d, "documents", spread=True).select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("phash"))
    return X.near_hashes(hashes, 3)


@query("SELECT sha256(text) AS sha, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY sha HAVING count(*) > 1")
def near_dup_hash(spark, d):
    return X.same_text(table(spark, d, "documents", spread=True))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE list_contains(list_transform(range(5), lambda j: (j * n) // 5), i)")
def evenly_spaced_sample(spark, d):
    return X.evenly_spaced(table(spark, d, "documents", spread=True).select("source", "doc_id"), "source", "doc_id", 5)


@query("SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 2")
def max_two_per_kind(spark, d):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, d, "part").withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("p_brand", "p_partkey")


@query(f"SELECT lang, term, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rn FROM (SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest({TOKENS.format('text')}) AS term FROM documents) WHERE length(term) >= 6 GROUP BY lang, term)) WHERE rn <= 10")
def topic_words(spark, d):
    words = table(spark, d, "documents", spread=True).select("lang", F.explode(S.tokens(F.col("text"))).alias("term")).where("length(term) >= 6")
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "term")
    return words.groupBy("lang", "term").agg(F.count("*").alias("n")).withColumn("rn", F.row_number().over(w)).where("rn <= 10").select("lang", "term", "n")


@query(f"SELECT a.conv_id, round(len(list_intersect(list_distinct({TOKENS.format('b.text')}), list_distinct({TOKENS.format('a.text')})))::DOUBLE / greatest(len(list_distinct({TOKENS.format('a.text')})), 1), 6) AS overlap FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1")
def term_overlap(spark, d):
    c = table(spark, d, "conversations")
    a, b = c.where("turn = 0").select("conv_id", F.col("text").alias("qa")), c.where("turn = 1").select("conv_id", F.col("text").alias("an"))
    return a.join(b, "conv_id").select("conv_id", F.round(S.term_overlap(S.tokens(F.col("an")), S.tokens(F.col("qa"))), 6).alias("overlap"))


@query("WITH r AS (SELECT l.doc_id % 10 AS k, l.doc_id, row_number() OVER (PARTITION BY l.doc_id % 10 ORDER BY n_chars DESC, l.doc_id) AS rank FROM labels l JOIN documents USING (doc_id)), t AS (SELECT * FROM r WHERE rank <= 20), j AS (SELECT doc_id % 10 AS k, doc_id FROM labels WHERE quality = 1) SELECT j.k, count(t.doc_id) AS hits, round(count(t.doc_id) / greatest((SELECT count(*) FROM t x WHERE x.k = j.k), 1), 6) AS precision, round(count(t.doc_id) / count(*), 6) AS recall, round(coalesce(1 / min(t.rank), 0), 6) AS reciprocal FROM j LEFT JOIN t ON t.k = j.k AND t.doc_id = j.doc_id GROUP BY j.k")
def eval_recall_precision(spark, d):
    labels = table(spark, d, "labels").withColumn("k", F.col("doc_id") % 10)
    w = Window.partitionBy("k").orderBy(F.desc("n_chars"), "doc_id")
    results = labels.join(table(spark, d, "documents", spread=True).select("doc_id", "n_chars"), "doc_id").withColumn("rank", F.row_number().over(w)).where("rank <= 20").select("k", "doc_id", "rank")
    return precision_recall(results, labels.where("quality = 1").select("k", "doc_id"), "k", "doc_id")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    return V.tumbling(table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY start")
def events_sliding(spark, d):
    return V.sliding(table(spark, d, "events"), "2 hours", "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def events_session(spark, d):
    return V.sessions(table(spark, d, "events"), "6 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT kind, count(*) AS n, count(DISTINCT norm) AS kinds FROM (SELECT 'code' AS kind, 'inv-' || o_orderkey AS norm FROM orders UNION ALL SELECT 'money', 'inr' || floor(o_totalprice)::BIGINT FROM orders UNION ALL SELECT 'date', lower(strftime(o_orderdate, '%-d%B%Y')) FROM orders) GROUP BY kind")
def entities_rules(spark, d):
    text = F.concat(F.lit("Invoice INV-"), "o_orderkey", F.lit(" dated "), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit(" for INR "), F.floor("o_totalprice"))
    rows = E.entity_rows(table(spark, d, "orders").select("o_orderkey", text.alias("text")), "o_orderkey")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("norm").alias("kinds"))


@query("SELECT 'inv-' || o_orderkey AS src, 'dated' AS rel, lower(strftime(o_orderdate, '%-d%B%Y')) AS dst, o_orderkey AS place FROM orders UNION ALL SELECT 'inv-' || o_orderkey, 'has_amount', 'inr' || floor(o_totalprice)::BIGINT, o_orderkey FROM orders")
def relations(spark, d):
    text = F.concat(F.lit("Invoice INV-"), "o_orderkey", F.lit(" dated "), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit(" for INR "), F.floor("o_totalprice"))
    return E.relations(table(spark, d, "orders", spread=True).select("o_orderkey", text.alias("text")), "o_orderkey", "code", {"date": "dated", "money": "has_amount"})


@query("SELECT o_orderkey, 'Order status' AS label, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'Priority', o_orderpriority FROM orders")
def facts(spark, d):
    text = F.concat(F.lit("Order status: "), "o_orderstatus", F.lit("\nno fact here\n Priority : "), "o_orderpriority", F.lit(" "))
    return E.labelled_facts(table(spark, d, "orders").select("o_orderkey", text.alias("text")), "o_orderkey")


@query()
def chunks(spark, d):
    return X.chunk(table(spark, d, "documents", spread=True))


@query("SELECT o_orderkey, CAST(o_orderkey + 100001 AS VARCHAR) AS value FROM orders WHERE o_orderkey % 7 = 0")
def claim_check(spark, d):
    """Answers that state another number than their sources in a seventh of the rows: the values that the sources lack."""
    number = F.col("o_orderkey") + 100000
    stated = F.when(F.col("o_orderkey") % 7 == 0, number + 1).otherwise(number)
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("It weighs "), F.format_number(stated, 0), F.lit(" in all.")).alias("answer"), F.concat(F.lit("Weight "), number.cast("string")).alias("sources"))
    return rows.select("o_orderkey", F.explode(Y.unsupported(F.col("answer"), F.col("sources"))).alias("value"))


@query("""
WITH q AS (SELECT p_partkey, p_partkey % 5 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'table' WHEN 1 THEN 'compare' WHEN 2 THEN 'image' WHEN 3 THEN 'entity' ELSE 'semantic' END AS leading,
  CASE k WHEN 0 THEN 'table,semantic' WHEN 1 THEN 'compare,semantic' WHEN 2 THEN 'image' WHEN 3 THEN 'entity,keyword,semantic' ELSE 'semantic' END AS routes
FROM q
""")
def question_routes(spark, d):
    wording = F.array(*map(F.lit, ("how many parts are left", "what changed since then", "show the photo", "who is behind PO-1234", "a quiet word")))
    found = table(spark, d, "part").select("p_partkey", A.routes(F.get(wording, (F.col("p_partkey") % 5).cast("int"))).alias("found"))
    return found.select("p_partkey", A.primary(F.col("found")).alias("leading"), F.array_join("found", ",").alias("routes"))


@query("""
SELECT o_orderkey, 'Paid' || CASE WHEN k BETWEEN 1 AND 3 THEN ' [1][' || k || '].' ELSE ' [1].' END AS text, CASE WHEN k BETWEEN 1 AND 3 THEN 0 ELSE 1 END AS n_invalid
FROM (SELECT o_orderkey, o_custkey % 6 AS k FROM orders)
""")
def citation_check(spark, d):
    text = F.concat(F.lit("Paid [1, "), (F.col("o_custkey") % 6).cast("string"), F.lit("] ."))
    checked = table(spark, d, "orders").select("o_orderkey", A.check_citations(text, F.lit(3)).alias("c"))
    return checked.select("o_orderkey", F.col("c.text").alias("text"), F.size("c.invalid").alias("n_invalid"))


@query("""
SELECT o_orderkey, 'The order goes to priority ' || o_orderpriority || '. [1]' AS text FROM orders
""")
def citation_attach(spark, d):
    answer = F.concat(F.lit("The order goes to priority "), F.col("o_orderpriority"), F.lit(". Never pay USD 987654321 again for anything."))
    rows = table(spark, d, "orders", spread=True).select("o_orderkey", A.attach_citations(answer, F.array(F.concat(F.lit("Order of priority "), F.col("o_orderpriority"), F.lit(" goes out")), F.lit("something else"))).alias("a"))
    return rows.select("o_orderkey", F.col("a.text").alias("text"))


HYBRID_SQL = f"""
WITH v AS (SELECT vec_id AS doc_id, list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS cos FROM embeddings),
lists AS (
  SELECT 'vector' AS list, doc_id, round(cos, 6) AS score, 1.0::DOUBLE AS weight FROM v QUALIFY row_number() OVER (ORDER BY round(cos, 6) DESC, doc_id) <= 20
  UNION ALL SELECT 'keyword', doc_id, score, 1.2::DOUBLE FROM ({_bm25_sql({"text": 1.0})})
  UNION ALL (SELECT 'exact', doc_id, 1.0, 2.0::DOUBLE FROM documents WHERE contains(text, 'thonea') ORDER BY doc_id LIMIT 10)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY score DESC, doc_id) AS r FROM lists),
fused AS (SELECT doc_id, round(sum(weight / (60 + r)), 5) AS rrf, min(r - 1) FILTER (list = 'keyword') AS keyword_rank, bool_or(list = 'exact') AS exact FROM ranked GROUP BY doc_id),
best AS (SELECT f.* FROM fused f ORDER BY rrf DESC, doc_id LIMIT 30)
SELECT b.doc_id, rrf, coalesce(keyword_rank, -1) AS keyword_rank, exact, round(coalesce(cos, 0), 4) AS vector_score FROM best b JOIN documents d ON d.doc_id = b.doc_id LEFT JOIN v ON v.doc_id = b.doc_id
"""


@query(HYBRID_SQL)
def hybrid_search(spark, d):
    """Three lists fused over documents, whose vectors are those of the same number; cosines filled in for hits by words."""
    docs, q = table(spark, d, "documents", spread=True), _vector(spark, d)
    vectors = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    exact = docs.where(F.col("text").contains("thonea")).select("doc_id", F.lit(1.0).alias("score")).orderBy("doc_id").limit(10)
    lists = {"vector": (S.dense(vectors, q, id_col="doc_id"), 1.0), "keyword": (S.bm25(docs, BM25_TERMS), 1.2), "exact": (exact, 2.0)}
    hits = H.hybrid(docs, vectors, q, lists)
    return hits.select("doc_id", "rrf", F.coalesce("keyword_rank", F.lit(-1)).cast("long").alias("keyword_rank"), "exact", "vector_score")


@query("""
WITH h AS (SELECT o_orderkey AS doc_id, o_orderkey % 7 AS k, o_custkey % 5 AS m, (o_orderkey % 100) / 100.0::DOUBLE AS vec, (o_custkey % 90) / 3000.0::DOUBLE AS rrf FROM orders)
SELECT doc_id, round(1.6 * vec + 1.2 * rrf + CASE WHEN k = 1 THEN 1.0 ELSE 0 END + CASE WHEN k = 2 THEN 0.35 ELSE 0 END
  + CASE WHEN k < 4 THEN 0.5 - 0.02 * least(k * 10, 25) ELSE 0 END
  - CASE m WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0 END
  + CASE WHEN m = 3 THEN 0.8 ELSE 0 END + 0.25 + CASE m WHEN 0 THEN 0.1 WHEN 3 THEN 0.15 ELSE 0.1 END
  + CASE WHEN m = 0 THEN 0.55 ELSE -0.35 END + CASE WHEN k = 5 THEN 0.3 ELSE 0 END + CASE WHEN k = 6 THEN 0.3 ELSE 0 END, 4) AS rerank_score
FROM h ORDER BY rerank_score DESC, rrf DESC, doc_id LIMIT 200
""")
def hybrid_rerank(spark, d):
    """Hits of known features: codes, keyword ranks, passages about tests or full of questions, values, tables and headings."""
    k, m = F.col("o_orderkey") % 7, F.col("o_custkey") % 5
    more = F.array(*map(F.lit, ("of 30 days", "; expected behavior: should return", "? ? ? ? ?", "of AB-12", "of none")))
    hits = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat(F.lit("The warranty period "), F.get(more, m.cast("int"))).alias("text"),
        F.when(k == 6, "1. Warranty").otherwise("2. Scope").alias("heading"),
        F.when(k == 5, "table").otherwise("text").alias("content_type"),
        ((F.col("o_orderkey") % 100) / 100.0).alias("vector_score"),
        ((F.col("o_custkey") % 90) / 3000.0).alias("rrf"),
        F.when(k < 4, F.least(k * 10, F.lit(25))).alias("keyword_rank"),
        (k == 1).alias("exact"),
        (k == 2).alias("graph"),
    )
    asked = H.Question("Which warranty period has AB-12?", ["AB-12"], ["warranty"], r"\d+ days", numeric=True)
    return H.rerank(hits, asked, 200).select("doc_id", "rerank_score")


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_custkey % 9 = 0 THEN 'replaced' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def replace_rows(spark, d):
    stored = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    rows = stored.where("o_custkey % 9 = 0").withColumn("o_orderpriority", F.lit("replaced"))
    return R.replaced(stored, rows, ["o_custkey"]).drop("o_custkey")


@query("SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey % 3 <> 0")
def cascade_delete(spark, d):
    tables = {"orders": table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id")), "lineitem": table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"))}
    left = R.delete_cascade(tables, tables["orders"].where("doc_id % 3 = 0"), "doc_id")
    return left["orders"].agg(F.count("*").alias("n")).select(F.lit("orders").alias("name"), "n").unionByName(left["lineitem"].agg(F.count("*").alias("n")).select(F.lit("lineitem").alias("name"), "n"))


@query("SELECT o_custkey, count(*) AS counter FROM orders GROUP BY o_custkey UNION ALL SELECT c_custkey, 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def repair_counts(spark, d):
    orders = table(spark, d, "orders").select("o_custkey")
    parents = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")).unionByName(orders).distinct().withColumn("counter", F.lit(-1).cast("long"))
    return R.repaired(parents, orders, "o_custkey", "counter")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1)")
def paths_in_use(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return R.still_used(orders, orders.where("o_orderkey % 2 = 0"), "o_custkey", "o_orderkey")


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS documents, (SELECT sum(o_custkey)::BIGINT FROM orders WHERE o_orderstatus = 'F') AS pages, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) AS chunks")
def ready_totals(spark, d):
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus", "o_custkey")
    return R.ready_totals(docs, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id")), "doc_id", "o_custkey", F.col("o_orderstatus") == "F")


@query("SELECT count(DISTINCT l_partkey) AS nodes, count(*) AS mentions, (SELECT count(*) FROM orders) AS edges FROM lineitem")
def graph_totals(spark, d):
    return R.graph_totals(table(spark, d, "lineitem").select(F.col("l_partkey").alias("node")), table(spark, d, "orders").select("o_orderkey"))


@query("SELECT lower(p_name) AS norm, p_name AS name, sum(p_size)::BIGINT AS mentions FROM part WHERE contains(lower(p_name), 'ring') GROUP BY p_name ORDER BY mentions DESC, name, norm LIMIT 10")
def node_search(spark, d):
    nodes = table(spark, d, "part").groupBy("p_name").agg(F.sum("p_size").alias("mentions")).select(F.lower("p_name").alias("norm"), F.col("p_name").alias("name"), "mentions")
    return R.find_nodes(nodes, "Ring")


@query("SELECT o_orderkey, o_totalprice AS score FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY score DESC, o_orderkey LIMIT 20")
def ranked_in_scope(spark, d):
    allowed = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.ranked_in_scope(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("score")), allowed, "o_orderkey", 20)


@query("SELECT l_orderkey AS doc_id, 'order ' || l_orderkey AS doc_name, array_to_string(list_sort(list_distinct(list(l_linenumber % 3))), ',') AS pages FROM lineitem GROUP BY l_orderkey")
def mention_documents(spark, d):
    mentions = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("order "), "l_orderkey").alias("doc_name"), (F.col("l_linenumber") % 3).alias("page"))
    return R.mention_documents(mentions).withColumn("pages", F.array_join(F.transform("pages", lambda x: x.cast("string")), ","))
