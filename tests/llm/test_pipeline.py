"""The pipeline from end to end: each stage's rows against brute force over what the stage before kept."""

import collections

import numpy as np
import pytest
from test_operators import library, plain_components, plain_dedup  # noqa: F401

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, label string, sig long, runs string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two languages of their own words, and planted cases, as documents and benchmark."""
    rng = np.random.default_rng(41)
    words = {x: ["".join(rng.choice(list(s), rng.integers(3, 8))) + e for _ in range(300)] for x, s, e in (("aa", "abcdfgh", "o"), ("bb", "klmnpqr", "u"))}
    sentence = lambda lang: " ".join(rng.choice(words[lang], rng.integers(6, 12))) + "."
    prose = lambda lang, n=8: " ".join(sentence(lang) for _ in range(n))
    one_piece = list(rng.choice(words["aa"], 100))
    near = one_piece.copy()
    near[50] = "other"
    passage, item = prose("bb", 9), " ".join(rng.choice(words["aa"], 30))
    texts = {i: prose("aa" if i % 2 else "bb") for i in range(1, 121)}
    texts |= {500: texts[3], 501: " ".join(one_piece), 502: " ".join(near), 503: f"{prose('aa', 3)} {item} {prose('aa', 3)}"}
    texts |= {504: f"{prose('bb', 3)} {passage} {prose('bb', 3)}", 505: f"{prose('bb', 3)} {passage} {prose('bb', 3)}", 506: None, 507: "", 508: "12 34 !", 509: prose("aa", 600)}
    rows = [(i, t, "aa" if t and "o" in t else "bb", "s", len(t or ""), "x", i, "y") for i, t in texts.items()]
    rows.append((504, *rows[list(texts).index(504)][1:]))  # a repeated row
    rows.append((None, prose("aa"), None, None, None, None, None, None))
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), item


def test_stages_and_run(spark, folder, library, tmp_path):  # noqa: F811
    path, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontamination", "packing"]
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        assert name == "packing" or docs.columns == columns

    ids = lambda rows: collections.Counter(r["doc_id"] for r in rows)
    texts = lambda rows: {r["doc_id"]: r["text"] for r in rows if r["doc_id"] is not None}

    first = kept["language_id"]
    assert not {506, 507, 508} & set(ids(first)) and len(first) >= 0.95 * (len(before) - 3)
    assert set(map(tuple, first)) <= set(map(tuple, before))

    second, want = kept["line_dedup"], plain_dedup(texts(first), 25)
    assert texts(second) == {i: t for i, t in want.items() if t.strip() or not texts(first)[i].strip()}
    assert 500 not in texts(second) and len(texts(second)[505]) < len(texts(first)[505])
    assert all(r["n_chars"] == len(r["text"]) for r in second) and sum(r["doc_id"] is None for r in second) == 1

    third, want = kept["ngram_join"], plain_components(texts(second))
    assert ids(third) == {i: n for i, n in ids(second).items() if i is None or want[i][1] == i}
    assert {501, 502} & set(texts(third)) == {501}

    fourth = kept["decontamination"]
    assert ids(fourth) == {i: n for i, n in ids(third).items() if i != 503} and item in texts(third)[503]

    pieces = kept["packing"]
    tokens = collections.Counter()
    for r in pieces:
        tokens[r["doc_id"]] += r["length"]
    assert tokens == collections.Counter({i: sum(len(library(r["text"])) + 1 for r in fourth if r["doc_id"] == i) for i in ids(fourth)})
    filled = collections.Counter()
    for r in pieces:
        filled[r["sequence_id"]] += r["length"]
    assert all(filled[k] == 2048 for k in range(len(filled) - 1)) and sum(filled.values()) == sum(tokens.values())

    again = collections.Counter()
    for r in corpus_pipeline.run(spark, path).collect():
        again[r["doc_id"]] += r["length"]
    assert again == tokens


def test_stages_of_an_empty_table(spark, folder):
    path, _ = folder
    empty = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).count() == 0
