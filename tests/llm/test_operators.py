"""The operators of the llm subpackage against brute force, with nulls, blanks, repeats, empty tables and clashing names."""

import collections
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat_format, common, decontamination, lang_id, license_scan, line_dedup, ngram_join, packing, quality_rules, token_counts, tokenizer, voronoi_topk
from lodestone.llm.common import Workspace

DOCS = "doc_id long, text string, score double, x string"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 0.5, "x") for i, t in zip(ids, texts, strict=True)], DOCS).repartition(3)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer.default_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


ODD = ["", " ", "a  b", " a", "a ", "a\n b", "it's <|endoftext|> x", "x  y", "日本 語 x", "don't  'll  ", "\n\n", "é. è,\né", "× . ÷.", "a.b.\n\nC\n", "É!! DE!!\n", "x  y", "\t\ta\n\tb", "a" * 300, "''' '.", "word " * 3000, "😀 a😀b"]


def encode(texts):
    out = []
    for _, ids, edges in tokenizer.Encoder(tokenizer.default_path(), keep=50).rows(pa.array(texts)):
        out += [ids[a:b].tolist() for a, b in zip(edges, edges[1:], strict=False)]
    return out


def test_encoder_equals_the_library(library):
    assert encode(ODD) == [library(t) for t in ODD]


def test_encoder_on_random_text(library):
    rng = np.random.default_rng(0)
    signs = list("ab É.,'\n\t !?1 　😀ßñ s t")
    texts = ["".join(rng.choice(signs, 40)) for _ in range(400)]
    assert encode(texts) == [library(t) for t in texts]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, library, rule):
    texts = [*ODD, None, "one\ntwo\n\nthree 日本\n"]
    rows = collections.defaultdict(list)
    for r in token_counts.token_counts(docs(spark, texts), rule=rule).collect():
        rows[r["doc_id"]].append(r)
    for i, t in enumerate(texts):
        own = sorted(rows[i], key=lambda r: r["section"])
        assert sum(r["n_tokens"] for r in own) == pytest.approx(len(library(t or ""))) and own[0]["doc_tokens"] == len(library(t or ""))
        assert "".join((t or "")[r["start_char"] : r["end_char"]] for r in own) == (t or "")
        assert [(t or "")[r["start_char"] : r["end_char"]] for r in own] == ((t or "").splitlines(keepends=True) if "\n" in (t or "") and not re.search(r"[\x0b\x0c\x1c-\x1e\x85  \r]", t) else [t or ""])
    assert token_counts.token_counts(docs(spark, ["a"]).limit(0)).count() == 0


def test_packing_round_trip(spark, library):
    texts, ids = [*ODD, None, "again", "again"], [*range(len(ODD) + 1), 900, 900]
    rows = packing.pack(docs(spark, texts, ids), length=64, with_ids=True).collect()
    by = collections.defaultdict(dict)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
        assert r["offset"] not in by[r["sequence_id"]]
        by[r["sequence_id"]][r["offset"]] = r["length"]
    whole = sorted((sum(s.values()) for s in by.values()), reverse=True)
    assert all(n == 64 for n in whole[:-1]) and sorted(by) == list(range(len(by)))
    for s in by.values():
        at = 0
        for offset in sorted(s):
            assert offset == at
            at += s[offset]
    for i, t in enumerate(texts[:-2]):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert [x for r in own for x in r["ids"]] == [*library(t or ""), 1]
    assert sum(r["length"] for r in rows if r["doc_id"] == 900) == 2 * (len(library("again")) + 1)
    assert packing.pack(docs(spark, ["a"]).limit(0)).count() == 0


def test_chat_views(spark):
    schema = "conv_id long, turn long, role string, text string, speaker string"
    rows = [(1, 0, "system", "be kind", "z"), (1, 1, "ann", "hi", "z"), (1, 2, "bob", None, "z"), (1, 2, "bob", None, "z"), (1, None, None, "late", "z"), (None, 0, "ann", "lost", "z"), (2, 130, "ann", "far", "z"), (2, 0, "ann", "near", "z")]
    found = chat_format.rotate(spark.createDataFrame(rows, schema)).collect()
    view = {(r["conv_id"], r["speaker"], r["block"]): r for r in found}
    assert set(view) == {(1, s, b) for s in ("ann", "bob", "unknown") for b in (-1, 0)} | {(2, "ann", 0), (2, "ann", 2)}
    r = view[1, "ann", 0]
    assert r["text"] == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n"
    assert [r["text"][m["start"] : m["end"]] for m in r["mask"]] == ["hi<|im_end|>\n"]
    assert chat_format.rotate(spark.createDataFrame([], schema)).count() == 0


def test_quality_rules(spark):
    rng = np.random.default_rng(1)
    good = [" ".join(rng.choice(["sun", "moon", "the", "of", "river", "tree"], 40)) + "." for _ in range(150)]
    bad = [" ".join(w + "!!" for w in rng.choice(["SUN", "MOON", "THE"], 40)) for _ in range(150)]
    texts = [*good, *bad, "", None]
    labels = spark.createDataFrame([(i, int(i < 150), 9.0) for i in range(300)] + [(None, 1, 0.0), (5, None, 0.0)], "doc_id long, quality int, score double")
    rows = quality_rules.score_quality(docs(spark, texts), labels).collect()
    assert len(rows) == 302 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["predicted"] == int(r["doc_id"] < 150) for r in rows if r["held_out"] and r["doc_id"] < 300]) > 0.98
    none = quality_rules.score_quality(docs(spark, ["a"]), labels.limit(0)).collect()
    assert [r["score"] for r in none] == [0.5]


def test_compiled_rules_equal_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.random((300, len(quality_rules.STATISTICS)))
    model = quality_rules.fit(x, (x[:, 3] + x[:, 8] > 1).astype(float), trees=8)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i long, " + ", ".join(f"{s} double" for s in quality_rules.STATISTICS))
    got = [r[0] for r in df.orderBy("i").select(model.score()).collect()]
    assert model.weights and np.allclose(got, model.predict(x))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_license_scan(spark):
    texts = ["Licensed under the Apache License, Version 2.0", "x\nReleased under the MIT License. CC BY-NC 4.0, cc by nc", "SPDX-License-Identifier: BSD-3-Clause", "permit under commit", "", None, "é UNDER THE MIT LICENSE" * 2]
    rows = {r["doc_id"]: r for r in license_scan.scan_licenses(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        at = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and {x for _, x in at} <= set(r["labels"].split(",")) | {""}
    assert rows[2]["labels"] == "bsd-3-clause" and rows[3]["labels"] == "" and rows[0]["labels"] == "apache-2"


def test_every_license_rule_can_fire():
    scanner = license_scan.Scanner()
    assert len(scanner.rules) > 400
    for label, name in license_scan.NAMES.items():
        plain = license_scan._branches(name)[0]
        plain = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\?", r"\1", plain)
        plain = re.sub(r"\[([^\]])[^\]]*\]", r"\1", re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)", r"\1", plain)).replace("?", "")
        assert label in scanner.scan(f"SPDX-License-Identifier: {plain} end".encode())[5], (label, plain)


@pytest.mark.parametrize(
    ("label", "text"),
    [
        ("zlib", "2. Altered source versions must be plainly marked as such, and must not be misrepresented\n   as being the original software."),
        ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
        ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\")"),
        ("epl-2", "Eclipse Public License - v 2.0\n\nTHE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\")."),
    ],
)
def test_sentences_of_license_texts(label, text):
    assert label in license_scan.Scanner().scan(text.encode())[5]


def test_every_license_sentence_can_fire():
    scanner = license_scan.Scanner()
    for label, pattern in license_scan.TEXTS:
        assert label in scanner.scan(re.sub(r"\(\?[^()]*\)", "", pattern).encode() + b" end")[5], label


def test_suppression():
    assert license_scan.suppress([(80, 0, 8, 1), (50, 2, 5, 2), (50, 7, 10, 3), (80, 0, 8, 1)]) == [(80, 0, 8, 1), (50, 7, 10, 3)]


def plain_dedup(texts, min_words):
    """Line dedup by definition, over (id, text) in order of id."""
    def finer(pieces, pattern):
        return [y for x in pieces for y in (re.split(pattern, x) if len(x.encode()) > 120 else [x])]

    cut = {i: finer(finer(re.split(r"(?<=\n)|(?<=[.!?] )", t), r"(?<=[,;:] )"), r"(?<=e )") for i, t in texts.items()}
    solid = {i: [k for k, x in enumerate(p) if x.strip(" \t\r\n")] for i, p in cut.items()}
    seen, out = {}, {}
    for i in sorted(cut):
        bare = [cut[i][k].strip(" \t\r\n") for k in solid[i]]
        hit = set()
        for s in range(len(bare) - 2):
            run = tuple(bare[s : s + 3])
            if run in seen and (seen[run][0] != i or s >= seen[run][1] + 3):
                hit.add(s)
            seen.setdefault(run, (i, s))
        runs = []
        for s in sorted(hit):
            if runs and s <= runs[-1][2] + 3:
                runs[-1][1:] = [s + 2, s]
            else:
                runs.append([s, s + 2, s])
        gone = {k for a, b, _ in runs if sum(len(bare[k].split(" ")) for k in range(a, b + 1)) >= min_words for k in range(a, b + 1)}
        kept, now = [], -1
        for k, x in enumerate(cut[i]):
            now += k in solid[i]
            if now not in gone:
                kept.append(x)
        out[i] = "".join(kept)
    return out


def test_line_dedup(spark):
    rng = np.random.default_rng(3)
    sentence = lambda: " ".join(rng.choice(["ab", "cd", "ef", "gh", "ij"], rng.integers(3, 9))) + "."
    shared = [" ".join(sentence() for _ in range(5)) for _ in range(4)]
    texts = ["\n".join(rng.permutation([sentence(), sentence() + " " + sentence(), shared[rng.integers(4)], "", shared[rng.integers(4)]])) for _ in range(60)] + ["same. " * 40, "", " \n"]
    df = docs(spark, [*texts, None], [*range(len(texts)), None])
    rows = line_dedup.dedup_lines(df, 12, drop_emptied=False, count_as="gone").collect()
    assert {r["doc_id"]: r["text"] for r in rows if r["doc_id"] is not None} == plain_dedup(dict(enumerate(texts)), 12)
    assert len(rows) == 64 and rows[0].asDict().keys() == {"doc_id", "text", "score", "x", "gone"}
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_of_odd_texts(spark):
    """Tabs, carriage returns, the mark that cuts, repeated ids, and long lines with and without commas."""
    rng = np.random.default_rng(23)
    words = lambda n, sep: sep.join(" ".join(rng.choice(["Ären", "cone", "ef", "gin", "x\x01y", "tab\there"], rng.integers(2, 7))) for _ in range(n))
    shared = [words(14, ", "), words(30, " "), words(9, ". "), words(8, "!\r\n\t"), words(12, "; ")]
    texts = [rng.choice(["", "\r\n", "a b "]) + words(2, ". ") + rng.choice([" ", ". ", "\n"]) + shared[k % 5] + rng.choice([" ", "! ", "\n \t\n"]) + words(3, ", ") for k in range(50)]
    rows = line_dedup.dedup_lines(docs(spark, texts), 12, drop_emptied=False).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == plain_dedup(dict(enumerate(texts)), 12)
    twice = line_dedup.dedup_lines(docs(spark, [texts[0], texts[5], texts[5]], [1, 2, 2]), 12, drop_emptied=False).collect()
    assert {(r["doc_id"], r["text"]) for r in twice} == set(plain_dedup({1: texts[0], 2: texts[5]}, 12).items())


@pytest.mark.parametrize("sentences", [1, 2, 4])
def test_passage_of_sixty_words_inside_a_line(spark, sentences):
    rng = np.random.default_rng(24)
    words = lambda n: " ".join("".join(rng.choice(list("abdeegilmnoorste"), rng.integers(2, 8))) for _ in range(n))
    passage = ". ".join(words(60 // sentences) for _ in range(sentences))
    texts = [words(9) + " " + passage + " " + words(11) for _ in range(3)] + [words(200)]
    rows = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, texts), drop_emptied=False).collect()}
    assert rows[0] == texts[0] and rows[3] == texts[3]
    gone = [len(texts[i].split()) - len(rows[i].split()) for i in (1, 2)]
    assert min(gone) >= 30, gone  # all but the pieces at its ends
    assert all(rows[i][:20] == texts[i][:20] for i in (1, 2))


def test_line_dedup_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 5)
    texts = [f"Only {i}. One two three. Four five six. Seven eight nine. Last {i}." for i in range(20)]
    rows = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, texts), 5).collect()}
    assert rows == plain_dedup(dict(enumerate(texts)), 5)


def test_line_dedup_is_native(spark):
    plan = line_dedup.dedup_lines(docs(spark, ["a. b. c. d."]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = [list(map(float, rng.normal(0, 0.2, 8).round(2))) for _ in range(500)]
    v[7], v[8], v[9], v[200] = None, [1.0, None] + [0.0] * 6, [float("nan")] * 8, v[100]
    rows = [(i, x, 3) for i, x in enumerate(v)] + [(None, v[0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(4)
    x = {i: np.floor(1024 * np.array(e)).astype(int) for i, e in enumerate(v) if i not in (7, 8, 9)}
    want = {(q, k, i, s) for q in x if q % 100 == 0 for k, (s, i) in enumerate(sorted(((-int(x[q] @ e), i) for i, e in x.items() if i != q))[:10], 1) for s in [-s]}
    assert {tuple(r) for r in voronoi_topk.top_k(df, pivots=12, block=2, piece=64).collect()} == want
    assert {tuple(r) for r in voronoi_topk.top_k(df).collect()} == want
    monkeypatch.setattr(voronoi_topk, "NEEDS", 0)  # beyond the broadcast
    assert {tuple(r) for r in voronoi_topk.top_k(df, pivots=12, block=2, piece=64).collect()} == want
    assert voronoi_topk.top_k(df.limit(0)).count() == 0
    assert voronoi_topk.top_k(df.where("vec_id in (100, 3)")).count() == 1


def test_integers_of_sliced_arrays():
    v = [[0.5, -0.001], None, [], [1.0, None], [float("inf")], [2.0**53], [-(2.0**53)], [3.0, 0.1, 1.0]]
    whole = pa.array([[9.0]] + v + [[7.0]], pa.list_(pa.float64())).slice(1, len(v))
    values, edges, valid = voronoi_topk.integers(whole, 1024.0)
    assert valid.tolist() == [True, False, True, False, False, False, True, True]
    got = {i: values[edges[i] : edges[i + 1]].tolist() for i in np.flatnonzero(valid)}
    assert got == {0: [512, -2], 2: [], 6: [-(2**63)], 7: [3072, 102, 1024]}


def test_decontamination(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    item = list(rng.choice(words, 30))
    swapped = item.copy()
    swapped[4], swapped[20] = "other", "thing"
    clean = [" ".join(rng.choice(words, 80)) for _ in range(20)]
    texts = [f"{clean[0]} {' '.join(item)} {clean[1]}", f"{clean[2]} {' '.join(swapped).upper()}!", f"{clean[3]} {' '.join(item[:8])}", *clean[4:], "", None]
    bench = spark.createDataFrame([(1, " ".join(item), "d"), (2, "too short", "d"), (3, None, "d"), (None, clean[5], "d")], "item_id long, text string, doc_id string")
    df = docs(spark, texts)
    rows = decontamination.overlaps(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(0, 1), (1, 1)}
    assert {r["doc_id"] for r in decontamination.decontaminate(df, bench).collect()} == set(range(2, len(texts)))
    assert decontamination.overlaps(df.limit(0), bench).count() == 0 and decontamination.overlaps(df, bench.limit(0)).count() == 0


def fits_somewhere(mask, agrees):
    return any(all(agrees[at + i] for i, c in enumerate(mask) if c == "1") for at in range(len(agrees) - len(mask) + 1))


@pytest.mark.parametrize("agree", [0.6, 0.8, 0.9, 1.0])
def test_masks_miss_no_accepted_pattern(agree):
    for n in range(1, 16):
        differ = max(k for k in range(n + 1) if n - k >= agree * n)
        for gone in itertools.combinations(range(n), differ):
            agrees = [i not in gone for i in range(n)]
            assert any(fits_somewhere(m, agrees) for m in decontamination.masks(n, agree)), (n, gone)


def plain_overlaps(texts, items, window=15, agree=0.8):
    """Every aligned window of every document and item, without masks."""
    split = lambda t: [x for x in re.split(r"[\W_]+", t.lower()) if x]
    out = set()
    for d, t in enumerate(texts):
        for k, item in enumerate(items):
            w, v = split(t), split(item)
            n = min(window, len(v))
            found = [(-sum(x == y for x, y in zip(w[a : a + n], v[b : b + n], strict=True)), a, b) for a in range(len(w) - n + 1) for b in range(len(v) - n + 1)] if n else []
            best = min(found, default=(0, 0, 0))
            if n and -best[0] >= agree * n:
                out.add((d, k, -best[0], n, *best[1:]))
    return out


def test_decontamination_equals_search_without_masks(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(300)]
    items = [list(rng.choice(words, n)) for n in (1, 2, 4, 5, 6, 7, 8, 9, 10, 10, 11, 12, 13, 14, 15, 15, 15, 16, 20, 30)]
    texts = []
    for item in items:
        for copy in range(9):
            near = item.copy()
            for k in rng.permutation(len(item))[: min(copy // 2, len(item))]:
                near[k] = "other"
            texts.append(" ".join([*rng.choice(words, rng.integers(0, 20)), *near, *rng.choice(words, rng.integers(0, 20))]))
    whole = [" ".join(x) for x in items]
    bench = spark.createDataFrame(list(enumerate(whole)), "item_id long, text string")
    want = plain_overlaps(texts, whole)
    rows = decontamination.overlaps(docs(spark, texts), bench).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want) > 80


def test_short_item_copied_into_a_document(spark):
    bench = spark.createDataFrame([(1, "What is the capital of France?")], "item_id long, text string")
    df = docs(spark, ["Quiz: what is the capital of France? Paris.", "The capital is far away."])
    assert [(r["doc_id"], r["n_agree"], r["doc_start"]) for r in decontamination.overlaps(df, bench).collect()] == [(0, 6, 1)]
    assert {r["doc_id"] for r in decontamination.decontaminate(df, bench).collect()} == {1}


def plain_components(texts):
    sets = {}
    for i, t in texts.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    for _ in ids:
        before = dict(label)
        for a in ids:
            for b in ids:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_near_duplicates(spark):
    rng = np.random.default_rng(6)
    words = [f"v{i}" for i in range(60)]
    base = [list(rng.choice(words, n)) for n in (40, 60, 25, 80)]
    texts = []
    for b in base:
        for _ in range(12):
            t = b.copy()
            for k in rng.integers(0, len(t), rng.integers(0, 3)):
                t[k] = rng.choice(words)
            texts.append(" ".join(t))
    texts += ["A b c", "a B  c", "a b d", "", "  ", texts[0].upper(), *(" ".join(rng.choice(words, 30)) for _ in range(20))]
    df = docs(spark, [*texts, None, "lost"], [*range(len(texts)), 999, None])
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df).collect()}
    assert rows.pop(None)[1] is None and rows.pop(999) == (0, 999)
    want = plain_components(dict(enumerate(texts)))
    assert rows == want
    assert {r["doc_id"] for r in ngram_join.keep_first(df).collect()} == {i for i, (_, c) in want.items() if c == i} | {999, None}
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_of_each_text_of_an_id(spark):
    rng = np.random.default_rng(9)
    words = [f"v{i}" for i in range(500)]
    texts = [" ".join(rng.choice(words, 40)) for _ in range(4)]
    near = [t + " more" for t in texts]
    rows = ngram_join.near_duplicates(docs(spark, [*texts, *near], [1, 1, 1, 1, 2, 3, 4, 5])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {(i, 1) for i in range(1, 6)}


def test_leaders_that_fit_nobody_do_not_end_the_search(spark, monkeypatch):
    """A list of sets of 40, 100, 100 and 101: the 2nd and 4th are similar, the first leader drawn is the 1st."""
    monkeypatch.setattr(ngram_join, "DRAWS", (1,))
    token, work = 77, Workspace(spark, "planted")
    home = int(ngram_join.mix(np.array([token], np.uint64))[0] % np.uint64(32))
    draw = F.xxhash64(F.lit((home << 32) | token).cast("long"), "id", F.lit(100)).alias("draw")
    low = spark.range(1, 400).select("id", draw).orderBy("draw").first()["id"]
    drawn = [low, *(1000 + i for i in (1, 2, 3))]
    others = spark.createDataFrame([(x,) for x in drawn], "id long").select("id", draw)
    assert others.orderBy("draw").first()["id"] == low
    late = np.append(np.arange(1, 26), token).astype(np.uint64).tobytes()
    first = np.array([token], np.uint64).tobytes()
    rows = [(k, sig, n, p, b"") for k, (sig, n, p) in enumerate(zip(drawn, (40, 100, 100, 101), (first, first, late, first), strict=True))]
    join = object.__new__(ngram_join._Join)
    join.spark, join.work, join.percent, join.split = spark, work, 75, ngram_join.SPLIT
    join.levels = spark.sparkContext.broadcast((np.zeros(1 << ngram_join.BITS, np.uint8), 0))
    join.sets = spark.createDataFrame(rows, ngram_join.SETS)
    join.classes = join.sets.select("sig", "n", "doc_id")
    place = lambda side: join.classes.select(F.col("sig").alias(f"sig_{side}"), F.col("doc_id").alias(side))
    join.verify = lambda pairs, name: work.write(pairs.join(place("a"), "sig_a").join(place("b"), "sig_b").select("a", "b"), f"{name}-links")
    assert {tuple(r) for r in join.links().collect()} == {(1, 1), (3, 1)}


def test_lists_dealt_out_in_parts(spark):
    """Sixty texts of five shared words at most three apart: their lists of more than four members go to several parts."""
    rng = np.random.default_rng(16)
    words = [f"v{i}" for i in range(80)]
    base = list(rng.choice(words, 40))
    texts = []
    for i in range(60):
        t = base.copy()
        for k in rng.integers(0, len(t), i % 4):
            t[k] = rng.choice(words)
        texts.append(" ".join(t))
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs(spark, texts), split=4).collect()}
    assert rows == plain_components(dict(enumerate(texts)))


@pytest.mark.parametrize("rows", [100_000, 20])
def test_narrow_tables_have_no_more_files_than_rows_warrant(spark, monkeypatch, rows):
    """With 16 partitions that Spark doesn't merge; what small tables hold fits one file."""
    rng = np.random.default_rng(19)
    words = [f"v{i}" for i in range(80)]
    base = [list(rng.choice(words, 40)) for _ in range(5)]
    texts = [" ".join([*b[:k], f"x{k}", *b[k + 1 :]]) for b in base for k in range(0, 40, 4)]
    monkeypatch.setattr(common, "FILE_ROWS", rows, raising=False)
    files, write = {}, Workspace.write
    narrow = re.compile(r"classes|first-pairs|drawn-\d+-(lists|pairs)|.*-components-\w+")

    def seen(work, df, name, *more):
        out = write(work, df, name, *more)
        if narrow.fullmatch(name):
            files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(Workspace, "write", seen)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(held, ("16", "false"), strict=True):
            spark.conf.set(k, v)
        found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs(spark, texts)).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert found == plain_components(dict(enumerate(texts)))
    assert {"classes", "first-pairs", "drawn-3-lists", "first-components-edges", "first-components-0"} <= set(files)
    assert set(files.values()) == {1} if rows == 100_000 else max(files.values()) > 1


def test_parity_bitmaps_bound_what_is_shared():
    rng = np.random.default_rng(17)
    for n, m, both in ((1, 1, 1), (5, 900, 4), (300, 400, 250), (3000, 3000, 1500), (64, 64, 0)):
        s = np.unique(rng.integers(0, 2**63, n + m + both, dtype=np.uint64))
        rng.shuffle(s)
        a, b = s[:n], np.concatenate([s[: min(both, n)], s[n : n + m]])
        shared = len(np.intersect1d(a, b))
        assert shared <= ngram_join.most_shared(ngram_join.parity(a), len(a), ngram_join.parity(b), len(b)) <= min(len(a), len(b)) + abs(len(a) - len(b))


def test_components_of_long_chains(spark):
    rng = np.random.default_rng(18)
    order = rng.permutation(400).tolist()  # chains end after each multiple of 100
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:], strict=False) if a % 100] + [(7, 7)], "a long, b long")
    want, label = {}, {}
    for part in [[*g] for g in _runs(order)]:
        for v in part:
            label[v] = min(part)
    want = {v: x for v, x in label.items() if any(v in (a, b) for a, b in edges.collect())}
    work = Workspace(spark, "chains")
    first = ngram_join.components(edges.where("a < 200"), work, "one")
    assert {tuple(r) for r in ngram_join.components(edges, work, "two", first).collect()} == set(want.items())


def _runs(order):
    run = []
    for a in order:
        run.append(a)
        if a % 100 == 0:
            yield run
            run = []
    if run:
        yield run


def test_language_id(spark):
    rng = np.random.default_rng(7)
    make = {"aa": ["kala", "moto", "lapa", "tuli"], "bb": ["strecht", "grompf", "schnell", "pfiff"]}
    texts, langs = [], []
    for i in range(240):
        lang = "aa" if i % 2 else "bb"
        texts.append(" ".join(rng.choice(make[lang], 12)))
        langs.append(lang if i % 10 else None)
    rows = [(i, t, x, "s") for i, (t, x) in enumerate(zip(texts, langs, strict=True))] + [(240, None, "aa", "s"), (241, "123 ###", "bb", "s"), (242, "", None, "s"), (None, "kala moto", "aa", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)
    out = {r["doc_id"]: r for r in lang_id.identify(df).collect()}
    assert len(out) == 244 and all(out[i]["lang_pred"] == ("aa" if i % 2 else "bb") for i in range(240))
    assert all(out[i]["lang_pred"] == "und" and out[i]["rejected"] for i in (240, 241, 242))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items() if i is not None)
    kept = lang_id.keep_identified(df)
    assert kept.columns == df.columns and {240, 241, 242}.isdisjoint({r["doc_id"] for r in kept.collect()}) and kept.count() >= 238
    assert {r["lang_pred"] for r in lang_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert lang_id.identify(df.limit(0)).count() == 0


def test_language_blocks_add_up():
    from lodestone.llm.common import utf8

    texts = ["kala moto " * 40, "", "x" * 90, "é a.b  ", "lapa"]
    data, offsets = utf8(pa.array(texts))
    whole = [list(zip(b.tolist(), r.tolist(), strict=True)) for b, r in lang_id._ngrams(data, offsets, 1 << 10)]
    for block in (1, 7, 64):
        parts = [[] for _ in whole]
        for a in range(0, len(data), block):
            for k, (b, r) in enumerate(lang_id._ngrams(data, offsets, 1 << 10, a, a + block)):
                parts[k] += zip(b.tolist(), r.tolist(), strict=True)
        assert parts == whole
