"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of every whole text come from numpy passes over its bytes. On a bounded sample of labelled rows, small
regression trees are grown on the residuals of their predecessors; every path from a root to a node becomes a
conjunctive rule, a lasso logistic regression weighs the rules, and the few with a weight are compiled into one
Spark column expression over the statistics.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import LOWER, chunks, utf8, word_hashes, words

STATISTICS = ("n_bytes", "n_words", "n_lines", "upper", "letters", "digits", "signs", "odd_signs", "exclaims", "pipes", "beyond_ascii", "word_bytes", "longest_word", "distinct_words", "top_word", "same_as_last", "distinct_lines", "short_lines", "end_marks", "words_per_line")

_CLASS = {
    "upper": np.isin(np.arange(256), list(range(65, 91))),
    "letter": np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)]),
    "digits": np.isin(np.arange(256), list(range(48, 58))),
    "signs": np.isin(np.arange(256), [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]),
    "odd_signs": np.isin(np.arange(256), [ord(c) for c in "#$%&*+/<=>@\\^_`{}~[]"]),
    "exclaims": np.isin(np.arange(256), [ord("!")]),
    "pipes": np.isin(np.arange(256), [ord("|")]),
    "beyond_ascii": np.isin(np.arange(256), list(range(128, 256))),
    "end_marks": np.isin(np.arange(256), [ord(c) for c in ".!?"]),
}


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text; shares are of bytes, words or lines, and 0 where there are none."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)

    def per_row(mask: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (run[offsets[1:]] - run[offsets[:-1]]).astype(float)

    share = lambda a, b: a / np.maximum(b, 1)
    count = {k: per_row(v[data]) for k, v in _CLASS.items()}
    starts, ends, owner = words(data, offsets)
    lengths, hashes = ends - starts, word_hashes(LOWER[data], starts, ends)
    n_words = np.bincount(owner, minlength=n).astype(float)
    longest, distinct, top = np.zeros(n), np.zeros(n), np.zeros(n)
    same = np.zeros(n)
    line_starts = np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1])
    line_starts = np.unique(line_starts[line_starts < len(data)])
    line_ends = np.append(line_starts[1:], len(data))
    line_owner = np.searchsorted(offsets, line_starts, "right") - 1
    line_hash = word_hashes(data, line_starts, line_ends)
    n_lines, kinds = np.bincount(line_owner, minlength=n).astype(float), np.zeros(n)
    at, line_at = np.searchsorted(owner, np.arange(n + 1)), np.searchsorted(line_owner, np.arange(n + 1))
    for i in range(n):
        h = hashes[at[i] : at[i + 1]]
        if len(h):
            _, c = np.unique(h, return_counts=True)
            distinct[i], top[i] = len(c), c.max()
            same[i] = np.count_nonzero(h[1:] == h[:-1])
            longest[i] = lengths[at[i] : at[i + 1]].max()
        kinds[i] = len(np.unique(line_hash[line_at[i] : line_at[i + 1]]))
    short = np.bincount(line_owner[(line_ends - line_starts) < 20], minlength=n).astype(float)
    word_bytes = np.bincount(owner, weights=lengths, minlength=n)
    columns = [size, n_words, n_lines, share(count["upper"], count["letter"]), share(count["letter"], size), share(count["digits"], size), share(count["signs"], size), share(count["odd_signs"], size), share(count["exclaims"], n_words), share(count["pipes"], n_words), share(count["beyond_ascii"], size), share(word_bytes, n_words), longest, share(distinct, n_words), share(top, n_words), share(same, n_words), share(kinds, n_lines), share(short, n_lines), share(count["end_marks"], n_words), share(n_words, n_lines)]
    return np.column_stack(columns)


@dataclass(frozen=True)
class Rule:
    """Holds where every (statistic, is it above, bound) holds."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, bound in self.terms:
            out &= x[:, k] > bound if above else x[:, k] <= bound
        return out

    def column(self) -> Column:
        tests = [F.col(STATISTICS[k]) > F.lit(bound) if above else F.col(STATISTICS[k]) <= F.lit(bound) for k, above, bound in self.terms]
        return functools.reduce(lambda a, b: a & b, tests)


@dataclass
class RuleEnsemble:
    bias: float
    weights: list[tuple[Rule, float]]

    def score(self) -> Column:
        """The probability of label 1 as a column over STATISTICS."""
        total = F.lit(float(self.bias))
        for rule, weight in self.weights:
            total = total + F.when(rule.column(), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sum((w * r.holds(x) for r, w in self.weights), np.zeros(len(x))))))


def _split(x: np.ndarray, target: np.ndarray, rows: np.ndarray, features: np.ndarray, least: int) -> tuple[float, int, float]:
    best = (0.0, -1, 0.0)
    total, n = target[rows].sum(), len(rows)
    for k in features:
        v = x[rows, k]
        order = np.argsort(v, kind="stable")
        v, run = v[order], np.cumsum(target[rows][order])
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        at = at[(at >= least) & (at <= n - least)]
        if len(at):
            left = run[at - 1]
            gain = left**2 / at + (total - left) ** 2 / (n - at) - total**2 / n
            i = int(gain.argmax())
            if gain[i] > best[0] + 1e-9:
                best = (float(gain[i]), int(k), float((v[at[i] - 1] + v[at[i]]) / 2))
    return best


def _paths(x: np.ndarray, target: np.ndarray, depth: int, rng: np.random.Generator, least: int) -> tuple[list[Rule], np.ndarray]:
    """The rules of one tree, and its prediction of the target."""
    rules, fitted = [], np.zeros(len(x))

    def grow(rows: np.ndarray, terms: tuple, left: int) -> None:
        gain, k, bound = _split(x, target, rows, rng.permutation(x.shape[1])[: max(4, x.shape[1] * 2 // 3)], least) if left and len(rows) >= 2 * least else (0.0, -1, 0.0)
        if k < 0:
            fitted[rows] = target[rows].mean()
            return
        above = x[rows, k] > bound
        for side, mask in ((False, ~above), (True, above)):
            rules.append(Rule((*terms, (k, side, bound))))
            grow(rows[mask], (*terms, (k, side, bound)), left - 1)

    grow(np.arange(len(x)), (), depth)
    return rules, fitted


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 0.003, seed: int = 11) -> RuleEnsemble:
    """Grows trees, takes their paths as rules, and weighs these by lasso logistic regression (proximal gradient)."""
    rng, least = np.random.default_rng(seed), max(3, len(x) // 400)
    base = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    bias = np.log(base / (1 - base))
    if len(y) < 2 * least or y.min() == y.max():
        return RuleEnsemble(bias, [])
    f, rules = np.full(len(y), bias), []
    for _ in range(trees):
        pick = np.unique(rng.integers(0, len(x), len(x)))
        p = 1 / (1 + np.exp(-f[pick]))
        found, fitted = _paths(x[pick], y[pick] - p, depth, rng, least)
        rules += found
        if found:
            step = np.zeros(len(x))
            step[pick] = fitted
            f += 2.0 * step
    rules = list(dict.fromkeys(rules))
    z = np.column_stack([r.holds(x) for r in rules]).astype(float)
    _, keep = np.unique(z, axis=1, return_index=True)  # rules that hold for the same rows: the first stands
    keep = np.sort(keep)
    z, rules = z[:, keep], [rules[i] for i in keep]
    w, b = np.zeros(len(rules)), bias
    ahead, ahead_b, t = w.copy(), b, 1.0
    step = 4.0 / max(1.0, np.linalg.norm(np.column_stack([z, np.ones(len(z))]), 2) ** 2 / len(z))
    for _ in range(400):
        g = 1 / (1 + np.exp(-(z @ ahead + ahead_b))) - y
        new = ahead - step * (z.T @ g) / len(z)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = ahead_b - step * g.mean()
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / after * (new - w), new_b + (t - 1) / after * (new_b - b)
        w, b, t = new, new_b, after
    return RuleEnsemble(float(b), [(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-6])


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and STATISTICS of every whole text; null counts as empty."""
    names = ["doc_id", "held_out", *STATISTICS]

    def measure(batches):
        for batch in batches:
            for first, part, edges in chunks(*utf8(batch.column(2)), 1 << 20):
                n = len(edges) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n), *map(pa.array, statistics(part, edges).T.copy())], names)

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(measure, "doc_id long, held_out boolean, " + ", ".join(f"{s} double" for s in STATISTICS))


def sample(docs: DataFrame, labels: DataFrame, rows: int = 6000) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of a bounded sample: about ``rows`` labelled rows that aren't held out, by a hash of the id.

    An id with several labels takes the smallest; labels other than 0 and 1, and null ones, teach nothing.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)).select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    n, scale = known.count(), 1 << 30
    taken = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < int(min(1.0, rows / max(n, 1)) * scale))
    ids = taken.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    texts = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(scale)) < int(min(1.0, rows / max(n, 1)) * scale))
    found = with_statistics(texts).join(F.broadcast(ids), "doc_id").toPandas().sort_values(["doc_id", *STATISTICS], kind="stable")
    return found[list(STATISTICS)].to_numpy(float), found["quality"].to_numpy(float)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, model: RuleEnsemble | None = None) -> DataFrame:
    """A row for each document: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 from the threshold).

    Null text is scored as the empty text. Rows of null ids count as not held out and teach nothing; repeated rows are
    scored alike; an empty table gives no rows; without usable labels every score is 0.5. Only doc_id and text of the
    documents are read, and doc_id only to split and join.
    """
    model = model or fit(*sample(docs, labels))
    scored = with_statistics(docs).select("doc_id", "held_out", model.score().alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
