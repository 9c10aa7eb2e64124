"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text's features are its byte n-grams after lower-casing, hashed to rows of an embedding table. Their embeddings
are averaged and a linear layer gives a score for each language. Both are trained by stochastic gradient descent in
numpy on a bounded sample of labelled rows. As averaging and the layer are linear, scoring adds up one product row
for each n-gram of the whole text. A temperature, fitted on held-back rows of the sample, turns the scores into
probabilities; the rejection threshold is a low quantile of the probabilities of held-back rows that are classified right.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import chunks, lean, relieve, utf8

UNKNOWN = "und"
SIZES = (1, 2, 3, 4, 5)
#: Bytes of text whose n-grams are worked out at once when scoring.
BLOCK = 1 << 17
RESULT = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


@dataclass
class Model:
    """One row of language scores for each bucket of n-grams; only rows some n-gram of the sample met are not zero."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, column: pa.Array):
        """For each run of rows: (first row, probabilities). A very long text is scored in blocks of BLOCK bytes."""
        known = self.table.any(axis=1)
        for first, _, near in chunks(*utf8(column)):
            data, offsets = utf8(pc.utf8_lower(column.slice(first, len(near) - 1)))
            total, count = np.zeros((len(self.languages), len(offsets) - 1)), np.zeros(len(offsets) - 1)
            for a in range(0, len(data), BLOCK):
                for bucket, row in _ngrams(data, offsets, len(self.table), a, a + BLOCK):
                    met = known[bucket]
                    bucket, row = bucket[met], row[met]
                    if not len(row):
                        continue
                    low, high = row[0], row[-1] + 1
                    count[low:high] += np.bincount(row - low, minlength=high - low)
                    for k in range(len(self.languages)):
                        total[k, low:high] += np.bincount(row - low, self.table[bucket, k], high - low)
            logits = (total.T / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
            yield first, _softmax(logits)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


_LETTERS = np.zeros(256, bool)
_LETTERS[97:123] = _LETTERS[128:] = True


def _ngrams(data: np.ndarray, offsets: np.ndarray, buckets: int, start: int = 0, stop: int | None = None):
    """For each n: (bucket, row) of the n-grams of letters within words, a word's borders included, in order of the text.

    Every byte that is no letter counts as one border byte. Only n-grams that begin from ``start`` to before ``stop``
    count, so blocks add up to the whole.
    """
    stop = len(data) if stop is None else min(stop, len(data))
    if start >= stop:
        return
    end = min(len(data), stop + SIZES[-1] - 1)
    data, edges = data[start:end], np.clip(offsets, start, end) - start
    code = np.where(_LETTERS[data], data, 32).astype(np.uint64)
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    inside = code != 32
    gram = np.zeros(len(data), np.uint64)
    fits = np.ones(len(data), bool)
    for n in range(1, SIZES[-1] + 1):
        m = len(data) - n + 1
        if m <= 0:
            return
        gram = (gram[:m] << np.uint64(8)) | code[n - 1 :]
        fits = fits[:m]
        if n > 1:
            fits &= row[:m] == row[n - 1 :]
            if n > 2:
                fits &= inside[n - 2 : n - 2 + m]  # only the first and the last byte may be a border
        keep = fits & (inside[:m] | inside[n - 1 :]) if n > 1 else inside.copy()
        keep[stop - start :] = False
        h = (gram[keep] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        yield (h >> np.uint64(40)).astype(np.int64) % buckets, row[:m][keep]


def train(texts: list[str], languages: list[str], buckets: int = 1 << 17, width: int = 12, epochs: int = 4, batch: int = 32, rate: float = 0.5, seed: int = 7, reject: float = 0.002) -> Model:
    """Fits a model; a fifth of the rows, spread evenly, is held back for temperature and threshold."""
    rng = np.random.default_rng(seed)
    names = sorted(set(languages))
    y = np.array([names.index(x) for x in languages])
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    data, offsets = utf8(pc.utf8_lower(pa.array(texts, pa.large_string())))
    for _, part, edges in chunks(data, offsets, 1 << 20):
        found = [[] for _ in edges[1:]]
        for bucket, row in _ngrams(part, edges, buckets):
            at = np.searchsorted(row, np.arange(len(edges)))
            for i in range(len(edges) - 1):
                found[i].append(bucket[at[i] : at[i + 1]])
        for x in found:
            ids, counts = np.unique(np.concatenate(x) if x else np.zeros(0, np.int64), return_counts=True)
            rows.append((ids.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)))
    order = rng.permutation(len(rows))
    back, fit = order[: len(rows) // 5], order[len(rows) // 5 :]
    embed = rng.normal(0, 0.1, (buckets, width)).astype(np.float32)
    layer, bias = rng.normal(0, 0.3, (width, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    met = np.zeros(buckets, bool)
    speed_e = np.zeros(buckets, np.float32)
    speed_l = np.zeros_like(layer)
    for _ in range(epochs):
        rng.shuffle(fit)
        for k in range(0, len(fit), batch):
            part = fit[k : k + batch]
            ids = np.concatenate([rows[i][0] for i in part])
            weight = np.concatenate([rows[i][1] for i in part])
            size = [len(rows[i][0]) for i in part]
            owner = np.repeat(np.arange(len(part)), size)
            mean = np.zeros((len(part), width), np.float32)
            np.add.at(mean, owner, embed[ids] * weight[:, None])
            off = _softmax(mean @ layer + bias)
            off[np.arange(len(part)), y[part]] -= 1
            off /= len(part)
            step = (off @ layer.T)[owner] * weight[:, None]
            g = mean.T @ off
            speed_l += g * g
            layer -= rate * g / (np.sqrt(speed_l) + 1e-3)
            bias -= rate * off.sum(axis=0)
            uniq, inverse = np.unique(ids, return_inverse=True)
            grad = np.zeros((len(uniq), width), np.float32)
            np.add.at(grad, inverse, step)
            speed_e[uniq] += (grad * grad).mean(axis=1)
            embed[uniq] -= rate * grad / (np.sqrt(speed_e[uniq]) + 1e-4)[:, None]
            met[uniq] = True
    model = Model(names, np.where(met[:, None], embed @ layer, 0).astype(np.float32), bias.astype(float), 1.0, 0.0)
    held = [texts[i] for i in back]
    p = np.concatenate([x for _, x in model.probabilities(pa.array(held, pa.large_string()))]) if held else np.zeros((0, len(names)))
    if len(p):
        logit = np.log(np.maximum(p, 1e-30))
        loss = {t: -np.log(_softmax(logit / t)[np.arange(len(back)), y[back]] + 1e-12).mean() for t in np.geomspace(0.25, 5, 31)}
        model.temperature = float(min(loss, key=loss.get))
        p = _softmax(logit / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y[back]]
        if len(right):
            model.threshold = float(min(np.quantile(right, reject), 0.5))
    return model


def sample(docs: DataFrame, rows: int = 2400, longest: int = 20_000) -> tuple[list[str], list[str]]:
    """Texts and languages of a bounded sample of the rows to learn from.

    It takes about ``rows`` rows in all, evenly from the languages as far as they go, chosen by a hash of the id
    (the same for every order of the rows), of whole texts of at most ``longest`` characters.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.col("held_out"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    share, scale = rows / len(counts), 1 << 30
    limit = F.lit(0)
    for lang, n in counts.items():
        limit = F.when(F.col("lang") == lang, F.lit(int(min(1.0, share / n) * scale))).otherwise(limit)
    taken = known.where((F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < limit) & (F.length("text") <= longest)).select("text", "lang", "doc_id").toPandas()
    taken = taken.sort_values(["doc_id", "lang", "text"], kind="stable")
    return taken["text"].tolist(), taken["lang"].tolist()


def _view(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False)).alias("held_out"), "text", "lang")


def judge(text: pa.Array, model: Model | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and rejection of each text."""
    n = len(text)
    lang, best = np.zeros(n, np.int64), np.zeros(n)
    letters = pc.match_substring_regex(text, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
    if model is not None:
        for first, p in model.probabilities(text):
            lang[first : first + len(p)], best[first : first + len(p)] = p.argmax(axis=1), p.max(axis=1)
    else:
        letters = np.zeros(n, bool)
    names = np.array([*(model.languages if model else []), UNKNOWN], object)
    lang[~letters], best[~letters] = len(names) - 1, 0.0
    return names[lang], best, ~letters | (best < (model.threshold if model else 1))


def _slices(batches, rows: int = 1000):
    """The batches in pieces of at most so many rows, so that little is held at once."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)


def learn(docs: DataFrame) -> Model | None:
    """A model from the documents' own labels, of rows that aren't held out; None without any."""
    texts, languages = sample(_view(docs))
    model = train(texts, languages) if texts else None
    del texts, languages
    relieve(docs.sparkSession)
    return model


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents, all columns, that aren't rejected (see identify); no row moves. Without labels to learn from all stay."""
    model = model or learn(docs)
    if model is None:
        return docs
    at = docs.columns.index("text")

    def keep(batches):
        for batch in _slices(batches):
            yield batch.filter(pa.array(~judge(batch.column(at), model)[2]))

    return docs.mapInArrow(lean(keep), docs.schema)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """A row for each document: RESULT.

    Null texts and texts without a letter are ``und`` with score 0 and are rejected; a text whose best probability is
    below the threshold keeps its language, with that score, and is rejected. Without labelled rows to learn from every
    document is ``und``. Rows of null ids count as not held out; repeated rows are judged alike; an empty table gives no
    rows; other columns than doc_id, text and lang are not read, and lang only to train.
    """
    view = _view(docs)
    model = model or learn(docs)

    def score(batches):
        for batch in _slices(batches):
            names, best, rejected = judge(batch.column(2), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(best), pa.array(rejected)], [f.split()[0] for f in RESULT.split(", ")])

    return view.select("doc_id", "held_out", "text").mapInArrow(lean(score), RESULT)
