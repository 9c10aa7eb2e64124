"""N-gram Jaccard join by adaptive multi-match prefixes.

Documents are sets of 5-word shingles. Shingles are put in one order for all: those that stand out as frequent from a
hashed count over the whole corpus come last, the more frequent the later. Two sets of Jaccard similarity t share at least l shingles among the first |x| - ceil(t|x|) + l of each,
for any l. Every document takes the l whose prefix costs least: a longer prefix meets more lists, but a pair must share
as many as the smaller l of the two before it is verified. Documents with equal sets are one class and are joined once.

The postings of the prefixes are packed into byte strings and dealt out by shingle; a shingle so frequent that its list
would overfill a task is dealt out in parts. Where a list is long, its members are first compared with a leader and
with their neighbours by size, then with several drawn leaders; pairs whose links already lie in one component need no
test of their own. What is left of a list, pairs across components, is tested in full, so no link between different
components is lost.

Before texts are fetched, a pair must pass a bound from two short parity bitmaps: a bit tells whether an odd number of
the set's shingles fall on it, so as many shingles at least are in just one of the sets as bits differ.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import LOWER, Workspace, checked_broadcast, chunks, lean, mix, partitions, utf8, word_hashes, words
from lodestone.llm.components import components

#: Counters of the shingles' hashed counts, 1 << BITS: a fixed size at every scale.
BITS = 22
#: The longest lengthening of a prefix.
MOST = 4
#: Members of a list that one task is given; a longer list is dealt out in several parts.
SPLIT = 500_000
#: Leaders drawn from each list that is still open, round by round: more each time, as ever fewer members stand apart.
DRAWS = (3, 12)
#: The most bits of a parity bitmap.
BITMAP = 1 << 20

_STEP = np.multiply.accumulate(np.full(16, 0xBF58476D1CE4E5B9, np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The distinct shingles of each row, sorted: a hash of ``size`` words, or of all words where there are fewer."""
    data = LOWER[data]
    starts, ends, owner = words(data, offsets)
    h = word_hashes(data, starts, ends)
    at = np.searchsorted(owner, np.arange(len(offsets))).tolist()
    n = len(h)
    rolled = np.zeros(max(0, n - size + 1), np.uint64)
    for i in range(size):
        rolled += h[i : i + len(rolled)] * _STEP[i]
    rolled = mix(rolled)
    out = []
    for a, b in zip(at, at[1:], strict=False):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            out.append(mix(np.array([(h[a:b] * _STEP[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signature(s: np.ndarray) -> int:
    """A hash of a set."""
    return int(mix(np.array([mix(s + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _needed(n: int, percent: int) -> int:
    """The least overlap of a set of n with any set of at least that similarity."""
    return -(-percent * n // 100)


def _counter(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - BITS)).astype(np.int64)


def parity(s: np.ndarray) -> bytes:
    """The set's parity bitmap: at least two bits for each shingle, a power of two."""
    m = min(BITMAP, max(64, 1 << (2 * len(s) - 1).bit_length()))
    return np.packbits(np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1).tobytes()


def most_shared(a: bytes, n_a: int, b: bytes, n_b: int) -> int:
    """No more shingles than these are in both sets, by their parity bitmaps; the larger is folded onto the smaller."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return (n_a + n_b - int(np.bitwise_count(x ^ y).sum())) // 2


def prefix(s: np.ndarray, levels: np.ndarray, chance: int, percent: int) -> tuple[int, np.ndarray]:
    """l and the prefix of a set, in the corpus's order (level of the count, hash).

    The cost of l is the expected length of the lists its prefix meets, over l squared: pairs that share one shingle
    by chance seldom share several.
    """
    n = len(s)
    c = levels[_counter(s)]
    order = np.argsort(c, kind="stable")
    base = n - _needed(n, percent)
    most = min(MOST, n - base)
    head = order[: base + most]
    lists = np.cumsum(np.where(c[head] > chance, 2.0 ** (c[head] / 8.0), 0.0))
    if lists[base] < 4:
        return 1, s[order[: base + 1]]
    size = np.arange(1, most + 1)
    best = int(np.argmin((lists[base + size - 1] + 0.25 * (base + size)) / size**2)) + 1
    return best, s[order[: base + best]]


def _pack(total: np.ndarray) -> bytes:
    """Counts as low bytes, compressed, and the few that are greater."""
    high = np.flatnonzero(total > 255)
    low = zlib.compress(np.minimum(total, 255).astype(np.uint8).tobytes(), 1)
    return len(low).to_bytes(8, "little") + low + high.astype("<i8").tobytes() + total[high].astype("<i8").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    out = np.frombuffer(zlib.decompress(raw[8 : 8 + size]), np.uint8).astype(np.int64)
    high, value = np.frombuffer(raw[8 + size :], "<i8").reshape(2, -1)
    out[high] = value
    return out


def shingle_levels(docs: DataFrame, work: Workspace, size: int) -> tuple[np.ndarray, int]:
    """How far each counter's shingles stand out, as bytes: 8 log2 of what its count, over all documents, exceeds the usual one by.

    The usual count is the median of all counters, so shingles that are frequent beside what else falls on their counter
    stand out at any size of the corpus. Levels within three times the square root of the usual count may be chance; they
    order shingles, but ``chance``, the greatest such level, comes with them.
    """

    def count(batches):
        total = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            for _, part, edges in chunks(*utf8(batch.column(0))):
                at, often = np.unique(_counter(np.concatenate(shingle_sets(part, edges, size))), return_counts=True)
                total[at] += often
        yield pa.RecordBatch.from_arrays([pa.array([_pack(total)], pa.binary())], ["counts"])

    def add(batches):
        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += _unpack(raw)
        yield pa.RecordBatch.from_arrays([pa.array([_pack(total)], pa.binary())], ["counts"])

    parts = work.write(docs.select("text").mapInArrow(lean(count), "counts binary"), "counts")
    merged = parts.coalesce(6).mapInArrow(lean(add), "counts binary").collect()  # at most 6 rows of some MB
    work.drop("counts")
    total = sum((_unpack(r[0]) for r in merged), np.zeros(1 << BITS, np.int64))
    usual = float(np.median(total))
    level = lambda count: np.minimum(np.round(8 * np.log2(np.maximum(count, 1))), 255)
    return level(total - usual).astype(np.uint8), int(level(3 * np.sqrt(usual)))


SETS = "doc_id long, sig long, n long, prefix binary, bits binary"


def prefix_table(docs: DataFrame, shared, size: int, percent: int) -> DataFrame:
    """SETS for each document; ``shared`` is a broadcast of the levels."""

    def run(batches):
        levels = shared.value
        for batch in batches:
            for first, part, edges in chunks(*utf8(batch.column(1))):
                rows = [(_signature(s), len(s), prefix(s, *levels, percent)[1].tobytes(), parity(s)) if len(s) else (_signature(s), 0, b"", b"") for s in shingle_sets(part, edges, size)]
                sig, n, p, bits = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), pa.array(sig, pa.int64()), pa.array(n, pa.int64()), pa.array(p, pa.binary()), pa.array(bits, pa.binary())], ["doc_id", "sig", "n", "prefix", "bits"])

    return docs.mapInArrow(lean(run), SETS)


#: The lower half of a shingle (two that agree in it and in their part share a list, which only adds candidates), its
#: class, and the place in the prefix, at most 65,535: a smaller place only weakens the bounds.
_POSTING = np.dtype([("token", "<u4"), ("sig", "<i8"), ("n", "<i4"), ("place", "<u2"), ("salt", "<u2")])


def _packed(sets: DataFrame, shared, parts: int, split: int) -> DataFrame:
    """The prefixes' postings as (part, tokens, sigs, sizes, places, salts) in byte strings; a class once for each task.

    A list of more than ``split`` members, by the levels, is dealt out to as many parts as hold it, by class: ``salt`` is
    1 + how far a part is from the list's own; of other lists it is 0.
    """

    def run(batches):
        levels, _ = shared.value
        held: list[np.ndarray] = []
        tokens: list[np.ndarray] = []
        seen: set[int] = set()
        total = 0

        def flush():
            rows, full = np.concatenate(held), np.concatenate(tokens)
            part = (mix(full) % np.uint64(parts)).astype(np.int64)
            level = levels[_counter(full)]
            long = np.flatnonzero(level > 8 * np.log2(split))
            if len(long):
                shares = np.minimum(np.ceil(2.0 ** (level[long] / 8.0) / split), min(parts, 65_000)).astype(np.uint64)
                salt = mix(rows["sig"][long].view(np.uint64)) % shares
                rows["salt"][long] = salt + np.uint64(1)
                part[long] = (part[long] + salt.astype(np.int64)) % parts
            order = np.argsort(part, kind="stable")
            rows, part = rows[order], part[order]
            at = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part))
            pieces = [rows[a:b] for a, b in zip(at, at[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array(part[at[:-1]].astype(np.int32)), *(pa.array([x[f].tobytes() for x in pieces], pa.binary()) for f in _POSTING.names)], ["part", "tokens", "sigs", "sizes", "places", "salts"])

        for batch in batches:
            for sig, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n and sig not in seen:
                    seen.add(sig)
                    full = np.frombuffer(raw, np.uint64)
                    rows = np.zeros(len(full), _POSTING)
                    rows["token"], rows["sig"], rows["n"], rows["place"] = full & np.uint64(0xFFFFFFFF), sig, n, np.minimum(np.arange(len(rows)), 65_535)
                    held.append(rows)
                    tokens.append(full)
                    total += len(rows)
            if total > 750_000:
                yield flush()
                held, tokens, seen, total = [], [], set(), 0
        if total:
            yield flush()

    return sets.select("sig", "n", "prefix").mapInArrow(lean(run), "part int, tokens binary, sigs binary, sizes binary, places binary, salts binary")


_ROW = np.dtype([("token", "<i8"), ("sig", "<i8"), ("n", "<i4"), ("place", "<u2"), ("split", "?")])


def _lists(batches, parts: int):
    """The partition's postings in order of (token, n, sig), each class once, without tokens of one class that have no
    other members elsewhere. A token's number is made of its list's own part and its lower half."""
    held = []
    for batch in batches:
        for part, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            column = {f: np.frombuffer(x, _POSTING[f]) for f, x in zip(_POSTING.names, raw, strict=True)}
            rows = np.empty(len(column["token"]), _ROW)
            home = (part - np.maximum(column["salt"].astype(np.int64) - 1, 0)) % parts
            rows["token"] = (home << 32) | column["token"].astype(np.int64)
            rows["sig"], rows["n"], rows["place"], rows["split"] = column["sig"], column["n"], column["place"], column["salt"] > 0
            held.append(rows)
    if not held:
        return np.empty(0, _ROW)
    rows = np.concatenate(held)
    del held

    def several(rows):
        same = rows["token"][1:] == rows["token"][:-1]
        return rows[np.concatenate([same, [False]]) | np.concatenate([[False], same]) | rows["split"]]

    rows = several(rows[np.argsort(rows["token"], kind="stable")])
    rows = rows[np.lexsort((rows["sig"], rows["n"], rows["token"]))]
    again = (rows["token"][1:] == rows["token"][:-1]) & (rows["sig"][1:] == rows["sig"][:-1])
    return several(rows[np.concatenate([[True], ~again])]) if len(rows) else rows


def _first_pairs(percent: int, parts: int):
    """From each list: pairs of a leader (the smallest set) with all, and of neighbours by size. Long lists, and all that
    are dealt out in parts, go on as rows, with a place for n_b.

    A pair passes where this shingle may be its first in common: then no more than what stands from here on is shared.
    Every similar pair passes in the list of its first common shingle.
    """

    def run(batches):
        rows = _lists(batches, parts)
        if not len(rows):
            return
        starts = np.flatnonzero(np.concatenate([[True], rows["token"][1:] != rows["token"][:-1]]))
        sizes = np.diff(np.append(starts, len(rows)))
        which = np.repeat(np.arange(len(starts)), sizes)
        place = np.arange(len(rows)) - starts[which]
        late = np.flatnonzero(place > 0)
        a = np.concatenate([starts[which[late]], late[place[late] > 1] - 1])
        b = np.concatenate([late, late[place[late] > 1]])
        n_a, n_b = rows["n"][a].astype(np.int64), rows["n"][b].astype(np.int64)
        fits = (100 * n_a >= percent * n_b) & ((100 + percent) * np.minimum(n_a - rows["place"][a], n_b - rows["place"][b]) >= percent * (n_a + n_b))
        a, b = a[fits], b[fits]
        for i in range(0, len(a), 100_000):
            x, y = rows[a[i : i + 100_000]], rows[b[i : i + 100_000]]
            p = np.unique(np.stack([x["sig"], x["n"], y["sig"], y["n"]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(p), pa.int64()), *(pa.array(p[:, k]) for k in range(4))], ["token", "sig_a", "n_a", "sig_b", "n_b"])
        long = rows[(sizes[which] > 3) | rows["split"]]
        for i in range(0, len(long), 100_000):
            r = long[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(r["token"]), pa.array(r["sig"]), pa.array(r["n"].astype(np.int64)), pa.nulls(len(r), pa.int64()), pa.array(r["place"].astype(np.int64))], ["token", "sig_a", "n_a", "sig_b", "n_b"])

    return run


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class _Join:
    def __init__(self, spark: SparkSession, docs: DataFrame, work: Workspace, size: int, percent: int, split: int = SPLIT):
        self.spark, self.docs, self.work, self.size, self.percent, self.split = spark, docs, work, size, percent, split
        self.levels = spark.sparkContext.broadcast(shingle_levels(docs, work, size))
        self.sets = work.write(prefix_table(docs, self.levels, size, percent), "sets")
        classes = self.sets.where(F.col("n") > 0).groupBy("sig", "n").agg(F.min("doc_id").alias("doc_id")).where(F.col("doc_id").isNotNull())
        self.classes = work.write(classes, "classes", self.sets.count())

    def verify(self, pairs: DataFrame, name: str) -> DataFrame:
        """(a, b): class representatives of the pairs of (sig_a, n_a, sig_b, n_b) that are similar."""
        work, percent, size, levels = self.work, self.percent, self.size, self.levels
        asked = pairs.select(F.col("sig_a").alias("sig"), F.col("n_a").alias("n")).unionByName(pairs.select(F.col("sig_b").alias("sig"), F.col("n_b").alias("n"))).distinct()
        heads = self.sets.join(checked_broadcast(asked), ["sig", "n"], "left_semi").groupBy("sig", "n").agg(F.min("doc_id").alias("doc_id"), F.max("bits").alias("bits"))
        heads = work.write(heads.where(F.col("doc_id").isNotNull()), f"{name}-heads")

        def bound(batches):
            for batch in batches:
                a, b, n_a, bits_a, n_b, bits_b = (c.to_pylist() for c in batch.columns)
                keep = pa.array([i for i in range(len(a)) if (100 + percent) * most_shared(bits_a[i], n_a[i], bits_b[i], n_b[i]) >= percent * (n_a[i] + n_b[i])], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

        head = lambda x: heads.select(F.col("doc_id").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
        both = pairs.join(head("a"), ["sig_a", "n_a"]).join(head("b"), ["sig_b", "n_b"]).select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
        likely = work.write(both.mapInArrow(lean(bound), "a long, b long"), f"{name}-likely")
        work.drop(f"{name}-heads")

        members = likely.select(F.col("a").alias("doc_id")).unionByName(likely.select(F.col("b").alias("doc_id"))).distinct()
        texts = self.docs.join(checked_broadcast(members), "doc_id", "left_semi")

        def check(batches):
            """Enough of both prefixes must be shared, as many as the smaller l, and then enough of both sets."""
            for batch in batches:
                keep = []
                for i in range(0, len(batch), 256):
                    sets = [[s for _, part, edges in chunks(*utf8(batch.column(k).slice(i, 256))) for s in shingle_sets(part, edges, size)] for k in (2, 3)]
                    for j, (x, y) in enumerate(zip(*sets, strict=True)):
                        if len(x) and len(y):
                            (l_x, head_x), (l_y, head_y) = prefix(x, *levels.value, percent), prefix(y, *levels.value, percent)
                            if len(np.intersect1d(head_x, head_y, assume_unique=True)) >= min(l_x, l_y) and _similar(x, y, percent):
                                keep.append(i + j)
                keep = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

        # an id of several texts is one vertex: any two of its and the other's texts may link them
        found = likely.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
        return work.write(found.select("a", "b", "ta", "tb").mapInArrow(lean(check), "a long, b long"), f"{name}-links")

    def links(self) -> DataFrame:
        """(v, label) of the components of all links between classes, by their representatives."""
        work, percent = self.work, self.percent
        postings = self.sets.agg(F.sum(F.length("prefix"))).first()[0] or 0
        parts = max(32, partitions(self.spark, postings // 8, 1_000_000))
        dealt = _packed(self.sets, self.levels, parts, self.split).repartitionById(parts, "part")
        raw = work.write(dealt.mapInArrow(lean(_first_pairs(percent, parts)), "token long, sig_a long, n_a long, sig_b long, n_b long"), "lists")
        most = raw.count()
        first = work.write(raw.where(F.col("token").isNull()).select("sig_a", "n_a", "sig_b", "n_b").distinct(), "first-pairs", most)
        links = self.verify(first, "first")
        labels = components(links, work, "first-components")
        lists = raw.where(F.col("token").isNotNull()).select("token", F.col("sig_a").alias("sig"), F.col("n_a").alias("n"), F.col("n_b").alias("place")).join(self.classes, ["sig", "n"])
        fits = lambda n, place, m, other: (F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)) & (F.lit(100 + percent) * F.least(n - place, m - other) >= F.lit(percent) * (n + m))
        for draws in (*DRAWS, 0):
            name = f"drawn-{draws}" if draws else "rest"
            known = lists.join(labels, F.col("doc_id") == F.col("v"), "left").select("token", "sig", "n", "place", F.coalesce("label", "doc_id").alias("part"))
            known = work.write(known, f"{name}-lists", most)
            lead = [F.min(F.struct(F.xxhash64("token", "sig", F.lit(100 * draws + i)).alias("draw"), "sig", "n", "place", "part")) for i in range(max(draws, 1))]
            open_lists = known.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.array(*lead).alias("leads")).where(F.col("low") != F.col("high")).select("token", "leads")
            left = known.join(open_lists, "token")
            if draws:  # drawn by hash
                near = F.filter("leads", lambda x: (F.col("part") != x["part"]) & fits(F.col("n"), F.col("place"), x["n"], x["place"]))
                pairs = left.select("sig", "n", F.explode(F.array_distinct(F.transform(near, lambda x: F.struct(x["sig"].alias("sig"), x["n"].alias("n"))))).alias("x")).select(F.least(F.struct("sig", "n"), "x").alias("a"), F.greatest(F.struct("sig", "n"), "x").alias("b"))
                pairs = pairs.select(F.col("a.sig").alias("sig_a"), F.col("a.n").alias("n_a"), F.col("b.sig").alias("sig_b"), F.col("b.n").alias("n_b"))
            else:
                one = left.select("token", F.col("sig").alias("sig_a"), F.col("n").alias("n_a"), F.col("place").alias("place_a"), F.col("part").alias("part_a"))
                two = left.select("token", F.col("sig").alias("sig_b"), F.col("n").alias("n_b"), F.col("place").alias("place_b"), F.col("part").alias("part_b"))
                pairs = one.join(two, "token").where((F.col("part_a") < F.col("part_b")) & fits(F.col("n_a"), F.col("place_a"), F.col("n_b"), F.col("place_b"))).select("sig_a", "n_a", "sig_b", "n_b")
            pairs = work.write(pairs.distinct(), f"{name}-pairs", draws * most if draws else None)
            work.drop(f"{name}-lists")
            if not pairs.isEmpty():  # leaders that fit nobody leave the other pairs of their lists to the rest
                links = links.unionByName(self.verify(pairs, name))
                labels = components(links, work, f"{name}-components", labels)
            work.drop(f"{name}-pairs")
        for name in ("lists", "first-pairs"):
            work.drop(name)
        return labels


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, class_id.

    Two documents link when 100 * |both| >= percent * |either|, over their sets of distinct shingles of ``size`` words
    (A-Z in small letters; words are runs without ASCII white space; a shorter text is one shingle of all its words).
    Null and blank texts have no shingles and link with nothing. ``component_id`` is the smallest id reachable by links,
    ``class_id`` the smallest with the same set. Rows that repeat an id count as one vertex with several texts, and a
    row comes out for each; a null id links with nothing and has null for both. An empty table gives no rows; other
    columns are not read. Lists that look longer than ``split`` are dealt out in parts.
    """
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "near")
    view = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    join = _Join(spark, view, work, size, percent, split)
    labels = join.links()
    classes = join.classes.select("sig", "n", F.col("doc_id").alias("class_id")).join(labels, F.col("class_id") == F.col("v"), "left").select("sig", "n", "class_id", F.coalesce("label", "class_id").alias("component_id"))
    out = join.sets.select("doc_id", "sig", "n").join(classes, ["sig", "n"], "left")
    known = F.col("doc_id").isNotNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(known, F.coalesce("class_id", "doc_id")).alias("class_id"))


def keep_first(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, of which each component keeps the one of the smallest id; null ids stay.

    Rows that repeat an id stay or go together.
    """
    work = Workspace(docs.sparkSession, "keep")
    found = near_duplicates(docs, size, percent, id_col, text_col)
    gone = checked_broadcast(work.write(found.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct(), "gone"))
    return docs.join(gone, docs[id_col] == gone["doc_id"], "left_anti")
