"""Offset-mapped attribution of tokens to the sections of a text.

Each whole text is encoded once. A byte-level token stands for a known number of bytes, so a running sum gives
every token's span; these spans are joined to the sections' spans by binary search, and tokens that cross a border
are allocated by a rule.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import utf8
from lodestone.llm.tokenizer import byte_lengths, default_path, encoder

RULES = ("start", "most", "share")
SECTIONS = "doc_id long, section long, start_char long, end_char long, n_tokens double, n_crossing long, doc_tokens long"


def token_counts(docs: DataFrame, tokenizer: str | None = None, rule: str = "start", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each section of each document: SECTIONS. A section is a line with its line feed; spans are in characters.

    A token that crosses borders counts, by ``rule``: ``start``, for the section of its first byte; ``most``, for the
    one that holds most of its bytes (ties: the earlier); ``share``, for each by its share of the bytes. Under every
    rule a document's sections sum to ``doc_tokens``. ``n_crossing``: tokens that touch the section and another.
    Null or empty text: one section 0 of no characters and tokens. A null id stays null, a repeated row is counted
    again, an empty table gives no rows, other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = tokenizer or default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def attribute(batches):
        enc, sizes = encoder(path), byte_lengths(path)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for first, ids, edges in enc.rows(batch.column(1)):
                n = len(edges) - 1
                low, high = offsets[first], offsets[first + n]
                yield _sections(data[low:high], offsets[first : first + n + 1] - low, sizes[ids], edges, batch.column(0).slice(first, n), rule)

    return rows.mapInArrow(attribute, SECTIONS)


def _sections(data: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, edges: np.ndarray, doc_ids: pa.Array, rule: str) -> pa.RecordBatch:
    """The sections of some rows, from their bytes and their tokens' byte sizes."""
    begins = np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1])
    owner = np.searchsorted(offsets, begins, "right") - 1
    owner[: len(offsets) - 1] = np.arange(len(offsets) - 1)  # an empty row has a section too
    inner = np.ones(len(begins), bool)
    inner[len(offsets) - 1 :] = ~np.isin(begins[len(offsets) - 1 :], offsets)  # a text's last line feed begins nothing
    begins, owner = begins[inner], owner[inner]
    order = np.lexsort((begins, owner))
    begins, owner = begins[order], owner[order]
    ends = np.append(begins[1:], len(data))
    first = np.searchsorted(owner, np.arange(len(offsets) - 1))
    section = np.arange(len(begins)) - first[owner]

    stop = np.cumsum(sizes)
    start = stop - sizes
    solid = np.flatnonzero(ends > begins)  # sections that hold bytes, in order
    lo = solid[np.searchsorted(begins[solid], start, "right") - 1] if len(sizes) else np.zeros(0, np.int64)
    hi = solid[np.searchsorted(begins[solid], stop - 1, "right") - 1] if len(sizes) else lo
    cross = np.flatnonzero(lo != hi)
    counts = np.bincount(np.delete(lo, cross) if rule != "start" else lo, minlength=len(begins)).astype(float)
    touched = np.zeros(len(begins), np.int64)
    for t in cross.tolist():
        over = [s for s in range(lo[t], hi[t] + 1) if ends[s] > begins[s]]
        held = [min(stop[t], ends[s]) - max(start[t], begins[s]) for s in over]
        touched[over] += 1
        if rule == "most":
            counts[over[int(np.argmax(held))]] += 1
        elif rule == "share":
            counts[over] += np.array(held) / sizes[t]
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    origin = chars[offsets[:-1]][owner]
    columns = [doc_ids.take(pa.array(owner)), pa.array(section), pa.array(chars[begins] - origin), pa.array(chars[ends] - origin), pa.array(counts), pa.array(touched), pa.array(np.diff(edges)[owner])]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SECTIONS.split(", ")])
