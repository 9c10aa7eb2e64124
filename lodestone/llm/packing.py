"""Concatenate and cut: documents become one stream of ids, cut into sequences of a fixed length.

Pass one encodes every text and writes its ids with the place of the document within its partition. The partitions'
totals, one number each, are summed in order on the driver, which gives each partition's place in the whole stream.
Pass two cuts every document where the stream crosses a sequence border. All sequences but the last are full.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace, lean
from lodestone.llm.tokenizer import default_path, encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = 2048, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece of a document in a sequence: PIECES, and ``ids array<int>`` if asked for.

    ``start`` counts the document's ids before the piece, ``offset`` the sequence's. Null text is empty: its document
    is ``end_id`` alone (without an end id it has no piece). A null id stays null; rows that repeat an id are packed
    each for itself. An empty table gives no rows. Other columns are not read. The last sequence may be short.
    """
    path, tokens = tokenizer or default_path(), Workspace(docs.sparkSession, "pack")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def encode(batches):
        part, place, enc = TaskContext.get().partitionId(), 0, encoder(path)
        end = np.array([] if end_id is None else [end_id], enc.dtype).tobytes()
        for batch in batches:
            for first, ids, edges in enc.rows(batch.column(1)):
                n = len(edges) - 1
                sizes = np.diff(edges) + len(end) // enc.dtype.itemsize
                raw, at = ids.tobytes(), (edges * enc.dtype.itemsize).tolist()
                before = place + np.cumsum(sizes) - sizes
                place += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), pa.array(before), batch.column(0).slice(first, n), pa.array(sizes), pa.array([raw[a:b] + end for a, b in zip(at, at[1:], strict=False)], pa.binary())], ["part", "before", "doc_id", "n", "ids"])

    stream = tokens.write(rows.mapInArrow(lean(encode), "part long, before long, doc_id long, n long, ids binary"), "stream")
    totals = sorted(map(tuple, stream.groupBy("part").agg(F.sum("n")).collect()))
    base, place = {}, 0
    for part, n in totals:
        base[part], place = place, place + n

    def cut(batches):
        dtype = encoder(path).dtype
        for batch in batches:
            out: list[list] = [[] for _ in range(8 if with_ids else 7)]
            for part, before, doc, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                begin, ids = base[part] + before, np.frombuffer(raw, dtype).astype("<u4")
                a = 0
                while a < n:
                    sequence, offset = divmod(begin + a, length)
                    b = min(n, a + length - offset)
                    piece = (doc, a, b - a, zlib.crc32(ids[a:b]), n, sequence, offset)
                    for column, value in zip(out, (*piece, ids[a:b].astype(np.int32)) if with_ids else piece, strict=True):
                        column.append(value)
                    a = b
            names = [f.split()[0] for f in PIECES.split(", ")]
            arrays = [pa.array(c, pa.int64()) for c in out[:7]] + ([pa.array(out[7], pa.list_(pa.int32()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

    return stream.mapInArrow(lean(cut), PIECES + (", ids array<int>" if with_ids else ""))
