"""Packing by power-of-two decomposition.

Every document's ids are cut into pieces whose lengths are powers of two, from `longest` down:
as many pieces of `longest` as fit, then the binary digits of the rest. Pieces of one length
form a bucket, and each piece is a sequence of its own, so no sequence crosses documents and
none needs padding. The work is one pass over the documents without a shuffle.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import documents, workers_ready
from riskloom.llm.tokens import encoded_batches, vocabulary_path

LONGEST = 4096
END_ID = 2
_PIECES = "id bigint, start bigint, length bigint, ids binary, doc_tokens bigint"


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pieces(batches, path: str, drops_space: bool, end_id: int, longest: int):
    end = np.array([end_id], "<u4").tobytes()
    for ids, flat, counts in encoded_batches(batches, path, drops_space):
        out: list[list] = [[], [], [], [], []]
        raw, at = flat.astype("<u4").tobytes(), 0
        for doc, count in zip(ids.to_pylist(), counts.tolist(), strict=True):
            tokens = raw[4 * at : 4 * (at + count)] + end
            at += count
            n, start = count + 1, 0
            for length in piece_lengths(n, longest):
                for column, value in zip(out, (doc, start, length, tokens[4 * start : 4 * (start + length)], n), strict=True):
                    column.append(value)
                start += length
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["id", "start", "length", "ids", "doc_tokens"])


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, end_id: int = END_ID, path: str | None = None, drops_space: bool = True) -> DataFrame:
    """One row per piece: id_col, start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset (always 0), bucket (log2 of the length).

    A null or empty text is the end id alone. Rows that repeat an id are packed each. Null ids
    stay null. sequence_id is unique; it numbers the pieces within input splits, so it stays
    the same when a task is run again. An empty table gives an empty result. Other columns are
    not read. `path` is the vocabulary file, at the same place on all machines.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    workers_ready(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = rows.mapInArrow(partial(_pieces, path=path or vocabulary_path(), drops_space=drops_space, end_id=end_id, longest=longest), _PIECES)
    return pieces.select(
        F.col("id").alias(id_col),
        "start",
        "length",
        "ids",
        "doc_tokens",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.log2(F.col("length").cast("double")).cast("int").alias("bucket"),
    )


def digest(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return pieces.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return digest(pack(documents(spark, sf_dir)))
