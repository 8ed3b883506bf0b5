"""Token files: ids of all documents in ascending id order, coded by rANS.

A store is a folder with one shared frequency table (table.rtb, counted over all documents)
and files of consecutive documents. A file has a header, an index of its documents (ids and
lengths), checkpoints (for each block its byte offset and first token) and the blocks, which
decode independently; index and blocks carry checksums.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm import rans
from riskloom.llm.common import documents, removed_at_exit, shared_dir, workers_ready, written
from riskloom.llm.tokens import encoded_batches, encoder, vocabulary_path

END_ID = 1
FILE_TOKENS = 4_000_000
_MAGIC = b"RTF1"
_HEAD = struct.Struct("<4sQQQII")  # magic, documents, those without an id (the first ones), tokens, blocks, crc32 of the index
_IDS = "id bigint, n bigint, ids binary"
_FILES = "path string, first_id bigint, documents bigint, tokens bigint"
_DOCS = "id bigint, start bigint, n_tokens bigint, ids binary"


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def put(uri: str, data: bytes) -> None:
    """Writes under another name first, so that a reader or a second attempt never meets half a file."""
    fs, path = _fs(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def get(uri: str) -> bytes:
    fs, path = _fs(uri)
    with fs.open_input_stream(path) as source:
        return source.read()


def file_bytes(named: list[int | None], lengths: np.ndarray, tokens: np.ndarray, table: rans.Table) -> bytes:
    blocks = [rans.encode_block(tokens[a : a + rans.BLOCK], table) for a in range(0, len(tokens), rans.BLOCK)]
    sizes = np.array([len(b) for b in blocks], np.int64)
    ids = np.array([i or 0 for i in named], np.int64)
    index = ids.astype("<i8").tobytes() + lengths.astype("<u8").tobytes() + (np.cumsum(sizes) - sizes).astype("<u8").tobytes()
    return _HEAD.pack(_MAGIC, len(ids), sum(i is None for i in named), len(tokens), len(blocks), zlib.crc32(index)) + index + b"".join(blocks)


class TokenFile:
    """Reads a token file; blocks can be decoded on their own and in any order."""

    def __init__(self, data: bytes, table: rans.Table) -> None:
        magic, docs, nameless, self.tokens, blocks, crc = _HEAD.unpack_from(data)
        at, end = _HEAD.size, _HEAD.size + 16 * docs + 8 * blocks
        if magic != _MAGIC or zlib.crc32(memoryview(data)[at:end]) != crc:
            raise ValueError("damaged token file")
        self.ids = pa.array(np.frombuffer(data, "<i8", docs, at), mask=np.arange(docs) < nameless)
        self.lengths = np.frombuffer(data, "<u8", docs, at + 8 * docs).astype(np.int64)
        self.checkpoints = np.frombuffer(data, "<u8", blocks, at + 16 * docs)
        self.data, self.table, self.base = data, table, end

    def block(self, i: int) -> np.ndarray:
        return rans.decode_block(self.data, self.table, self.base + int(self.checkpoints[i]))

    def all(self) -> np.ndarray:
        blocks = [self.block(i) for i in range(len(self.checkpoints))]
        return np.concatenate(blocks) if blocks else np.zeros(0, np.uint32)


def _encode(batches, path: str, drops_space: bool, end_id: int):
    for ids, flat, counts in encoded_batches(batches, path, drops_space):
        whole = np.insert(flat, np.cumsum(counts), flat.dtype.type(end_id))
        ends = np.concatenate(([0], np.cumsum(counts + 1)))
        offsets = pa.py_buffer((ends * flat.dtype.itemsize).astype(np.int32))
        column = pa.Array.from_buffers(pa.binary(), len(counts), [None, offsets, pa.py_buffer(whole)])
        yield pa.RecordBatch.from_arrays([ids, pa.array(counts + 1), column], ["id", "n", "ids"])


def _count(batches, dtype: str, size: int):
    total = np.zeros(size, np.int64)
    for batch in batches:
        raw = b"".join(batch.column(0).to_pylist())
        total += np.bincount(np.frombuffer(raw, dtype), minlength=size)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["token", "count"])


def _write(batches, folder: str, freq: bytes, dtype: str):
    """A partition of consecutive documents, in order, to one or more files."""
    table = rans.Table.from_bytes(freq)
    ids: list[int | None] = []
    raws: list[bytes] = []
    held = part = 0

    def flush():
        nonlocal held, part
        tokens = np.frombuffer(b"".join(raws), dtype)
        lengths = np.array([len(r) // np.dtype(dtype).itemsize for r in raws])
        digest = zlib.crc32(lengths.tobytes(), zlib.crc32(repr(ids).encode()))
        first = "null" if ids[0] is None else f"{ids[0] + 2**63:016x}"
        uri = f"{folder}/{part:06d}-{first}-{len(ids)}-{digest:08x}.rtf"  # the same in a second attempt
        part += 1
        put(uri, file_bytes(ids, lengths, tokens, table))
        row = pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([ids[0]], pa.int64()), pa.array([len(ids)]), pa.array([len(tokens)])], ["path", "first_id", "documents", "tokens"])
        ids.clear()
        raws.clear()
        held = 0
        return row

    for batch in batches:
        for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held > FILE_TOKENS * 2:
                yield flush()
            ids.append(doc)
            raws.append(raw)
            held += len(raw) // np.dtype(dtype).itemsize
    if ids:
        yield flush()


def _read(batches, table_uri: str):
    table = None
    for batch in batches:
        for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            table = table or rans.Table.from_bytes(get(table_uri))
            source = TokenFile(get(path), table)
            tokens = source.all().astype("<u4")
            ends = np.cumsum(source.lengths)
            for at in range(0, len(ends), 1000):
                stop = ends[at : at + 1000]
                begin = stop - source.lengths[at : at + 1000]
                cuts = [tokens[a:b].tobytes() for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([source.ids[at : at + 1000], pa.array(begin + before), pa.array(stop - begin), pa.array(cuts, pa.binary())], ["id", "start", "n_tokens", "ids"])


def write_store(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, path: str | None = None, drops_space: bool = True) -> DataFrame:
    """Writes the store and returns its files: path, first_id, documents, tokens.

    A null or empty text is the end id alone. Rows that repeat an id are stored each, next to
    each other, in the order of their ids' bytes. Rows with a null id come first. An empty
    table gives a store without files. Other columns are not read.
    """
    workers_ready(df.sparkSession)
    path = path or vocabulary_path()
    coder = encoder(path, drops_space)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ids = written(rows.mapInArrow(partial(_encode, path=path, drops_space=drops_space, end_id=end_id), _IDS), "ids", compression="zstd")
    counts = np.zeros(coder.size, np.int64)
    found = ids.select("ids").mapInArrow(partial(_count, dtype=coder.dtype.str, size=coder.size), "token bigint, count bigint")
    for token, n in found.groupBy("token").agg(F.sum("count")).collect():  # a row a vocabulary entry at most
        counts[token] = n
    table = rans.Table.of_counts(counts).to_bytes()
    fs, where = _fs(folder)
    fs.create_dir(where, recursive=True)
    put(f"{folder}/table.rtb", table)
    parts = max(1, int(-(-counts.sum() // FILE_TOKENS)))
    dealt = ids.select("id", "ids").repartitionByRange(parts, "id").sortWithinPartitions("id", "ids")
    return written(dealt.mapInArrow(partial(_write, folder=folder, freq=table, dtype=coder.dtype.str), _FILES), "files")


def read_store(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """One row per document: id, start (ids of all documents before), n_tokens, ids (binary)."""
    workers_ready(spark)
    order = Window.orderBy("first_id", "path").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    listed = files.select("path", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("before"))
    parts = max(1, files.count())
    return listed.repartition(parts).mapInArrow(partial(_read, table_uri=f"{folder}/table.rtb"), _DOCS)


def op6_token_store(spark, sf_dir: str) -> DataFrame:
    folder = removed_at_exit(spark, f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}")
    files = write_store(documents(spark, sf_dir), folder)
    rows = read_store(spark, folder, files)
    return rows.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
