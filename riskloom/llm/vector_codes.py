"""Vector codes: eight codebooks of sixteen entries, looked up by a vector-approximation file.

Components become integers, so every sum, distance and tie is exact. A part of a vector finds
its nearest entry in three steps (the VA-file):

1. each coordinate of the entries is cut to BITS bits, a cell, once for a codebook;
2. each part gets a table of the least and the greatest squared distance from its own
   coordinates to every cell; their sums over an entry's cells bound its distance;
3. only entries whose lower bound does not pass the smallest upper bound are measured.

A round is one pass over the vectors: tasks give a row of sums for each entry and position,
Spark adds them, and the driver gets one row for each component of the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import salted_lookup, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bits of a cell; vectors measured at once.
BITS, CHUNK = 3, 2048
#: The largest integer component: up to parts of 1,024 components no distance leaves 63 bits.
LIMIT = 1 << 25


@dataclass(frozen=True)
class Approximation:
    """The codebook of one part with the cells of its coordinates."""

    entries: np.ndarray  # (entry, position)
    cells: np.ndarray  # (entry, position)
    low: np.ndarray  # (position, cell): the smallest integer of a cell
    high: np.ndarray  # (position, cell): the largest


def approximated(entries: np.ndarray, bits: int = BITS) -> Approximation:
    """Cuts every coordinate's range over the entries into 2**bits cells of integers."""
    least = entries.min(axis=0)
    span = entries.max(axis=0) - least + 1
    cells = ((entries - least) << bits) // span
    edges = least[:, None] - (-(np.arange((1 << bits) + 1)[None, :] * span[:, None]) >> bits)
    return Approximation(entries, cells, edges[:, :-1], edges[:, 1:] - 1)


def nearest(x: np.ndarray, book: Approximation) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of x: the index of the nearest entry (ties: the lower one), its squared
    distance, and, over all rows, the number of distances that were measured."""
    gap_low, gap_high = book.low[None] - x[:, :, None], x[:, :, None] - book.high[None]
    least = np.maximum(np.maximum(gap_low, gap_high), 0) ** 2  # an empty cell's bounds are never looked up
    most = np.maximum(np.abs(gap_low), np.abs(gap_high)) ** 2
    at = np.arange(x.shape[1])[None, :]
    lower = least[:, at, book.cells].sum(axis=2)
    upper = most[:, at, book.cells].sum(axis=2)
    row, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
    found = np.full(lower.shape, np.iinfo(np.int64).max)
    found[row, entry] = ((x[row] - book.entries[entry]) ** 2).sum(axis=1)
    best = found.argmin(axis=1)
    return best, found[np.arange(len(x)), best], len(row)


def coded(vectors: np.ndarray, books: list[Approximation]) -> tuple[np.ndarray, np.ndarray]:
    """(row, part) indexes and squared distances."""
    width = vectors.shape[1] // PARTS
    index, error = np.zeros((len(vectors), PARTS), np.int64), np.zeros((len(vectors), PARTS), np.int64)
    for part, book in enumerate(books):
        for a in range(0, len(vectors), CHUNK):
            index[a : a + CHUNK, part], error[a : a + CHUNK, part], _ = nearest(vectors[a : a + CHUNK, part * width : (part + 1) * width], book)
    return index, error


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, vector of longs) of the rows whose vector is not null and holds finite
    components only. Of the rest, rows whose length is not the commonest (of several the
    longest) or is no positive multiple of PARTS have no parts to compare and are dropped too.
    A component over LIMIT stops the run with an error: its squared distance has no long."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("raw"))
    rows = rows.where(F.col("raw").isNotNull() & ~F.exists("raw", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    fits = F.when(~F.exists("raw", lambda v: F.abs(v) >= LIMIT / SCALE), F.transform("raw", lambda v: F.floor(v * float(SCALE)).cast("int")))
    kept = written(rows.select("vec_id", "label", F.size("raw").alias("length"), F.coalesce(fits, F.raise_error(F.lit(f"a component passes {LIMIT // SCALE}")).cast("array<int>")).alias("vector")), "vectors")
    lengths = kept.where((F.col("length") > 0) & (F.col("length") % PARTS == 0)).groupBy("length").count().orderBy(F.desc("count"), F.desc("length")).first()
    return kept.where(F.col("length") == F.lit(lengths["length"] if lengths else -1)).select("vec_id", "label", "vector")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _sums(books: list[Approximation]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = count = None
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("vector"))
            index, _ = coded(vectors, books)
            if total is None:
                total, count = np.zeros((PARTS, len(books[0].entries), vectors.shape[1] // PARTS), np.int64), np.zeros((PARTS, len(books[0].entries)), np.int64)
            for part in range(PARTS):
                mine = vectors[:, part * total.shape[2] : (part + 1) * total.shape[2]]
                np.add.at(total[part], index[:, part], mine)
                count[part] += np.bincount(index[:, part], minlength=count.shape[1])
        if total is not None:
            part, entry, position = (g.ravel() for g in np.indices(total.shape))
            yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "position": pa.array(position, pa.int32()), "total": pa.array(total.ravel()), "n": pa.array(np.repeat(count.ravel(), total.shape[2]))})

    return run


def trained(vectors: DataFrame) -> list[Approximation]:
    """The codebooks after ROUNDS rounds; none for an empty table. They start from the
    ENTRIES vectors of the smallest ids (null ids last, equal ids by their vectors)."""
    first = [r["vector"] for r in vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).collect()]
    if not first:
        return []
    books = [approximated(b) for b in np.split(np.array(first, np.int64), PARTS, axis=1)]
    for _ in range(ROUNDS):
        sums = vectors.select("vector").mapInArrow(_sums(books), "part int, entry int, position int, total bigint, n bigint")
        moved = [b.entries.copy() for b in books]
        for r in sums.groupBy("part", "entry", "position").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).where("n > 0").collect():
            moved[r["part"]][r["entry"], r["position"]] = int(r["total"]) // r["n"]
        books = [approximated(b) for b in moved]
    return books


def codes(vectors: DataFrame, books: list[Approximation]) -> DataFrame:
    """(vec_id, label, code, error) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                index, error = coded(_matrix(batch.column("vector")), books)
                text = index.astype(np.uint8).tobytes().hex()
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], pa.string()), pa.array(error.sum(axis=1))], ["vec_id", "label", "code", "error"])

    kinds = dict(vectors.dtypes)
    return vectors.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def books_digest(books: list[Approximation]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.entries.ravel().tolist()).encode()).hexdigest()


def compressed(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) for every row that integer_vectors keeps.

    Repeated ids and equal vectors each give their rows. Fewer than ENTRIES vectors give
    smaller codebooks. Null labels are summed together. An empty table gives an empty result;
    columns not named are not read.
    """
    vectors = integer_vectors(df, id_col, vector_col, label_col)
    books = trained(vectors)
    rows = written(codes(vectors, books).withColumn("key", F.coalesce(F.col("label").cast("string"), F.lit("null"))), "codes")
    sums = written(rows.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("weight")), "label-errors")
    found = salted_lookup(rows, sums, "key", "weight", ["vec_id", "code"])
    return found.select(F.col("vec_id").alias(id_col), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _round(i: int) -> str:
    return f"""
a{i} AS MATERIALIZED (
  SELECT rid, part, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT p.rid, p.part, c.e, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i]))) AS d
    FROM p JOIN c{i} c ON p.part = c.part) GROUP BY rid, part),"""


def _moved(i: int) -> str:
    return f"""
c{i + 1} AS MATERIALIZED (
  SELECT c.part, c.e, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
    SELECT part, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS x FROM (
      SELECT part, e, i, sum(x[i]) AS s, count(*) AS n
      FROM (SELECT p.part, a.e, p.x, unnest(range(1, len(p.x) + 1)) AS i FROM p JOIN a{i} a ON p.rid = a.rid AND p.part = a.part) GROUP BY part, e, i)
    GROUP BY part, e) m ON c.part = m.part AND c.e = m.e),"""


SQL = (
    """
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rid, vec_id, part, v[part * len(v) // 8 + 1 : (part + 1) * len(v) // 8] AS x FROM k, range(8) t(part)),
c0 AS (SELECT part, rid - 1 AS e, x FROM p WHERE rid <= 16),"""
    + "".join(_round(i) + _moved(i) for i in range(ROUNDS))
    + _round(ROUNDS)
    + f"""
b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{ROUNDS}),
r AS (SELECT k.vec_id, k.label, k.rid, string_agg(printf('%02x', a.e), '' ORDER BY a.part) AS code, CAST(sum(a.d) AS BIGINT) AS error
      FROM k JOIN a{ROUNDS} a ON k.rid = a.rid GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, b
"""
)
