"""Product codes of vectors with codebooks learned in whole numbers; the nearest entry is found by Orchard's search.

Each component x counts as floor(4096 * x), so all results are exact. Vectors are cut into equal parts; each part position
has its own codebook. A round assigns all parts and replaces each entry by the floored mean of its parts; the sums are
made in Spark, a row an entry and task, so only entries, their sums and counts reach the driver.

Orchard's search: each entry has a list of all entries by distance from it. A query starts at one entry, goes along its
list, jumps to the list of the first entry that is nearer to the query, marks what it has looked at, and stops where the
list's distance is over twice the query's. Squared, that is four times; equal distances go to the lower index.

Cases: vectors that are null or empty, or hold a null, NaN or infinite component, are dropped, and so are those of another
length than the vector of the smallest id; fewer than 16 vectors give as many entries; lengths that 8 doesn't divide are cut
at floor(i * length / 8); rows that repeat an id stay rows, equal ids are ordered by their vectors; a null id comes last; null
labels are one label; an error beyond a long is null; further columns are ignored; an empty table, or one without a
valid vector, gives no rows. Sums of an entry's components must have at most 38 digits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.common import join_sizes, pick, small_batches

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6

#: Squared distances stay below this, also four times, or Python's whole numbers are used.
LARGE = 1 << 60

#: Queries are looked at so many at a time.
QUERIES = 1 << 15


def whole(x: np.ndarray) -> np.ndarray:
    """floor(4096 * x), as int64 or, where that could be too small, as Python's whole numbers."""
    x = x.astype(np.float64)
    if x.size and np.abs(x).max() >= 1 << 40:
        return np.array([int(v) * SCALE if abs(v) >= 1 << 53 else int(np.floor(v * SCALE)) for v in x.ravel()], object).reshape(x.shape)
    return np.floor(x * SCALE).astype(np.int64)


def _fitting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as int64 if squared distances between their rows are small enough, else both as Python's whole numbers."""
    most = max([0, *(int(np.abs(x).max()) for x in (a, b) if x.size)])
    kind = np.int64 if 4 * a.shape[-1] * (2 * most) ** 2 < LARGE else object
    return a.astype(kind), b.astype(kind)


def neighbour_lists(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry all entries by distance and index, and their squared distances."""
    far = ((book[:, None] - book[None]) ** 2).sum(axis=2)
    order = np.array([sorted(range(len(book)), key=lambda e, row=row: (row[e], e)) for row in far])
    return order, np.take_along_axis(far, order, axis=1)


def orchard(queries: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each query, its squared distance, and how many distances were computed in all."""
    queries, book = _fitting(queries, book)
    order, near = neighbour_lists(book)
    n, k = len(queries), len(book)
    now, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
    best = ((queries - book[0]) ** 2).sum(axis=1)
    marked = np.zeros((n, k), bool)
    marked[:, 0] = True
    looked, left = n, np.arange(n)
    while len(left):
        entry, place = now[left], at[left]
        on = place < k
        on[on] = (near[entry[on], place[on]] <= 4 * best[left[on]]).astype(bool)
        left, entry, place = left[on], entry[on], place[on]
        other = order[entry, place]
        at[left] += 1
        new = ~marked[left, other]
        q, other = left[new], other[new]
        marked[q, other] = True
        far = ((queries[q] - book[other]) ** 2).sum(axis=1)
        looked += len(q)
        better = ((far < best[q]) | ((far == best[q]) & (other < now[q]))).astype(bool)
        q = q[better]
        now[q], best[q], at[q] = other[better], far[better], 0
    return now, best, looked


def bounds(length: int, parts: int = PARTS) -> list[tuple[int, int]]:
    return [(i * length // parts, (i + 1) * length // parts) for i in range(parts)]


def assigned(vectors: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each vector's parts."""
    entry, error = np.zeros((len(vectors), len(books)), np.int64), np.zeros((len(vectors), len(books)), object)
    for p, (a, b) in enumerate(bounds(vectors.shape[1], len(books))):
        for s in range(0, len(vectors), QUERIES):
            entry[s : s + QUERIES, p], error[s : s + QUERIES, p], _ = orchard(vectors[s : s + QUERIES, a:b], books[p])
    return entry, error


def valid(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)


def _vectors(column: pa.Array, length: int) -> np.ndarray:
    return whole(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length))


def sums(rows: DataFrame, books: list[np.ndarray], length: int) -> list:
    """(part, entry, count, the sum of each component) of the parts that each entry is nearest to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        totals = [np.zeros(b.shape, object) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _vectors(batch.column(0), length)
            entry, _ = assigned(vectors, books)
            for p, (a, b) in enumerate(bounds(length)):
                own = np.zeros(books[p].shape, vectors.dtype)
                np.add.at(own, entry[:, p], vectors[:, a:b])
                totals[p] += own
                counts[p] += np.bincount(entry[:, p], minlength=len(books[p]))
        rows = [(p, e, int(counts[p][e]), [Decimal(int(x)) for x in totals[p][e]]) for p in range(len(books)) for e in np.flatnonzero(counts[p])]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0))]
        arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(arrays, names=["part", "entry", "n", "total"])

    found = rows.select("vector").mapInArrow(run, "part int, entry int, n bigint, total array<decimal(38,0)>")
    width = max(b - a for a, b in bounds(length))
    each = [F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(width)]
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect()


def learned(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[list[np.ndarray], int]:
    """The codebooks, a matrix a part, and the vectors' length, of rows(vec_id, vector) of valid vectors."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").select("vector").limit(entries).collect()
    if not first:
        return [], 0
    length = len(first[0].vector)
    if any(len(r.vector) != length for r in first):
        first = rows.filter(F.size("vector") == length).orderBy(F.asc_nulls_last("vec_id"), "vector").select("vector").limit(entries).collect()
    start = whole(np.array([r.vector for r in first], np.float64))
    books = [start[:, a:b] for a, b in bounds(length)]
    same = rows.filter(F.size("vector") == length)
    for _ in range(rounds):
        moved = [b.astype(object) for b in books]
        for r in sums(same, books, length):
            moved[r.part][r.entry] = [int(r[f"t{i}"]) // r.n for i in range(books[r.part].shape[1])]
        books = [_fitting(m, m)[0] for m in moved]
    return books, length


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def coded(rows: DataFrame, books: list[np.ndarray], length: int) -> DataFrame:
    """rows(vec_id, label, vector) with code and error instead of the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            entry, error = assigned(_vectors(batch.column(2), length), books)
            codes = ["".join(f"{e:02x}" for e in row) for row in entry.tolist()]
            total = [int(x) if x < 1 << 63 else None for x in error.sum(axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes), pa.array(total, pa.int64())], names=["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.filter(F.size("vector") == length).select("vec_id", "label", "vector").mapInArrow(run, f"vec_id bigint, label {kind}, code string, error bigint")


def compressed(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """A row a valid vector: vec_id, code, error, label_error, codebooks_sha256."""
    small_batches(embeddings.sparkSession)
    rows = valid(pick(embeddings, vec_id, vector, label).toDF("vec_id", "vector", "label"), "vector").withColumn("vec_id", F.col("vec_id").cast("bigint"))
    books, length = learned(rows)
    if not books:
        return rows.sparkSession.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    made = coded(rows, books, length).withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null")))
    labels = made.groupBy("key").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint").alias("label_error"), F.count("*").alias("size"))
    spread = F.concat(F.lit("-"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    met = join_sizes(made.withColumn("_spread", spread), labels, "key", "size", "_spread")
    return met.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
