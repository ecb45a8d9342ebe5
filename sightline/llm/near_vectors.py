"""Near copies among face descriptors: random-hyperplane tables, exact cosine, and connected groups.

A table gives each vector a key of sign bits. Two vectors at the least cosine agree in one bit with probability
``1 - acos(c) / pi``; the number of bits follows the number of vectors, so that buckets keep their size, and the
number of tables follows the bits, so that a pair at the least cosine is missed with probability ``MISS`` at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.base import Shelf
from sightline.llm.groups import linked_groups

LEAST_COSINE = 0.95
MISS = 1e-3
BUCKET_ROWS = 64  # rows that a bucket of evenly spread vectors would hold
CELL_ROWS = 1024  # a larger bucket is split into blocks, and every pair of blocks is a cell of its own
SEED = 20_260


def table_shape(rows: int, least_cosine: float = LEAST_COSINE, miss: float = MISS) -> tuple[int, int]:
    """Bits per key and number of tables for so many vectors."""
    bits = min(48, max(6, math.ceil(math.log2(max(rows, 1) / BUCKET_ROWS))))
    met = (1 - math.acos(least_cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-met)))


def hyperplanes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, bits * tables))


def sign_keys(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """One integer key per vector and table."""
    signs = (vectors @ hyperplanes(vectors.shape[1], bits, tables) > 0).reshape(len(vectors), tables, bits)
    return signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that neither huge nor tiny vectors lose their length."""
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def vector_keys(rows: DataFrame, bits: int, tables: int) -> DataFrame:
    """``(vec, dim, body, keys)`` for ``rows(vec, vector)`` that have a direction; bytes, in half the width where that loses nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            sizes = np.diff(vectors.offsets.to_numpy())
            values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                matrix = values[starts[at][:, None] + np.arange(dim)]
                keys = sign_keys(unit_rows(matrix), bits, tables).astype("<i8" if bits > 31 else "<i4")
                with np.errstate(over="ignore"):
                    single = matrix.astype("<f4")
                body = single if np.array_equal(single, matrix) else matrix
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), dim, np.int32)),
                     pa.array([b.tobytes() for b in body], pa.binary()), pa.array([k.tobytes() for k in keys], pa.binary()),
                     pa.array([k.astype(np.int64).tolist() for k in keys], pa.list_(pa.int64()))], ["vec", "dim", "body", "keys", "key"])

    kind = rows.schema["vec"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec {kind}, dim int, body binary, keys binary, key array<bigint>")


CELL = ["cell", "table", "key", "dim", "pair_a", "pair_b"]


def cell_pairs(least_cosine: float, bits: int):
    """A task's walk over rows sorted by cell: links per vector, and a spanning set of linked pairs.

    Rows are ``(cell, table, key, dim, pair_a, pair_b, block, vec, copies, body, keys)``. A pair counts in the first table where
    its keys agree and nowhere else; a pair of blocks holds the pairs across, an equal pair those within.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in CELL], axis=1)
            bounds = [0, *(np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1)) + 1).tolist(), len(cells)]
            for a, b in zip(bounds[:-1], bounds[1:]):
                if held and [held[0].column(c)[0].as_py() for c in CELL] != cells[a].tolist():
                    yield from answer(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from answer(held)

    def answer(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(held).combine_chunks()
        if cell.num_rows < 2:
            return
        table = cell.column("table")[0].as_py()
        first, second = cell.column("pair_a")[0].as_py(), cell.column("pair_b")[0].as_py()
        block = cell.column("block").to_numpy()
        dim = cell.column("dim")[0].as_py()
        bodies = cell.column("body").to_pylist()
        unit = unit_rows(np.stack([np.frombuffer(b, dtype="<f4" if len(b) == 4 * dim else "<f8") for b in bodies]).astype(np.float64))
        keys = cell.column("keys").to_pylist()
        keys = np.frombuffer(b"".join(keys), dtype="<i4" if bits <= 31 else "<i8").reshape(cell.num_rows, -1)
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        if not len(left) or not len(right):
            return
        copies = cell.column("copies").to_numpy()
        links = np.zeros(cell.num_rows, dtype=np.int64)
        label = np.arange(cell.num_rows)
        for at in range(0, len(left), 512):
            rows = left[at:at + 512]
            near = unit[rows] @ unit[right].T >= least_cosine
            if first == second:
                near &= right[None, :] > rows[:, None]
            i, j = np.nonzero(near)
            i, j = rows[i], right[j]
            for t in range(table):
                later = keys[i, t] != keys[j, t]
                i, j = i[later], j[later]
            if len(i):
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                low = np.full(cell.num_rows, cell.num_rows)
                np.minimum.at(low, j, i)
                np.minimum.at(low, i, j)
                label = spread(label, i, j)
        linked = np.flatnonzero(links)
        if len(linked):
            vec = cell.column("vec").combine_chunks()
            yield pa.RecordBatch.from_arrays([vec.take(pa.array(linked)), vec.take(pa.array(label[linked])), pa.array(links[linked])], ["vec", "other", "links"])

    return run


def spread(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable position per position, after the links ``i - j`` have been added to those known."""
    while True:
        low = np.minimum(label[i], label[j])
        before = label
        label = label.copy()
        np.minimum.at(label, before[i], low)
        np.minimum.at(label, before[j], low)
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def near_identity_vectors(identity_vectors: DataFrame, least_cosine: float = LEAST_COSINE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(vec, n_links, group, kept)`` per row of ``identity_vectors(vec, vector)``: near copies by cosine.

    ``vec`` names an enrolled reference. ``n_links`` counts the other rows linked directly, ``group`` is the smallest
    ``vec`` that links reach, and ``kept`` says whether it is this one. Vectors that are null, empty, zero, or hold
    null or non-finite components link with nothing, and vectors of different length never link.

    Equal vectors are one row with a count, so a descriptor held by a third of all rows costs nothing. A full bucket
    is split into blocks of ``cell_rows`` and compared cell by cell, exactly; what leaves a cell is one row per linked
    vector, never the pairs. Counting the links inside a dense cloud is quadratic in the cloud by nature.
    Rows without ``vec`` count as rows and never name a group. Repeated rows link with each other; other columns
    are ignored; an empty table gives an empty table.
    """
    shelf = Shelf(identity_vectors.sparkSession, "near-vectors")
    rows = shelf.keep(identity_vectors.select("vec", F.col("vector").cast("array<double>").alias("vector")), "rows")
    sound = F.col("vector").isNotNull() & F.exists("vector", lambda x: x != 0) & F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # A vector's name is a hash of its components; the components themselves are compared too.
    named = rows.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    named = named.select("vec", "sound", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"), "vector")
    distinct = shelf.keep(named.where("sound").groupBy("h1", "h2", "vector").agg(F.min("vec").alias("owner"), F.count("*").alias("copies"))
                          .withColumn("id", F.struct("h1", "h2")), "distinct")
    bits, tables = table_shape(distinct.count(), least_cosine)
    keyed = vector_keys(distinct.select(F.col("id").alias("vec"), "vector"), bits, tables).join(
        distinct.select(F.col("id").alias("vec"), "copies"), "vec")
    keyed = shelf.keep(keyed, "keys")
    placed = keyed.select("*", F.posexplode("key").alias("table", "table_key")).drop("key").withColumnRenamed("table_key", "key")
    sizes = shelf.keep(placed.groupBy("table", "key", "dim").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / cell_rows).cast("int"))
    own = F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int")
    cells = placed.join(sizes, ["table", "key", "dim"]).withColumn("block", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.withColumns({"pair_a": F.least("block", "other"), "pair_b": F.greatest("block", "other")})
    cells = cells.select(F.xxhash64("table", "key", "dim", "pair_a", "pair_b").alias("cell"), "table", "key", "dim", "pair_a", "pair_b", "block", "vec", "copies", "body", "keys")
    found = shelf.keep(cells.repartition("cell").sortWithinPartitions(*CELL).mapInArrow(
        cell_pairs(least_cosine, bits), "vec struct<h1:bigint,h2:bigint>, other struct<h1:bigint,h2:bigint>, links bigint"), "found")
    links = shelf.keep(found.groupBy("vec").agg(F.sum("links").alias("links")), "links")
    groups = linked_groups(found.select(F.col("vec").alias("a"), F.col("other").alias("b")), shelf)
    owners = shelf.keep(distinct.select(F.col("id").alias("vec"), "owner", "copies").join(groups.withColumnRenamed("id", "vec"), "vec", "left")
                        .join(links, "vec", "left").withColumn("root", F.coalesce("group", "vec")).drop("group"), "owners")
    names = shelf.keep(owners.groupBy("root").agg(F.min("owner").alias("group")), "names")
    answers = shelf.keep(owners.join(names, "root").select(
        F.col("vec.h1").alias("h1"), F.col("vec.h2").alias("h2"), "group", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "answers")
    keys = named.select("vec", "sound", F.when(F.col("sound"), F.col("h1")).alias("h1"), F.when(F.col("sound"), F.col("h2")).alias("h2"))
    out = keys.join(answers, ["h1", "h2"], "left").select(
        "vec", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("sound"), F.col("group")).otherwise(F.col("vec")).alias("group"))
    return out.withColumn("kept", F.col("vec").eqNullSafe(F.col("group")))
