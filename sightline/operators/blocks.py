"""All-against-all comparison without a cross join and without emitting the pairs.

Both sides are hashed into blocks of bounded size, and neighbouring blocks travel together. A row is
replicated once per such batch of the other side, and the equal (left batch, right batch) cells meet in a
co-grouped task, where one matrix product after the other compares a block with a block. A reducer turns their scores
into a few rows per left row (or a bounded histogram), and where these can be merged, a task merges what a left block found
in all of its right blocks before anything leaves it. So shuffles carry vectors in and summaries out. Block ids hash the row key, hence a hot identity or source is spread over all blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
TOGETHER = 8  # blocks of a side that travel to a task together, so that a row is copied once for 32,768 rows of the other side
MERGED_TOGETHER = 64  # the same where a task merges what its blocks found, so that its rows do not grow with their pairs
BATCH_BYTES = 64 << 20  # vectors of a side that travel together; wide ones come in fewer blocks
LEAST_BATCHES = 6  # a side is not gathered into fewer, so that there is work for many tasks
STRIPE = 1024  # left rows per matrix product, so that scores of one stripe stay near 32 MB


def block_count(df: DataFrame, rows: int = BLOCK_ROWS) -> int:
    """Number of blocks holding about ``rows`` rows each; one counting job, no data moves."""
    return max(1, math.ceil(df.count() / rows))


def together(width: int, merged: bool, item: int = 8) -> int:
    """How many blocks of vectors with ``width`` numbers of ``item`` bytes may travel together."""
    return max(TOGETHER, min(MERGED_TOGETHER, BATCH_BYTES // (BLOCK_ROWS * max(1, width) * item))) if merged else TOGETHER


def side_blocks(df: DataFrame, rows: int, merged: bool) -> tuple[int, int]:
    """Number of blocks, and how many may travel together; one aggregating job, no data moves."""
    if not merged or "vector" not in df.columns:
        return block_count(df, rows), together(1, merged)
    found = df.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    item = 4 if dict(df.dtypes)["vector"] == "array<float>" else 8
    return max(1, math.ceil(found["n"] / rows)), together(found["width"] or 1, merged, item)


def batch_blocks(blocks: int, most: int = TOGETHER) -> int:
    """How many blocks of a side travel together."""
    return max(1, min(most, blocks // LEAST_BATCHES))


def even_batches(left_blocks: int, right_blocks: int, left_most: int, right_most: int) -> tuple[int, int]:
    """How many blocks of each side travel together where many may: work for as many tasks as ``LEAST_BATCHES`` of each side make, with the fewest copies.

    The larger side is cut more often, since its rows are copied once per batch of the smaller one.
    """
    left = max(1, min(LEAST_BATCHES ** 2, round(LEAST_BATCHES * math.sqrt(left_blocks / right_blocks))))
    even = lambda blocks, most, least: math.ceil(blocks / min(blocks, max(math.ceil(blocks / most), least)))
    return even(left_blocks, left_most, left), even(right_blocks, right_most, math.ceil(LEAST_BATCHES ** 2 / left))


def _grid_side(df: DataFrame, key: Sequence[Column], own: str, other: str, own_blocks: int,
               other_blocks: int, own_batch: int, other_batch: int) -> DataFrame:
    block = F.pmod(F.xxhash64(*key), F.lit(own_blocks)).cast("int")
    return (df.withColumn("__block", block).withColumn(own, F.floor(F.col("__block") / own_batch).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit((other_blocks - 1) // other_batch)))))


Merge = Callable[[pd.DataFrame], pd.DataFrame]


def by_blocks(reducer: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, merge: Merge | None = None, whole: bool = False) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """A cell's function: ``reducer`` for each ``__block`` of the left batch and each of the right one; ``merge`` over a left block's finds.

    A ``whole`` reducer takes both batches at once: what it makes of the right one serves all left blocks.
    """
    names = [field.split()[0] for field in schema.split(",")]

    def cell(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if whole and len(x) and len(y):
            return reducer(x, y)
        rights = [part.drop(columns="__block") for _, part in y.groupby("__block", sort=False)]
        found = []
        for _, part in x.groupby("__block", sort=False):
            part = part.drop(columns="__block")
            own = [rows for rows in (reducer(part, right) for right in rights) if len(rows)]
            found += [merge(pd.concat(own, ignore_index=True))] if merge and len(own) > 1 else own
        return pd.concat(found) if found else pd.DataFrame({n: pd.Series([], dtype="object") for n in names})

    return cell


def block_join(left: DataFrame, right: DataFrame, left_key: Sequence[str], right_key: Sequence[str],
               reducer: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
               same: Sequence[str] = (), rows: int = BLOCK_ROWS,
               counted: tuple[DataFrame, DataFrame] | None = None, *, answers: int = 1, merge: Merge | None = None, whole: bool = False) -> DataFrame:
    """Run ``reducer(left block, right block)`` for every pair of blocks that agree on ``same``.

    Every left row meets every right row with equal ``same`` columns in exactly one pair. ``counted``
    names cheaper tables with at least as many rows to size the grid by, where counting the sides
    themselves would compute them. ``answers`` is about the most rows that a reducer returns for a left row: where there are many, fewer
    blocks travel together, so that a task holds no more of them than one pair of blocks can have. ``merge`` folds reducers' rows for one
    left block into fewer of the same kind, as what is done with the result would: with it, many blocks travel together, and the copies of
    a row stay the same until a side has ``LEAST_BATCHES`` times what a task may hold. A ``whole`` reducer takes batches at once and merges by itself.
    """
    merged = whole or merge is not None
    (left_blocks, left_most), (right_blocks, right_most) = (side_blocks(df, rows, merged) for df in (counted or (left, right)))
    left_batch, right_batch = batch_blocks(left_blocks, left_most), batch_blocks(right_blocks, right_most)
    if whole:  # half a left batch leaves room for what such a reducer makes of the right one
        left_batch, right_batch = even_batches(left_blocks, right_blocks, max(1, left_most // 2), right_most)
    while (4 * max(left_batch, right_batch) if merged else left_batch * right_batch) > max(4 if merged else 1, BLOCK_ROWS // answers):
        left_batch, right_batch = (left_batch // 2, right_batch) if left_batch > right_batch else (left_batch, right_batch // 2)
    columns = lambda names: [F.col(n) for n in names]
    a = _grid_side(left, columns(left_key), "__left", "__right", left_blocks, right_blocks, left_batch, right_batch)
    right = right.toDF(*right.columns)  # fresh attributes: both sides may stem from one table
    b = _grid_side(right, columns(right_key), "__right", "__left", right_blocks, left_blocks, right_batch, left_batch)
    keys = ["__left", "__right", *same]
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(by_blocks(reducer, schema, merge, whole), schema)


def unit_matrix(vectors: pd.Series) -> np.ndarray:
    """Rows scaled to unit length in double precision; zero rows stay zero."""
    matrix = np.vstack(vectors.to_numpy()).astype(np.float64)
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)


def stripes(size: int) -> Iterator[slice]:
    for start in range(0, size, STRIPE):
        yield slice(start, min(start + STRIPE, size))


def group_bounds(sorted_codes: np.ndarray) -> np.ndarray:
    """Start position of each run of equal values."""
    return np.flatnonzero(np.r_[True, sorted_codes[1:] != sorted_codes[:-1]])


def fold_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable, step: Callable, schema: str) -> DataFrame:
    """Walk each group in ``order`` with a state, row by row, as one pass over sorted partitions.

    ``start()`` makes a group's state; ``step(state, rows)`` takes consecutive row tuples with equal
    ``order[0]`` and returns output tuples. A group is streamed through its task, never gathered, and
    many small groups cost no more than one large one. The row number is there for what its window
    demands: clustered and sorted input, which a bare repartition does not guarantee under AQE.
    """
    names = df.columns
    line = Window.partitionBy(*keys).orderBy(*order)
    key_at, group_at = [names.index(k) for k in keys], names.index(order[0])
    fields = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, held, out = None, None, [], []
        for batch in batches:
            for row in zip(*(batch[c].tolist() if batch[c].dtype != object else batch[c] for c in names)):
                here = tuple(row[i] for i in key_at)
                if held and (here != key or row[group_at] != held[0][group_at]):
                    out.extend(step(state, held))
                    held = []
                if here != key:
                    key, state = here, start()
                held.append(row)
            yield pd.DataFrame(out, columns=fields)
            out = []
        if held:
            yield pd.DataFrame(step(state, held), columns=fields)

    return df.withColumn("__turn", F.row_number().over(line)).mapInPandas(run, schema)
