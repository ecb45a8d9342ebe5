"""Hooks for the caller's own models: loaded once per task, fed Arrow batches.

A column whose ``.str`` a model used lies in a reference cycle, so a batch is collected before the next one comes: otherwise a task holds dozens of
them, whole texts included.
What was there before the first batch (modules, the model) is left out of these collections.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.vectors import l2_normalize

MODEL_FIELDS = ("name", "version", "backend", "training_dataset", "input_size")


def _one_by_one(batches: Iterator[pd.DataFrame], work: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What ``work`` makes of each batch; the batch is collected before the next one comes."""
    gc.collect()
    gc.freeze()
    try:
        for batch in batches:
            yield work(batch)
            del batch
            gc.collect()
    finally:
        gc.unfreeze()


def score_with(rows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], model: dict, keep: Sequence[str],
               inputs: Sequence[str]) -> DataFrame:
    """Score rows with the caller's detector: adds ``score`` in [0, 1], ``notes`` and the ``model`` identity.

    ``load()`` runs once per task and returns a function from a batch of ``inputs`` to columns ``score`` and
    ``notes``. Filter before calling: Spark cannot move a filter below Python code.
    """
    names = list(dict.fromkeys([*keep, *inputs]))
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("notes", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()

        def answer(batch: pd.DataFrame) -> pd.DataFrame:
            out = predict(batch[list(inputs)])
            score = pd.Series(out["score"], dtype="float64").to_numpy()
            if ((score < 0) | (score > 1)).any():
                raise ValueError("a detector score must lie in [0, 1]")
            return batch[list(keep)].assign(score=score, notes=out["notes"].to_numpy())

        yield from _one_by_one(batches, answer)

    scored = rows.select(*names).mapInPandas(run, schema)
    identity = F.struct(*[F.lit(model.get(f)).cast("int" if f == "input_size" else "string").alias(f) for f in MODEL_FIELDS])
    return scored.withColumn("model", identity)


def embed_with(rows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], Sequence]], keep: Sequence[str], inputs: Sequence[str]) -> DataFrame:
    """Embed rows with the caller's model; vectors come back at unit length with their dimension."""
    names = list(dict.fromkeys([*keep, *inputs]))
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField("raw", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = load()
        yield from _one_by_one(batches, lambda batch: batch[list(keep)].assign(raw=[list(map(float, v)) for v in embed(batch[list(inputs)])]))

    out = rows.select(*names).mapInPandas(run, schema)
    return out.select(*keep, F.size("raw").alias("dim"), l2_normalize(F.col("raw")).cast("array<float>").alias("vector"))
