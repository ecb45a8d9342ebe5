"""Language of a text by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.base import Shelf, portions
from sightline.operators.prefix import ordered_rank

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
MOST_LANGUAGES = 200  # in one block of the model, which is gathered and broadcast: below 200 x BUCKETS doubles, 52 MB; more languages are more blocks
SMOOTHING = 0.5
UNKNOWN = "und"
CHARACTERS_AT_ONCE = 1 << 17
OVERLAP = max(ORDERS) - 1


class Part(NamedTuple):
    """A text, or a stretch of a long one; a later stretch begins with the last ``OVERLAP`` letters of the one before."""

    text: str
    first: bool = True
    last: bool = True


def codes(part: Part) -> np.ndarray:
    """Lower-case code points; digits, marks and white space count as one blank, and a blank stands at both ends of a text."""
    return np.frombuffer(f"{' ' * part.first}{part.text.lower()}{' ' * part.last}".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def blank_table() -> np.ndarray:
    """Code points of the first plane that are no letter become a blank."""
    table = np.arange(1 << 16, dtype=np.uint32)
    letters = np.array([chr(i).isalpha() for i in range(1 << 16)])
    table[~letters] = 32
    return table


_blank: list[np.ndarray] = []


def n_grams(texts: list[str | Part], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every n-gram of the given texts that holds a letter; of a later stretch, what ends behind its overlap."""
    if not _blank:
        _blank.append(blank_table())
    stretches = [t if isinstance(t, Part) else Part(t) for t in texts]
    parts = [codes(t) for t in stretches]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    points = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    fresh = np.ones(len(points), dtype=bool)
    later = (np.cumsum(sizes) - sizes)[[not t.first for t in stretches]] if parts else np.empty(0, np.int64)
    for i in range(OVERLAP):
        fresh[later + i] = False
    low = points < (1 << 16)
    points = np.where(low, _blank[0][np.where(low, points, 0)], points)
    # A run of blanks is one blank.
    stays = np.r_[True, (points[1:] != 32) | (points[:-1] != 32) | (owner[1:] != owner[:-1])][:len(points)]
    points, owner, fresh = points[stays].astype(np.uint64), owner[stays], fresh[stays]
    owners, places = [], []
    h = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(points) < n:
            break
        h = h[:len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1:] + np.uint64(n)
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
            inside = (owner[:len(h)] == owner[n - 1:]) & fresh[n - 1:]
            if n == 1:
                inside = inside & (points != 32)
            owners.append(owner[:len(h)][inside])
            places.append((mixed >> np.uint64(40)).astype(np.int64)[inside] % buckets)
    return (np.concatenate(owners), np.concatenate(places)) if owners else (np.empty(0, np.int32), np.empty(0, np.int64))


def _plain(letter: str) -> bool:
    """A letter that has one lower-case letter, whatever stands around it."""
    return letter.isalpha() and letter != "\u03a3" and len(letter.lower()) == 1 and letter.lower().isalpha()


def stretches(text: str) -> Iterator[Part]:
    """A text in parts of about ``CHARACTERS_AT_ONCE``, cut before a space that follows ``OVERLAP`` plain letters; together they have the text's own n-grams."""
    begin = at = 0
    while len(text) - at > CHARACTERS_AT_ONCE:
        cut = text.find(" ", at + CHARACTERS_AT_ONCE)
        while cut >= 0 and not all(map(_plain, text[cut - OVERLAP:cut])):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield Part(text[begin:cut], begin == 0, False)
        begin, at = cut - OVERLAP, cut
    yield Part(text[begin:], begin == 0, True)


def chunks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[Part]]]:
    """Texts in portions of bounded size; a long text comes in stretches."""
    at, parts = [], []
    for i, text in enumerate(texts):
        for part in stretches(text) if text else ():
            at.append(i)
            parts.append(part)
    for some in portions([len(p.text) for p in parts], CHARACTERS_AT_ONCE):
        yield np.array(at[some], dtype=np.int64), parts[some]


@dataclass
class LanguageModel:
    """Log-probabilities of buckets (one row per bucket) and of languages."""

    languages: list[str]
    prior: np.ndarray
    matrix: np.ndarray

    def __post_init__(self) -> None:
        share = np.exp(self.matrix)
        self.mean = (share * self.matrix).sum(axis=0)
        self.spread = np.sqrt((share * (self.matrix - self.mean) ** 2).sum(axis=0))

    def blocks(self) -> Iterator[LanguageModel]:
        if self.languages:
            yield self

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Joint log-probability of each text and language, whole texts, as sums over their sparse n-grams; and the number of n-grams."""
        total, counts = np.tile(self.prior, (len(texts), 1)), np.zeros(len(texts), dtype=np.int64)
        for at, parts in chunks(texts):
            owner, place = n_grams(parts, len(self.matrix))
            np.add.at(counts, at, np.bincount(owner, minlength=len(parts)))
            for j in range(len(self.languages)):
                sums = np.bincount(owner, weights=self.matrix[place, j], minlength=len(parts))
                np.add.at(total[:, j], at, sums)
        return total, counts


@dataclass
class ManyLanguages:
    """A model of more languages than one block holds: its counts as a table, gathered block by block, in alphabetical order."""

    counted: DataFrame
    count: int
    texts: int
    smoothing: float
    buckets: int

    @property
    def languages(self) -> range:
        return range(self.count)

    def blocks(self) -> Iterator[LanguageModel]:
        for block in range(-(-self.count // MOST_LANGUAGES)):
            yield _gathered(self.counted.where(F.col("block") == block), self.texts, self.smoothing, self.buckets)


def _gathered(counted: DataFrame, texts: int, smoothing: float, buckets: int) -> LanguageModel:
    """The model of at most ``MOST_LANGUAGES`` languages; ``texts`` were learned from in all."""
    held = counted.toArrow()
    names = held.column("language").combine_chunks().dictionary_encode()
    languages = sorted(names.dictionary.to_pylist())
    column = {language: j for j, language in enumerate(languages)}
    places = np.array([column[n] for n in names.dictionary.to_pylist()], dtype=np.int64)[names.indices.to_numpy(zero_copy_only=False)]
    bucket, n = held.column("bucket").to_numpy(), held.column("n").to_numpy()
    share, counts = np.zeros(len(languages)), np.full((buckets, len(languages)), smoothing)
    np.add.at(share, places[bucket < 0], n[bucket < 0])
    np.add.at(counts, (bucket[bucket >= 0], places[bucket >= 0]), n[bucket >= 0])
    return LanguageModel(languages, np.log(share / max(1, texts)), np.log(counts / counts.sum(axis=0)) if languages else counts)


def learn_languages(pages: DataFrame, smoothing: float = SMOOTHING, buckets: int = BUCKETS) -> LanguageModel | ManyLanguages:
    """Counts over every row of ``pages(content, language)`` that has both; no row is sampled.

    Each task adds up its texts per (language, bucket), and the counts are summed before and after one shuffle. The driver gathers
    at most ``MOST_LANGUAGES`` x ``buckets`` rows at a time: more languages stay a table, in blocks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        texts_of: dict[str, int] = {}
        for batch in batches:
            if len(counts) > MOST_LANGUAGES:  # what is held stays bounded; sums are formed again after the shuffle
                yield from summed(counts, texts_of)
                counts, texts_of = {}, {}
            texts, names = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), dtype=object)
            for name in set(names):
                mine = [t for t, n in zip(texts, names) if n == name]
                texts_of[name] = texts_of.get(name, 0) + len(mine)
                held = counts.setdefault(name, np.zeros(buckets, dtype=np.int64))
                for _, parts in chunks(mine):
                    held += np.bincount(n_grams(parts, buckets)[1], minlength=buckets)
        yield from summed(counts, texts_of)

    def summed(counts: dict[str, np.ndarray], texts_of: dict[str, int]) -> Iterator[pa.RecordBatch]:
        for name, held in counts.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1)), pa.array(np.r_[-1, at]), pa.array(np.r_[texts_of[name], held[at]])],
                                             ["language", "bucket", "n"])

    learned = pages.select(F.col("content").cast("string").alias("content"), F.col("language").cast("string").alias("language")).where("content IS NOT NULL AND language IS NOT NULL")
    rows = learned.mapInArrow(run, "language string, bucket bigint, n bigint").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    counted = Shelf(pages.sparkSession, "languages").keep(rows, "counts")
    size = counted.where("bucket < 0").agg(F.count("*").alias("languages"), F.coalesce(F.sum("n"), F.lit(0)).alias("texts")).first()
    if size["languages"] <= MOST_LANGUAGES:
        return _gathered(counted, size["texts"], smoothing, buckets)
    numbers = ordered_rank(counted.where("bucket < 0").select("language", F.lit(0).alias("all")), ["all"], [F.col("language")], "number")
    blocks = numbers.select("language", F.floor((F.col("number") - 1) / MOST_LANGUAGES).alias("block"))
    placed = Shelf(pages.sparkSession, "languages").keep(counted.join(blocks, "language"), "blocks")
    return ManyLanguages(placed, size["languages"], size["texts"], smoothing, buckets)


def predict_languages(pages: DataFrame, model: LanguageModel | ManyLanguages) -> DataFrame:
    """``(uri, language, score, n_grams, fit)`` for every row of ``pages(uri, content)``: the likeliest language and its posterior.

    ``fit`` tells how usual the text is in that language: its mean log-probability an n-gram, less what the language has on average, in the
    language's own standard deviations. A text in another language, or noise, lies far below 0, however sure the posterior is.

    Texts without a letter, null texts, and all texts where nothing could be learned, get ``und`` with score 0 and a null ``fit``.
    Equal scores go to the language first in the alphabet. Repeated rows and null ``uri`` are answered row by
    row; other columns are ignored; an empty table gives an empty table. A model in several blocks is gone through block by block.
    """
    def run_with(held, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = held.value
            names = np.array([*block.languages, UNKNOWN], dtype=object)
            for batch in batches:
                texts = batch.column(1).to_pylist()
                said, top, others, count, fit = (batch.column(i).to_numpy(zero_copy_only=False).copy() for i in range(2, 7))
                known = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], dtype=bool)
                if known.any():
                    joint, grams = block.scores([t for t, k in zip(texts, known) if k])
                    best = joint.argmax(axis=1)
                    peak = joint[np.arange(len(best)), best]
                    usual = (peak - block.prior[best]) / np.maximum(grams, 1)
                    better = peak > top[known]
                    level = np.maximum(peak, top[known])
                    others[known] = np.exp(joint - level[:, None]).sum(axis=1) + others[known] * np.exp(top[known] - level)
                    said[known] = np.where(better, names[best], said[known])
                    fit[known] = np.where(better, (usual - block.mean[best]) / np.maximum(block.spread[best], 1e-9), fit[known])
                    top[known], count[known] = level, grams
                content = pa.nulls(len(texts), pa.string()) if last else batch.column(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), content, pa.array(said, pa.string()), pa.array(top), pa.array(others), pa.array(count), pa.array(fit)], names_out)

        return run

    spark, kind = pages.sparkSession, pages.schema["uri"].dataType.simpleString()
    names_out = ["uri", "content", "language", "top", "others", "n_grams", "fit"]
    rows = pages.select("uri", F.col("content").cast("string").alias("content"), F.lit(UNKNOWN).alias("language"), F.lit(float("-inf")).alias("top"),
                        F.lit(0.0).alias("others"), F.lit(0).cast("bigint").alias("n_grams"), F.lit(float("nan")).alias("fit"))
    shelf, turns = Shelf(spark, "predicted"), -(-len(model.languages) // MOST_LANGUAGES)
    for turn, block in enumerate(model.blocks()):
        if turn:  # one block's broadcast and workers at a time
            rows = shelf.keep(rows, "blocks")
        rows = rows.mapInArrow(run_with(spark.sparkContext.broadcast(block), turn == turns - 1),
                               f"uri {kind}, content string, language string, top double, others double, n_grams bigint, fit double")
    return rows.select("uri", "language", F.when(F.col("others") > 0, 1.0 / F.col("others")).otherwise(0.0).alias("score"), "n_grams", F.when(~F.isnan("fit"), F.col("fit")).alias("fit"))
