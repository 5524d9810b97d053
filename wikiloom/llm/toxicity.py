"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams of a text, hashed into 2**20 cells. A cell's scale is
the log ratio of the smoothed shares of toxic and other training texts that hold it; cells whose
ratio is not far from 0 in its own standard errors are left out. A logistic regression on the
scaled features gives the weights. Shares are counted over the training rows in Spark; the few
selected features of each training row are fitted in the driver, which the bound on training rows
keeps small. Scoring reads each text once and sends nothing but the score back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikiloom.llm.common import column
from wikiloom.llm.grams import mix
from wikiloom.llm.memory import frugal, give_back
from wikiloom.llm.tokens import slices
from wikiloom.session import WorkFolder

ORDERS = (3, 4, 5)
CELL_BITS = 20
#: Standard errors that a log ratio must be away from 0.
LEAST_Z = 4.0
#: Labelled rows that are learned from at most, those with the smallest hash of their doc_id.
MAX_TRAINING = 20_000
SMOOTHING = 0.5
_BASE = np.uint64(0x9E3779B97F4A7C55)
_SLICE = 1 << 18
#: Numbers of cells that a step of the fit looks at together.
_BLOCK = 1 << 17


def cells_of(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text number, cell) pairs of the texts, of ``wanted`` cells only if given.

    Texts are lower-cased, white space is one space, also before and after the text.
    """
    even = [f" {' '.join(t.lower().split())} " for t in texts]
    points = np.frombuffer("".join(even).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    text = np.repeat(np.arange(len(even)), [len(t) for t in even])
    found = []
    hashes = points
    for k in range(1, max(ORDERS)):
        hashes = hashes[:-1] * _BASE + points[k:]
        if k + 1 not in ORDERS:
            continue
        cell = (mix(hashes + np.uint64(k)) >> np.uint64(64 - CELL_BITS)).astype(np.int64)
        whole = text[: len(cell)] == text[k : k + len(cell)]
        at = np.flatnonzero(whole if wanted is None else whole & wanted[cell])
        found.append((text[at] << CELL_BITS) | cell[at])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> CELL_BITS, pairs & ((1 << CELL_BITS) - 1)


def _texts(batch: pa.RecordBatch, at: int) -> list[str]:
    return [t or "" for t in batch.column(at).to_pylist()]


@dataclass(frozen=True)
class Model:
    """Cells with a weight (scale times coefficient), and the constant; ``share`` if nothing could be learned."""

    cells: np.ndarray
    weights: np.ndarray
    constant: float
    share: float | None = None

    def scorer(self) -> Callable[[list[str]], np.ndarray]:
        """The function from texts to scores, with the table of weights it looks up."""
        if self.share is not None:
            return lambda texts: np.full(len(texts), self.share)
        table = np.zeros(1 << CELL_BITS, np.float64)
        table[self.cells] = self.weights
        wanted = np.zeros(1 << CELL_BITS, bool)
        wanted[self.cells] = True

        def scores(texts: list[str]) -> np.ndarray:
            text, cell = cells_of(texts, wanted)
            total = np.bincount(text, weights=table[cell], minlength=len(texts)) + self.constant
            return 1 / (1 + np.exp(-np.clip(total, -500, 500)))

        return scores


# --- learning ------------------------------------------------------------------------------
def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text is a multiple of 5; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(
    docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, most: int
) -> DataFrame:
    """text and toxic of at most ``most`` labelled texts that are not held out.

    A doc_id labelled both ways counts as toxic, and rows equal in doc_id and text count once. The
    bounded table of labels is broadcast, and then the bounded list of ids and text hashes, so that
    no more rows than that are ever gathered, however often a doc_id is repeated.
    """
    known = labels.select(column(labels, doc_id).alias("id"), column(labels, label).cast("int").alias("toxic"))
    known = known.where("id is not null and toxic is not null").where(~held_out(F.col("id")))
    chosen = known.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.select(column(docs, doc_id).alias("id"), column(docs, text).cast("string").alias("text"))
    labelled = rows.join(F.broadcast(chosen), "id").withColumn("print", F.xxhash64("text"))
    order = F.xxhash64("id", "print")
    picked = labelled.select("id", "print").distinct().orderBy(order, "id", "print").limit(most)
    once = labelled.join(F.broadcast(picked), ["id", "print"]).groupBy("id", "print")
    return once.agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def _count_cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << CELL_BITS), np.int64)
    for batch in slices(batches, 0, _SLICE):
        toxic = batch.column(1).to_numpy() > 0
        text, cell = cells_of(_texts(batch, 0))
        for k in (0, 1):
            counts[k] += np.bincount(cell[toxic[text] == k], minlength=1 << CELL_BITS)
    cell = np.flatnonzero(counts.any(axis=0))
    columns = [pa.array(cell), pa.array(counts[1][cell]), pa.array(counts[0][cell])]
    yield pa.RecordBatch.from_arrays(columns, names=["cell", "toxic", "other"])


def log_ratios(rows: DataFrame, toxic: int, other: int) -> DataFrame:
    """cell and scale of the cells whose log-count ratio is at least ``LEAST_Z`` standard errors away from 0."""
    counts = rows.mapInArrow(frugal(_count_cells), "cell bigint, toxic bigint, other bigint").groupBy("cell")
    counts = counts.agg(*((F.sum(c) + SMOOTHING).alias(c) for c in ("toxic", "other")))
    ratio = F.log(F.col("toxic") / (toxic + 2 * SMOOTHING)) - F.log(F.col("other") / (other + 2 * SMOOTHING))
    error = F.sqrt(1 / F.col("toxic") + 1 / F.col("other"))
    return counts.select("cell", ratio.alias("scale"), (F.abs(ratio) / error).alias("z")).where(f"z >= {LEAST_Z}").select("cell", "scale")


def _blocks(lists: pa.ChunkedArray) -> list[tuple[slice, np.ndarray, np.ndarray]]:
    """Stretches of rows with about ``_BLOCK`` numbers in their lists, a longer list by itself: the rows, the lengths of
    their lists, and the numbers, which stay where they are."""
    found, first = [], 0
    for chunk in lists.chunks:
        ends, numbers = chunk.offsets.to_numpy(), chunk.values.to_numpy()
        a = 0
        while a < len(chunk):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + _BLOCK, side="right")) - 1)
            found.append((slice(first + a, first + b), np.diff(ends[a : b + 1]), numbers[ends[a] : ends[b]]))
            a = b
        first += len(chunk)
    return found


def _fit(lists: pa.ChunkedArray, toxic: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients and constant of a lightly regularised logistic regression, by scaled gradient steps.

    ``lists`` has the numbers of each row's cells. A step goes through them block by block, each added to the sums of
    those before it, so that the driver holds four bytes for each number and nothing else of their size.
    """
    n, cells = len(toxic), len(scale)
    weight, constant = np.zeros(cells), float(np.log((toxic.sum() + 0.5) / ((1 - toxic).sum() + 0.5)))
    pace, constant_pace = np.zeros(cells), 0.0
    blocks, off = _blocks(lists), np.empty(n)
    for turn in range(300):
        scaled, step = scale * weight, np.zeros(cells)
        for rows, sizes, cell in blocks:
            row, cell = np.repeat(np.arange(len(sizes)), sizes), cell.astype(np.int64)
            total = np.bincount(row, weights=scaled[cell], minlength=len(sizes)) + constant
            off[rows] = 1 / (1 + np.exp(-np.clip(total, -500, 500))) - toxic[rows]
            np.add.at(step, cell, scale[cell] * off[rows][row])
        step = step / n + 1e-5 * weight
        pace = 0.9 * pace + 0.1 * step**2
        constant_pace = 0.9 * constant_pace + 0.1 * off.mean() ** 2
        rate = 0.05 / (1 + turn / 30)
        weight -= rate * step / (np.sqrt(pace) + 1e-8)
        constant -= rate * off.mean() / (np.sqrt(constant_pace) + 1e-8)
    return weight, constant


def learn(
    docs: DataFrame,
    labels: DataFrame,
    work: WorkFolder,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_training: int = MAX_TRAINING,
) -> Model:
    """Fit the classifier to the labelled documents that are not held out, ``max_training`` of them at most.

    Without rows of both labels, every score is the share of toxic ones, 0 without any rows.
    """
    rows = work.keep(training_rows(docs, labels, doc_id, text, label, max_training), "training")
    sizes = {r["toxic"] > 0: r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    toxic, other = sizes.get(True, 0), sizes.get(False, 0)
    none = np.zeros(0, np.int64)
    if not toxic or not other:
        return Model(none, none, 0.0, float(toxic > 0))
    found = log_ratios(rows, toxic, other).orderBy("cell").toArrow()
    cells, scale = found.column("cell").to_numpy(), found.column("scale").to_numpy()

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(1 << CELL_BITS, -1, np.int32)
        number[cells] = np.arange(len(cells), dtype=np.int32)
        wanted = number >= 0
        for batch in slices(batches, 0, _SLICE):
            text, cell = cells_of(_texts(batch, 0), wanted)
            ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=batch.num_rows))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(number[cell]))
            yield pa.RecordBatch.from_arrays([batch.column(1), lists], names=["toxic", "numbers"])

    # Ordered, so that the sums of the fit do not depend on where the rows were.
    fitted = rows.mapInArrow(frugal(vectors), "toxic int, numbers array<int>").orderBy("toxic", "numbers").toArrow()
    weight, constant = _fit(fitted.column("numbers"), (fitted.column("toxic").to_numpy() > 0).astype(float), scale)
    del fitted
    give_back()  # the driver's memory, too, is wanted by the steps to come
    return Model(cells, weight * scale, constant)


# --- scoring -------------------------------------------------------------------------------
def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1, higher: rather toxic), predicted (1 from 0.5 on).

    The whole text counts, of any length; a null text is empty and has the score of no features.
    Null and repeated doc_ids are rows like others; other columns are ignored.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)  # 16 bytes for each of at most 2**20 cells

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = given.value.scorer()
        for batch in slices(batches, 1, _SLICE):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(_texts(batch, 1)))], names=["doc_id", "score"])

    rows = docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(frugal(judge), f"doc_id {id_type}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that score below 0.5, with all their columns."""
    given = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = given.value.scorer()
        for batch in slices(batches, names.index(text), _SLICE):
            yield batch.filter(pa.array(scores(_texts(batch, names.index(text))) < 0.5))

    return docs.mapInArrow(frugal(keep), docs.schema)
