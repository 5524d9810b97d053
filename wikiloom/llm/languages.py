"""Language identification: multinomial naive Bayes on hashed character n-grams.

Every task counts the n-grams of its texts by language into one table of cells; Spark sums the
tables. The logarithms of the smoothed shares form a matrix of languages and cells of at most 2**22
entries, whatever the corpus: more languages get fewer cells each. It is broadcast, and a batch of
texts is scored by gathering the columns of its n-grams. Texts are handled whole, in stretches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikiloom.llm.common import column
from wikiloom.llm.grams import BASE, mix
from wikiloom.llm.memory import frugal
from wikiloom.llm.tokens import slices

ORDERS = (1, 2, 3)
#: Bits of a cell number at most, and of the entries of the whole matrix.
CELL_BITS, MATRIX_BITS = 18, 22
SMOOTHING = 0.1
#: The answer for texts without a letter.
UNKNOWN = "und"
_STRETCH = 1 << 18


def cell_bits(languages: int) -> int:
    return max(0, min(CELL_BITS, MATRIX_BITS - (languages - 1).bit_length()))


def cells_of(texts: list[str], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text numbers and cells of all n-grams of the texts, with repeats, a stretch of characters at a time.

    Texts are lower-cased, white space is one space, also before and after the text.
    """
    even = [f" {' '.join(t.lower().split())} " for t in texts]
    points = np.frombuffer("".join(even).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.array([len(t) for t in even], np.int64))
    for a in range(0, len(points), _STRETCH):
        part = points[a : a + _STRETCH + max(ORDERS) - 1].astype(np.uint64)
        at = np.arange(a, min(a + _STRETCH, len(points)))
        text = np.searchsorted(ends, at, side="right")
        room = ends[text] - at
        found = []
        hashes = np.zeros(len(at), np.uint64)
        for k in range(max(ORDERS)):
            more = part[k : k + len(at)]
            hashes = hashes * BASE
            hashes[: len(more)] += more + np.uint64(1)
            if k + 1 in ORDERS:
                whole = room > k
                found.append((text[whole], (mix(hashes[whole] + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(int(whole.sum()), np.int64)))
        yield np.concatenate([t for t, _ in found]), np.concatenate([c for _, c in found])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    """Languages in order, the logarithm of each one's share of documents, and of each cell's share within it."""

    languages: list[str]
    priors: np.ndarray
    matrix: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its probability; of equal ones the first."""
        read = [k for k, t in enumerate(texts) if t is not None and has_letter(t)] if self.languages else []
        names, sure = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not read:
            return names, sure
        bits = self.matrix.shape[1].bit_length() - 1
        total = np.tile(self.priors, (len(read), 1))
        for text, cell in cells_of([texts[k] for k in read], bits):
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(text, weights=self.matrix[k][cell], minlength=len(read))
        best = total.argmax(axis=1)
        sure[read] = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        for k, b in zip(read, best.tolist(), strict=True):
            names[k] = self.languages[b]
        return names, sure


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text is 1 modulo 3; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit the classifier to all texts with a language that are not held out.

    Rows without a doc_id, text or language teach nothing; repeated rows count as often as they are
    there. Values of ``lang`` are taken as they are. The driver sees one row for each language and
    for each entry of the matrix that is not 0. Without rows the model knows no language.
    """
    rows = docs.select(
        column(docs, text).cast("string").alias("text"), column(docs, lang).cast("string").alias("lang"), column(docs, doc_id).alias("id")
    ).where("id is not null and text is not null and lang is not null")
    rows = rows.where(~held_out(F.col("id"))).select("text", "lang")
    known = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect())
    languages = [name for name, _ in known]
    if not languages:
        return Model([], np.zeros(0), np.zeros((0, 1), np.float32))
    bits, number = cell_bits(len(languages)), {name: k for k, name in enumerate(languages)}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(number) << bits, np.int64)
        for batch in slices(batches, 0):
            of = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for text, cell in cells_of(batch.column(0).to_pylist(), bits):
                total += np.bincount((of[text] << bits) | cell, minlength=len(total))
        entry = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(entry), pa.array(total[entry])], names=["entry", "n"])

    counts = rows.mapInArrow(frugal(count), "entry bigint, n bigint").groupBy("entry").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.full(len(languages) << bits, SMOOTHING)
    matrix[counts.column("entry").to_numpy()] += counts.column("n").to_numpy()
    matrix = matrix.reshape(len(languages), -1)
    documents = np.array([n for _, n in known], float)
    return Model(
        languages, np.log(documents / documents.sum()), np.log(matrix / matrix.sum(axis=1, keepdims=True)).astype(np.float32)
    )


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred and score, the model's probability of that language.

    The whole text counts, of any length. A null text, one without a letter (so an empty one), and
    every text if the model knows no language, get ``und`` and 0. Null and repeated doc_ids are rows
    like others; other columns are ignored.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**22 entries of 4 bytes

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            names, sure = given.value.predict(batch.column(1).to_pylist())
            columns = [batch.column(0), pa.array(names, pa.string()), pa.array(sure)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])

    rows = docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(frugal(judge), f"doc_id {id_type}, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
