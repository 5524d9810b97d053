"""Hard negatives by an inverted multi-index that is searched exactly.

Vectors are integer terms, as in the exact search. Their two halves have a codebook each, learned
from a bounded sample; a pair of codes is a cell, and every vector lies in one. In a shard of
vectors each code knows the largest distance of its halves to the centroid, its radius. For an
anchor, centroid product plus anchor length times radius bounds the product of any half with that
code, so the sum over both halves bounds every score in a cell. The multi-sequence heap visits cells
in descending order of that sum. Positives are found first: the visit ends when the next cell cannot
reach the last positive. Their scores then give the windows that negatives must lie in. The second
visit ends when every window is certified: the next cell can reach neither the window nor the last
negative found in it. Cells that lie above all windows, by the same bounds from below, are passed
over. Shards and groups of anchors meet once per visit; what they find is merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wikiloom.llm.common import column
from wikiloom.session import WorkFolder

#: Rows that the codebooks are learned from at most, and centroids of each half.
SAMPLE_ROWS, CENTROIDS = 4096, 8
#: A shard holds 2**SHARD_BITS vectors at most.
SHARD_BITS, GROUP_ANCHORS = 14, 512
#: Vectors of the cells that are scored before what they add is merged, at first and at most.
MERGE_FIRST, MERGE_MOST = 256, 4096
#: What bounds are raised by, against rounding: scores are whole numbers.
SLACK = 0.5


# --- vectors -------------------------------------------------------------------------------
def labelled_terms(vectors: DataFrame, label: Column, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, label and terms (``floor(scale * x)`` of each component) of the rows that take part.

    Rows without a vec_id, label or vector, and vectors with null or non-finite components, do not.
    """
    x = column(vectors, embedding).cast("array<double>")
    rows = vectors.select(column(vectors, vec_id).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), x.alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where("vec_id is not null and label is not null and x is not null").where(finite)
    return rows.select("vec_id", "label", F.transform("x", lambda v: F.floor(v * scale)).alias("terms"))


def matrix_of(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of whole numbers as rows of ``width`` columns, with zeros behind the short ones."""
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = flat.value_lengths().to_numpy()
    out = np.zeros((len(flat), width), np.int64)
    row = np.repeat(np.arange(len(flat)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat.flatten().to_numpy()
    return out


# --- codebooks -----------------------------------------------------------------------------
def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, up to the same amount for all centres of a point."""
    return (centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T


def _centroids(points: np.ndarray, turns: int = 10) -> np.ndarray:
    """At most ``CENTROIDS`` means of the distinct points, from evenly spaced ones."""
    distinct = np.unique(points, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(CENTROIDS, len(distinct))).astype(np.int64)]
    for _ in range(turns):
        code = _distances(points, centres).argmin(axis=1)
        n = np.bincount(code, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, code, points)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


@dataclass(frozen=True)
class Codebooks:
    """Centroids of the first ``half`` terms and of the others."""

    first: np.ndarray
    second: np.ndarray
    half: int
    width: int


def learn_codebooks(rows: DataFrame, width: int) -> Codebooks:
    """Codebooks from at most ``SAMPLE_ROWS`` rows, those with the smallest hashes; any would give right results."""
    order = F.xxhash64("vec_id", "terms")
    sample = rows.select("terms", order.alias("h")).orderBy("h", "terms").limit(SAMPLE_ROWS).select("terms").toArrow()
    points = matrix_of(sample.column("terms"), width).astype(float)
    half = width // 2
    return Codebooks(_centroids(points[:, :half]), _centroids(points[:, half:]), half, width)


class MultiIndex:
    """The vectors of a shard by cell, with radii of the codes; ``largest`` is the largest term of any anchor.

    Products are taken in doubles where all sums are exact in them, else in 64-bit integers.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, books: Codebooks, largest: int):
        self.books = books
        exact = float(np.abs(matrix.astype(float)).max(initial=0)) * largest * books.width < 2**53
        halves = (matrix[:, : books.half].astype(float), matrix[:, books.half :].astype(float))
        codes, self.radii = [], []
        for points, centres in zip(halves, (books.first, books.second), strict=True):
            code = _distances(points, centres).argmin(axis=1)
            away = np.sqrt(((points - centres[code]) ** 2).sum(axis=1))
            radius = np.full(len(centres), -1.0)  # a code that no vector has
            np.maximum.at(radius, code, away)
            codes.append(code)
            self.radii.append(radius)
        cell = codes[0] * len(books.second) + codes[1]
        order = np.lexsort((ids, cell))
        self.ids, self.labels, self.matrix = ids[order], labels[order], matrix[order].astype(float if exact else np.int64)
        cells, begins = np.unique(cell[order], return_index=True)
        ends = np.append(begins[1:], len(ids))
        self.ranges = {int(c): (int(a), int(b)) for c, a, b in zip(cells, begins, ends, strict=True)}

    def _half_bounds(self, query: np.ndarray) -> Iterator[tuple[list[int], list[float], list[float]]]:
        """Codes of a half by descending upper bound, and their upper and lower bounds."""
        parts = (query[: self.books.half], query[self.books.half :])
        for part, centres, radius in zip(parts, (self.books.first, self.books.second), self.radii, strict=True):
            product, reach = centres @ part, float(np.sqrt((part.astype(float) ** 2).sum())) * radius
            order = np.argsort(-(product + reach), kind="stable")
            order = order[radius[order] >= 0]
            yield order.tolist(), (product + reach)[order].tolist(), (product - reach)[order].tolist()

    def visit(self, query: np.ndarray) -> Iterator[tuple[float, float, slice]]:
        """Upper bound, lower bound and rows of each cell that holds vectors, by descending upper bound."""
        (first, high_1, low_1), (second, high_2, low_2) = self._half_bounds(query)
        codes = len(self.books.second)
        heap = [(-(high_1[0] + high_2[0]), 0, 0)] if first and second else []
        reached = [0] * len(first)  # how many cells of each first code were taken
        while heap:
            bound, i, j = heappop(heap)
            reached[i] = j + 1
            # The next cells are those whose neighbours before them, in both sequences, are all taken.
            if j + 1 < len(second) and (i == 0 or reached[i - 1] > j + 1):
                heappush(heap, (-(high_1[i] + high_2[j + 1]), i, j + 1))
            if i + 1 < len(first) and reached[i + 1] == j:
                heappush(heap, (-(high_1[i + 1] + high_2[j]), i + 1, j))
            rows = self.ranges.get(first[i] * codes + second[j])
            if rows is not None:
                slack = SLACK + 1e-9 * abs(bound)
                yield slack - bound, low_1[i] + low_2[j] - slack, slice(*rows)

    def _taken(self, taken: list[slice], query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """vec_ids, labels and scores of the vectors of some cells."""
        query = query.astype(self.matrix.dtype)
        scores = np.concatenate([self.matrix[rows] @ query for rows in taken]).astype(np.int64)
        return np.concatenate([self.ids[rows] for rows in taken]), np.concatenate([self.labels[rows] for rows in taken]), scores

    def positives(self, own: int, label: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """vec_ids and scores of the best ``k`` vectors with the label and another vec_id; ties by vec_id."""
        best = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def merge() -> None:
            nonlocal best
            ids, labels, scores = self._taken(taken, query)
            keep = (labels == label) & (ids != own)
            if len(best[1]) == k:
                keep &= scores >= best[1][-1]
            best = _best(best, ids[keep], scores[keep], k)

        taken: list[slice] = []
        size, most = 0, MERGE_FIRST
        for bound, _, rows in self.visit(query):
            if len(best[1]) == k and bound < best[1][-1]:
                break
            taken.append(rows)
            size += rows.stop - rows.start
            if size >= most:
                merge()
                taken, size, most = [], 0, min(2 * most, MERGE_MOST)
        if taken:
            merge()
        return best

    def negatives(
        self, label: int, query: np.ndarray, lows: list[int], highs: list[int], k: int
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window from low to high, the best ``k`` vectors of other labels with a score in it."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(lows)
        open_ = [w for w in range(len(lows)) if lows[w] <= highs[w]]
        if not open_:
            return found
        top = max(highs[w] for w in open_)
        least = list(lows)  # what a score must reach to matter to a window

        def merge() -> None:
            ids, labels, scores = self._taken(taken, query)
            some = (labels != label) & (scores >= min(least[w] for w in open_)) & (scores <= top)
            ids, scores = ids[some], scores[some]
            for w in open_:
                inside = (scores >= least[w]) & (scores <= highs[w])
                if inside.any():
                    found[w] = _best(found[w], ids[inside], scores[inside], k)
                    if len(found[w][1]) == k:
                        least[w] = int(found[w][1][-1])

        taken: list[slice] = []
        size, most = 0, MERGE_FIRST
        for bound, floor, rows in self.visit(query):
            if bound < least[open_[0]]:
                open_ = [w for w in open_ if bound >= least[w]]  # the others are certified
                if not open_:
                    break
            if floor > top:
                continue
            taken.append(rows)
            size += rows.stop - rows.start
            if size >= most:
                merge()
                taken, size, most = [], 0, min(2 * most, MERGE_MOST)
        if taken:
            open_ = [w for w in range(len(lows)) if lows[w] <= highs[w]]
            merge()
        return found


def _best(best: tuple[np.ndarray, np.ndarray], ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """vec_ids and scores of the best ``k`` of both; of equal scores, smaller vec_ids."""
    ids, scores = np.concatenate([best[0], ids]), np.concatenate([best[1], scores])
    top = np.lexsort((ids, -scores))[:k]
    return ids[top], scores[top]


# --- job -----------------------------------------------------------------------------------
def mine(
    vectors: DataFrame,
    anchors: DataFrame,
    work: WorkFolder,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    Positives of an anchor are the best rows of ``vectors`` with its label and another vec_id.
    Negatives of a positive are the best rows with another label whose score lies between ``low`` and
    ``high`` percent of the positive's; fewer are all returned. Ties go to the smaller vec_id. Labels
    are whole numbers. Rows without a vec_id, label or vector, and vectors with null or non-finite
    components, take no part; vectors of different lengths are padded with zeros. Rows that repeat
    are found as often as they are there; anchors that repeat vec_id, label and vector count once,
    those that repeat the vec_id alone are answered each. Scores must fit into 64 bits. No vectors
    or no anchors give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = labelled_terms(vectors, column(vectors, label), scale, vec_id, embedding)
    rows = work.keep(rows.withColumn("shard", F.shiftright(F.monotonically_increasing_id(), SHARD_BITS)), "terms")
    asked = labelled_terms(anchors, column(anchors, label), scale, vec_id, embedding).withColumn("anchor", F.xxhash64("label", "terms"))
    asked = work.keep(asked.withColumnRenamed("vec_id", "anchor_id").distinct(), "anchors")
    of_rows = rows.agg(F.count_distinct("shard").alias("shards"), F.max(F.size("terms")).alias("width")).head()
    of_anchors = asked.agg(F.count("*").alias("n"), F.max(F.size("terms")).alias("width")).head()
    width = max(2, of_rows["width"] or 0, of_anchors["width"] or 0)  # two halves, also of empty vectors
    names = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not of_rows["shards"] or not of_anchors["n"]:
        return spark.createDataFrame([], names)
    books = spark.sparkContext.broadcast(learn_codebooks(rows, width))  # 2 x CENTROIDS rows of half the width
    buckets, groups = of_rows["shards"], -(-of_anchors["n"] // GROUP_ANCHORS)

    bucket = F.pmod(F.xxhash64("shard"), F.lit(buckets)).cast("int")
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    every_bucket = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    group = F.pmod(F.xxhash64("anchor_id", "anchor"), F.lit(groups)).cast("int")
    left = rows.select(bucket.alias("bucket"), every_group.alias("group"), "shard", "vec_id", "label", "terms")

    def indexes(table: pa.Table, asked: np.ndarray) -> Iterator[MultiIndex]:
        shard, largest = table.column("shard").to_numpy(), int(np.abs(asked).max())
        for s in np.unique(shard):
            part = table.filter(pa.array(shard == s))
            yield MultiIndex(
                part.column("vec_id").to_numpy(), part.column("label").to_numpy(), matrix_of(part.column("terms"), width), books.value, largest
            )

    def find_positives(table: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], []]
        if table.num_rows and queries.num_rows:
            own, labels, asked = queries.column("anchor_id").to_numpy(), queries.column("label").to_numpy(), matrix_of(queries.column("terms"), width)
            for index in indexes(table, asked):
                for n in range(len(own)):
                    ids, scores = index.positives(int(own[n]), int(labels[n]), asked[n], positives)
                    for out, x in zip(found, (np.full(len(ids), n), ids, scores), strict=True):
                        out.append(x)
        row, ids, scores = (np.concatenate([np.zeros(0, np.int64), *x]) for x in found)
        of = [queries.column(c).take(pa.array(row)) for c in ("anchor_id", "anchor")]
        return pa.table([*of, pa.array(ids), pa.array(scores)], names=["anchor_id", "anchor", "vec_id", "score"])

    right = asked.select(every_bucket.alias("bucket"), group.alias("group"), "anchor_id", "anchor", "label", "terms")
    hits = (
        left.groupBy("bucket", "group")
        .cogroup(right.groupBy("bucket", "group"))
        .applyInArrow(find_positives, "anchor_id bigint, anchor bigint, vec_id bigint, score bigint")
    )
    order = Window.partitionBy("anchor_id", "anchor").orderBy(F.desc("score"), "vec_id")
    best = hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    best = best.groupBy("anchor_id", "anchor").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))
    best = work.keep(asked.join(best, ["anchor_id", "anchor"]), "positives")

    def find_negatives(table: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if table.num_rows and queries.num_rows:
            labels, asked, held = queries.column("label").to_numpy(), matrix_of(queries.column("terms"), width), queries.column("best").to_pylist()
            lows = [[-(-low * x["score"] // 100) for x in b] for b in held]
            highs = [[high * x["score"] // 100 for x in b] for b in held]
            for index in indexes(table, asked):
                for n in range(len(labels)):
                    for w, (ids, scores) in enumerate(index.negatives(int(labels[n]), asked[n], lows[n], highs[n], negatives)):
                        for x, y in zip(out, (np.full(len(ids), n), np.full(len(ids), w), ids, scores), strict=True):
                            x.append(y)
        row, window, ids, scores = (np.concatenate([np.zeros(0, np.int64), *x]) for x in out)
        of = [queries.column(c).take(pa.array(row)) for c in ("anchor_id", "anchor")]
        return pa.table([*of, pa.array(window), pa.array(ids), pa.array(scores)], names=["anchor_id", "anchor", "window", "negative_id", "negative_score"])

    right = best.select(every_bucket.alias("bucket"), group.alias("group"), "anchor_id", "anchor", "label", "terms", "best")
    hits = (
        left.groupBy("bucket", "group")
        .cogroup(right.groupBy("bucket", "group"))
        .applyInArrow(find_negatives, "anchor_id bigint, anchor bigint, window bigint, negative_id bigint, negative_score bigint")
    )
    order = Window.partitionBy("anchor_id", "anchor", "window").orderBy(F.desc("negative_score"), "negative_id")
    near = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    of = best.select("anchor_id", "anchor", F.posexplode("best").alias("window", "x"))
    of = of.select("anchor_id", "anchor", F.col("window").cast("bigint").alias("window"), F.col("x.vec_id").alias("positive_id"), F.col("x.score").alias("positive_score"))
    return near.join(of, ["anchor_id", "anchor", "window"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


#: Hard negatives of every fiftieth vector, by a scan of all pairs of anchors and rows.
NEGATIVES_SQL = """
with rows as (
    select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as terms
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
anchors as (select * from rows where vec_id % 50 = 0),
pairs as (
    select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same,
        list_dot_product(a.terms, r.terms)::bigint as score
    from anchors a, rows r
),
positives as (
    select anchor_id, vec_id as positive_id, score as positive_score from pairs where same and vec_id <> anchor_id
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
),
negatives as (
    select p.anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score,
        row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as rank
    from positives p join pairs n
        on p.anchor_id = n.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
)
select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score
from negatives where rank <= 3
"""
