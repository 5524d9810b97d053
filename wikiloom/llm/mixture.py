"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks of words.

Each source is one stream: its documents in an order shuffled by hash, cut into blocks of equal
size. The mix is a row of slots. Slot ``i`` has the point ``frac(i * golden ratio)``, in 64-bit
integer arithmetic; the source whose stretch of the cumulative target weights holds the point gets
the slot, and the slot's rank among the source's slots names the block it takes, again from the
first one when the stream is through. Every prefix of the mix has the target weights up to a few
blocks. A source stops at exactly its target, inside a block if need be.

How many of the first ``n`` points fall into a stretch has a closed form, so a task ranks its slots
without seeing the others. Positions in the streams come from two levels of sums, by source and by
4,096 stretches of the shuffled order: a source that holds most rows is spread like any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wikiloom.llm.common import WORD, column, fresh, text_of
from wikiloom.session import WorkFolder

#: 2**64 divided by the golden ratio, odd: multiples of it modulo 2**64 are spread evenly.
GOLDEN = 0x9E3779B97F4A7C15
MODULUS = 1 << 64
#: Stretches of the shuffled order of a source whose sums are added up first.
STRETCHES = 4096


# --- targets -------------------------------------------------------------------------------
@dataclass(frozen=True)
class Source:
    """A source with its number in code point order, words, target and schedule."""

    index: int
    name: str | None
    size: int
    target: Fraction
    #: Words to take: the target without its fraction.
    quota: int
    #: Blocks of the stream, and slots the source needs for its quota.
    blocks: int
    slots: int


def capped_shares(sizes: Sequence[int], weights: Sequence[int], cap: int) -> list[Fraction]:
    """All words shared out by weight; no share is above ``cap`` times its size, the rest is shared again."""
    shares = [Fraction(0)] * len(sizes)
    left, free = Fraction(sum(sizes)), list(range(len(sizes)))
    while free:
        total = sum(weights[i] for i in free)
        above = [i for i in free if left * weights[i] > cap * sizes[i] * total]
        if not above:
            for i in free:
                shares[i] = left * weights[i] / total
            break
        for i in above:
            shares[i] = Fraction(cap * sizes[i])
        left -= sum(shares[i] for i in above)
        free = [i for i in free if i not in set(above)]
    return shares


def sources_of(sizes: dict[str | None, int], weights: Sequence[int], cap: int, block: int) -> list[Source]:
    names = sorted(sizes, key=lambda name: (name is None, name or ""))
    words = [sizes[name] for name in names]
    shares = capped_shares(words, [weights[i % len(weights)] for i in range(len(names))], cap)
    out = []
    for i, (name, size, share) in enumerate(zip(names, words, shares, strict=True)):
        quota, blocks = int(share), -(-size // block)
        turns, rest = divmod(quota, size) if size else (0, 0)
        out.append(Source(i, name, size, share, quota, blocks, turns * blocks + -(-rest // block)))
    return out


# --- schedule ------------------------------------------------------------------------------
def _floor_sum(n: int, m: int, a: int, b: int) -> int:
    """The sum of ``(a * i + b) // m`` over ``0 <= i < n``."""
    total = 0
    while True:
        total += (a // m) * n * (n - 1) // 2 + (b // m) * n
        a, b = a % m, b % m
        top = a * n + b
        if top < m:
            return total
        n, b = divmod(top, m)
        m, a = a, m


def points_below(n: int, threshold: int) -> int:
    """How many of the first ``n`` points are smaller than ``threshold``."""
    if n <= 0 or threshold <= 0:
        return 0
    return _floor_sum(n, MODULUS, GOLDEN, 0) - _floor_sum(n, MODULUS, GOLDEN, MODULUS - threshold) + n


def thresholds(sources: Sequence[Source]) -> list[int]:
    """The ends of the sources' stretches of 0 to 2**64, in their order."""
    total = sum((s.target for s in sources), Fraction(0))
    ends, summed = [], Fraction(0)
    for s in sources:
        summed += s.target
        ends.append(int(summed / total * MODULUS) if total else 0)
    return ends


def slots_needed(sources: Sequence[Source], ends: Sequence[int]) -> int:
    """The length of the shortest schedule in which every source gets the slots it needs."""
    most, begin = 0, 0
    for s, end in zip(sources, ends, strict=True):
        if s.slots and end == begin:
            raise ValueError(f"the weight of source {s.name!r} is below the resolution of the schedule")
        count = lambda n, a=begin, b=end: points_below(n, b) - points_below(n, a)
        if s.slots and count(most) < s.slots:
            low, high = most, max(1, 2 * most)
            while count(high) < s.slots:
                low, high = high, 2 * high
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (low, middle) if count(middle) >= s.slots else (middle, high)
            most = high
        begin = end
    return most


def _schedule(spark, sources: Sequence[Source], block: int) -> DataFrame:
    """One row per slot of the mix: slot, source_index, turn, block, begin and words (in the stream)."""
    ends = thresholds(sources)
    n = slots_needed(sources, ends)
    facts = [(s.size, s.quota, s.blocks, s.slots) for s in sources]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, quota, blocks, slots = (np.array(x, np.int64) for x in zip(*facts, strict=True))
        # Ends of 2**64 do not fit; the one point that is not below 2**64 - 1 is in the first stretch to end there.
        inner = np.array([min(e, MODULUS - 1) for e in ends], np.uint64)
        last = ends.index(MODULUS)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            if ids[-1] - ids[0] != len(ids) - 1:
                raise ValueError("a batch of slots must be a stretch of the schedule")
            points = ids.astype(np.uint64) * np.uint64(GOLDEN)
            source = np.minimum(np.searchsorted(inner, points, side="right"), last)
            below = [points_below(int(ids[0]), e) for e in ends]
            before = np.diff(np.array([0, *below], dtype=object)).astype(np.int64)
            order = np.argsort(source, kind="stable")
            first = np.searchsorted(source[order], np.arange(len(facts)))
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids)) - first[source[order]]
            rank += before[source]
            keep = rank < slots[source]
            source, rank, slot = source[keep], rank[keep], ids[keep]
            turn, at = rank // blocks[source], rank % blocks[source]
            begin = at * block
            words = np.minimum(np.minimum(block, size[source] - begin), quota[source] - turn * size[source] - begin)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(source.astype(np.int32)), pa.array(turn), pa.array(at), pa.array(words)],
                names=["slot", "source_index", "turn", "block", "block_words"],
            )

    return spark.range(0, n).mapInArrow(place, "slot bigint, source_index int, turn bigint, block bigint, block_words bigint")


# --- streams -------------------------------------------------------------------------------
@dataclass(frozen=True)
class Mix:
    """A planned mix.

    ``items``: one row per distinct (source, doc_id, text), with ``copies`` and ``begin``, its place
    in the stream. ``parts``: the mix, one row per slot and item in the slot's block: slot,
    source_index, turn, begin (of the item), item_from and item_to (words of the item).
    """

    sources: list[Source]
    items: DataFrame
    parts: DataFrame


def _code_points(sources: Sequence[Source]) -> list[tuple[int, str | None, int, float]]:
    return [(s.index, s.name, s.size, float(s.target)) for s in sources]


def item_print(text: Column) -> Column:
    return F.xxhash64(text)


def plan_mix(
    docs: DataFrame,
    work: WorkFolder,
    weights: Sequence[int] = (5, 2, 1),
    cap: int = 3,
    block: int = 256,
    seed: int = 1,
    max_sources: int = 100_000,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> Mix:
    """Plan a mix of all words of ``docs``.

    Sources in code point order, null last, get ``weights`` in turn, as many words in all as the
    documents have, and at most ``cap`` times their own words. The size of a document is its number
    of words; null and empty texts have none and are taken 0 times. Rows with equal source, doc_id
    and text are one item with copies that share what it gets evenly. Null doc_ids and sources are
    values like others. No words at all, or no rows, give an empty mix. A text of any length is an
    item that spans many blocks. The same rows give the same mix, however they are stored.

    One row per source goes through the driver; more than ``max_sources`` sources are an error.
    """
    spark = docs.sparkSession
    whole = text_of(docs, text)
    items = (
        docs.select(
            column(docs, source).cast("string").alias("source"),
            column(docs, doc_id).alias("doc_id"),
            F.regexp_count(whole, F.lit(WORD)).cast("bigint").alias("size"),
            item_print(whole).alias("print"),
        )
        .groupBy("source", "doc_id", "size", "print")
        .agg(F.count("*").alias("copies"))
    )
    items = work.keep(items, "items")
    totals = items.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    rows = totals.limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sources = sources_of({r["source"]: r["words"] for r in rows}, weights, cap, block)
    table = spark.createDataFrame(_code_points(sources), "source_index int, source string, source_size bigint, target double")
    known = table.select("source_index", F.col("source").alias("_source"), "source_size", "target")
    items = items.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    shuffled = items.where("size > 0").withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "print")).withColumn(
        "stretch", F.pmod(F.shiftrightunsigned("place", 40), F.lit(STRETCHES)).cast("int")
    )
    length = F.col("size") * F.col("copies")
    sums = shuffled.groupBy("source_index", "stretch").agg(F.sum(length).alias("stretch_words"))
    up_to = Window.partitionBy("source_index").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source_index", "stretch", F.coalesce(F.sum("stretch_words").over(up_to), F.lit(0)).alias("base"))
    within = (
        Window.partitionBy("source_index", "stretch")
        .orderBy("place", "doc_id", "size", "print")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        shuffled.withColumn("before", F.coalesce(F.sum(length).over(within), F.lit(0)))
        .join(bases, ["source_index", "stretch"])
        .withColumn("begin", F.col("base") + F.col("before"))
        .drop("base", "before", "stretch", "place")
    )
    empty = items.where("size = 0").withColumn("begin", F.lit(None).cast("bigint"))
    items = work.keep(placed.unionByName(empty), "placed")

    if sum(s.quota for s in sources) == 0:
        parts = spark.createDataFrame(
            [], "slot bigint, source_index int, turn bigint, begin bigint, item_from bigint, item_to bigint"
        )
        return Mix(sources, items, parts)
    spans = items.where("size > 0").select(
        "source_index",
        "begin",
        (F.col("begin") + length).alias("end"),
        F.explode(F.sequence(F.expr(f"begin div {block}"), F.expr(f"(begin + size * copies - 1) div {block}"))).alias("block"),
    )
    block_begin = F.col("block") * block
    parts = (
        _schedule(spark, sources, block)
        .join(spans, ["source_index", "block"])
        .select(
            "slot",
            "source_index",
            "turn",
            "begin",
            (F.greatest(F.col("begin"), block_begin) - F.col("begin")).alias("item_from"),
            (F.least(F.col("end"), block_begin + F.col("block_words")) - F.col("begin")).alias("item_to"),
        )
        .where("item_to > item_from")
    )
    return Mix(sources, items, parts)


def taken(mix: Mix) -> DataFrame:
    """One row per item: source, doc_id, size, print, copies, source_size, target, taken and more.

    Each of an item's ``copies`` gives ``taken`` words, and ``more`` of them one word besides.
    """
    words = mix.parts.groupBy("source_index", "begin").agg(F.sum(F.expr("item_to - item_from")).alias("words"))
    each = mix.items.join(words, ["source_index", "begin"], "left")
    each = each.withColumn("taken", F.expr("coalesce(words, 0) div copies")).withColumn("more", F.expr("coalesce(words, 0) % copies"))
    return each.drop("words", "begin")


def per_document(mix: Mix) -> DataFrame:
    """``taken`` with a row for each copy of an item, which together take all words that the item gives."""
    rows = taken(mix).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    share = F.col("taken") + (F.col("_copy") <= F.col("more")).cast("bigint")
    return rows.withColumn("taken", share).drop("_copy", "copies", "more")


def mixed_documents(
    docs: DataFrame,
    work: WorkFolder,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    n_chars: str = "n_chars",
    **how,
) -> DataFrame:
    """The documents as often as the mix takes them, with all columns of ``docs``.

    A document taken two and a half times gives two rows as they are and one with the first half of
    its words, joined by one space; ``n_chars``, where it exists, is then the length of those.
    Documents the mix does not take, among them all without words, are left out. Rows equal in
    source, doc_id and text take the same number of words each; what does not divide, less than one
    word for each of them, is left out here, for rows that are equal have no order.
    """
    mix = plan_mix(docs, work, doc_id=doc_id, text=text, source=source, **how)
    names = docs.columns
    s, i, p, n, size, turn = fresh(names, "mix_source", "mix_id", "mix_print", "mix_taken", "mix_size", "mix_turn")
    plan = taken(mix).where("taken > 0").select(
        F.col("source").alias(s), F.col("doc_id").alias(i), F.col("print").alias(p), F.col("taken").alias(n), F.col("size").alias(size)
    )
    rows = docs.withColumn(p, item_print(text_of(docs, text))).join(
        plan.withColumnRenamed(p, f"{p}_"),
        F.col(p).eqNullSafe(F.col(f"{p}_"))
        & column(docs, source).cast("string").eqNullSafe(F.col(s))
        & column(docs, doc_id).eqNullSafe(F.col(i)),
    )
    rows = rows.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("bigint"), F.ceil(F.col(n) / F.col(size)))))
    rest = F.least(F.col(size), F.col(n) - (F.col(turn) - 1) * F.col(size))
    first = F.slice(F.regexp_extract_all(column(rows, text), F.lit(WORD), 0), F.lit(1), rest.cast("int"))
    cut = F.when(rest == F.col(size), column(rows, text)).otherwise(F.array_join(first, " "))
    out = rows.withColumn(text, cut)
    if n_chars in names:
        out = out.withColumn(n_chars, F.length(column(out, text)).cast(docs.schema[n_chars].dataType))
    return out.select([column(out, name) for name in names])
