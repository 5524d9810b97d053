"""Ranked lexical search with range maxima over posting lists.

Documents are cut into segments of consecutive rows. A segment holds, for each term that some item
may hold, the list of its documents in order of doc_id; a fixed table of hashed term bits keeps the
other terms out, and the joins by the terms themselves make that exact. When all weights are known,
a segment builds a sparse table of range maxima over the impacts of its lists. An item starts with
one interval, all documents of the segment. The interval with the largest bound, the sum over the
item's terms of weight times the largest impact in the interval, is split at the document that
holds the largest of these; the document is scored exactly and the two sides get bounds of their
own. This ends when no bound reaches the k-th best score. Segments and groups of items meet once
each, and what they find, at most k rows per item, is merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wikiloom.llm.common import column
from wikiloom.llm.memory import frugal
from wikiloom.llm.tokens import slices
from wikiloom.session import WorkFolder

#: Maximal runs of ASCII letters and digits and of all characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEGMENT_DOCS, SEGMENT_POSTINGS = 4096, 1 << 20
GROUP_ITEMS = 1024
FILTER_BITS = 20
#: Intervals of an item that are split in one step, the best ones first.
SPLIT = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM_BYTES = bytes(
    i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256)
)


# --- terms ---------------------------------------------------------------------------------
def terms(text: Column) -> Column:
    """The distinct terms of a text; none of a null one."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)))


def split_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All terms of the texts one after the other, dictionary-encoded, and the text number of each."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = b"" if data is None else data[int(offsets[0]) : int(offsets[-1])].to_pybytes().translate(_TERM_BYTES)
    even = pa.StringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(raw))
    cut = pc.ascii_split_whitespace(even)
    bounds = cut.offsets.to_numpy()
    coded = cut.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    codes = coded.indices.to_numpy()
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:  # what stands before a first and behind a last blank
        some = codes != empty
        codes, text = codes[some], text[some]
    return coded.dictionary, codes, text


def _slots(words: pa.Array, bits: int) -> np.ndarray:
    """The number of the filter's bit for each word."""
    hashes = pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def term_filter(wanted: DataFrame) -> np.ndarray:
    """A table of 2**FILTER_BITS bits, those of the terms of ``wanted`` set; its size depends on nothing else."""
    bits = FILTER_BITS

    def slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slots(batch.column(0), bits)))], names=["slot"])

    found = wanted.select("term").mapInArrow(slots, "slot bigint").distinct().toArrow()
    table = np.zeros(1 << bits, bool)
    table[found.column("slot").to_numpy()] = True
    return table


# --- segments ------------------------------------------------------------------------------
class _Segment:
    """Documents and postings of the segment that a task is filling."""

    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.sizes: list[np.ndarray] = []
        self.words: list[pa.DictionaryArray] = []
        self.docs: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.n = self.postings = 0

    def add(self, ids: pa.Array, texts: pa.Array, wanted: np.ndarray) -> None:
        words, codes, text = split_terms(texts)
        keep = wanted[_slots(words, len(wanted).bit_length() - 1)] if len(words) else np.zeros(0, bool)
        of = keep[codes]
        pair, count = np.unique(text[of] * max(len(words), 1) + codes[of], return_counts=True)
        doc, code = np.divmod(pair, max(len(words), 1))
        kept = words.filter(pa.array(keep))
        self.words.append(pa.DictionaryArray.from_arrays(pa.array((np.cumsum(keep) - 1)[code].astype(np.int32)), kept))
        self.docs.append(doc + self.n)
        self.counts.append(count)
        self.ids.append(ids)
        self.sizes.append(np.bincount(text, minlength=len(texts)))
        self.n += len(texts)
        self.postings += len(pair)

    def rows(self, segment: int) -> pa.RecordBatch:
        """One row with the ids and lengths of the documents, by doc_id and nulls last, and one per term."""
        ids, sizes = pa.concat_arrays(self.ids), np.concatenate(self.sizes)
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy().astype(np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        coded = pa.chunked_array(self.words).unify_dictionaries().combine_chunks()
        coded = coded if isinstance(coded, pa.DictionaryArray) else coded.chunk(0)
        code, doc = coded.indices.to_numpy().astype(np.int64), place[np.concatenate(self.docs)]
        by = np.argsort(code * max(self.n, 1) + doc)
        code, doc, count = code[by], doc[by], np.concatenate(self.counts)[by]
        begins = np.flatnonzero(np.diff(code, prepend=-1))
        lists = np.concatenate([[0, 0], begins[1:], [len(code)]]).astype(np.int32) if len(code) else np.zeros(2, np.int32)
        n = len(begins)
        size_ends = np.concatenate([[0], np.full(n + 1, self.n)]).astype(np.int32)
        counts_ends = np.concatenate([[0], lists[1:] + self.n]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n + 1, segment)),
                pa.concat_arrays([pa.nulls(1, pa.string()), coded.dictionary.take(pa.array(code[begins]))]),
                pa.ListArray.from_arrays(pa.array(size_ends), ids.take(pa.array(order))),
                pa.ListArray.from_arrays(pa.array(lists), pa.array(doc.astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(counts_ends), pa.array(np.concatenate([sizes[order], count]).astype(np.int32))),
            ],
            names=["segment", "term", "ids", "docs", "counts"],
        )


def segments(docs: DataFrame, wanted: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """segment, term, ids, docs, counts: the inverted lists of the documents, see ``_Segment.rows``.

    In the row without a term, ids and counts are the doc_ids and numbers of terms of the segment's
    documents; in the others, docs and counts are the places and term counts of the documents with
    the term. Only terms whose bit is set in ``wanted`` are there.
    """
    given = docs.sparkSession.sparkContext.broadcast(wanted)

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        made = _Segment()
        for batch in slices(batches, 1):
            for a in range(0, batch.num_rows, SEGMENT_DOCS):
                part = batch.slice(a, SEGMENT_DOCS)
                if made.n and made.n + part.num_rows > SEGMENT_DOCS:
                    yield made.rows(number)
                    number, made = number + 1, _Segment()
                made.add(part.column(0), part.column(1), given.value)
                if made.postings >= SEGMENT_POSTINGS:
                    yield made.rows(number)
                    number, made = number + 1, _Segment()
        if made.n:
            yield made.rows(number)

    rows = docs.select(column(docs, doc_id).cast("bigint").alias("doc_id"), column(docs, text).cast("string").alias("text"))
    return rows.mapInArrow(
        frugal(fill), "segment bigint, term string, ids array<bigint>, docs array<int>, counts array<int>"
    )


# --- search in a segment -------------------------------------------------------------------
class RangeMaxima:
    """Posting lists one after the other, their impacts, and where the largest impact of any range of a list is."""

    def __init__(self, lists: list[np.ndarray], impacts: list[np.ndarray], docs: int):
        self.docs = max(docs, 1)
        self.ends = np.cumsum([len(x) for x in lists], dtype=np.int64)
        self.keys = np.concatenate([x.astype(np.int64) + k * self.docs for k, x in enumerate(lists)])
        self.impacts = np.concatenate(impacts)
        longest = max(len(x) for x in lists)
        self.logs = np.zeros(longest + 1, np.int64)
        for n in range(2, longest + 1):
            self.logs[n] = self.logs[n >> 1] + 1
        level = np.arange(len(self.keys), dtype=np.int32)
        levels = [level]
        for j in range(int(self.logs[longest])):
            reach = np.minimum(np.arange(len(level)) + (1 << j), len(level) - 1)
            other = level[reach]
            level = np.where(self.impacts[other] > self.impacts[level], other, level)
            levels.append(level)
        self.levels = np.stack(levels)

    def largest(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and impact of the largest in each range; impact 0 of an empty one."""
        size = end - begin
        log = self.logs[np.maximum(size, 0)]
        last = len(self.keys) - 1
        a = self.levels[log, np.minimum(begin, last)]
        b = self.levels[log, np.clip(end - (1 << log), 0, last)]
        at = np.where(self.impacts[b] > self.impacts[a], b, a)
        return at, np.where(size > 0, self.impacts[at], 0)

    def search(self, lists: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the best ``k`` with a score above 0; of equal scores, smaller documents first."""
        best, best_docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin = np.where(lists > 0, self.ends[lists - 1], 0)[None, :]
        end = self.ends[lists][None, :]
        low = np.zeros(1, np.int64)

        def bounded(begin: np.ndarray, end: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, ...]:
            at, impact = self.largest(begin, end)
            parts = impact * weights
            bound = parts.sum(axis=1)
            top = parts.argmax(axis=1)
            split = self.keys[at[np.arange(len(at)), top]] - lists[top] * self.docs
            some = bound > 0
            return begin[some], end[some], low[some], bound[some], split[some]

        open_ = bounded(begin, end, low)
        while len(open_[3]):
            if len(best) == k:
                useful = (open_[3] > best[-1]) | ((open_[3] == best[-1]) & (open_[2] < best_docs[-1]))
                open_ = tuple(x[useful] for x in open_)
                if not len(open_[3]):
                    break
            if len(open_[3]) > SPLIT:
                order = np.argpartition(-open_[3], SPLIT - 1)
            else:
                order = np.arange(len(open_[3]))
            now, later = order[:SPLIT], order[SPLIT:]
            begin, end, low, _, split = (x[now] for x in open_)
            wanted = lists * self.docs + split[:, None]
            at = np.searchsorted(self.keys, wanted)
            hit = (at < end) & (self.keys[np.minimum(at, len(self.keys) - 1)] == wanted)
            score = (np.where(hit, self.impacts[np.minimum(at, len(self.keys) - 1)], 0) * weights).sum(axis=1)
            best, best_docs = np.concatenate([best, score]), np.concatenate([best_docs, split])
            top = np.lexsort((best_docs, -best))[:k]
            best, best_docs = best[top], best_docs[top]
            sides = bounded(
                np.concatenate([begin, at + hit]), np.concatenate([at, end]), np.concatenate([low, split + 1])
            )
            open_ = tuple(np.concatenate([x[later], y]) for x, y in zip(open_, sides, strict=True))
        return best_docs, best


def _impacts(counts: np.ndarray, sizes: np.ndarray, documents: int, total: int) -> np.ndarray:
    """The impact of a term that occurs ``counts`` times in documents of ``sizes`` terms."""
    length = 100 - 90 + (90 * sizes * documents) // total
    return (1_000_000_000 * counts) // (1000 * counts + 8 * length)


def search_segment(
    rows: pa.Table, items: list[tuple[list[str], list[int]]], documents: int, total: int, k: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and scores of the ``k`` best documents of a segment (its rows, see ``segments``) for each item (terms, weights)."""
    names = rows.column("term").to_pylist()
    info = names.index(None)
    sizes = rows.column("counts")[info].values.to_numpy().astype(np.int64)
    asked = {t for words, _ in items for t in words}
    lists, impacts, number = [], [], {}
    for row, name in enumerate(names):
        if name is not None and name in asked:
            docs = rows.column("docs")[row].values.to_numpy()
            counts = rows.column("counts")[row].values.to_numpy().astype(np.int64)
            number[name] = len(lists)
            lists.append(docs)
            impacts.append(_impacts(counts, sizes[docs], documents, total))
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not lists:
        return [nothing] * len(items)
    index = RangeMaxima(lists, impacts, len(sizes))
    found = []
    for words, weights in items:
        here = [(number[t], w) for t, w in zip(words, weights, strict=True) if t in number and w > 0]
        if here:
            found.append(index.search(np.array([x for x, _ in here], np.int64), np.array([w for _, w in here], np.int64), k))
        else:
            found.append(nothing)
    return found


# --- job -----------------------------------------------------------------------------------
def search(
    docs: DataFrame,
    items: DataFrame,
    work: WorkFolder,
    k: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``k`` best documents for each item.

    Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII in the whole
    text, only A to Z lower-cased. With N documents that have terms and L terms in all, a document
    of n terms and m = 10 + 90nN div L scores for each term of the item the product of its weight,
    floor(1000 ln((2N + 2) / (2df + 1))), and 10**9 tf div (1000 tf + 8m). Only scores above 0 are returned; equal ones go to the smaller
    doc_id, a null one comes last. Null and empty texts have no terms: such a document is never
    found, such an item finds nothing. Repeated documents are found as often as they are there;
    items that repeat id and terms count once, those that repeat the id alone are answered each. No
    documents or no items give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    asked = items.select(column(items, item_id).alias("item_id"), F.array_sort(terms(column(items, item_text))).alias("terms"))
    asked = work.keep(asked.withColumn("item", F.xxhash64("terms")).distinct(), "items")
    held = asked.select("item_id", "item", F.explode("terms").alias("term"))
    parts = work.keep(segments(docs, term_filter(held.select("term").distinct()), doc_id, text), "segments")

    info = parts.where("term is null")
    size = F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, n: s + n)
    row = info.agg(
        F.count("*").alias("segments"), F.sum(F.size(F.filter("counts", lambda n: n > 0))).alias("documents"), F.sum(size).alias("total")
    ).head()
    documents, total, buckets = int(row["documents"] or 0), int(row["total"] or 0), max(1, row["segments"])
    out_type = f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, doc_id bigint, score bigint"
    if not total:
        return spark.createDataFrame([], out_type)

    found = parts.where("term is not null").groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2) / (2 * F.col("df") + 1)))
    weighted = held.join(found.select("term", weight.alias("weight")), "term")
    weighted = weighted.groupBy("item_id", "item").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("terms"))
    weighted = work.keep(weighted, "weighted")
    groups = max(1, -(-weighted.count() // GROUP_ITEMS))

    def meet(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        ids: list[pa.Array] = []
        if rows.num_rows and queries.num_rows:
            held = queries.column("terms").to_pylist()
            these = [([x["term"] for x in e], [x["weight"] for x in e]) for e in held]
            of = rows.column("segment").to_numpy()
            for segment in np.unique(of):
                part = rows.filter(pa.array(of == segment)).combine_chunks()
                places = part.column("ids")[part.column("term").to_pylist().index(None)].values
                for n, (docs, scores) in enumerate(search_segment(part, these, documents, total, k)):
                    out[0].append(np.full(len(docs), n))
                    out[1].append(scores)
                    ids.append(places.take(pa.array(docs)))
        none = np.zeros(0, np.int64)
        row = pa.array(np.concatenate([none, *out[0]]))
        return pa.table(
            {
                "item_id": queries.column("item_id").take(row),
                "item": queries.column("item").take(row),
                "doc_id": pa.chunked_array(ids, pa.int64()),
                "score": pa.array(np.concatenate([none, *out[1]])),
            }
        )

    bucket = F.pmod(F.xxhash64("segment"), F.lit(buckets)).cast("int")
    left = parts.select(bucket.alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "segment", "term", "ids", "docs", "counts")
    group = F.pmod(F.xxhash64("item_id", "item"), F.lit(groups)).cast("int")
    right = weighted.select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), group.alias("group"), "item_id", "item", "terms")
    id_type = asked.schema["item_id"].dataType.simpleString()
    hits = (
        left.groupBy("bucket", "group")
        .cogroup(right.groupBy("bucket", "group"))
        .applyInArrow(meet, f"item_id {id_type}, item bigint, doc_id bigint, score bigint")
    )
    order = Window.partitionBy("item_id", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


#: The ten best documents of each benchmark item.
SEARCH_SQL = r"""
with terms as (
    select row_number() over () as doc, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words
    from documents
),
facts as (
    select count(*)::bigint as total_docs, sum(len(words))::bigint as total_terms from terms where len(words) > 0
),
items as (
    select item_id, unnest(list_distinct(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) as term
    from (select distinct item_id, text from benchmark)
),
each_word as (select doc, doc_id, len(words)::bigint as n, unnest(words) as term from terms),
postings as (
    select doc, doc_id, n, term, count(*)::bigint as tf from each_word
    where term in (select term from items) group by all
),
weights as (
    select term, floor(1000 * ln((2 * total_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as weight
    from postings, facts group by term, total_docs
),
scored as (
    select item_id, doc, doc_id,
        sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * total_docs) // total_terms))))::bigint as score
    from items join weights using (term) join postings using (term), facts
    group by all
),
ranked as (
    select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0
)
select item_id, rank::integer as rank, doc_id, score from ranked where rank <= 10
"""
