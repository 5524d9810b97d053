"""N-gram Jaccard join by vertical partitioning of one global order of shingles.

1. An up and down sweep (``sweep``) counts in how many documents each shingle occurs, by the upper
   48 bits of its hash. The global order is by the power of two below that number, then by hash.
   Shingles of one document come first and can never overlap. (Two shingles with the same upper
   bits count as one more frequent shingle: more work, but no other result.)
2. Documents with the same set become one node, by a 128-bit sum of the set. A set of ``n``
   shingles can be similar to another only if at most ``(1 - t) n`` of them are its own alone;
   all other documents are done here, and for the rest only shared shingles are kept.
3. Two similar sets share a shingle among the first ``n - ceil(t n) + 1`` of the order. Sets are
   candidates if they do, and if their sizes, the positions of the shared shingle and their marks
   allow enough overlap. The marks are 256 bits; each shared shingle turns one of them over. Where
   two sets' marks differ, there is a shingle that only one of them has, so they never rule out a
   similar pair, and they rule out almost all others of a large group of loose copies.
4. The order is cut into fragments. The overlap of a pair is counted fragment by fragment, each
   with the two segments that its sets have there, and summed per pair; the sum decides exactly.

A large group of near copies is never expanded into all pairs. In each of some rounds a node meets
``HUBS`` others at most, those that come first among its shingles in an order drawn anew, and only
nodes of other components that it has not met; the links found join components. The rounds end
when no shingle has sets of two components. When a round leaves more than half of the pairs that were left before it, all nodes meet all nodes of other
components that share a shingle of their prefix. Links inside a component need not be known, so no
component is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikiloom.llm.common import column, fresh, row_key, text_of
from wikiloom.llm.components import components
from wikiloom.llm.grams import mix, windows_of, words_of
from wikiloom.llm.sweep import blobs, bucket_bits, bucket_cuts, run_count, sort_groups
from wikiloom.session import WorkFolder

#: Nodes that a node meets in a round at most.
HUBS = 6
#: Bits of a set's marks, as words of 64.
MARK_WORDS = 4
#: What the two sides of a pair are compared by.
SIDE = ("node", "n", "alone", "marks", "place", "label")
#: The last frequency class (power of two) of each fragment but the last one.
FRAGMENT_CLASSES = (1, 2, 3, 5, 8)


# --- sets ----------------------------------------------------------------------------------
def shingles_of(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every shingle of ``size`` words; shorter texts are one shingle.

    A to Z are read as a to z. Texts without words have none. Repeated shingles stay.
    """
    words, counts = words_of(texts, lower=True)
    hashes, text, _ = windows_of(words, counts, size)
    first = np.cumsum(counts) - counts
    for short in range(1, size):
        of = np.flatnonzero(counts == short)
        if len(of):
            rows = np.concatenate([words[a : a + short] for a in first[of]])
            whole, _, _ = windows_of(rows, np.full(len(of), short), short)
            hashes, text = np.concatenate([hashes, whole]), np.concatenate([text, of])
    return hashes, text


def _sets(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (shingle, text) pairs in the order of shingles; the distinct 48-bit tops of the
    shingles, which are what is counted in the sweep, and the number of its top for each pair."""
    texts = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
    hashes, text = shingles_of(texts, size)
    by_text = np.argsort(text, kind="stable")  # short texts come last
    hashes, text = hashes[by_text], text[by_text]
    order, new, _ = sort_groups(hashes)
    text = text[order]
    keep = new.copy()
    keep[1:] |= text[1:] != text[:-1]  # the sort is stable, so a shingle's texts are in order
    hashes, text = hashes[order][keep], text[keep]
    tops = hashes >> np.uint64(16)
    new = np.diff(tops, prepend=tops[:1] + np.uint64(1)) != 0
    return hashes, text, tops[new], np.cumsum(new) - 1


def _six_bytes(tops: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(tops.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def _from_six_bytes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _total(values: np.ndarray, by: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2**64 of ``values`` by number."""
    order = np.argsort(by, kind="stable")
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values[order], dtype=np.uint64)])
    ends = np.cumsum(np.bincount(by, minlength=n))
    return np.diff(sums[np.concatenate([[0], ends])])


def _marks(hashes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The marks of ``n`` sets: a bit is set if an odd number of the set's hashes fall on it."""
    bits = 64 * MARK_WORDS
    at, times = np.unique(of * bits + (hashes % np.uint64(bits)).astype(np.int64), return_counts=True)
    at = at[times % 2 == 1]
    words = np.zeros(n * MARK_WORDS, np.uint64)
    if len(at):
        first = np.flatnonzero(np.diff(at >> 6, prepend=-1))
        words[at[first] >> 6] = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
    return words.view(np.int64)


def document_sets(docs: DataFrame, size: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """One row per document: doc_id, print (a hash of the text), n, node, alone, shared, marks, fragments.

    ``node`` names the set (null if empty); ``alone`` is the number of shingles of no other
    document. ``shared``, the other shingles in the global order, is null where ``alone`` rules
    out any partner, and for all but one of the documents of a run with the same set.
    ``marks`` are those of the shingles in ``shared``, ``fragments`` the ends of the fragments there.
    """
    rows = docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).head()["n"] or 0
    runs, bits = run_count(total), bucket_bits(total // 6)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(runs)).cast("int")
    ranged = rows.select(spread.alias("run"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("print"), "text")

    def up(table: pa.Table) -> pa.Table:
        run = table.column("run")[0].as_py()
        _, _, distinct, number = _sets(table, size)
        count = np.bincount(number, minlength=len(distinct))
        cuts = bucket_cuts(distinct, bits, 48)
        many = count >= 255
        made = pa.table(
            {
                "bucket": np.arange(len(cuts) - 1, dtype=np.int32),
                "run": np.full(len(cuts) - 1, run, np.int32),
                "tops": blobs(_six_bytes(distinct), cuts),
                "counts": blobs(np.minimum(count, 255).astype(np.uint8), cuts),
                "more": blobs(count[many].astype(np.uint64), np.searchsorted(np.flatnonzero(many), cuts)),
            }
        )
        return made.filter(pa.array(np.diff(cuts) > 0))

    def meet(table: pa.Table) -> pa.Table:
        parts = [_from_six_bytes(b) for b in table.column("tops").to_pylist()]
        sizes = np.array([len(p) for p in parts])
        count = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint8).astype(np.int64)
        count[count == 255] = np.frombuffer(b"".join(table.column("more").to_pylist()), np.uint64)
        order, new, group = sort_groups(np.concatenate(parts))
        documents = np.add.reduceat(count[order], np.flatnonzero(new)) if len(order) else count
        level = np.empty(len(order), np.uint8)
        level[order] = np.log2(documents).astype(np.uint8)[group]
        # log2 of numbers from 2**49 on may round up; any order of shingles will do, but not a class of 0.
        return pa.table({"run": table.column("run"), "bucket": table.column("bucket"), "levels": blobs(level, np.concatenate([[0], np.cumsum(sizes)]))})

    def down(table: pa.Table, answers: pa.Table) -> pa.Table:
        hashes, of, distinct, number = _sets(table, size)
        cuts = bucket_cuts(distinct, bits, 48)
        level = np.zeros(len(distinct), np.uint8)
        for b, answer in zip(answers.column("bucket").to_pylist(), answers.column("levels").to_pylist(), strict=True):
            level[cuts[b] : cuts[b + 1]] = np.frombuffer(answer, np.uint8)
        level = level[number]
        n_docs = table.num_rows
        n = np.bincount(of, minlength=n_docs)
        alone = np.bincount(of[level == 0], minlength=n_docs)
        names = np.empty((n_docs, 2), np.uint64)
        names[:, 0] = _total(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), of, n_docs)
        names[:, 1] = _total(mix(hashes + np.uint64(0x14057B7EF767814F)), of, n_docs)
        possible = (n > 0) & (100 * (n - alone) >= percent * n)
        _, first = np.unique(names, axis=0, return_index=True)
        chosen = np.zeros(n_docs, bool)
        chosen[first] = True
        chosen &= possible
        keep = np.flatnonzero(chosen[of] & (level > 0))
        keep = keep[np.lexsort((hashes[keep], level[keep], of[keep]))]
        shared = np.bincount(of[keep], minlength=n_docs)
        offsets = np.concatenate([[0], np.cumsum(shared)])
        ends = np.stack(
            [np.bincount(of[keep][level[keep] <= c], minlength=n_docs) for c in FRAGMENT_CLASSES] + [shared], axis=1
        ).astype(np.int32)
        null = pa.array(~chosen)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes[keep].view(np.int64)), mask=null)
        steps = pa.array(np.arange(n_docs + 1) * ends.shape[1], pa.int32())
        parts = pa.ListArray.from_arrays(steps, pa.array(ends.ravel()), mask=null)
        words = pa.array(np.arange(n_docs + 1) * MARK_WORDS, pa.int32())
        marks = pa.ListArray.from_arrays(words, pa.array(_marks(hashes[keep], of[keep], n_docs)), mask=null)
        node = blobs(names.ravel(), np.arange(n_docs + 1) * 2)
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "print": table.column("print"),
                "n": pa.array(n, pa.int64()),
                "node": pc.if_else(pa.array(n > 0), node, pa.scalar(None, pa.binary())),
                "alone": pa.array(alone, pa.int64()),
                "shared": lists,
                "marks": marks,
                "fragments": parts,
            }
        )

    sent = ranged.groupBy("run").applyInArrow(up, "bucket int, run int, tops binary, counts binary, more binary")
    answers = sent.groupBy("bucket").applyInArrow(meet, "run int, bucket int, levels binary")
    return (
        ranged.groupBy("run")
        .cogroup(answers.groupBy("run"))
        .applyInArrow(
            down,
            f"doc_id {id_type}, print bigint, n bigint, node binary, alone bigint, shared array<bigint>, marks array<bigint>, fragments array<int>",
        )
    )


# --- pairs ---------------------------------------------------------------------------------
def _needed(a: str, b: str, percent: int) -> Column:
    """The smallest overlap of sets of ``a`` and ``b`` shingles that are similar."""
    return F.expr(f"({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent}")


def _postings(nodes: DataFrame) -> DataFrame:
    """node, n, alone, marks, shingle and place (in the global order) of each set's prefix, where two sets share it."""
    rows = nodes.select("node", "n", "alone", "marks", F.posexplode("prefix").alias("at", "shingle"))
    rows = rows.withColumn("place", F.col("alone") + F.col("at")).drop("at")
    often = rows.groupBy("shingle").agg(F.count("*").alias("sets")).where("sets > 1").select("shingle")
    return rows.join(often, "shingle")


def _possible(percent: int) -> Column:
    """Whether sets a and b may be similar if the shingle at their places is the first that they share.

    Shingles that are a set's alone and those that the marks differ by are in one of the two only.
    """
    needed = _needed("n_a", "n_b", percent)
    rest = F.least(F.expr("n_a - place_a"), F.expr("n_b - place_b"))
    apart = F.expr(" + ".join(["alone_a", "alone_b", *(f"bit_count(marks_a[{k}] ^ marks_b[{k}])" for k in range(MARK_WORDS))]))
    return (rest >= needed) & (apart <= F.col("n_a") + F.col("n_b") - 2 * needed)


def _as_pair() -> list[Column]:
    turn = F.col("node_a") < F.col("node_b")
    return [F.when(turn, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")).alias(out) for c, x, y, out in (("node", "a", "b", "a"), ("node", "b", "a", "b"), ("n", "a", "b", "n_a"), ("n", "b", "a", "n_b"))]


def _marked(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """The postings of shingles whose sets are in several components, with label and the shingle's main one."""
    rows = postings.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = rows.groupBy("shingle", "label").agg(F.count("*").alias("sets"))
    main = sizes.groupBy("shingle").agg(
        F.max(F.struct("sets", "label")).alias("main"), F.sum("sets").alias("all"), F.count("*").alias("labels")
    )
    main = main.where("labels > 1").select("shingle", F.col("main.label").alias("main"), F.col("main.sets").alias("in_main"), "all")
    return rows.join(main, "shingle")


def hub_pairs(marked: DataFrame, percent: int, seed: int) -> DataFrame:
    """Each set with those of other components that come first among its shingles, in its own size
    class and the one below, in an order drawn by ``seed``."""
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))) if percent < 100 else F.col("n")
    sized = marked.withColumn("size", size)
    drawn = [F.xxhash64(F.lit(seed * HUBS + k), "node").alias("drawn") for k in range(HUBS)]
    firsts = [F.min(F.struct(d, *SIDE)).alias(f"hub_{k}") for k, d in enumerate(drawn)]
    hubs = sized.groupBy("shingle", "size").agg(*firsts)
    hubs = hubs.select("shingle", "size", F.array_distinct(F.array(*(F.struct(*(F.col(f"hub_{k}")[c].alias(c) for c in SIDE)) for k in range(HUBS)))).alias("hubs"))
    sides = sized.select("shingle", *(F.col(c).alias(f"{c}_a") for c in SIDE), F.explode(F.array(F.col("size"), F.col("size") - 1)).alias("size"))
    met = sides.join(hubs, ["shingle", "size"]).withColumn("hub", F.explode("hubs"))
    met = met.select(*(f"{c}_a" for c in SIDE), *(F.col(f"hub.{c}").alias(f"{c}_b") for c in SIDE))
    met = met.where(F.col("label_a") != F.col("label_b")).where(_possible(percent))
    chosen = F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64(F.lit(seed), "node_b").alias("drawn"), "node_b", "n_b"))), 1, HUBS)
    few = met.groupBy("node_a", "n_a").agg(F.explode(chosen).alias("hub"))
    return few.select("node_a", "n_a", "hub.node_b", "hub.n_b").select(*_as_pair()).distinct()


def cross_pairs(marked: DataFrame, percent: int) -> DataFrame:
    """All pairs of sets of different components that share a shingle of their prefixes.

    The main component of a shingle does not meet itself: one side is the sets outside of it.
    """
    outside = marked.where("label <> main")
    a = outside.select(F.col("shingle").alias("shingle_a"), "main", *(F.col(c).alias(f"{c}_a") for c in SIDE))
    b = marked.select("shingle", *(F.col(c).alias(f"{c}_b") for c in SIDE))
    once = (F.col("label_b") == F.col("main")) | (F.col("node_a") < F.col("node_b"))
    met = a.join(b, (F.col("shingle_a") == F.col("shingle")) & (F.col("label_a") != F.col("label_b")) & once & _possible(percent))
    return met.select(*_as_pair()).distinct()


def similar(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose overlaps, counted fragment by fragment, add up to enough."""
    left = segments.select(F.col("node").alias("a"), F.col("segments").alias("segments_a"))
    right = segments.select(F.col("node").alias("b"), F.col("segments").alias("segments_b"))
    both = pairs.join(left, "a").join(right, "b")
    parts = F.zip_with("segments_a", "segments_b", lambda x, y: F.size(F.array_intersect(x, y)))
    overlap = F.aggregate(parts, F.lit(0), lambda total, part: total + part)
    return both.where(overlap >= _needed("n_a", "n_b", percent)).select("a", "b")


def joined_sets(postings: DataFrame, segments: DataFrame, percent: int, work: WorkFolder) -> DataFrame:
    """node and label of all sets that are linked to another one."""
    spark = postings.sparkSession
    labels = spark.createDataFrame([], "node binary, label binary")
    tried: list[DataFrame] = []
    turn, before = 0, None
    while True:
        marked = work.keep(_marked(postings, labels), f"marked-{turn}")
        shingles = marked.groupBy("shingle").agg(F.first(F.expr("(all - in_main) * all")).alias("pairs"))
        left = shingles.agg(F.sum("pairs").alias("n")).head()["n"] or 0
        if left == 0:
            return labels
        last = before is not None and 2 * left > before
        pairs = cross_pairs(marked, percent) if last else hub_pairs(marked, percent, turn)
        for done in tried:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = work.keep(pairs, f"pairs-{turn}")
        links = work.keep(similar(pairs, segments, percent), f"links-{turn}")
        if not links.isEmpty():
            labels = work.keep(_relabelled(labels, links, work.part(f"joined-{turn}")), f"labels-{turn}")
        if last:
            return labels
        tried.append(pairs.select("a", "b"))
        turn, before = turn + 1, left


def _relabelled(labels: DataFrame, links: DataFrame, work: WorkFolder) -> DataFrame:
    """The labels of components that ``links`` join with each other and with nodes that have none yet."""
    ends = links
    for side in ("a", "b"):
        ends = ends.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}")), side, "left")
    between = ends.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    joined = components(between, work).select(F.col("node").alias("old"), F.col("label").alias("new"))
    old = labels.join(joined, labels["label"] == joined["old"], "left").select("node", F.coalesce("new", "label").alias("label"))
    new = joined.join(labels, joined["old"] == labels["node"], "left_anti").select(F.col("old").alias("node"), F.col("new").alias("label"))
    return old.unionByName(new)


def jaccard_components(
    docs: DataFrame,
    work: WorkFolder,
    size: int = 5,
    percent: int = 80,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, component (its name), print.

    Two documents are linked if ``100 * intersection >= percent * union`` of their sets of
    shingles of ``size`` words (A to Z read as a to z; a shorter text is one shingle as a whole).
    ``component_id`` is the smallest doc_id over any path of links, null only if all of these are
    null. Null texts and texts without words have an empty set and no links; a null doc_id is
    linked like any other. Rows that repeat are documents with equal sets. No rows give no rows;
    other columns are ignored. Shingles are compared by 64-bit hashes, sets by 128-bit sums.
    """
    sets = work.keep(document_sets(docs, size, percent, doc_id, text), "sets")
    least = F.expr(f"{percent} * (n + 1) <= 100 * n")  # else not even one more shingle would be similar
    shared = sets.where(F.col("shared").isNotNull() & least)
    prefix = F.slice("shared", F.lit(1), F.expr(f"cast(n - ({percent} * n + 99) div 100 + 1 - alone as int)"))
    nodes = shared.withColumn("prefix", prefix).groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "alone", "marks", "prefix")))
    postings = work.keep(_postings(nodes), "postings")
    # From here on only sets that share a shingle of their prefix with another one count.
    active = shared.join(postings.select("node").distinct(), "node", "left_semi")
    whole = active.groupBy("node").agg(F.first("shared").alias("shared"), F.first("fragments").alias("fragments"))
    ends = F.concat(F.array(F.lit(0)), "fragments")
    cut = F.transform(
        "fragments",
        lambda end, k: F.slice("shared", F.element_at(ends, k + 1) + 1, end - F.element_at(ends, k + 1)),
    )
    segments = work.keep(whole.select("node", cut.alias("segments")), "segments")

    labels = joined_sets(postings, segments, percent, work)

    # Only sets without too many shingles of their own can be equal or similar to another.
    open_ = F.expr(f"node is not null and 100 * (n - alone) >= {percent} * n")
    known = sets.select("doc_id", "print", "n", "node", open_.alias("open"))
    smallest = known.where("open").groupBy("node").agg(F.min("doc_id").alias("least"))
    marked = smallest.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least_of = marked.groupBy("label").agg(F.min("least").alias("component_id"))
    named = marked.join(least_of, "label").select("node", "label", "component_id")
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce("label", "node").alias("component"), "print"]
    linked = known.where("open").join(named, "node", "left").select(*columns)
    alone = known.where("not open").withColumn("component_id", F.col("doc_id")).withColumn("label", F.col("node"))
    return linked.union(alone.select(*columns))


def one_of_each_group(
    docs: DataFrame, work: WorkFolder, doc_id: str = "doc_id", text: str = "text", **how
) -> DataFrame:
    """The document with the smallest doc_id of each component, with all columns of ``docs``.

    Null doc_ids come last; of documents with the same doc_id in one component, that with the
    smaller hash of its text stays. Documents without words are groups by themselves and stay.
    Rows that repeat both doc_id and text are one row afterwards.
    """
    groups = jaccard_components(docs, work, doc_id=doc_id, text=text, **how)
    (key,) = fresh(docs.columns, "group_key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "print")).alias("first")
    chosen = groups.where("component is not null").groupBy("component").agg(first).select("first.doc_id", "first.print")
    empty = groups.where("component is null").select("doc_id", "print")
    kept = chosen.union(empty).select(row_key(F.col("doc_id"), F.col("print")).alias(key))
    rows = docs.withColumn(key, row_key(column(docs, doc_id), F.xxhash64(text_of(docs, text))))
    once = rows.join(kept, key, "left_semi").dropDuplicates([key])  # one exchange serves both
    return once.select([column(once, name) for name in docs.columns])
