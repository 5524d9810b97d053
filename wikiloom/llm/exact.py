"""Exact deduplication by a tree merge of sorted digest runs; built-in functions only.

Every input partition is a run: its (digest, identifier) rows, sorted by digest and written once.
The runs are merged in binomial rounds, sixteen at a time: in each round the runs whose numbers
agree but for the next four bits exchange their rows and every digest keeps its smallest
identifier. A digest that a third of all rows share is one row per run after the first level, so
no round ever sees more of its rows than there are runs in a merge. The answers go back down the
same tree, from a merged run to the runs it was made of.

A digest is SHA-256 of the normalised text. The length and a second hash of the same text travel
with it as part of the key at every level, so texts are taken as equal only if all three agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikiloom.llm.common import SPACE, column, fresh, row_key, text_of
from wikiloom.session import WorkFolder

#: Runs that one merge takes together, as bits of the run number: four binomial rounds at once.
MERGE_BITS = 4
KEY = ["digest", "length", "check"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def digest_runs(docs: DataFrame, work: WorkFolder, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, row, run and the key of its text, each run sorted by its keys."""
    even = normalised(text_of(docs, text))
    rows = docs.select(
        column(docs, doc_id).alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.spark_partition_id().alias("run"),
        F.unhex(F.sha2(even, 256)).alias("digest"),
        F.length(even).alias("length"),
        F.xxhash64(even).alias("check"),
    )
    return work.keep(rows.sortWithinPartitions(*KEY), "runs")


def _smallest() -> Column:
    """Null identifiers are larger than all others; of equal ones the row that came first is smallest."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")


def merge_runs(runs: DataFrame) -> DataFrame:
    """``runs`` with keep_id, keep_row and group_size of each row's text."""
    top = runs.agg(F.max("run").alias("n")).head()["n"] or 0
    levels = [runs.groupBy("run", *KEY).agg(_smallest(), F.count("*").alias("n"))]
    while top:
        top >>= MERGE_BITS
        below = levels[-1].withColumn("run", F.shiftright("run", MERGE_BITS))
        levels.append(below.groupBy("run", *KEY).agg(F.min("first").alias("first"), F.sum("n").alias("n")))
    answer = levels.pop().where("n > 1")
    while levels:
        up = answer.select(F.col("run").alias("up"), *KEY, "first", "n")
        here = levels.pop().select(F.col("run"), F.shiftright("run", MERGE_BITS).alias("up"), *KEY)
        answer = here.join(up, ["up", *KEY]).drop("up")
    return runs.join(answer, ["run", *KEY], "left").select(
        *runs.columns,
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("first.row", "row").alias("keep_row"),
        F.coalesce("n", F.lit(1)).alias("group_size"),
    )


def exact_groups(docs: DataFrame, work: WorkFolder, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after each run of ASCII white space has become one
    space; a null text is empty, and empty texts are equal. Of equal texts the row with the
    smallest doc_id stays; null doc_ids come last, and of rows with the same doc_id exactly one
    stays. No rows give no rows; other columns are ignored.
    """
    merged = merge_runs(digest_runs(docs, work, doc_id, text))
    return merged.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, work: WorkFolder, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that repeat both doc_id and text are one row afterwards.
    """
    (key,) = fresh(docs.columns, "exact_key")
    kept = exact_groups(docs, work, doc_id, text).where("kept")
    kept = kept.select(row_key(F.col("doc_id"), F.col("text_sha256")).alias(key))
    digest = F.sha2(normalised(text_of(docs, text)), 256)
    rows = docs.withColumn(key, row_key(column(docs, doc_id), digest))
    once = rows.join(kept, key, "left_semi").dropDuplicates([key])  # one exchange serves both
    return once.select([column(once, name) for name in docs.columns])


GROUPS_SQL = r"""
with norm as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') t from documents
)
select doc_id, min(doc_id) over w keep_id, count(*) over w group_size,
       row_number() over (partition by t order by doc_id) = 1 kept, sha256(t) text_sha256
from norm window w as (partition by t)
"""
