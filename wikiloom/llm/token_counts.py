"""Token counts as delta-maintained rollups by source, language and tokenizer version.

Changes are rows that insert a document's count, delete it, or revise it from an old count to a new
one. A batch of changes is summed to signed deltas, one small row per key, and committed under its
batch id: first the deltas, then the id in the ledger. Totals are the sums of the deltas of all
batches in the ledger. A batch that is already there is not applied again, and one whose commit
broke off is not counted and may be repeated. Documents are never read again to keep totals right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
DELTAS = "source string, lang string, tokenizer string, documents bigint, tokens bigint"
#: Tokenizers by version, as patterns whose matches are tokens.
TOKENIZERS = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "words-2": r"[^\x20\x09-\x0D]*[\p{L}\p{N}][^\x20\x09-\x0D]*",
    "pieces-1": r"\p{L}+|\p{N}|[^\x20\x09-\x0D\p{L}\p{N}]+",
}


def count_tokens(text: Column, tokenizer: str) -> Column:
    """How many tokens a text has (null: none) under a version of ``TOKENIZERS``."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(TOKENIZERS[tokenizer])).cast("bigint")


def change(rows: DataFrame, op: str, tokenizer: str, tokens: Column, old_tokens: Column | None = None) -> DataFrame:
    """``rows`` (with source and lang) as changes: ``op`` is insert, delete or revise."""
    none = F.lit(None).cast("bigint")
    return rows.select(
        F.lit(op).alias("op"), F.col("source"), F.col("lang"), F.lit(tokenizer).alias("tokenizer"),
        tokens.cast("bigint").alias("tokens"), (none if old_tokens is None else old_tokens.cast("bigint")).alias("old_tokens"),
    )


class Rollup:
    """Totals in a folder that Spark can read and write."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, folder: str) -> Rollup:
        made = cls(spark, folder)
        spark.createDataFrame([], "batch string").write.parquet(f"{made.folder}/ledger")
        return made

    def batches(self) -> set[str]:
        """The ids of all committed batches."""
        return {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{self.folder}/ledger").collect()}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch of changes once; False if it was applied before.

        ``changes`` has op, source, lang, tokenizer, tokens and old_tokens. A null count is 0, other
        ops are an error, and null sources and languages are keys like others. Sums are made before
        the shuffle, so a key with most rows is one row per task. No rows commit an empty batch.
        One writer commits at a time.
        """
        if not batch.isascii() or not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id has ASCII letters, digits, - and _ only")
        if batch in self.batches():
            return False
        new, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
        sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0)
        sign = sign.otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))))
        signed = changes.select(*KEYS, sign.cast("bigint").alias("documents"), F.when(F.col("op") == "revise", new - old).otherwise(sign * new).alias("tokens"))
        deltas = signed.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        deltas.write.mode("overwrite").parquet(f"{self.folder}/deltas/{batch}")
        self.spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(f"{self.folder}/ledger")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents and tokens of all keys that are not empty."""
        paths = [f"{self.folder}/deltas/{batch}" for batch in sorted(self.batches())]
        if not paths:
            return self.spark.createDataFrame([], DELTAS)
        sums = self.spark.read.schema(DELTAS).parquet(*paths).groupBy(*KEYS)
        sums = sums.agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 or tokens <> 0")


COUNTS_SQL = r"""
with gone as (select distinct doc_id from labels where toxic = 1),
kept as (select * from documents where doc_id is null or doc_id not in (select doc_id from gone where doc_id is not null)),
counts as (
  select source, lang, 'words-1' tokenizer,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]*[\p{L}\p{N}][^\x20\x09-\x0D]*')) n from kept
  union all select source, lang, 'pieces-1', len(regexp_extract_all(coalesce(text, ''), '\p{L}+|\p{N}|[^\x20\x09-\x0D\p{L}\p{N}]+')) from kept
)
select source, lang, tokenizer, count(*) documents, cast(sum(n) as bigint) tokens from counts group by all
"""
