"""Wiki-shaped views derived from the test tables, as SQL that both engines run.

The texts carry three placeholders, ``@ARR0@``, ``@ARR(a,b)@`` and ``@AGG(x,sep,order)@``, which
differ between the dialects.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "orders", "lineitem", "part", "events", "conversations", "pages",
)
_FOLDER = Path(__file__).parent
NAMES = tuple(sorted(p.stem for p in _FOLDER.glob("*.sql")))
ORIGIN = "https://wiki.example.com"


def _aggregates(text: str, form: str) -> str:
    def one(m: re.Match) -> str:
        value, separator, order = re.match(
            r"(.*),((?:''|'[^']*'|chr\(10\))),(\w+)$", m.group(1), re.S
        ).groups()
        return form.format(value=value, separator=separator, order=order)

    return re.sub(r"@AGG\((.*?)\)@", one, text, flags=re.S)


def spark_text(name: str) -> str:
    text = (_FOLDER / f"{name}.sql").read_text()
    text = text.replace("@ARR0@", "cast(array() as array<string>)")
    text = re.sub(r"@ARR\((.*?)\)@", r"array(\1)", text)
    return _aggregates(text, "listagg({value}, {separator}) within group (order by {order})")


def duckdb_text(name: str) -> str:
    text = (_FOLDER / f"{name}.sql").read_text()
    text = text.replace("@ARR0@", "[]::varchar[]")
    text = re.sub(r"@ARR\((.*?)\)@", r"[\1]", text)
    return _aggregates(text, "string_agg({value}, {separator} order by {order})")


SMALL_BYTES = 1 << 30


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table. One small file would keep all parsing in one task, so its rows are spread;
    tables of any size are read as they are split."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if len(df.inputFiles()) < cores and int(size) < SMALL_BYTES:
        return df.repartition(cores)
    return df


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived view over the tables of ``folder``."""
    text = spark_text(name)
    used = [t for t in TABLES if re.search(rf"\b(?:from|join) {t}\b", text)]
    quoted = text.replace("{", "{{").replace("}", "}}")
    for t in used:
        quoted = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", quoted)
    return spark.sql(quoted, **{t: table(spark, folder, t) for t in used})
