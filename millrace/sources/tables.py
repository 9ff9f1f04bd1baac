"""Reads and writes of declared tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.shapes import same_key, under_keys
from millrace.sources.schemas import DURABLE, REGISTRY

READ_ONLY = ("SELECT", "WITH")


def scan(spark: SparkSession, folder: str, name: str, fmt: str = "parquet") -> DataFrame:
    """Typed lazy scan of a declared table, with the names that the operators use; empty text counts as missing."""
    df = spark.read.schema(REGISTRY[name].schema).format(fmt).load(f"{folder}/{name}")
    return blank_to_null(df).withColumnsRenamed(REGISTRY[name].names)


def blank_to_null(df: DataFrame) -> DataFrame:
    """Empty text as null.  ``nullif`` keeps the scan prunable; filters on other values still reach it."""
    texts = {f.name: F.nullif(F.col(f.name), F.lit("")) for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.withColumns(texts) if texts else df


def read_sql(spark: SparkSession, sql: str, params: dict | Sequence | None = None, **tables: DataFrame) -> DataFrame:
    """A read-only statement over the given frames, named in braces; anything but a query is refused.

    The statement is explained first, which parses and does nothing, and every
    node of its plan must be part of a query: ``WITH ... INSERT`` begins like one.
    """
    words = sql.strip().split(None, 1)
    if not words or words[0].upper() not in READ_ONLY:
        raise ValueError("only SELECT and WITH statements are read")
    plan = spark.sql(f"EXPLAIN EXTENDED {sql}", args=params, **tables).first()[0]
    parsed = plan.split("== Analyzed Logical Plan ==")[0]
    for line in parsed.splitlines():
        node = _NODE.match(line)
        if node and _WRITES.match(node[1]):
            raise ValueError(f"not a query: {node[1]}")
    return spark.sql(sql, args=params, **tables)


_NODE = re.compile(r"[\s:+|\-]*'?(\w+)")
_WRITES = re.compile(r"\w*(?:Insert|Overwrite|Append|Merge|Update|Delete|Create|Drop|Replace|Alter|Truncate|Set|Cache|Load|Write)\w*(?:Into|Statement|Command|Table|Data|Dir|Select|From|Expression)\w*$")


def columns_of(name: str) -> list[tuple[str, str]]:
    """Column names and types of a declared table."""
    return [(f.name, f.dataType.simpleString()) for f in REGISTRY[name].schema.fields]


def replace_slice(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of the keys that ``new`` brings are replaced by its rows."""
    touched = under_keys(new.select(*keys).distinct(), keys)
    return old.join(touched, same_key(keys), "left_anti").unionByName(new)


def export(df: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> str:
    """Rows as CSV (with header) or JSON lines, as one file per partition."""
    if fmt not in ("csv", "json"):
        raise ValueError(f"unknown format: {fmt!r}")
    writer = df.write.mode(mode)
    if fmt == "csv":
        nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        writer = df.withColumns({c: F.to_json(c) for c in nested}).write.mode(mode).option("header", True)
    writer.format(fmt).save(path)
    return path


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows of the child whose parent is not there; rows without a parent key are none."""
    parents = parent.select(F.col(parent_key or key).alias(key)).distinct()
    return child.filter(F.col(key).isNotNull()).join(parents, key, "left_anti")


def violations(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows whose value is not allowed, or missing."""
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(*allowed))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def embed_text(max_chars: int | None = None):
    """The text an article is embedded by: title, conclusion and summary; its first characters only if a bound is given."""
    whole = F.concat_ws(": ", F.coalesce("title", F.lit("")), F.coalesce("conclusion", F.lit("")), F.coalesce("summary", F.lit("")))
    return whole if max_chars is None else F.substring(whole, 1, max_chars)


def embed_articles(df: DataFrame, embed: Callable[[list[str]], Sequence[Sequence[float]]], max_chars: int | None = None) -> DataFrame:
    """Add ``embedding`` to pending articles by the caller's model and mark them as embedded.

    The model gets lists of texts, one Arrow batch at a time.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(embed(texts.tolist())), index=texts.index, dtype=object)

    pending = df.filter(F.coalesce("embedding_status", F.lit("PENDING")) == "PENDING")
    done = pending.withColumn("embedding", run(embed_text(max_chars)))
    return done.withColumn("embedding_status", F.when(F.col("embedding").isNotNull(), "EMBEDDED").otherwise("PENDING"))


def durable_frames(spark: SparkSession, source: str) -> dict[str, DataFrame]:
    """All durable tables of a mirror."""
    return {name: scan(spark, source, name) for name in DURABLE}


def restore(frames: dict[str, DataFrame], target: str) -> list[str]:
    """Write the given durable tables, parents first, then rebuild the text index from the articles."""
    from millrace.operators.retrieval import write_index

    names = [name for name in DURABLE if name in frames]
    for name in names:
        frames[name].write.mode("overwrite").parquet(f"{target}/{name}")
    if "scraped_articles" in frames:
        articles = scan(frames["scraped_articles"].sparkSession, target, "scraped_articles")
        write_index(articles, ["title", "conclusion", "summary"], f"{target}/article_postings")
    return names
