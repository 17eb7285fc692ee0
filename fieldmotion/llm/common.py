"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmotion.operators.reliable import checkpoint_dir

#: What counts as a word: a run of anything but space and the control blanks 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write a stage as Parquet in the shared folder and read it back, so that several
    readers share the work and a lost executor costs nothing but a new read."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not by else spark.read.parquet(path)


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times in ``body``: inside a lambda a plain
    expression would be computed again for every element."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """All words of a text in order; no words for a null text."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return let(inner, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BLANK)))


def id_crc(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary"))


def rowed(df: DataFrame, **extra: Column) -> DataFrame:
    """The whole row as one struct ``row`` beside new columns, so that no column of the
    input can clash with a working name."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in extra.items()])


def parallelism(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
