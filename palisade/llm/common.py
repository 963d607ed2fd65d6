"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's white space, as the inside of a character class.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir.

    Only a local session without that setting (as in tests) gets a folder of its own: the
    executors of a cluster would each write to a disk of theirs."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="palisade-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/palisade-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and a lost
    executor costs no work that was done before."""
    spark = df.sparkSession
    path = folder or shared_folder(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, for a caller's own use."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without its columns of these names: an operator's results replace them."""
    drop = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in drop])


def text_of(column: str | Column = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() does just that where every character is one byte."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def set_aside(df: DataFrame, names) -> tuple[DataFrame, list[Column]]:
    """df with its columns of these names renamed, and what selects its own columns again."""
    clash = [c for c in df.columns if c.lower() in {n.lower() for n in names}]
    away = dict(zip(clash, fresh(df, *(f"__own_{c}" for c in clash))))
    renamed = df.select(*[F.col(f"`{c}`").alias(away.get(c, c)) for c in df.columns])
    return renamed, [F.col(f"`{away.get(c, c)}`").alias(c) for c in df.columns]


def guarded(df: DataFrame, condition: Column) -> DataFrame:
    """df.where(condition) evaluated where it stands: Catalyst would otherwise push the
    condition below the projections it refers to, and evaluate those twice."""
    (place,) = fresh(df, "__place")
    rows = df.withColumn(place, F.monotonically_increasing_id())
    return rows.where(condition & (F.col(place) >= 0)).drop(place)


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """A row of df for each of the n smallest different values of key, a hash. Only hashes
    are sorted; the rows themselves are filtered where they lie."""
    smallest = df.select(key).distinct().orderBy(key).limit(n)
    last = smallest.agg(F.max(key)).first()[0]
    return df.where(F.lit(False) if last is None else F.col(key) <= last).dropDuplicates([key])
