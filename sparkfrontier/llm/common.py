"""What the training-data operators share: word rule, uniform hashes, staged tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

#: A broadcast side may have this many rows of a few dozen bytes at most; more rows join by shuffle.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """The words of a text, an empty array for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*cols: Column) -> Column:
    """A double in [0, 1) that depends on nothing but the given columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; one under /tmp only where it names none (local tests)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = "file:///tmp/checkpoints"
    return folder.rstrip("/")


def stage_out(df: DataFrame, name: str, rebalance: bool = True) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and a lost executor takes nothing along.

    Rebalanced tables get as many files as their size asks for, split where a partition is too large.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sparkfrontier/{name}-{uuid.uuid4().hex}"
    (df.hint("rebalance") if rebalance else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """df with a broadcast hint if a count proves that it has few rows; df must be cheap to count (staged).

    Rows that aren't narrow come with a weight (elements, or units of a few dozen bytes), whose sum is bounded instead.
    """
    if weight is None:
        return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
    return F.broadcast(df) if (df.agg(F.sum(weight)).first()[0] or 0) <= rows else df


def text_id(text: Column) -> Column:
    """128 bits that name a text; two texts of one id are out of reach at any number of documents."""
    return F.unhex(F.md5(text.cast("binary")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(columns: list[str]) -> Column:
    """The columns as one struct, which no working column can clash with; it has a field more, so that it is never empty."""
    spare = "_"
    while spare in {c.lower() for c in columns}:
        spare += "_"
    return F.struct(F.lit(0).alias(spare), *[F.col(f"`{c}`") for c in columns])


def only(df: DataFrame, columns: list[str] | None) -> list[str]:
    """The columns to keep: all, or those of the list that df has."""
    have = {c.lower() for c in df.columns}
    return df.columns if columns is None else [c for c in columns if c.lower() in have]
