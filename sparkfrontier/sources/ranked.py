"""Ranked domain lists: CSV rows (rank, domain), plain or as the first file of a zip archive."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROWS_AT_ONCE = 100_000


def _unzip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for content in frame["content"]:
            with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(archive.namelist()[0]) as member:
                held, rank = [], 0
                for row in csv.reader(io.TextIOWrapper(member, encoding="utf-8")):
                    if len(row) < 2:
                        continue
                    rank += 1
                    held.append((rank, row[1]))
                    if len(held) == _ROWS_AT_ONCE:
                        yield pd.DataFrame(held, columns=["rank", "domain"])
                        held = []
                yield pd.DataFrame(held, columns=["rank", "domain"])


def read_ranked(spark: SparkSession, path: str) -> DataFrame:
    """rank, domain; in an archive the rank is the row's place, as rows of less than two columns don't count."""
    if path.endswith(".zip"):
        return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_unzip, "rank long, domain string")
    return spark.read.csv(path, schema="rank long, domain string", mode="DROPMALFORMED").where(F.col("domain").isNotNull())
