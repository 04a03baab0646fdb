"""Crawl logs: tab-separated lines in multi-member gzip files, some members damaged by kills."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes inflated at once; fewer in damaged members, as what a step holds in front of the damage is lost with it.
STEP, SMALL_STEP = 1 << 16, 1 << 9
_MAGIC = b"\x1f\x8b\x08"
LINES_SCHEMA = "path string, seq long, line string, damaged int, truncated int"


def members(data: bytes) -> Iterator[tuple[int, int, bool]]:
    """(start, end, damaged) of each member. Nothing that is inflated is kept.

    Where a damaged member ends can't be known, so the next header is searched for, and only then: inside intact members
    its bytes occur by chance.
    """
    pos, view = 0, memoryview(data)
    while pos < len(data):
        inflater, at = zlib.decompressobj(31), pos
        try:
            while at < len(data) and not inflater.eof:
                inflater.decompress(view[at : at + STEP])
                at += STEP
        except zlib.error:
            pass
        if inflater.eof:
            end, damaged = min(at, len(data)) - len(inflater.unused_data), False
        else:
            follow = data.find(_MAGIC, pos + 1)
            end, damaged = follow if follow > 0 else len(data), True
        yield pos, end, damaged
        pos = end


def lines_of(data: bytes, start: int, end: int, damaged: bool) -> Iterator[list[bytes]]:
    """The whole rows of a member, a step's at a time; of a damaged one those in front of the damage, and an empty list if a part of a row is lost there."""
    inflater, rest, view = zlib.decompressobj(31), b"", memoryview(data)
    step = STEP if not damaged else SMALL_STEP
    for at in range(start, end, step):
        try:
            out = inflater.decompress(view[at : min(at + step, end)])
        except zlib.error:
            break
        *whole, rest = (rest + out).split(b"\n")
        if whole:
            yield whole
    if damaged:
        if rest:
            yield []
    elif rest:
        yield [rest]


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            seq, data = 0, bytes(content)
            for start, end, damaged in members(data):
                truncated = 0
                for lines in lines_of(data, start, end, damaged):
                    truncated = int(not lines)
                    if lines:
                        yield pd.DataFrame({"path": path, "seq": range(seq, seq + len(lines)), "line": [x.decode("utf-8", "replace") for x in lines], "damaged": 0, "truncated": 0})
                    seq += len(lines)
                if damaged:  # a row without a line counts the damage
                    yield pd.DataFrame({"path": [path], "seq": [seq], "line": [None], "damaged": [1], "truncated": [truncated]})


def read_gzip_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """path, seq, line of every recoverable row of gzip logs; rows with damaged = 1 have no line and count damaged members.

    One task per file, as gzip can't be split. The task holds the compressed file, which Spark reads up to 2 GB, and one
    step of what is in it, however long its members are.
    """
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    return files.mapInPandas(_read, LINES_SCHEMA)


def fields(line: Column) -> Column:
    return F.split(line, "\t", -1)


def parse_dispatched(lines: DataFrame) -> DataFrame:
    """dispatch_ts, slot_id, url, monotonic_ts and `state`: ok, short, uncheckable (no stamp) or unreadable, of log lines.

    The monotonic stamp is used where there is one; it is another clock, so the two never mix in one series.
    """
    p = fields(F.col("line"))
    at = lambda i: F.get(p, i)
    stamp = F.coalesce(at(3).try_cast("double"), at(0).try_cast("double"))
    state = F.when(F.size(p) < 2, "short").when(at(0) == "NA", "uncheckable").when(stamp.isNull(), "unreadable").otherwise("ok")
    return lines.select(at(0).try_cast("double").alias("dispatch_ts"), at(1).alias("slot_id"), at(2).alias("url"), at(3).try_cast("double").alias("monotonic_ts"), state.alias("state"))


def parse_crawled(lines: DataFrame) -> DataFrame:
    """Crawl log lines of six (no size) or seven columns; shorter ones are left out."""
    p = fields(F.col("line"))
    at = lambda i: F.get(p, i)
    return lines.where(F.size(p) >= 6).select(
        at(0).alias("sent"), at(0).try_cast("double").alias("sent_ts"), at(1).try_cast("double").alias("recv_ts"), at(2).alias("url"), at(3).alias("status"),
        at(4).alias("content_type"), at(5).try_cast("long").alias("n_links"), at(6).try_cast("long").alias("bytes"),
    )


def escaped(field: Column) -> Column:
    return F.replace(F.replace(field.cast("string"), F.lit("\t"), F.lit("%09")), F.lit("\n"), F.lit("%0A"))


def crawled_lines(rows: DataFrame) -> DataFrame:
    """(line): crawl rows as the log has them; a missing stamp is NA, content types lose their parameters."""
    stamp = lambda c: F.when(F.col(c).isNull(), "NA").otherwise(F.format_string("%.3f", c))
    return rows.select(F.concat_ws("\t", stamp("sent_ts"), F.format_string("%.3f", "recv_ts"), escaped(F.col("url")), "status", F.trim(F.substring_index("content_type", ";", 1)), F.col("n_links").cast("string"), F.col("bytes").cast("string")).alias("line"))


def discovered_lines(rows: DataFrame) -> DataFrame:
    """(line): a discovered URL a row; the log is written behind the filter of seen ones, so it has each once."""
    return rows.select(escaped(F.col("url")).alias("line"))


def dispatched_lines(rows: DataFrame) -> DataFrame:
    """(line): what was sent, as the log has it: stamp, slot, URL and the monotonic stamp. Refused rows (accepted = false) aren't logged."""
    sent = rows.where("accepted") if "accepted" in rows.columns else rows
    return sent.select(F.concat_ws("\t", F.format_string("%.3f", "dispatch_ts"), escaped(F.col("slot_id")), escaped(F.col("url")), F.format_string("%.6f", "monotonic_ts")).alias("line"))


def shard_of_file(path: Column) -> Column:
    """The shard that a telemetry file is of, by its name: runstats-3.tsv is of shard 3, runstats.tsv of 0."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.replace(stem, F.lit("runstats"), F.lit("")), "^-+", ""), F.lit("")), F.lit("0"))


def write_lines(lines: DataFrame, path: str) -> None:
    """One column of lines as gzip text; the commit protocol makes files appear whole."""
    lines.write.mode("append").option("compression", "gzip").text(path)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A telemetry table with a header; further files may be given as a glob: rows of another width, and rows with an unreadable number, are left out."""
    raw = spark.read.text(path)
    header = raw.where(F.col("value").contains("\t")).first()
    names = header[0].split("\t") if header else []
    p = F.split("value", "\t", -1)
    rows = raw.where((F.size(p) == len(names)) & (F.col("value") != (header[0] if header else "")))
    cast = rows.select(*[F.get(p, i).try_cast("double").alias(n) for i, n in enumerate(names)])
    return cast.dropna()


def write_tsv(rows: DataFrame, path: str) -> None:
    """A report as tab-separated text with a header."""
    rows.write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="", nullValue="")


def write_list(rows: DataFrame, column: str, path: str, comments: list[str] | None = None) -> None:
    """One value a line in the rows' order, below comment lines; for lists that a file holds, such as seeds."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(i, f"# {c}") for i, c in enumerate(comments or [])], "n long, line string")
    body = rows.select(F.monotonically_increasing_id().alias("n"), F.col(column).cast("string").alias("line"))
    both = head.select(F.lit(0).alias("part"), "n", "line").unionByName(body.select(F.lit(1).alias("part"), "n", "line"))
    both.coalesce(1).sortWithinPartitions("part", "n").select("line").write.mode("overwrite").text(path)
