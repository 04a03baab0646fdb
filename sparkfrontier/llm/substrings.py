"""Substring deduplication by a compacted de Bruijn graph of word windows.

Windows of K words are the edges of the graph. Every window has an anchor, its M-word window of the smallest hash; consecutive
windows of a text with one anchor occurrence are compacted into one path, so that the graph is dealt out by anchors and
holds a row for a path instead of a row for a window. Joins by anchor keep the anchors that are found twice; joins by
path find each path's first source coordinate (document, start). All later occurrences of a path are repeats as a whole.
Paths of one anchor that differ may still share windows (a repeat that starts or ends within them, a branch): first occurrences
of those are read again at their source coordinates and compared window by window. What is left are spans by document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfrontier.llm.common import only, packed, small, stage_out, table, text_id
from sparkfrontier.llm.tokens import CHUNK, mix, powers, windows, word_hashes

K, M = 20, 5
#: Rows of windows, and bytes of kept text, that a task holds before it hands them on.
OUT_ROWS, OUT_BYTES = 1 << 16, 1 << 22
#: Windows handled at once; a longer text is taken in parts, and anchors are ordered by the 40 bits above the place in a part.
PART = 1 << 22
_PLACE = np.uint64((1 << 24) - 1)
LAST = (1 << 63) - 1  # stands for a null id: after all others


def paths(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, path hash, first window, windows) of the compacted paths of one text."""
    for at in range(0, len(words) - K + 1, PART):
        part = words[at : at + PART + K - 1]
        small_ones = windows(part, M)
        low = (mix(small_ones) & ~_PLACE) | np.arange(len(small_ones), dtype="u8")
        n, reach = len(part) - K + 1, 1
        while reach < K - M + 1:  # sliding minimum by doubling
            step = min(reach, K - M + 1 - reach)
            low = np.minimum(low[: len(low) - step], low[step:])
            reach += step
        place = (low & _PLACE).astype("i8")
        first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        count = np.diff(np.append(first, n))
        yield small_ones[place[first]], _span_hashes(part, first, first + count + K - 1), first + at, count


def _span_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers(len(words) + 1)
    total = np.zeros(len(words) + 1, "u8")
    np.add.accumulate(mix(words) * up[: len(words)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype("u8"))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, tie, body) -> a row for each path."""
    names = ["anchor", "path", "doc", "tie", "start", "count"]
    for batch in batches:
        doc, tie, out = batch.column("doc").to_numpy(), batch.column("tie").to_numpy(), []
        for row, words in word_hashes(batch.column("body")):
            for anchor, path, start, count in paths(words) if len(words) >= K else ():
                out.append((anchor.view("i8"), path.view("i8"), np.full(len(start), doc[row]), np.full(len(start), tie[row]), start.astype("i4"), count.astype("i4")))
            if sum(len(x[0]) for x in out[-64:]) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)


def _marks(spans: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and counts of the packed spans of a row, in no order."""
    found = spans[row].values
    both = found.to_numpy() if found is not None else np.zeros(0, "i8")
    return both >> 32, both & 0xFFFFFFFF


def _each(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All places of the spans."""
    end = np.cumsum(count)
    return np.repeat(start - (end - count), count) + np.arange(end[-1])


def _checked_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, tie, body, spans of windows) -> a row for each window in the spans, by two hashes of its words."""
    names = ["h1", "h2", "doc", "tie", "start"]
    for batch in batches:
        doc, tie, spans, out, held = batch.column("doc").to_numpy(), batch.column("tie").to_numpy(), batch.column("spans"), [], 0
        for row, words in word_hashes(batch.column("body")):
            start, count = _marks(spans, row)
            if not len(start) or len(words) < K:
                continue
            at = _each(start, count)
            one, two = windows(words, K)[at], windows(mix(words ^ np.uint64(0x5851F42D4C957F2D)), K)[at]
            out.append((one.view("i8"), two.view("i8"), np.full(len(at), doc[row]), np.full(len(at), tie[row]), at.astype("i4")))
            held += len(at)
            if held > OUT_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)


def _spans_by_doc(spans: DataFrame) -> DataFrame:
    """The spans of a text in one list, each packed in a long: first window above 32 bits, number of windows below."""
    both = F.shiftleft(F.col("start").cast("long"), 32) + F.col("count")
    return spans.groupBy("doc", "tie").agg(F.collect_list(both).alias("spans"))


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(doc long, tie long, body) of different texts -> (doc, tie, start, count): windows that also start earlier, by first window and number."""
    found = texts.mapInArrow(_occurrences, "anchor long, path long, doc long, tie long, start int, count int")
    twice = found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    twice = stage_out(twice, "spans-anchors", rebalance=False)  # a plain table, so that the join can split a frequent anchor
    hits = stage_out(found.join(twice, "anchor"), "spans-hits", rebalance=False)
    first = hits.groupBy("anchor", "path").agg(F.min(F.struct("doc", "start", "tie")).alias("source"))
    first = stage_out(first, "spans-paths", rebalance=False)
    source = first.select(F.col("path").alias("p"), F.col("anchor").alias("a"), "source")
    later = hits.join(source, (F.col("path") == F.col("p")) & (F.col("anchor") == F.col("a"))).where((F.col("doc") != F.col("source.doc")) | (F.col("start") != F.col("source.start")))
    branching = first.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    check = first.join(branching, "anchor").select("anchor", "path", "source.doc", "source.tie", "source.start")
    count = hits.groupBy("anchor", "path").agg(F.max("count").alias("count"))
    check = check.join(count, ["anchor", "path"]).select("doc", "tie", "start", "count")
    wanted = _spans_by_doc(check).withColumnsRenamed({"doc": "d", "tie": "t"})
    at_source = texts.join(wanted, (F.col("doc") == F.col("d")) & (F.col("tie") == F.col("t"))).select("doc", "tie", "body", "spans").mapInArrow(_checked_windows, "h1 long, h2 long, doc long, tie long, start int")
    at_source = stage_out(at_source, "spans-windows", rebalance=False)
    earliest = at_source.groupBy("h1", "h2").agg(F.min(F.struct("doc", "start")).alias("source"), F.count("*").alias("n")).where("n > 1")
    shared = at_source.join(earliest, ["h1", "h2"]).where((F.col("doc") != F.col("source.doc")) | (F.col("start") != F.col("source.start")))
    return later.select("doc", "tie", "start", "count").unionByName(shared.select("doc", "tie", "start", F.lit(1).alias("count")))


_GAP = re.compile(rb"[ \t-\r]")


def _pieces(body: bytes) -> Iterator[list[bytes]]:
    """The words of a text, about CHUNK bytes at a time."""
    at = 0
    while at < len(body):
        gap = _GAP.search(body, at + CHUNK)
        end = gap.start() if gap else len(body)
        yield body[at:end].split()
        at = end


def _covered(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each word up to the last covered one: is it in a window of the spans?"""
    end = start + count + K - 1
    edge = np.zeros(int(end.max(initial=0)) + 1, "i4")
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1], dtype="i4") > 0


def _kept(body: bytes, gone: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(words, removed words, kept words joined by one space) for each piece of a text; pieces that keep words begin with a space but for the first."""
    at, any_yet = 0, False
    for words in _pieces(body):
        here = gone[at : at + len(words)]
        at += len(words)
        stay = [*compress(words, (~here).tolist()), *words[len(here) :]] if here.any() else words
        yield len(words), len(words) - len(stay), (b" " if any_yet and stay else b"") + b" ".join(stay)
        any_yet = any_yet or bool(stay)


def _cut_into(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    """(rest, body, copy, spans) -> rest with n_words, n_removed and the kept words joined by one space, or their digest."""
    for batch in batches:
        bodies, copies, spans = batch.column("body"), batch.column("copy"), batch.column("spans")
        rest = batch.drop_columns(["body", "copy", "spans"])
        total, removed, kept, size, done = [], [], [], 0, 0
        for row in range(batch.num_rows):
            body = (bodies[row].as_py() or "").encode()
            n = gone = 0
            text, sha = [], hashlib.sha256()
            whole = copies[row].as_py() and (n := sum(map(len, _pieces(body)))) >= K
            if whole:
                gone = n
            else:
                n = 0
                for words, less, part in _kept(body, _covered(*_marks(spans, row))):
                    n, gone = n + words, gone + less
                    sha.update(part) if digest else text.append(part)
            total.append(n)
            removed.append(gone)
            kept.append(sha.hexdigest() if digest else b"".join(text).decode())
            size += len(kept[-1])
            if size > OUT_BYTES or row == batch.num_rows - 1:
                out = rest.slice(done, row + 1 - done)
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                    names=[*out.schema.names, "n_words", "n_removed", "kept_sha256" if digest else "kept_text"],
                )
                total, removed, kept, size, done = [], [], [], 0, row + 1


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _cut_into(batches, False)


def _cut_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _cut_into(batches, True)


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """docs (or its columns in `keep`) with n_words, n_removed and kept_text (kept_sha256 of it, if digest).

    Every word is removed that a window of K words covers whose words also start earlier: in a row of a smaller id, or of the same id
    at an earlier word. Ids are whole numbers; null ids come last, as one id. Rows of equal id and text don't remove each other.
    A null text has no words; texts of under K words stay. Texts are read whole, in parts if they are very long. Input columns named like an added one are replaced. An empty
    table gives an empty result.
    """
    added = {"n_words", "n_removed", "kept_text", "kept_sha256"}
    kept = [c for c in only(docs, keep) if c.lower() not in added]
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    rows = docs.select(packed(kept).alias("rest"), doc.alias("doc"), F.col(text_col).cast("string").alias("body")).withColumn("text_hash", F.xxhash64("body"))
    groups = rows.where("body is not null").groupBy(text_id(F.col("body")).alias("h")).agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "first")
    groups = small(stage_out(groups, "spans-copies"))
    rows = rows.join(groups, text_id(F.col("body")) == F.col("h"), "left").withColumn("copy", F.coalesce(F.col("doc") > F.col("first"), F.lit(False))).drop("h", "first")
    shared_ids = rows.groupBy("doc").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).where("not (a <=> b)").select(F.col("doc").alias("d"))
    shared_ids = small(stage_out(shared_ids, "spans-ids")).withColumn("tied", F.lit(True))
    rows = rows.join(shared_ids, F.col("doc") == F.col("d"), "left").withColumn("tie", F.when(F.col("tied"), F.coalesce("text_hash", F.lit(0))).otherwise(0)).drop("d", "tied", "text_hash")
    spans = stage_out(_spans_by_doc(repeated_spans(rows.where("not copy and body is not null").select("doc", "tie", "body"))), "spans-found", rebalance=False).withColumnsRenamed({"doc": "d", "tie": "t"})
    out = rows.join(spans, (F.col("doc") == F.col("d")) & (F.col("tie") == F.col("t")), "left").select("rest", "body", "copy", "spans")
    rest_type = out.schema["rest"].dataType.simpleString()
    cut = out.mapInArrow(_cut_digest if digest else _cut, f"rest {rest_type}, n_words long, n_removed long, {'kept_sha256' if digest else 'kept_text'} string")
    return cut.select(*[f"rest.`{c}`" for c in kept], "n_words", "n_removed", "kept_sha256" if digest else "kept_text")


def op7_substring_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"], digest=True)


QUERIES = {"op7_substring_dedup": op7_substring_dedup}
ORACLE_SQL: dict[str, str] = {}
