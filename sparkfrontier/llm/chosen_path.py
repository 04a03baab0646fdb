"""N-gram Jaccard join by chosen paths.

Documents become sets of hashed five-word shingles, equal sets become one class. Each set is embedded as min-wise hashes
(sampled tokens). A run sends every set down the paths of its sampled tokens: sets that share a token meet in a bucket, buckets
above a limit are split again on further tokens that the path chooses, small ones are compared by brute force on the
embedding. Runs repeat until a pair at the threshold is met with the target probability. What meets is gathered into
candidate groups, and exact Jaccard similarities over the whole sets decide, each pair of sets once, in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfrontier.llm.common import small, stage_out, table
from sparkfrontier.llm.components import connected
from sparkfrontier.llm.tokens import windows, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
TARGET_RECALL = 0.9999
#: Tokens that a path chooses at each node, and levels of splitting.
BRANCH, LEVELS = 2, 6
#: A bucket of more sets than this is split; a block of a comparison has about so many sets, or tokens, at most.
BUCKET, BLOCK, BLOCK_TOKENS = 2048, 1024, 1 << 21
#: Groups of more than SPREAD sets are cut into up to WAYS blocks already, so that other tasks share the work.
SPREAD, WAYS = 128, 16
COORDINATES = 48
#: Splitting doesn't help a bucket in which this share of the sets agrees in a token.
DENSE = 0.5

_rng = np.random.default_rng(31)
_A = _rng.integers(1, 1 << 63, COORDINATES, dtype="u8") | np.uint64(1)
_B = _rng.integers(0, 1 << 63, COORDINATES, dtype="u8")


def runs_needed(threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> int:
    """Runs until two sets at the threshold meet with probability target, if every bucket is split to the last level."""
    meet = 1.0
    for _ in range(LEVELS):
        meet = 1 - (1 - threshold * meet) ** BRANCH
    return ceil(log(1 - target) / log(1 - meet))


RUNS = runs_needed()
_AGREE = int(COORDINATES * (THRESHOLD - 4 * sqrt(THRESHOLD * (1 - THRESHOLD) / COORDINATES)))


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for row, words in word_hashes(texts):
        yield row, np.unique(windows(words, SHINGLE))


def _embed(tokens: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, np.iinfo("u8").max, "u8")
    for i in range(0, len(tokens), 4096):
        part = tokens[i : i + 4096]
        out = np.minimum(out, (part[:, None] * _A + _B).min(0))
    return out


def _set_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


_ROWS = "id string, text_hash long, node long, size int, sketch binary, buckets array<long>"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        node, size, sketch, buckets = [None] * n, [0] * n, [None] * n, [None] * n
        for row, tokens in shingle_sets(batch.column(2)):
            if len(tokens):
                mins = _embed(tokens)
                node[row], size[row] = _set_id(tokens), len(tokens)
                sketch[row] = (mins & np.uint64(0xFFFF)).astype("<u2").tobytes()  # a minimum's low bits are even, its high bits aren't
                buckets[row] = mins[: RUNS * BRANCH].view("i8") ^ np.arange(RUNS * BRANCH)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(sketch, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))],
            names=["id", "text_hash", "node", "size", "sketch", "buckets"],
        )


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Slices of equal leading columns; the rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            key = tuple(c[lo] for c in cols)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Label of each of n items under the given links: the smallest index it is joined with."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Brute force within each bucket on the embedding: a forest of the sets that agree in enough coordinates."""
    a, b = [], []

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(np.concatenate(a) if a else [], pa.int64()), pa.array(np.concatenate(b) if b else [], pa.int64())], names=["a", "b"])
        a.clear()
        b.clear()
        return made

    for group in _groups(batches, 3):
        n = group.num_rows
        if n < 2:
            continue
        group = group.take(np.argsort(group.column("node").to_numpy(), kind="stable"))  # stars around the smallest node: other buckets give the same edges
        node = group.column("node").to_numpy()
        side = group.column("side").to_numpy()
        size = group.column("size").to_numpy().astype("f8")
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), "<u2").reshape(n, COORDINATES)
        left, right = [], []
        cross = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        step = max(1, (1 << 22) // (n * COORDINATES) + 1)
        for lo in range(0, n - 1, step):
            hi = min(n, lo + step)
            agree = (sketch[lo:hi, None, :] == sketch[None, lo + 1 :, :]).sum(2) if n > 2 else (sketch[:1, None, :] == sketch[None, 1:, :]).sum(2)
            fits = (agree >= _AGREE) & (np.minimum(size[lo:hi, None], size[None, lo + 1 :]) >= THRESHOLD * np.maximum(size[lo:hi, None], size[None, lo + 1 :]))
            if cross:
                fits &= side[lo:hi, None] != side[None, lo + 1 :]
            x, y = np.nonzero(fits)
            x, y = x + lo, y + lo + 1
            ok = x < y
            left.append(x[ok])
            right.append(y[ok])
        label = _forest(n, np.concatenate(left), np.concatenate(right))
        joined = np.flatnonzero(label != np.arange(n))
        if len(joined):
            a.append(node[label[joined]])
            b.append(node[joined])
            if len(a) >= 2000:
                yield out()
    yield out()


def _blocks(n: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK), F.least(F.lit(WAYS), F.ceil(n / SPREAD)))


def _blocked(df: DataFrame, blocks: Column) -> DataFrame:
    """Rows of a large group once for each pair of blocks that they take part in: columns i, j, side."""
    df = df.withColumn("_g", F.greatest(F.lit(1), blocks).cast("int")).withColumn("side", F.pmod(F.xxhash64("node"), F.col("_g")).cast("int"))
    df = df.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    return df.withColumn("i", F.least("side", "_o")).withColumn("j", F.greatest("side", "_o")).drop("_g", "_o")


def _candidates(sets: DataFrame) -> DataFrame:
    """Edges of a forest over sets that meet in a bucket of some run."""
    spread = lambda df: df.select("bucket", "i", "j", "side", "node", "size", "sketch")
    compare = lambda df: spread(df).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_pairs, "a long, b long")
    entries = sets.select(F.explode("buckets").alias("bucket"), "node", "size", "sketch")
    found = []
    for level in range(LEVELS + 1):
        counts = stage_out(entries.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET), "path-large")
        large = small(counts)
        alone = entries.join(large, "bucket", "left_anti").withColumns({"i": F.lit(0), "j": F.lit(0), "side": F.lit(0)})
        found.append(compare(alone))
        if counts.isEmpty():
            break
        hot = stage_out(entries.join(large, "bucket"), "path-hot")
        share = None
        for c in range(4):  # how far the sets of a bucket agree in tokens that no path has chosen yet
            at = hot.groupBy("bucket", F.expr(f"substring(sketch, {2 * (COORDINATES - 1 - c) + 1}, 2)").alias("v")).agg(F.count("*").alias("k")).groupBy("bucket").agg(F.max("k").alias("k"))
            share = at if share is None else share.unionByName(at)
        top = stage_out(share.groupBy("bucket").agg((F.sum("k") / 4).alias("k")), "path-dense")
        hot = hot.join(small(top), "bucket")
        dense = (F.col("k") > DENSE * F.col("n")) | F.lit(level == LEVELS)
        found.append(compare(_blocked(hot.where(dense), F.ceil(F.col("n") / BLOCK))))
        chosen = [F.struct(F.xxhash64("bucket", F.lit(b), F.expr(f"substring(sketch, cast(2 * pmod(xxhash64(bucket, {b}), {COORDINATES}) + 1 as int), 2)")).alias("bucket")) for b in range(BRANCH)]
        entries = hot.where(~dense).select(F.explode(F.array(*chosen)).alias("c"), "node", "size", "sketch").select("c.bucket", "node", "size", "sketch")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, node, ...) -> the whole set of the rows whose text has that set."""
    for batch in batches:
        keep, tokens = [], []
        node = batch.column("node").to_numpy()
        for row, found in shingle_sets(batch.column("body")):
            if len(found) and _set_id(found) == node[row]:
                keep.append(row)
                tokens.append(found.tobytes())
        rest = batch.drop_columns(["body"]).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(tokens, pa.binary())], names=[*rest.schema.names, "tokens"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within each pair of blocks: copies linked to each set (b null), and a forest of the links (w null)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("w", pa.int64())])
    for group in _groups(batches, 3):
        node, first = np.unique(group.column("node").to_numpy(), return_index=True)
        n = len(node)
        if n < 2:
            continue
        side, copies = group.column("side").to_numpy()[first], group.column("m").to_numpy()[first]
        cross = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        binary = group.column("tokens")
        sets = [np.frombuffer(binary[int(k)].as_py(), "u8") for k in first]
        size = np.array([len(s) for s in sets], "f8")
        token, where = np.unique(np.concatenate(sets), return_inverse=True)
        held = np.bincount(where)
        column = np.where(held > 1, np.cumsum(held > 1) - 1, -1)  # tokens of one set are in no intersection
        at = np.concatenate([[0], np.cumsum(size)]).astype("i8")
        width = int((held > 1).sum())
        common = np.zeros((n, n), "f4")
        columns = [c[c >= 0] for c in (column[where[at[k] : at[k + 1]]] for k in range(n))]
        columns = [np.sort(c) for c in columns]
        for lo in range(0, width, 4096):
            dense = np.zeros((n, min(4096, width - lo)), "f4")
            for k, c in enumerate(columns):
                dense[k, c[np.searchsorted(c, lo) : np.searchsorted(c, lo + 4096)] - lo] = 1
            common += dense @ dense.T
        linked = common >= THRESHOLD * (size[:, None] + size[None, :] - common) - 1e-6
        np.fill_diagonal(linked, False)
        if cross:
            linked &= side[:, None] != side[None, :]
        weight = linked @ copies
        some = np.flatnonzero(weight)
        if len(some):
            x, y = np.nonzero(np.triu(linked))
            label = _forest(n, x, y)
            joined = np.flatnonzero(label != np.arange(n))
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.nulls(len(some), pa.int64()), pa.array(weight[some].astype("i8"))], schema=schema)
            yield pa.RecordBatch.from_arrays([pa.array(node[label[joined]]), pa.array(node[joined]), pa.nulls(len(joined), pa.int64())], schema=schema)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, text_hash, set_node, class_id, class_hash, n_links.

    A link joins two rows whose sets of five-word shingles have a Jaccard similarity of THRESHOLD or more; a text of
    fewer words is one shingle, a text without words (null, empty) has no set and no link. A class is what links lead to
    from a row; class_id and class_hash are those of its first row by id (nulls last) and hash of the text. n_links counts the other
    rows that a row is linked to, copies included. Ids are compared as their type does. An empty table gives an
    empty result; other columns aren't read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("body"))
    rows = stage_out(plain.mapInArrow(_rows, _ROWS), "path-rows").withColumn("id", F.col("id").cast(id_type))
    first = F.min(F.struct(F.col("id").isNull().alias("nul"), "id", "text_hash")).alias("rep")
    sets = stage_out(rows.where("node is not null").groupBy("node").agg(first, F.count("*").alias("m"), F.max("size").alias("size"), F.max("sketch").alias("sketch"), F.max("buckets").alias("buckets")), "path-sets")
    edges = stage_out(_candidates(sets), "path-candidates")
    groups = connected(edges, "path-groups")
    groups = stage_out(groups.join(sets.select("node", "rep", "m", "size"), "node"), "path-members")
    sizes = groups.groupBy("label").agg(F.greatest(_blocks(F.count("*")), F.ceil(F.sum("size") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    members = stage_out(groups.join(sizes, "label").select("label", "blocks", "node", F.col("rep.id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"), "m"), "path-blocks")
    first_row = (F.col("text_hash") == F.col("rep_hash")) & F.col("id").eqNullSafe(F.col("rep_id"))  # of each set: its copies stay behind
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("body")).join(small(members), first_row).select("body", "label", "blocks", "node", "m")
    whole = texts.mapInArrow(_sets, "label long, blocks int, node long, m long, tokens binary")
    blocks = _blocked(whole, F.col("blocks")).select("label", "i", "j", "side", "node", "m", "tokens")
    exact = stage_out(blocks.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j").mapInArrow(_exact, "a long, b long, w long"), "path-links")
    counts = exact.where("w is not null").groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("w"))
    classes = connected(exact.where("b is not null").select("a", "b"), "path-classes")
    linked = sets.where("m > 1").select("node").union(classes.select("node")).distinct()
    known = linked.join(sets.select("node", "rep", "m"), "node").join(classes, "node", "left").join(counts, "node", "left")
    known = known.select("node", "rep", F.coalesce("label", "node").alias("label"), (F.coalesce("w", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    names = known.groupBy("label").agg(F.min("rep").alias("class"))
    known = stage_out(known.join(names, "label").select("node", "class", "n_links"), "path-known")
    out = rows.select("id", "text_hash", "node").join(small(known), "node", "left")
    own = lambda theirs, mine: F.when(F.col("n_links").isNull(), F.col(mine)).otherwise(F.col(theirs))
    return out.select("id", "text_hash", F.col("node").alias("set_node"), own("class.id", "id").alias("class_id"), own("class.text_hash", "text_hash").alias("class_hash"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the first row of each class only; docs' own columns.

    Documents without words are no copies of each other and all stay. Of rows equal in id and text one stays.
    """
    found = stage_out(jaccard_join(docs, id_col, text_col), "path-classed")
    gone = found.where("not (id <=> class_id and text_hash = class_hash)").select(F.col("id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    gone = stage_out(gone, "path-gone")
    out = docs.join(small(gone), F.col(id_col).eqNullSafe(F.col("gone_id")) & (F.xxhash64(text_col) == F.col("gone_hash")), "left_anti")
    twice = found.where("set_node is not null").groupBy("id", "text_hash").agg(F.count("*").alias("c")).where("c > 1").select(F.col("id").alias("twice_id"), F.col("text_hash").alias("twice_hash"))
    twice = stage_out(twice, "path-twice")
    if twice.isEmpty():
        return out
    same = F.col(id_col).eqNullSafe(F.col("twice_id")) & (F.xxhash64(text_col) == F.col("twice_hash"))
    return out.join(small(twice), same, "left_anti").unionByName(out.join(small(twice), same, "left_semi").dropDuplicates([id_col, text_col]))


def op3_jaccard_join(spark, sf_dir):
    out = jaccard_join(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "class_id", "n_links", F.col("set_node").alias("set_id"))


QUERIES = {"op3_jaccard_join": op3_jaccard_join}
ORACLE_SQL: dict[str, str] = {}
