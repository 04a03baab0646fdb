"""Quality classifier by positive-unlabelled learning with a non-negative risk.

Rows labelled 1 are the trusted positives, the web text at large is the unlabelled set. A scorer on form features of the whole
text (a layer of random hidden units and a trained output) minimises the non-negative unbiased risk
pi * R_P(+) + max(0, R_U(-) - pi * R_P(-)). With the squared loss every part of it is a quadratic form of the output weights,
so that sums over all usable unlabelled rows, taken where the rows are, hold the whole risk: none is sampled.

The class prior pi is estimated from scores of positives and unlabelled texts alone, no label 0 is read: at any threshold the
share of unlabelled texts above it is at least pi times the share of positives, so the smallest ratio of the two bounds pi.
Features are computed once for every text and staged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import log
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfrontier.llm.common import only, packed, stage_out, table
from sparkfrontier.llm.toxicity import held_out_id

#: Trusted positives that are fitted on at most, chosen by the hash of their id.
FIT_POSITIVE = 4000
#: Random hidden units, their seed, and the ridge of the output weights: a part that stays, and one that few positives need.
HIDDEN, SEED, RIDGE, RIDGE_FEW = 160, 5, 1e-3, 4.0
#: Bins of the scores that the prior is read from, and how many positives at least lie above a threshold of it.
BINS, LEAST_ABOVE = 1000, 30
#: Tasks that add up what other tasks have summed.
ADDERS = 64
PASS = 0.7

_SYMBOL = re.compile(r"[^\w\s.,;:!?'’\"()\-]")
_SYMBOL_WORD = re.compile(r"\S*[^\w\s.,;:!?'’\"()\-]\S*")
_CAPITAL = re.compile(r"(?<!\S)[A-ZÀ-ÖØ-ÞА-Я]")


def features(text: str | None) -> list[float]:
    """Shares of words (0 to 1) by form, over the whole text and in its worst lines, and lengths."""
    text = text or ""
    lines = [w for x in text.split("\n") if (w := x.split())]
    n = sum(map(len, lines))
    if not n:
        return [0.0] * N_FEATURES
    bad, worst = [0] * 6, [0.0] * 6
    seen: set[str] = set()
    distinct: set[str] = set()
    dup_words = chars = longest = short = upper_first = 0
    for line in lines:
        k, joined, kinds = len(line), " ".join(line), set(line)
        if joined in seen:
            dup_words += k
        seen.add(joined)
        distinct |= kinds
        symbols = len(_SYMBOL_WORD.findall(joined)) if _SYMBOL.search(joined) else 0
        bare = sum(map(line.count, [w for w in kinds if not w[0].isalnum() and not any(map(str.isalnum, w))]))
        row = (symbols, joined.count("!!") + joined.count("??"), sum(map(str.isupper, line)), bare, sum(map(eq, line, line[1:])), k - len(kinds))
        bad = [x + y for x, y in zip(bad, row, strict=True)]
        if k >= 4:
            worst = [max(x, y / k) for x, y in zip(worst, row, strict=True)]
        chars += len(joined) - k + 1
        longest = max(longest, max(map(len, kinds)))
        short += k if k < 4 else 0
        upper_first += len(_CAPITAL.findall(joined))
    d = len(distinct)
    return [
        *(x / n for x in bad), *worst, dup_words / n, len(lines) / n, d / n, d / n**0.8, min(1.0, chars / n / 12), log(1 + n) / 10,
        sum(map(text.count, ".!?")) / n, sum(map(text.count, "0123456789")) / (chars + 1), upper_first / n, longest / 100, short / n, text.count(",") / n,
    ]


N_FEATURES = 24


@dataclass
class Units:
    """The fixed part of the scorer: standardised features, and random hidden units of them."""

    mean: np.ndarray
    scale: np.ndarray
    seed: int = SEED

    def __call__(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        w, b = rng.normal(0, 0.5, (N_FEATURES, HIDDEN)), rng.normal(0, 0.7, HIDDEN)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.ones(len(x)), z / 4, np.tanh(z @ w + b)])


N_UNITS = 1 + N_FEATURES + HIDDEN


@dataclass
class Scorer:
    units: Units
    out: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip((1 + self.units(x) @ self.out) / 2, 0.0, 1.0)


def fit(positive: np.ndarray, moment: np.ndarray, prior: float) -> np.ndarray:
    """Output weights that minimise the non-negative risk, of the positives' units and the mean outer product of the unlabelled rows' units.

    The loss of an output f is (1 - f)^2 / 4 for a positive, (1 + f)^2 / 4 for a negative. Where the negative part would
    fall below 0 it counts for the share of itself that keeps it at 0.
    """
    p = positive.T @ positive / len(positive)
    up, uu = p[0], moment[0]  # the first unit is constant, so these are the means

    def solve(t: float) -> np.ndarray:
        h = prior * (1 - t) * p + t * moment + (RIDGE + RIDGE_FEW / len(positive)) * np.eye(N_UNITS)
        return np.linalg.solve(h, prior * up - t * (uu - prior * up))

    def negative(w: np.ndarray) -> float:
        return (1 + 2 * uu @ w + w @ moment @ w) - prior * (1 + 2 * up @ w + w @ p @ w)

    w = solve(1.0)
    if negative(w) < 0:
        low, high = 0.0, 1.0
        for _ in range(40):
            t = (low + high) / 2
            w = solve(t)
            low, high = (low, t) if negative(w) < 0 else (t, high)
    return w


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The smallest ratio of the unlabelled and the positive share above a score, of counts by score bins from the highest score down.

    Both shares' standard errors are added, so that few positives at the top don't decide. The rows should be others
    than those the scorer was fitted on. 0.5 without rows.
    """
    n, m = positive.sum(), unlabelled.sum()
    if n < 2 or not m:
        return 0.5
    above = np.cumsum(positive)
    p, u = above / n, np.cumsum(unlabelled) / m
    error = np.sqrt(p * (1 - p) / n) + np.sqrt(u * (1 - u) / m)
    some = above >= min(LEAST_ABOVE, n)
    return float(np.clip(((u + error) / np.maximum(p, 1e-12))[some].min(), 0.02, 0.98))


def with_features(docs: DataFrame, text_col: str, **columns) -> DataFrame:
    """The columns and x, the features of the whole text (array<float>), staged."""

    @F.pandas_udf("array<float>")
    def form(text: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in text])

    return stage_out(docs.select(*[c.alias(k) for k, c in columns.items()], form(F.col(text_col)).alias("x")), "quality-features", rebalance=False)


def _matrix(x: pa.Array) -> np.ndarray:
    return np.asarray(x.flatten(), "f8").reshape(-1, N_FEATURES)


def _moments(units: Units):
    """(half, x) -> a row for each half in a task: number of rows and sum of their outer products."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(2, "i8"), np.zeros((2, N_UNITS, N_UNITS))
        for batch in batches:
            half, x = batch.column("half").to_numpy(), _matrix(batch.column("x"))
            for at in range(0, len(x), 1 << 14):
                u, h = units(x[at : at + (1 << 14)]), half[at : at + (1 << 14)]
                for k in (0, 1):
                    n[k] += (h == k).sum()
                    total[k] += u[h == k].T @ u[h == k]
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(n), pa.array([t.tobytes() for t in total], pa.binary())], names=["half", "n", "total"])

    return sums


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = np.zeros(2, "i8"), np.zeros((2, N_UNITS * N_UNITS))
    for batch in batches:
        for half, count, one in zip(batch.column("half").to_pylist(), batch.column("n").to_pylist(), batch.column("total"), strict=True):
            n[half] += count
            total[half] += np.frombuffer(one.as_py())
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(n), pa.array([t.tobytes() for t in total], pa.binary())], names=["half", "n", "total"])


def _binned(scores: np.ndarray) -> np.ndarray:
    return BINS - np.floor(scores * BINS).astype("i4")


def learn(rows: DataFrame, labels: DataFrame, held, id_col: str = "doc_id") -> Scorer | None:
    """The scorer of staged rows (id, held, x): positives are ids labelled 1 and never 0, rows that aren't held out are unlabelled text.

    An id's rows with different texts all count as unlabelled; as a positive, the one with the smallest features. None without positives.
    """
    usable = labels.where(~held & F.col(id_col).isNotNull() & F.col("quality").isin(0, 1))
    trusted = usable.groupBy(F.col(id_col).alias("id_")).agg(F.min("quality").alias("y")).where("y = 1").orderBy(F.xxhash64("id_"), "id_").limit(FIT_POSITIVE)
    web = rows.where("not held and id is not null")
    found = web.join(F.broadcast(trusted.select("id_")), F.col("id") == F.col("id_"))  # FIT_POSITIVE ids
    one = found.groupBy("id_").agg(F.min("x").alias("x")).orderBy(F.xxhash64("id_"), "id_").collect()
    if not one:
        return None
    positive = np.array([r["x"] for r in one], "f8").reshape(-1, N_FEATURES)
    column = lambda f: [f(F.col("x")[i].cast("double")) for i in range(N_FEATURES)]
    spread = web.agg(*column(F.avg), *column(F.stddev_pop)).first()
    units = Units(np.array(spread[:N_FEATURES], "f8"), np.array(spread[N_FEATURES:], "f8") + 1e-3)
    halves = web.select(F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("half"), "x")
    sums = stage_out(halves.mapInArrow(_moments(units), "half int, n long, total binary"), "quality-moments", rebalance=False)
    added = sums.repartition(ADDERS).mapInArrow(_added, "half int, n long, total binary").orderBy("half", "total").collect()
    n, total = np.zeros(2), np.zeros((2, N_UNITS, N_UNITS))
    for r in added:  # 2 * ADDERS rows
        n[r["half"]] += r["n"]
        total[r["half"]] += np.frombuffer(r["total"]).reshape(N_UNITS, N_UNITS)
    u = units(positive)
    if not n.all() or len(u) < 2:
        return Scorer(units, fit(u, total.sum(0) / n.sum(), 0.5))
    # fitted on one half, the prior is read from the other
    first = Scorer(units, fit(u[::2], total[0] / n[0], 0.5))
    bins = halves.where("half = 1").groupBy(_scored(halves, first, bins=True).alias("bin")).agg(F.count("*").alias("n")).collect()
    web_bins = np.zeros(BINS + 1)
    for r in bins:
        web_bins[r["bin"]] = r["n"]
    prior = estimated_prior(np.bincount(_binned(first(positive[1::2])), minlength=BINS + 1), web_bins)
    return Scorer(units, fit(u, total.sum(0) / n.sum(), prior))


def _scored(rows: DataFrame, scorer: Scorer | None, bins: bool = False):
    if scorer is None:
        return F.lit(0.5)

    @F.pandas_udf("int" if bins else "double")
    def score(x: pd.Series) -> pd.Series:
        scores = scorer(np.array(x.tolist(), "f8").reshape(-1, N_FEATURES))
        return pd.Series(_binned(scores) if bins else scores)

    return score(rows["x"])


def score_quality(docs: DataFrame, labels: DataFrame, held=None, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs (or its columns in `keep`) with quality (0 to 1) and quality_held_out; one row per input row, whole texts of any length; null is empty.

    Labels and texts of rows that `held` names aren't learned from. A row's score depends on its text alone, so repeated
    rows get equal scores; rows without an id are scored, not learned from. Without positives or texts to learn from all
    scores are 0.5. Input columns named like an added one are replaced. An empty table gives an empty result.
    """
    held = F.lit(False) if held is None else held
    kept = [c for c in only(docs, keep) if c.lower() not in {"quality", "quality_held_out"}]
    rows = with_features(docs, text_col, row=packed(kept), id=F.col(id_col), held=held)
    return rows.select(*[f"row.`{c}`" for c in kept], _scored(rows, learn(rows, labels, held, id_col)).alias("quality"), F.col("held").alias("quality_held_out"))


def op5_quality_classifier(spark, sf_dir):
    out = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out_id("doc_id", 4, 2), keep=["doc_id"])
    return out.select("doc_id", F.col("quality_held_out").alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= PASS).cast("int").alias("predicted"))


QUERIES = {"op5_quality_classifier": op5_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
