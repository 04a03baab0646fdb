"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer maps words to insult or threat classes with weights (learned from a bounded sample of labelled
rows: whole words and stems that mark toxic documents) and to target, negation and reported-speech classes (fixed lists).
The grammar composed on it (`grammar`) reads the classes of a clause and writes what is said in it: an insult, one aimed at a
target, one negated, one reported, a threat. A document's score is a logistic of the weights that its matched clauses
have in these channels, fitted on the same sample. A word alone, or in a list of such words, is no clause and weighs nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property
from math import exp, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from sparkfrontier.llm import grammar
from sparkfrontier.llm.common import only, small, stage_out, table

#: Labelled rows of each class that the model is fitted on at most, the ones with the smallest hash of their id.
FIT_ROWS = 3000
#: A learned word needs so many toxic documents, and this log ratio of document rates; and so does a stem, for so many words at least.
MIN_SUPPORT, MIN_WEIGHT = 5, 2.5
STEM_SUPPORT, STEM_WEIGHT, STEM_WORDS = 10, 2.0, 3
PREFIXES = (7, 6, 5, 4, 3)
PASS = 0.7
#: Ridge of the weight of a document's length, which says little by itself.
LENGTH_RIDGE = 1000.0

# Closed-class words of the grammar.
TARGETS = frozenset("you your you're u ur he she they them him her his their everyone tu te ton vous votre toi il elle ils du dein dich dir ihr euch er sie tú tu usted ustedes él ella ellos".split())
NEGATIONS = frozenset("not no never neither nor without isn't aren't wasn't don't doesn't didn't pas jamais aucun sans nicht kein keine nie niemals ohne nunca jamás tampoco sin".split())
REPORTS = frozenset("said says say wrote called quoted claimed according reported dit selon sagte laut dijo según".split())
THREATS = frozenset("kill hurt destroy beat murder burn tuer töten matar".split())

_CLASS = {w: c for c, listed in ((grammar.TARGET, TARGETS), (grammar.NEGATION, NEGATIONS), (grammar.REPORT, REPORTS), (grammar.THREAT, THREATS)) for w in listed}
_CLAUSE = re.compile(r"([^.!?;:\n\r|]+)([.!?;:\n\r|]*)")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")

#: The channels' weights, then matched clauses, then all clauses.
N_FEATURES = len(grammar.CHANNELS) + 2


@dataclass
class Scorer:
    words: dict
    stems: dict
    bias: float
    weights: tuple

    @cached_property
    def heads(self) -> frozenset:
        return frozenset(s[:PREFIXES[-1]] for s in self.stems)

    def entry(self, word: str) -> float:
        """The weight of the lexicon's longest match on a word, 0 if none."""
        if word in self.words:
            return self.words[word]
        stem = _matches(word, self.stems)
        return self.stems[stem] if stem else 0.0

    def insults(self, tokens: list[str]) -> dict[int, float]:
        """Place and weight of the lexicon's matches; most clauses have no word that could be one."""
        words, heads, k = self.words, self.heads, PREFIXES[-1]
        maybe = [i for i, w in enumerate(tokens) if w in words or w[:k] in heads]
        return {i: x for i in maybe if (x := self.entry(tokens[i]))}

    def features(self, text: str | None) -> list[float]:
        """Per channel, log(1 + summed weight over all clauses); then log(1 + matched clauses) and log(1 + clauses)."""
        total, matched, clauses = dict.fromkeys(grammar.CHANNELS, 0.0), 0, 0
        for m in _CLAUSE.finditer((text or "").lower()):
            tokens = _WORD.findall(m.group(1))
            clauses += bool(tokens)
            insults = self.insults(tokens)
            if not insults and THREATS.isdisjoint(tokens):
                continue
            classes = [grammar.INSULT if i in insults else _CLASS.get(w, grammar.OTHER) for i, w in enumerate(tokens)]
            classes += [grammar.OTHER] * ("!" in m.group(2))  # a word that is shouted is said, not named
            got = grammar.clause_weights(classes, [insults.get(i, 1.0) for i in range(len(classes))])
            matched += bool(got)
            for k, v in got.items():
                total[k] += v
        return [*(log(1 + total[k]) for k in grammar.CHANNELS), log(1 + matched), log(1 + clauses)]

    def score(self, text: str | None) -> float:
        z = self.bias + sum(a * b for a, b in zip(self.weights, self.features(text), strict=True))
        return 1 / (1 + exp(-max(-30.0, min(30.0, z))))


def _matches(word: str, stems) -> str | None:
    return next((word[:k] for k in PREFIXES if len(word) > k and word[:k] in stems), None)


def held_out_id(id_col: str, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held: Column, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_, y, text): at most `rows` labelled ids of each class that aren't held out, chosen by their hash, a row each.

    An id labelled both ways isn't used; of an id's different texts the one with the smallest hash is.
    """
    usable = labels.where(F.col(label).isin(0, 1) & ~held & F.col(id_col).isNotNull())
    agreed = usable.groupBy(F.col(id_col).alias("id_")).agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("other")).where("y = other").drop("other")
    by_hash = lambda y: agreed.where(F.col("y") == y).orderBy(F.xxhash64("id_"), "id_").limit(rows)
    found = docs.join(F.broadcast(by_hash(0).unionByName(by_hash(1))), F.col(id_col) == F.col("id_"))  # 2 * rows ids
    text = F.coalesce(F.col(text_col), F.lit(""))
    return found.groupBy("id_", "y").agg(F.min_by(text, F.struct(F.xxhash64(text), F.octet_length(text))).alias("text"))


@F.pandas_udf(ArrayType(StringType()))
def _tokens(text: pd.Series) -> pd.Series:
    return pd.Series([_WORD.findall(t.lower()) for t in text])


def learn_lexicon(sample: DataFrame) -> tuple[dict, dict]:
    """Whole words and stems that are found in toxic rows exp(MIN_WEIGHT) times as often as in clean rows, of (id_, y, text).

    Candidates come from document counts. What counts as support is different contexts (the words before and after), so
    that the words of one document don't enter the lexicon because the document has many near copies. The shortest stem
    that marks toxic rows is kept, if it covers several words and none of them makes most of it; of those, the words that
    clean rows have more often are entered without weight, and the others need no entry. All counting is done where the rows are; the entries alone come to the driver.
    """
    rows = stage_out(sample.select("id_", "y", _tokens("text").alias("ws")), "toxicity-sample")
    n = rows.agg(F.count_if(F.col("y") == 0).alias("clean"), F.count_if(F.col("y") == 1).alias("toxic")).first()
    word = "transform(ws, (w, i) -> named_struct('w', w, 'c', concat(if(i > 0, ws[i - 1], ''), ' ', if(i + 1 < size(ws), ws[i + 1], ''))))"
    each = rows.select("id_", "y", F.explode(F.expr(word)).alias("x")).select("id_", "y", "x.w", "x.c")
    stem = F.explode(F.expr(f"transform(filter(array({', '.join(map(str, PREFIXES))}), k -> char_length(w) > k), k -> substring(w, 1, k))")).alias("s")

    def weight(a: Column, b: Column) -> Column:
        return F.log((a + 0.5) / (max(1, n["toxic"]) + 1)) - F.log((b + 0.5) / (max(1, n["clean"]) + 1))

    def marks(support: int, least: float) -> Column:  # also with 1.6 standard errors less
        a, b = F.col("a"), F.col("b")
        return (a >= support) & (weight(a, b) >= least) & (weight(a, b) - 1.6 * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) >= least - 1)

    a, b = F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")
    good_word, good_stem = marks(MIN_SUPPORT, MIN_WEIGHT), marks(STEM_SUPPORT, STEM_WEIGHT)
    by_doc = stage_out(each.select("id_", "y", "w").distinct(), "toxicity-words")
    words = stage_out(by_doc.groupBy("w").agg(a, b).where(good_word).select("w"), "toxicity-candidates")
    cover = by_doc.select("y", "w", stem).where("y = 1").groupBy("s").agg(F.count_distinct("w").alias("n")).where(F.col("n") >= STEM_WORDS).select("s")
    stems = by_doc.select("id_", "y", stem).distinct().groupBy("s").agg(a, b).where(good_stem).join(cover, "s").select("s")
    stems = stage_out(stems, "toxicity-stems")
    places = each.select("y", "w", "c").distinct()
    words = places.join(small(words), "w").groupBy("w").agg(a, b).where(good_word).select("w", "a", weight(F.col("a"), F.col("b")).alias("x"))
    words = stage_out(words, "toxicity-lexicon")
    stems = places.select("y", "w", "c", stem).join(small(stems), "s").select("s", "y", "c").distinct().groupBy("s").agg(a, b).where(good_stem)
    main = words.select("w", "a", stem).groupBy("s").agg(F.max("a").alias("main"))
    stems = stems.join(main, "s", "left").where(F.coalesce("main", F.lit(0)) <= 0.5 * F.col("a")).select("s", weight(F.col("a"), F.col("b")).alias("x"))
    kept: dict[str, float] = {}
    for s, x in sorted(map(tuple, stems.collect()), key=lambda e: (len(e[0]), e[0])):
        if not _matches(s, kept):
            kept[s] = x
    entries = {w: x for w, x in sorted(map(tuple, words.select("w", "x").collect())) if not _matches(w, kept)}
    if kept:
        listed = sample.sparkSession.createDataFrame([(s,) for s in kept], "s string")
        clean = by_doc.select("w", "y", stem).join(F.broadcast(listed), "s").groupBy("w").agg(a, b).where("b > a").select("w")
        entries |= {r["w"]: 0.0 for r in clean.collect()}
    return entries, kept


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, tuple]:
    """Bias and channel weights by balanced ridge logistic regression; without both classes the score is the label share."""
    if not len(y) or y.min() == y.max():
        share = min(0.999, max(0.001, float(y.mean()))) if len(y) else 0.001
        return log(share / (1 - share)), (0.0,) * N_FEATURES
    x = np.column_stack([np.ones(len(y)), x])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.1)
    ridge[-1] = LENGTH_RIDGE
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (balance * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (balance * (p - y)) + ridge * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), tuple(map(float, w[1:]))


def learn(docs: DataFrame, labels: DataFrame, held: Column | None = None, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Lexicon and channel weights of at most `rows` labelled ids a class; their texts stay in the executors."""
    sample = stage_out(labelled_sample(docs, labels, "toxic", F.lit(False) if held is None else held, rows, id_col, text_col), "toxicity-labelled")
    words, stems = learn_lexicon(sample)
    draft = Scorer(words, stems, 0.0, (0.0,) * N_FEATURES)

    @F.pandas_udf("array<double>")
    def features(text: pd.Series) -> pd.Series:
        return pd.Series([draft.features(t) for t in text])

    found = sample.select("id_", "y", features("text").alias("x")).orderBy("id_").collect()  # 2 * rows rows of N_FEATURES numbers
    return Scorer(words, stems, *fit(np.array([r["x"] for r in found], "f8").reshape(-1, N_FEATURES), np.array([r["y"] for r in found], "f8")))


def score_toxicity(docs: DataFrame, scorer: Scorer, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """docs (or its columns in `keep`) with toxicity (0 to 1); one row per input row, whole texts of any length; null is empty.

    A row's score depends on its text alone, so repeated rows get equal scores. An input column named toxicity is
    replaced. An empty table gives an empty result.
    """

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([scorer.score(t) for t in text], dtype="float64")

    kept = [c for c in only(docs, keep) if c.lower() != "toxicity"]
    return docs.select(*[F.col(f"`{c}`") for c in kept], score(F.col(text_col)).alias("toxicity"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = PASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that score the threshold or more; docs' own columns, whatever their names.

    A null text is empty. Without labels, or with labels of one class, the score is the label share for all.
    """
    scored = score_toxicity(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("body")), learn(docs, labels, None, FIT_ROWS, id_col, text_col), text_col="body")
    return scored.where(F.col("toxicity") < threshold).select("row.*")


def op8_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = held_out_id("doc_id", 3, 1)
    out = score_toxicity(docs, learn(docs, labels, held), keep=["doc_id"])
    return out.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= PASS).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE_SQL: dict[str, str] = {}
