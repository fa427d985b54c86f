"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are binned at quantiles. Cyclic boosting goes through the features round
by round; each step fits a shallow tree on one feature's bins and adds its leaves to that
feature's lookup table. Then the pairs with the largest gain on the residuals get
two-dimensional tables the same way. A score is the logistic of the intercept and one table
entry per feature and pair, added up by vectorised look-ups.

The model is fitted on the driver on at most `MAX_SAMPLE` labelled rows (those first in hash
order; only their features are made for it). One pass over the texts then makes features and
scores. Only the model travels to the tasks, and its size is fixed.

Defined cases: null or empty text has all features 0 and gets the score of that; labels that
are null or belong to no document are not used, of several labels of a doc_id the smallest
counts; with labels of one kind only, or none, every score is that kind's (or 0.5); null or
repeated doc_id rows are kept; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, IntegerType, FloatType, StructField, StructType)

from twinsift.llm.frames import map_batches
from twinsift.session import materialise

MAX_SAMPLE = 20_000
BINS = 32
PAIR_BINS = 8
ROUNDS = 150
PAIRS = 10
RATE = 0.15
LEAST = 10           # rows in a leaf
CUT = 0.7
PLACES = 1 << 30
FEATURES = ("log_words", "word_length", "distinct_words", "symbols", "pipes", "upper", "digits",
            "non_ascii", "same_as_next", "ends_exclaimed", "ends_sentence", "lone_signs",
            "same_lines", "log_lines", "top_word", "distinct_pairs")


def features(text: str) -> list[float]:
    """Shares and averages that describe how a text is written; all 0 for an empty one."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, chars = len(words), np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    blanks = int(chars[[9, 10, 11, 12, 13, 32]].sum())
    visible = max(len(raw) - blanks, 1)
    lower, upper = int(chars[97:123].sum()), int(chars[65:91].sum())
    signs = visible - lower - upper - int(chars[128:].sum()) - int(chars[48:58].sum())
    distinct = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    after = words[1:]
    pairs = len(set(zip(words, after)))
    return [
        math.log1p(n), visible / n, len(distinct) / n,
        (signs - int(chars[[44, 46, 33, 63, 124]].sum())) / visible, int(chars[124]) / n,
        upper / max(lower + upper, 1), int(chars[48:58].sum()) / visible,
        int(chars[128:].sum()) / visible, sum(map(bytes.__eq__, words, after)) / n,
        int(chars[33]) / n, (int(chars[46]) + int(chars[63])) / n,
        distinct.get(b"|", 0) / n, (len(lines) - len(set(lines))) / max(len(lines), 1),
        math.log1p(len(lines)), max(distinct.values()) / n, pairs / max(n - 1, 1)]


def feature_rows(texts: Iterable[str | None]) -> np.ndarray:
    """Features of the texts, a row each."""
    rows = np.array([features(t or "") for t in texts], dtype=np.float32)
    return rows.reshape(-1, len(FEATURES))


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id and one float column per feature, for every row."""
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType)]
                        + [StructField(n, FloatType()) for n in FEATURES])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            rows = feature_rows(batch["text"])
            yield {"doc_id": batch["doc_id"]} | {n: rows[:, i] for i, n in enumerate(FEATURES)}

    return map_batches(docs.select("doc_id", "text"), run, schema)


@dataclass
class Model:
    """Lookup tables: `edges` bin the features, `pair_edges` bin them coarsely for the pairs."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables)):
            total += values[np.searchsorted(edges, x[:, j], side="right")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], side="right")
                  for j in {j for p in self.pairs for j in p}}
        for (a, b), values in zip(self.pairs, self.pair_tables):
            total += values[coarse[a], coarse[b]]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Best gain and the place of the cut along the bins (0: none)."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gt, ht, nt = g.sum(), h.sum(), n.sum()
    gain = gl ** 2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt ** 2 / (ht + 1)
    gain[(nl < LEAST) | (nt - nl < LEAST)] = -1
    if not len(gain) or gain.max() <= 1e-9:
        return 0.0, 0
    return float(gain.max()), int(gain.argmax()) + 1


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int) -> np.ndarray:
    """Leaf value of every bin in a shallow tree on one feature."""
    cut = _split(g, h, n)[1] if depth else 0
    if not cut:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:cut], h[:cut], n[:cut], depth - 1),
                           _tree(g[cut:], h[cut:], n[cut:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of a tree that cuts one feature of a pair, then the other."""
    best = (0.0, np.zeros_like(g))
    for turned in (False, True):
        a, b, c = (m.T if turned else m for m in (g, h, n))
        gain, cut = _split(a.sum(1), b.sum(1), c.sum(1))
        for at in ({cut, len(a) // 2} if cut else {len(a) // 2}):
            if not 0 < at < len(a):
                continue
            out, total = np.zeros_like(a), 0.0
            for part in (slice(0, at), slice(at, None)):
                ga, ha, na = a[part].sum(0), b[part].sum(0), c[part].sum(0)
                out[part] = _tree(ga, ha, na, 1)[None, :]
                total += _split(ga, ha, na)[0]
            if total + gain > best[0]:
                best = (total + gain, out.T if turned else out)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of the tables of single features, then of the best pairs."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    count = x.shape[1]
    edges = [_edges(x[:, j], BINS) if len(y) else np.zeros(0) for j in range(count)]
    coarse = [_edges(x[:, j], PAIR_BINS) if len(y) else np.zeros(0) for j in range(count)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = Model(math.log(share / (1 - share)), edges, tables, coarse, [], [])
    if len(y) == 0 or y.min() == y.max():
        return model
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    total = np.full(len(y), model.intercept)
    for _ in range(ROUNDS):
        for j in range(count):
            p = 1 / (1 + np.exp(-total))
            size = len(tables[j])
            step = RATE * _tree(np.bincount(bins[j], y - p, size),
                                np.bincount(bins[j], p * (1 - p), size),
                                np.bincount(bins[j], minlength=size), 2)
            tables[j] += step
            total += step[bins[j]]
    cells, shapes = {}, {}
    small = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]
    for a in range(count):
        for b in range(a + 1, count):
            shapes[a, b] = (len(coarse[a]) + 1, len(coarse[b]) + 1)
            cells[a, b] = small[a] * shapes[a, b][1] + small[b]

    def grids(pair, p):
        shape = shapes[pair]
        return [np.bincount(cells[pair], v, shape[0] * shape[1]).reshape(shape)
                for v in (y - p, p * (1 - p), np.ones(len(y)))]

    p = 1 / (1 + np.exp(-total))
    gains = {pair: _pair_tree(*grids(pair, p))[0] for pair in cells}
    model.pairs = sorted(sorted(gains), key=lambda k: -gains[k])[:PAIRS]
    model.pair_tables = [np.zeros(shapes[k]) for k in model.pairs]
    for _ in range(ROUNDS // 3):
        for k, pair in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-total))
            step = RATE * _pair_tree(*grids(pair, p))[1]
            model.pair_tables[k] += step
            total += step.ravel()[cells[pair]]
    return model


def sample(docs: DataFrame, labels: DataFrame, max_sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most `max_sample` labelled rows, the first in hash order."""
    known = (labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL")
             .groupBy("doc_id").agg(F.min("quality").cast("int").alias("__label")))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(PLACES))
    met = docs.select("doc_id").join(known, "doc_id")
    # Cut by hash first, with room to spare, so that tasks do not each send a whole sample.
    share = min(1.0, (1.2 * max_sample + 1000) / max(met.count(), 1))
    near = materialise(met.filter(place < int(share * PLACES)).distinct(), "sampled")
    # About 1.2 * max_sample ids at most: features are made of their rows alone.
    chosen = docs.select("doc_id", "text").join(F.broadcast(near), "doc_id", "left_semi")
    found = (feature_table(chosen).join(F.broadcast(near), "doc_id").withColumn("__place", place)
             .orderBy("__place", "doc_id", *FEATURES).limit(max_sample).select("__label", *FEATURES).toPandas())
    return (found[list(FEATURES)].to_numpy(dtype=np.float32).reshape(len(found), len(FEATURES)),
            found["__label"].to_numpy(dtype=np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame, train: str | None = None,
                   max_sample: int = MAX_SAMPLE, cut: float = CUT) -> DataFrame:
    """doc_id, score and predicted (1 if score >= cut) of every row.

    `train` is a condition on doc_id that says which labelled rows may be learnt from.
    """
    learnt = labels.select("doc_id", "quality")
    model = fit(*sample(docs, learnt.filter(train) if train else learnt, max_sample))
    schema = StructType([docs.schema["doc_id"], StructField("score", DoubleType()),
                         StructField("predicted", IntegerType())])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            scores = model.score(feature_rows(batch["text"]))
            yield {"doc_id": batch["doc_id"], "score": scores,
                   "predicted": (scores >= cut).astype(np.int32)}

    return map_batches(docs.select("doc_id", "text"), run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE,
              cut: float = CUT) -> DataFrame:
    """The rows of `docs` whose score reaches the cut, with all their columns."""
    model = fit(*sample(docs, labels.select("doc_id", "quality"), max_sample))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(feature_rows(texts)))

    return docs.filter(score(docs["text"]) >= F.lit(cut))
