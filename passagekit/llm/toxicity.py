"""Toxicity by maximum-scoring segment search over token log-odds.

Training: for every word and every word beginning of four letters, log-odds of
occurring in toxic against clean documents under an informative Dirichlet prior
(the rate in both together), less one standard error. Words that speak for clean
keep their negative log-odds; how significant a toxic feature has to be is chosen
by cross-validation on the training sample. Scoring: each word has its log-odds,
a word that says nothing a small negative score; one linear scan finds all
maximal-scoring segments (Ruzzo and Tompa); a segment of score S among n words
has the extreme-value (Karlin-Altschul) expectation K n exp(-lambda S) in clean
text, lambda from the tokens' frequencies there and K by maximum likelihood from
the best segments of clean texts left out of training; significant segments'
evidence is summed, and a logistic curve fitted on the training sample's
out-of-fold evidence makes it a probability.

The classifier is fitted on a bounded sample of labelled rows (max_labelled);
what is collected or broadcast is bounded by that sample.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold, text_of

_WORDS = re.compile(r"[^\W_]+")
_START = 4


def _features(word: str) -> tuple[str, ...]:
    return (word, word[:_START] + "~") if len(word) > _START else (word,)


def maximal_segments(scores: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of a row of runs (first, last, score), as (first, last, score)."""
    rising, total = [], 0.0
    for first, last, s in scores:
        if s > 0:
            rising.append((first, last, total, total + s))
        total += s
    return _maximal(rising)


def _maximal(rising: Iterable[tuple[int, int, float, float]]) -> list[tuple[int, int, float]]:
    """The segments from the runs of positive score: (first, last, sum left of it, sum with it), in linear time.

    Every candidate knows the nearest one before it whose left sum is smaller, so a search passes over
    whatever an earlier one has passed over.
    """
    found: list[tuple[int, int, float, float, int]] = []
    for first, last, left, right in rising:
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                break
            first, left = found[j][0], found[j][2]
            before = found[j][4]
            del found[j:]
            j = before
        found.append((first, last, left, right, j))
    return [(a, b, r - lo) for a, b, lo, r, _ in found]


def _spans(own) -> list[tuple[int, int, float]]:  # noqa: ANN001
    """(first word, last word, score) of all maximal segments of words with these scores."""
    import numpy as np

    upto, at = np.cumsum(own), np.flatnonzero(own > 0)
    left = np.where(at > 0, upto[at - 1], 0.0) if len(at) else at
    return _maximal(zip(at.tolist(), at.tolist(), left.tolist(), upto[at].tolist(), strict=True))


@dataclass
class ToxicityModel:
    """weights: log-odds of features with their z, of which those that count() lets pass; gap: score of a word without any."""

    weights: dict[str, tuple[float, float]]
    gap: float = -0.05
    rate: float = 1.0  # lambda
    k: float = 0.1
    slope: float = 1.0
    bias: float = 0.0
    most_expected: float = 0.05
    least_z: float = 0.0
    least_odds: float = 0.0
    most_cached: int = 300_000

    def counts(self, w: float, z: float) -> bool:
        """Clean features count wherever their log-odds are surer than their error; toxic ones have bounds of their own."""
        return (z >= self.least_z and w >= self.least_odds) if z > 0 else z <= -1

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float, float]]]:
        """Number of words, and (first word, last word, score, expectation) of all maximal segments."""
        import numpy as np

        words = _WORDS.findall(text.lower()) if text else []
        if not words:
            return 0, []
        return len(words), self.passages(np.fromiter(map(self._cache().__getitem__, words), np.float64, len(words)))

    def passages(self, own) -> list[tuple[int, int, float, float]]:  # noqa: ANN001
        """(first word, last word, score, expectation) of all maximal segments of words with these scores."""
        return [(a, b, s, self.k * len(own) * math.exp(-self.rate * s)) for a, b, s in _spans(own)]

    def score_of(self, hits: list[tuple[float, float]]) -> float:
        """A word's score from the weights of its features: the surest of those that count."""
        return max((x for x in hits if self.counts(*x)), key=lambda x: abs(x[1]), default=(self.gap, 0.0))[0]

    def evidence(self, n: int, segments: list[tuple[int, int, float, float]]) -> float:
        """Minus the log of the expectations of all significant segments together, or of the best one."""
        logs = [math.log(1 / max(e, 1e-300)) for *_, e in segments]
        sure = [x for x, s in zip(logs, segments, strict=True) if s[3] <= self.most_expected]
        return sum(sure) if sure else max(logs, default=math.log(1 / (self.k * max(1, n))))

    def probability(self, text: str | None) -> float:
        n, found = self.segments(text)
        z = self.slope * self.evidence(n, found) + self.bias
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

    def _cache(self) -> dict[str, float]:
        if "_words" not in self.__dict__:
            weights, score_of, most = self.weights, self.score_of, self.most_cached

            class Words(dict):
                def __missing__(self, word: str) -> float:
                    best = score_of([weights[f] for f in _features(word) if f in weights])
                    if len(self) < most:
                        self[word] = best
                    return best

            self.__dict__["_words"] = Words()
        return self.__dict__["_words"]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_words"}


class _Together:
    """Segments of a text under several models of one table of weights; each word is looked up once for all."""

    def __init__(self, models: list[ToxicityModel], most: int = 50_000):
        import numpy as np

        self.models, self.weights, self.most, self.ids = models, models[0].weights, most, {}
        self.gaps = [m.gap for m in models]
        self.scores = np.zeros((most, len(models)))

    def segments(self, text: str | None) -> tuple[int, list[list[tuple[int, int, float]]]]:
        """Number of words, and (first word, last word, score) of the maximal segments under each model."""
        import numpy as np

        words = _WORDS.findall(text.lower()) if text else []
        own = np.empty((len(words), len(self.models)))
        for at in range(0, len(words), self.most):
            part = words[at : at + self.most]
            new = set(part) - self.ids.keys()
            if len(self.ids) + len(new) > self.most:
                self.ids, new = {}, set(part)
            for w in new:
                hits = [self.weights[f] for f in _features(w) if f in self.weights]
                self.scores[len(self.ids)] = [m.score_of(hits) for m in self.models] if hits else self.gaps
                self.ids[w] = len(self.ids)
            own[at : at + len(part)] = self.scores[np.fromiter(map(self.ids.__getitem__, part), np.int64, len(part))]
        return len(words), [_spans(own[:, k]) for k in range(len(self.models))]


def _counts(rows: DataFrame, folds: int) -> DataFrame:
    """(feature, toxic, clean, uses): arrays by fold of the documents of each label that have it, and of its places in clean ones.

    The empty feature's uses are the clean documents' words.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            by: dict[tuple[str, int], list[int]] = {}
            for label, fold_no, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = Counter(_WORDS.findall(text.lower()))
                own: Counter = Counter()
                for w, n in words.items():
                    for f in _features(w):
                        own[f] += n
                for f, n in own.items():
                    x = by.setdefault((f, fold_no), [0, 0, 0])
                    x[label] += 1
                    x[2] += 0 if label else n
                by.setdefault(("", fold_no), [0, 0, 0])[2] += 0 if label else words.total()
            keys, values = list(by), list(by.values())
            cols = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32())]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([v[k] for v in values], pa.int64()) for k in (1, 0, 2))], ["feature", "f", "toxic", "clean", "uses"])

    found = rows.select("y", "f", "t").mapInArrow(run, "feature string, f int, toxic long, clean long, uses long")
    by_fold = lambda c: F.array(*(F.sum(F.when(F.col("f") == k, F.col(c)).otherwise(0)) for k in range(folds))).alias(c)
    return found.groupBy("feature").agg(by_fold("toxic"), by_fold("clean"), by_fold("uses"))


def _log_odds(toxic, clean, n_toxic: int, n_clean: int, prior: float):  # noqa: ANN001, ANN202
    """Log-odds of features (arrays of counts) less one standard error, and their z."""
    import numpy as np

    # Dirichlet prior: a share of the sample's weight, dealt by the rate in both labels together
    rate = (toxic + clean) * prior
    in_toxic, in_clean = np.maximum(toxic + rate, 1e-9), np.maximum(clean + rate, 1e-9)
    odds = lambda hits, n: np.log(hits / np.maximum(n + prior * (n_toxic + n_clean) - hits, 0.5))
    delta = odds(in_toxic, n_toxic) - odds(in_clean, n_clean)
    error = np.sqrt(1 / in_toxic + 1 / in_clean)
    return np.sign(delta) * np.maximum(np.abs(delta) - error, 0), delta / error


def _rate(model: ToxicityModel, uses: dict[str, int], words: int) -> float:
    """lambda: the mean of exp(lambda x score) over a clean text's words is 1."""
    kept = {f: x for f, x in model.weights.items() if model.counts(*x)}
    places = {f: uses[f] for f in kept}
    for f, x in kept.items():
        if f[_START:] not in ("", "~"):
            start = f[:_START] + "~"  # a word takes its own score or its beginning's
            if start in kept:
                if abs(x[1]) >= abs(kept[start][1]):
                    places[start] -= uses[f]
                else:
                    places[f] = 0
    mass = [(n / max(1, words), kept[f][0]) for f, n in places.items() if n]
    rest = max(0.01, 1 - sum(m for m, _ in mass))
    low, high = 1e-3, 4.0
    for _ in range(60):
        mid = (low + high) / 2
        s = sum(m * math.exp(min(700.0, mid * w)) for m, w in mass) + rest * math.exp(mid * model.gap)
        low, high = (mid, high) if s < 1 else (low, mid)
    return max(0.05, low)


def _logistic(x: list[float], y: list[int], ridge: float = 1e-2) -> tuple[float, float]:
    """slope and bias of a logistic curve, by Newton's method on standardised x; both labels weigh as they occur."""
    import numpy as np

    a, t = np.array(x), np.array(y, float)
    mean, sd = a.mean(), a.std() or 1.0
    z = np.c_[(a - mean) / sd, np.ones(len(a))]
    w = np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(2)
        w -= np.clip(np.linalg.solve(h, z.T @ (p - t) + ridge * w), -2, 2)
    return float(w[0] / sd), float(w[1] - w[0] * mean / sd)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_labelled: int = 20_000,
    prior: float = 0.1,
    bounds: tuple[tuple[float, float], ...] = ((2.4, 0.0), (2.4, 0.7), (2.4, 1.4), (4.0, 0.7), (4.0, 1.4)),
    folds: int = 3,
) -> ToxicityModel:
    """A model from at most max_labelled labelled rows, those first by a hash of the id.

    Of bounds (least z, least log-odds of a toxic feature) those are taken whose
    out-of-fold evidence tells the labels best. Ids with several labels take the
    greatest; null labels and ids are passed over; rows that repeat an id all
    count. Without labels of both kinds, so with empty tables too, every text
    scores below one half.
    """
    import numpy as np

    scratch = Scratch(docs.sparkSession, "toxicity")
    own = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).filter("i is not null and y in (0, 1)")
    own = own.groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(max_labelled)
    own = scratch.put(own)
    # at most max_labelled rows of two numbers
    rows = docs.select(F.col(id_col).alias("i"), text_of(text_col).alias("t")).join(F.broadcast(own), "i")
    rows = scratch.put(rows.select("y", F.pmod(F.xxhash64("i", F.lit(1)), F.lit(folds)).cast("int").alias("f"), "t"))
    sizes = np.zeros((2, folds), int)
    for r in rows.groupBy("y", "f").count().collect():
        sizes[r["y"], r["f"]] = r["count"]
    n_clean, n_toxic = sizes.sum(axis=1).tolist()
    if not n_toxic or not n_clean:
        scratch.drop(own, rows)
        return ToxicityModel({}, bias=-1.0, slope=0.0)
    # a part: the folds a model learns from; the last is all of them
    parts = [[k for k in range(folds) if k != out] for out in range(folds)] + [list(range(folds))]
    if (np.minimum(sizes, 1).sum(axis=1) < 2).any():
        parts = parts[-1:]  # too few labels to leave any out
    n_of = [(int(sizes[1, p].sum()), int(sizes[0, p].sum())) for p in parts]
    loosest = min(z for z, _ in bounds)

    def select(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            toxic, clean = (np.array(batch.column(k).to_pylist(), float).reshape(-1, folds) for k in (1, 2))
            keep = np.array([f == "" for f in batch.column(0).to_pylist()], bool)
            for p, n in zip(parts, n_of, strict=True):
                z = _log_odds(toxic[:, p].sum(axis=1), clean[:, p].sum(axis=1), *n, prior)[1]
                keep |= (z >= loosest) | (z <= -1)
            yield batch.filter(pa.array(keep))

    counted = _counts(rows, folds)
    found = counted.mapInArrow(select, counted.schema).collect()
    toxic, clean, uses = (np.array([r[c] for r in found], float).reshape(-1, folds) for c in ("toxic", "clean", "uses"))
    names = [r["feature"] for r in found]
    models: list[list[ToxicityModel]] = []  # by part and bounds
    for p, n in zip(parts, n_of, strict=True):
        w, z = _log_odds(toxic[:, p].sum(axis=1), clean[:, p].sum(axis=1), *n, prior)
        weights = {f: (float(a), float(b)) for f, a, b in zip(names, w, z, strict=True) if f and (b >= loosest or b <= -1)}
        places = dict(zip(names, uses[:, p].sum(axis=1).tolist(), strict=True))
        models.append([ToxicityModel(weights, least_z=a, least_odds=b, most_cached=20_000) for a, b in bounds])
        for m in models[-1]:
            m.rate = _rate(m, places, places.get("", 0))
    final, tried = models[-1], models[:-1] or models

    def told(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sets = [_Together(x) for x in tried]
        for batch in batches:
            words, sums = [], []
            for fold_no, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                part = fold_no % len(sets)
                n, found = sets[part].segments(text)
                words.append(n)
                sums.append([[m.rate * s for *_, s in own] for m, own in zip(tried[part], found, strict=True)])
            cols = [batch.column(0), pa.array(words, pa.int64()), pa.array(sums, pa.list_(pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays(cols, ["y", "n", "s"])

    # the texts are scanned once, out of fold: number of words and, by bounds, lambda x score of all segments
    segments = scratch.put(rows.select("y", "f", "t").mapInArrow(told, "y int, n long, s array<array<double>>"))
    n, s = F.greatest("n", F.lit(1)), [F.col("s")[k] for k in range(len(bounds))]
    # the likeliest K for best scores S of n words with P(S < s) = exp(-K n exp(-lambda s))
    tails = segments.filter("y = 0").select(F.count(F.lit(1)), *(F.sum(n * F.exp(-F.coalesce(F.array_max(x), F.lit(0.0)))) for x in s)).first()
    for k in range(len(bounds)):
        for of_part in models:
            of_part[k].k = min(1.0, max(1e-6, tails[0] / max(1e-9, tails[1 + k] or 0.0)))

    def evidence(k: int) -> Column:
        """ToxicityModel.evidence from the stored segments."""
        m = final[k]
        logs = F.transform(s[k], lambda x: F.least(F.lit(-math.log(1e-300)), x - F.log(m.k * n)))
        sure = F.filter(logs, lambda x: x >= -math.log(m.most_expected))
        return F.when(F.size(sure) > 0, F.aggregate(sure, F.lit(0.0), lambda a, b: a + b)).otherwise(F.coalesce(F.array_max(logs), -F.log(m.k * n)))

    fit = segments.select("y", F.array(*(evidence(k) for k in range(len(bounds)))).alias("x")).collect()
    y, best = [r["y"] for r in fit], None
    for k in range(len(bounds)):
        # labels of one kind are rare, and a curve between them may be steep: evidence of up to 60 tells enough
        x = [min(60.0, r["x"][k]) for r in fit]
        slope, bias = _logistic(x, y)
        side = np.where(np.array(y) == 1, -1.0, 1.0)
        loss = float(np.logaddexp(0, side * (slope * np.array(x) + bias)).mean())
        if best is None or loss < best[0]:
            best = loss, k, slope, bias
    _, k, slope, bias = best
    model = final[k]
    kept = {f: x for f, x in model.weights.items() if model.counts(*x)}
    scratch.drop(own, rows, segments)
    return ToxicityModel(kept, rate=model.rate, k=model.k, slope=slope, bias=bias)


def scorer(model: ToxicityModel):  # noqa: ANN201
    """A column function: text to (score, segments); null counts as empty."""

    kind = "score double, segments array<struct<first:int,last:int,score:double,expected:double>>"

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        out, parts = [], []
        for text in texts:
            n, found = model.segments(text)
            z = model.slope * model.evidence(n, found) + model.bias
            out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
            parts.append([{"first": a, "last": b, "score": s, "expected": e} for a, b, s, e in found if e <= model.most_expected])
        return pd.DataFrame({"score": out, "segments": parts})

    return run


def score_toxicity(df: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """df with a struct column: score (0 to 1) and segments (significant passages as word positions).

    Null texts score as empty ones do; every row is scored for itself, so equal rows score alike; an empty
    table gives no rows. A column of df that is named like out is replaced, all others stay.
    """
    return df.withColumn(out, scorer(model)(F.col(text_col).cast("string")))


def training_labels(labels: DataFrame, id_col: str = "doc_id", folds: int = 5, held_out: int = 0) -> DataFrame:
    """The labels of ids whose fold isn't held out: rows that repeat an id are in or out together, a null id counts as the empty text, an empty table gives none."""
    return labels.filter(fold(id_col, folds) != held_out)
