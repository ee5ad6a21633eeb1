"""Hierarchical language identification.

Whole texts become hashed byte n-grams (one to three bytes of the lower-cased letters and word
edges), square-rooted and scaled to length one.  Languages are grouped into families by the
training data: languages whose mean vectors are closer than average join (single link, at most
``MOST_FAMILY`` to a family, so machines grow in proportion to the languages).  A text's
family is predicted first, by one linear machine per family against the rest;
then one-versus-one machines between the languages of that family decide.  Every machine is a squared-hinge linear
support vector machine.  The score is the product of the two levels' logistic margins (over the next family, and the
least margin of the winner over its rivals).  Each level is one matrix; texts are scored in batches.

Training reads at most ``PER_LANGUAGE`` labelled rows per language, those of smallest hash, and fewer where
there are so many languages that ``MOST_ROWS`` would be exceeded (but one each): the documented bound of the labelled sample.
Prediction covers every row.

Edge cases: a null text, an empty one or one without a letter is ``und`` with score 0; rows with
a null lang never train; with a single learned language that one is predicted with score 1; with
none every row is ``und``; languages of a single training row take part; repeated rows are
predicted each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import held_out, map_rows, materialise

DIMENSIONS = 4096
#: Most training rows per language and in all: the bound of the labelled sample.
PER_LANGUAGE, MOST_ROWS = 300, 6000
#: Languages of a family at most.
MOST_FAMILY = 16
#: Languages whose counts are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 10_000
PENALTY = 1e-3
STEPS = 60
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
#: Bytes vectorised at once; counts add up over all of a long text, n-grams across the cuts included.
BYTES_AT_ONCE = 1 << 20


def vector(text: str | None) -> np.ndarray | None:
    """The unit vector of a whole text, or None if it has no letter."""
    if not text or not _LETTER.search(text):
        return None
    letters = (" " + _NOT_LETTERS.sub(" ", text.lower()) + " ").encode("utf-8", "surrogatepass")
    counts = np.zeros(DIMENSIONS)
    for at in range(0, len(letters), BYTES_AT_ONCE):
        b = np.frombuffer(letters[at : at + BYTES_AT_ONCE + 2], np.uint8).astype(np.uint32)
        n = min(BYTES_AT_ONCE, len(letters) - at)  # n-grams that start here
        two = (b[:-1] << 8) | b[1:]
        three = (two[:-1] << 8) | b[2:]
        mixed = np.concatenate([b[:n] * np.uint32(2654435761), two[:n] * np.uint32(2246822519) + np.uint32(1), three[:n] * np.uint32(3266489917) + np.uint32(2)])
        counts += np.bincount(mixed >> 20, minlength=DIMENSIONS)
    counts = np.sqrt(counts)
    return (counts / np.linalg.norm(counts)).astype(np.float32)


def train_svm(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> np.ndarray:
    """Weights (bias last) of linear squared-hinge SVMs, one per column of ``y`` (-1 or 1), by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = np.where(y > 0, 0.5 / np.maximum((y > 0).sum(axis=0), 1), 0.5 / np.maximum((y < 0).sum(axis=0), 1)).astype(x.dtype)  # both sides weigh the same
    y = y.astype(x.dtype)
    rate = 1 / (penalty + 4.0)  # rows have squared length two at most
    w = ahead = np.zeros((y.shape[1], x.shape[1]), x.dtype)
    for step in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead.T))
        new = ahead - rate * (penalty * ahead - 2 * (share * y * slack).T @ x)
        ahead = new + step / (step + 3) * (new - w)
        w = new
    return w


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-3 * margin.astype(float)))


@dataclass
class Hierarchy:
    """families: lists of languages; between: weights by family; inside: weights by pair (in order) of each family's languages."""

    families: list[list[str]] = field(default_factory=list)
    between: np.ndarray | None = None
    inside: list[np.ndarray] = field(default_factory=list)

    def family(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.families) == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        margin = x @ self.between[:, :-1].T + self.between[:, -1]
        best = margin.argmax(axis=1)
        two = np.partition(margin, -2, axis=1)[:, -2:]
        return best, _chance((two[:, 1] - two[:, 0]) / 2)

    def within(self, f: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.families[f])
        if n == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        a, b = np.triu_indices(n, 1)
        sign = np.zeros((len(a), n))  # for and against each language
        sign[np.arange(len(a)), a], sign[np.arange(len(a)), b] = 1, -1
        margin = x @ self.inside[f][:, :-1].T + self.inside[f][:, -1]
        wins = np.where(margin > 0, 1, -1) @ sign
        total = margin @ sign
        best = (wins + np.tanh(total / (4 * n))).argmax(axis=1)  # equal wins: the greater sum of margins
        mine = sign[:, best].T
        return best, _chance(np.where(mine, margin * mine, np.inf).min(axis=1))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        found = [(i, v) for i, t in enumerate(texts) if self.families and (v := vector(t)) is not None]
        if found:
            rows, x = np.array([i for i, _ in found]), np.array([v for _, v in found])
            family, p = self.family(x)
            for f in np.unique(family):
                mine = np.nonzero(family == f)[0]
                best, q = self.within(f, x[mine])
                for i, k, s in zip(rows[mine].tolist(), best.tolist(), (p[mine] * q).tolist()):
                    names[i], scores[i] = self.families[f][k], s
        return names, scores


def group_families(names: list[str], means: np.ndarray, most: int = MOST_FAMILY) -> list[list[str]]:
    """Languages (rows of ``means``) joined where their means are closer than the average pair (single link)."""
    if len(names) < 3:
        return [[n] for n in names]
    unit = means / np.linalg.norm(means, axis=1, keepdims=True)
    a, b = np.triu_indices(len(names), 1)
    distance = (1 - unit @ unit.T)[a, b]
    # the closest pair always forms a family; further ones join below the mean distance
    limit = max(distance.min(), 0.85 * distance.mean())
    family, left = [{i} for i in range(len(names))], len(names)
    for k in np.argsort(distance, kind="stable"):
        if distance[k] > limit or left == 2:
            break
        one, other = family[a[k]], family[b[k]]
        if one is not other and len(one) + len(other) <= most:
            one |= other
            left -= 1
            for i in other:
                family[i] = one
    return [[names[i] for i in sorted(f)] for i, f in enumerate(family) if min(f) == i]


def fit(rows: list[tuple[str, np.ndarray]]) -> Hierarchy:
    names = sorted({lang for lang, _ in rows})
    if not names:
        return Hierarchy()
    number = {n: i for i, n in enumerate(names)}
    x = np.array([v for _, v in rows], np.float32)
    lang = np.array([number[n] for n, _ in rows])
    families = group_families(names, np.array([x[lang == i].mean(axis=0) for i in range(len(names))]))
    of = np.array([next(f for f, group in enumerate(families) if n in group) for n in names])
    between = train_svm(x, np.where(of[lang][:, None] == np.arange(len(families)), 1, -1)) if len(families) > 1 else None
    inside = []
    for group in families:
        machines = [np.zeros((0, x.shape[1] + 1), np.float32)]
        for i, first in enumerate(group):
            for second in group[i + 1 :]:
                pair = np.isin(lang, [number[first], number[second]])
                machines.append(train_svm(x[pair], np.where(lang[pair] == number[first], 1, -1)[:, None]))
        inside.append(np.vstack(machines))
    return Hierarchy(families, between, inside)


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST_ROWS) -> list[tuple[str, np.ndarray]]:
    """Vectors of the bounded sample: ids are chosen first, texts of those alone are vectorised."""
    ids = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)).alias("h")).filter("lang is not null").filter(~held_out("doc_id", 5, 0))
    # level n holds the half of the hashes that is left at level n - 1: the least hashes have the highest levels
    ids = ids.withColumn("level", F.least(F.floor(-F.log2(F.greatest(F.col("h") / F.lit(2.0**64) + 0.5, F.lit(2.0**-60)))), F.lit(60)).cast("int"))
    levels = materialise(ids.groupBy("lang", "level").count(), "languages")
    languages = levels.select("lang").distinct().count()
    per_language = max(1, min(per_language, most // max(languages, 1)))
    held = F.sum("count").over(Window.partitionBy("lang").orderBy(F.desc("level")))  # so few rows per language stay for the window below
    enough = levels.withColumn("held", held).groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("held") >= 3 * per_language, F.col("level"))), F.lit(0)).alias("least"))
    near = ids.join(F.broadcast(enough) if languages <= MOST_BROADCAST else enough, "lang").filter("level >= least")

    def first(rows: DataFrame, *order: str) -> DataFrame:
        return rows.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("r") <= per_language).drop("r")

    chosen = materialise(first(near, "h", "doc_id").select("doc_id", "lang").distinct(), "training-ids")
    if chosen.isEmpty():
        return []
    few = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    few = few.join(F.broadcast(chosen) if languages <= MOST_BROADCAST else chosen, ["doc_id", "lang"], "left_semi")
    # where ids repeat there are more rows than ids
    few = first(few.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), F.lit(7))).withColumn("t", F.xxhash64("text")), "h", "doc_id", "t")

    def one(batch: pa.RecordBatch) -> dict:
        got = [(lang, x) for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (x := vector(t)) is not None]
        return {"lang": [g[0] for g in got], "x": [g[1].tobytes() for g in got]}

    rows = map_rows(few.select("lang", "text"), "lang string, x binary", one, [pa.string(), pa.binary()]).collect()
    return sorted(((r["lang"], np.frombuffer(bytes(r["x"]), np.float32)) for r in rows), key=lambda r: (r[0], r[1].tobytes()))


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``."""
    model = fit(training_rows(docs, per_language))
    shared = docs.sparkSession.sparkContext.broadcast((model.families, model.between, model.inside))

    def one(batch: pa.RecordBatch) -> dict:
        names, scores = Hierarchy(*shared.value).predict(batch.column(1).to_pylist())
        return {"doc_id": batch.column(0), "lang_pred": names, "score": scores}

    out = map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, lang_pred string, score double", one, [pa.int64(), pa.string(), pa.float64()])
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")
