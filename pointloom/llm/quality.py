"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every whole text becomes ``FEATURES`` transformed statistics.  Training reads labelled rows only
through sums: per class the count, the sums and the sums of products of the statistics, added up
by Spark over all labelled rows (no sample), two rows of which reach the driver.  From them come
class means and covariances, shrunk towards the pooled covariance (by ``POOL``, more where a class has few rows)
and then towards the pooled diagonal (by ``RIDGE``, likewise).  The Cholesky factor of each class is computed once and travels with
the model; a score is the logistic of the prior log odds plus half the difference of the
Mahalanobis distances and log determinants.

Edge cases: null and empty texts have the statistics of the empty text and are scored like any
other; repeated rows are scored (and, if labelled, counted) each; labels without a quality of
0 or 1 and rows without doc_id train nothing; a class of few rows is shrunk more; without a training row in
either class every score is the share of label 1 among training rows (0.5 if none) and
the stage keeps every row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import held_out, map_rows, materialise

FEATURES = ("words", "word_length", "distinct", "top_word", "upper", "digit", "symbol", "other_ascii_punct", "non_ascii", "lines", "line_copies", "packed", "marked_words", "stop_length", "blank")
#: Shares of the pooled covariance and of its diagonal in each class covariance.
POOL, RIDGE = 0.2, 0.05
#: Bytes of text compressed at once for the packing ratio; all of the text is compressed.
PACK_AT_ONCE = 1 << 20

_KIND = np.zeros(256, np.int64)
for _c in range(256):
    _KIND[_c] = (
        1 if 65 <= _c <= 90 else
        2 if 97 <= _c <= 122 else
        3 if 48 <= _c <= 57 else
        4 if _c in b".,;:'\"?-()" else
        5 if 33 <= _c <= 126 else
        6 if _c >= 128 else 0
    )


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text, in the order of ``FEATURES``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    kinds = np.bincount(_KIND, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), 7)
    words = raw.split()
    count = max(len(words), 1)
    distinct = set(words)
    letters = max(kinds[1] + kinds[2] + kinds[6], 1)
    lines = raw.split(b"\n")
    pack = zlib.compressobj(1)
    packed = sum(len(pack.compress(raw[i : i + PACK_AT_ONCE])) for i in range(0, len(raw), PACK_AT_ONCE)) + len(pack.flush())
    marked = sum(1 for w in words if 33 <= w[-1] < 48 and w[-1] not in b".,)\"'-") if words else 0
    top = 0
    if words:
        seen: dict[bytes, int] = {}
        for w in words:
            seen[w] = seen.get(w, 0) + 1
        top = max(seen.values())
    root = lambda part, whole: float(np.sqrt(part / whole))  # noqa: E731  variance-stabilising for shares
    return [
        float(np.log1p(len(words))), float(np.log1p(sum(map(len, words)) / count)), root(len(distinct), count), root(top, count),
        root(kinds[1], letters), root(kinds[3], n), root(kinds[5], n), root(kinds[4], n), root(kinds[6], n),
        float(np.log1p(len(lines))), root(len(lines) - len(set(lines)), len(lines)), float(np.log1p(packed / n)), root(marked, count),
        root(sum(1 for w in words if len(w) <= 3), count), root(kinds[0], n),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and f, the statistics of every row."""

    def one(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "f": [statistics(t) for t in batch.column(1).to_pylist()]}

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, f array<double>", one, [pa.int64(), pa.list_(pa.float64())])


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log terms of both classes; ``constant`` if it has none."""

    mean: np.ndarray | None
    factor: np.ndarray | None
    offset: np.ndarray | None
    constant: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(x), self.constant)
        density = [self.offset[k] - 0.5 * np.square((x - self.mean[k]) @ self.factor[k].T).sum(axis=1) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(rows: DataFrame, pool: float = POOL, ridge: float = RIDGE) -> Discriminant:
    """Fit on all ``rows`` (f, quality) by sums per class."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = [F.sum(F.col("f")[i]).alias(f"s{i}") for i in range(d)] + [F.sum(F.col("f")[i] * F.col("f")[j]).alias(f"p{i}_{j}") for i, j in pairs]
    got = {int(r["quality"]): r for r in rows.filter("quality in (0, 1)").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), *sums).collect()}
    n = np.array([got[k]["n"] if k in got else 0 for k in (0, 1)], float)
    if not n.min():
        return Discriminant(None, None, None, float(n[1] / n.sum()) if n.sum() else 0.5)
    mean, cov = np.zeros((2, d)), np.zeros((2, d, d))
    for k in (0, 1):
        mean[k] = [got[k][f"s{i}"] / n[k] for i in range(d)]
        for i, j in pairs:
            cov[k, i, j] = cov[k, j, i] = got[k][f"p{i}_{j}"] / n[k] - mean[k, i] * mean[k, j]
    pooled = np.tensordot(n / n.sum(), cov, 1)
    target = np.diag(np.maximum(np.diag(pooled), 1e-6))
    ridge = max(ridge, 2 / (2 + n.sum()))
    factor, offset = [], []
    for k in (0, 1):
        few = max(pool, 2 / (2 + n[k]))
        chol = np.linalg.cholesky((1 - ridge) * ((1 - few) * cov[k] + few * pooled) + ridge * target + 1e-9 * np.eye(d))
        factor.append(np.linalg.inv(chol))
        offset.append(np.log(n[k] / n.sum()) - np.log(np.diag(chol)).sum())
    return Discriminant(mean, np.array(factor), np.array(offset), 0.5)


def training_labels(labels: DataFrame) -> DataFrame:
    """doc_id and quality of the rows that are not held out."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(~held_out("doc_id", 3, 1))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; held-out labels train nothing."""
    stats = materialise(document_statistics(docs), "statistics")
    model = fit(stats.join(training_labels(labels), "doc_id").select("f", "quality"))

    def one(batch: pa.RecordBatch) -> dict:
        values = model.scores(np.array(batch.column(1).to_pylist(), float))
        return {"doc_id": batch.column(0), "score": values.tolist(), "predicted": (values >= 0.5).astype(np.int32).tolist()}

    out = map_rows(stats, "doc_id long, score double, predicted int", one, [pa.int64(), pa.float64(), pa.int32()])
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns; each row goes by its own text.

    The statistics are written beside the rows, so no text is shuffled.
    """
    described = F.arrow_udf(lambda texts: pa.array([statistics(t) for t in texts.to_pylist()], pa.list_(pa.float64())), "array<double>")
    rows = materialise(docs.withColumn("__loom_f", described(F.col("text").cast("string"))), "described")
    model = fit(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__loom_f").alias("f")).join(training_labels(labels), "doc_id"))
    if model.mean is None:
        return rows.drop("__loom_f")
    accepted = F.arrow_udf(lambda f: pa.array(model.scores(np.array(f.to_pylist(), float).reshape(-1, len(FEATURES))) >= 0.5), "boolean")
    return rows.filter(accepted("__loom_f")).drop("__loom_f")
