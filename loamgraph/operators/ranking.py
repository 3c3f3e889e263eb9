"""Learned ranking: weights of named features fitted to which candidates of a request are right, and the ranking by them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _sums(rows: DataFrame, features: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient, second derivatives and value of the summed losses at weights; one row of sums comes to the driver."""
    score = sum((F.col(f) * float(w) for f, w in zip(features, weights, strict=True)), F.lit(0.0))
    top = rows.withColumn("score", score).groupBy("request").agg(F.max("score").alias("top"))
    e = rows.withColumn("score", score).join(top, "request").withColumn("e", F.exp(F.col("score") - F.col("top")))
    k = range(len(features))
    cells = [(i, j) for i in k for j in k if i <= j]
    right = lambda c: F.sum(F.when(F.col("relevant"), c).otherwise(0.0))
    per = e.groupBy("request").agg(
        right(F.lit(1.0)).alias("p"), right(F.col("score")).alias("ps"), F.max("top").alias("top"), F.sum("e").alias("s"), *[right(F.col(f)).alias(f"p{i}") for i, f in enumerate(features)],
        *[F.sum(F.col("e") * F.col(f)).alias(f"s{i}") for i, f in enumerate(features)], *[F.sum(F.col("e") * F.col(features[i]) * F.col(features[j])).alias(f"s{i}_{j}") for i, j in cells],
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    p, s = F.col("p"), F.col("s")
    row = per.agg(
        total(p * (F.log(s) + F.col("top")) - F.col("ps")), *[total(p * F.col(f"s{i}") / s - F.col(f"p{i}")) for i in k],
        *[total(p * (F.col(f"s{i}_{j}") / s - F.col(f"s{i}") * F.col(f"s{j}") / (s * s))) for i, j in cells],
    ).first()
    gradient, second = np.array(row[1 : 1 + len(features)]), np.zeros((len(features), len(features)))
    for (i, j), v in zip(cells, row[1 + len(features) :], strict=True):
        second[i, j] = second[j, i] = v
    return gradient, second, float(row[0])


def fit_weights(rows: DataFrame, features: list[str], ridge: float = 1.0, rounds: int = 50, tolerance: float = 1e-9) -> dict[str, float]:
    """Weights by which right candidates of a request outrank the others; rows: request, relevant, and a column a feature.

    Conditional logistic regression: each right candidate's softmax probability among all candidates of its request. With one right and
    one wrong candidate that is the pairwise logistic loss; with more it needs no pairs, only sums by request, so a request with
    very many candidates costs no more than its rows. Newton steps, halved where the loss would grow; each is one aggregation in
    executors. Requests without a right candidate add nothing; null features count as 0, null relevance as wrong.
    """
    known = rows.where("request is not null").select("request", F.coalesce("relevant", F.lit(False)).alias("relevant"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    w = np.zeros(len(features))
    gradient, second, loss = _sums(known, features, w)
    for _ in range(rounds):
        step = np.linalg.solve(second + ridge * np.eye(len(w)), gradient + ridge * w)
        size = 1.0
        while True:
            new = w - size * step
            found = _sums(known, features, new)
            if found[2] + ridge * new @ new / 2 <= loss + ridge * w @ w / 2 + 1e-12 or size < 1e-6:
                break
            size /= 2
        moved, w, (gradient, second, loss) = np.abs(new - w).max(initial=0.0), new, found
        if moved < tolerance:
            break
    return dict(zip(features, map(float, w), strict=True))


def rank_by_weights(rows: DataFrame, weights: dict[str, float], limit: int = 10) -> DataFrame:
    """The best candidates (request, candidate, features) of each request by rounded weighted score: request, candidate, score, rank. Ties go to the lesser candidate."""
    score = F.round(sum((F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * float(w) for f, w in weights.items()), F.lit(0.0))).cast("long")
    rank = F.row_number().over(Window.partitionBy("request").orderBy(F.desc("score"), "candidate"))
    return rows.select("request", "candidate", score.alias("score")).withColumn("rank", rank).where(F.col("rank") <= limit)
