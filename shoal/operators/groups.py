"""Groups from vectors: new identities for what matches none, and concepts from samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.views import query
from .changes import numbered
from .graph import connected
from .metric import cosine_radius, in_balls
from .similarity import in_blocks, unit


#: Candidates that are scored again at once; links that are held at once.
CHECKED, LINKS = 1 << 16, 1 << 20


def _linked(q: np.ndarray, r: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of unit vectors within the threshold: products of single precision, those near it again in double."""
    slack = (q.shape[1] + 8) * 2.0**-22
    score = (q.astype(np.float32) @ r.astype(np.float32).T).ravel()
    at = np.flatnonzero(score >= 1 - threshold - slack)
    sure = score[at] > 1 - threshold + slack
    near = at[~sure]
    for k in range(0, len(near), CHECKED):
        some = near[k : k + CHECKED]
        sure[np.searchsorted(at, some)] = 1 - np.einsum("ij,ij->i", q[some // len(r)], r[some % len(r)]) <= threshold
    return np.divmod(at[sure], len(r))


def _tree(u: np.ndarray, v: np.ndarray) -> pd.DataFrame:
    """At most one link a node that connect what the links ``u`` to ``v`` connect."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
    own = np.flatnonzero(label != np.arange(len(ids)))
    return pd.DataFrame({"u": ids[own], "v": ids[label[own]]})


def _forest(q: pd.DataFrame, r: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of a block that connect all rows within the threshold, at most one a row; a pair counts where its query is the smaller."""
    if not len(q) or not len(r):
        return pd.DataFrame({"u": [], "v": []}).astype("int64")
    a, b = _linked(np.stack(q["v"]), np.stack(r["v"]), threshold)
    u, v = q["id"].to_numpy()[a], r["id"].to_numpy()[b]
    return _tree(u[u < v], v[u < v])


def _fewer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of a task as trees, so that they follow its rows and not its pairs."""
    held = pd.DataFrame({"u": [], "v": []}).astype("int64")
    for frame in frames:
        held = pd.concat((held, frame))
        if len(held) > LINKS:
            held = _tree(held["u"].to_numpy(), held["v"].to_numpy())
            if len(held) > LINKS // 2:
                yield held
                held = held[:0]
    yield _tree(held["u"].to_numpy(), held["v"].to_numpy())


def new_identities(unmatched: DataFrame, base: int, threshold: float = 0.178) -> DataFrame:
    """``(id, identity_id, name)``: detections connected by distances within the threshold share a new identity.

    Identities are numbered from ``base`` + 1 in order of their smallest detection. Unlike a greedy pass the
    result doesn't depend on the order of arrival.
    """
    links = in_balls(unmatched, unmatched, cosine_radius(threshold), lambda q, r: _forest(q, r, threshold), "u long, v long")
    labels = connected(links.mapInPandas(_fewer, "u long, v long")).withColumnRenamed("node", "id")
    rows = unmatched.select("id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    ids = numbered(rows.select("label").distinct(), ["label"], base, "identity_id")
    return rows.join(ids, "label").select("id", "identity_id", F.concat(F.lit("Character "), F.col("identity_id").cast("string")).alias("name"))


def concept_match(samples: DataFrame, images: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``(concept, id, score)``: images whose cosine with the mean of a concept's positive samples reaches the threshold.

    ``samples(concept, id, v, positive)``; its own negative samples are no match of a concept.
    """
    parts = samples.where("positive").select("concept", F.posexplode("v").alias("k", "x")).groupBy("concept", "k").agg(F.avg("x").alias("x"))
    means = parts.groupBy("concept").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("l")).select(F.col("concept").alias("vec_id"), F.col("l.x").alias("embedding"))

    def found(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"concept": [], "id": [], "score": []}).astype({"concept": "int64", "id": "int64", "score": "float64"})
        s = np.stack(q["v"]) @ np.stack(r["v"]).T
        a, b = np.nonzero(s >= threshold)
        return pd.DataFrame({"concept": q["id"].to_numpy()[a], "id": r["id"].to_numpy()[b], "score": s[a, b]})

    near = in_blocks(unit(means), images, found, "concept long, id long, score double")
    return near.join(samples.where("NOT positive").select("concept", "id"), ["concept", "id"], "left_anti")


@query("new_identities", """WITH RECURSIVE e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
l AS (SELECT a.id AS u, b.id AS v FROM e a JOIN e b ON 1 - list_cosine_similarity(a.v, b.v) <= 0.55), r(u, v) AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
m AS (SELECT u AS id, min(v) AS label FROM r GROUP BY 1), n AS (SELECT id, 100 + dense_rank() OVER (ORDER BY label) AS identity_id FROM m)
SELECT id, identity_id, 'Character ' || identity_id AS name FROM n""")
def _new_identities(t):
    rows = unit(t.embeddings)
    return new_identities(rows, 100, 0.55)


@query("concept_match", """
WITH e AS (SELECT vec_id AS id, label, [CAST(x AS DOUBLE) / sqrt(list_sum([CAST(y AS DOUBLE) * y FOR y IN embedding])) FOR x IN embedding] AS v FROM embeddings), p AS (SELECT label AS concept, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM e WHERE id % 3 = 0),
c AS (SELECT concept, k, avg(x) AS x FROM p GROUP BY ALL), n AS (SELECT concept, sqrt(sum(x * x)) AS n FROM c GROUP BY 1), i AS (SELECT id, label, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM e),
s AS (SELECT concept, id, label, sum(c.x * i.x) / any_value(n) AS score FROM c JOIN n USING (concept) JOIN i USING (k) GROUP BY ALL)
SELECT CAST(concept AS BIGINT) AS concept, id, CAST(floor(score * 1000000 + 0.5) AS BIGINT) AS score FROM s WHERE score >= 0.2 AND NOT (label = concept AND id % 3 = 1)""")
def _concept_match(t):
    rows = unit(t.embeddings)
    samples = t.embeddings.select(F.col("label").cast("long").alias("concept"), F.col("vec_id").alias("id")).join(rows, "id").where("id % 3 < 2").withColumn("positive", F.col("id") % 3 == 0)
    return concept_match(samples, rows, 0.2).select("concept", "id", F.floor(F.col("score") * 1000000 + 0.5).alias("score"))
