"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are dealt to blocks of bounded size and each block is searched by itself, so all pairs of query and
candidate blocks meet and no task holds more than one of each. Inside a pair of blocks, queries and candidates
are each indexed by a cover tree; node pairs are visited together, and a pair is pruned when

    q.p + |q| r_p + |p| r_q + r_q r_p  <  the worst k-th score of the query node's queries

(q, p the centres, r the covering radii). A node whose points a net of the next scale cannot separate into a
few children becomes a leaf and is scored by one matrix product. The blocks' results are merged per query.

Defined results: vectors that are null, or hold null or non-finite components, take no part; vectors of another
length than the query's are no candidates of it; empty vectors score 0; repeated rows are candidates of each
other, only a query's own row is not; ties go to the smaller vec_id (null last); a null vec_id is no query; an
empty table gives an empty result; other columns are not looked at. Scores are exact below 2 ** 53.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, with_uid

#: Rows of a block of queries and of candidates.
QUERIES, CANDIDATES = 4096, 16384
#: Children of a node at most, points of a leaf (of candidates, of queries), and the ratio of a level's scale to the next one's.
FAN, LEAF, QUERY_LEAF, RATIO = 48, 192, 16, 1.3
NO_ID = np.iinfo(np.int64).max


@dataclass
class Node:
    center: np.ndarray
    norm: float
    radius: float
    rows: np.ndarray
    children: list["Node"] = field(default_factory=list)


def cover_tree(points: np.ndarray, rows: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """A cover tree: children's centres are points of the node, more than a scale apart, and cover its points."""
    rows = np.arange(len(points)) if rows is None else rows
    center = points[rows[0]].copy()
    return _grow(points, rows, center, np.sqrt(((points[rows] - center) ** 2).sum(axis=1)), leaf)


def _grow(points: np.ndarray, rows: np.ndarray, center: np.ndarray, dist: np.ndarray, leaf: int) -> Node:
    node = Node(center, float(np.sqrt(center @ center)), float(dist.max(initial=0.0)), rows)
    if len(rows) <= leaf or node.radius == 0:
        return node
    scale = node.radius
    while True:
        scale /= RATIO
        # Farthest-point net: centres until every point is within the scale.
        mine, near = np.zeros(len(rows), np.int64), dist.copy()
        centers = [center]
        while near.max() > scale and len(centers) <= FAN:
            c = points[rows[int(near.argmax())]].copy()
            d = np.sqrt(((points[rows] - c) ** 2).sum(axis=1))
            closer = d < near
            near[closer], mine[closer] = d[closer], len(centers)
            centers.append(c)
        if len(centers) > FAN:
            return node  # a leaf: the next scale separates nearly every point
        if len(centers) > 1:
            break
    for k, c in enumerate(centers):
        own = mine == k
        if own.any():
            node.children.append(_grow(points, rows[own], c, near[own], leaf))
    return node


class DualTree:
    """Top-k candidates of each query of a block; scores and ids of the best so far."""

    def __init__(self, queries: np.ndarray, q_uid: np.ndarray, points: np.ndarray, ids: np.ndarray, uid: np.ndarray, k: int):
        self.q, self.q_uid, self.p, self.ids, self.uid, self.k = queries, q_uid, points, ids, uid, k
        self.scores = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), NO_ID)
        self.pairs = 0

    def run(self) -> None:
        if len(self.q) and len(self.p):
            self.visit(cover_tree(self.q, leaf=QUERY_LEAF), cover_tree(self.p))

    def bound(self, a: Node, b: Node) -> float:
        top = float(a.center @ b.center) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
        return top + 1e-9 * abs(top) + 1e-6

    def visit(self, a: Node, b: Node) -> None:
        if self.bound(a, b) < self.scores[a.rows, -1].min():
            return
        if not a.children and not b.children:
            self.score(a.rows, b.rows)
        elif b.children and (not a.children or b.radius >= a.radius):
            for child in sorted(b.children, key=lambda c: -float(a.center @ c.center) - a.norm * c.radius):
                self.visit(a, child)
        else:
            for child in a.children:
                self.visit(child, b)

    def score(self, qs: np.ndarray, ps: np.ndarray) -> None:
        for at in range(0, len(ps), 4096):
            part = ps[at : at + 4096]
            self.pairs += len(qs) * len(part)
            s = self.q[qs] @ self.p[part].T
            s[self.q_uid[qs][:, None] == self.uid[part][None, :]] = -np.inf
            worst = self.scores[qs, -1]
            for i in np.flatnonzero(s.max(axis=1) >= worst):
                row = qs[i]
                take = np.flatnonzero((s[i] >= worst[i]) & (s[i] > -np.inf))
                if not len(take):
                    continue
                score, name = np.concatenate([self.scores[row], s[i, take]]), np.concatenate([self.found[row], self.ids[part[take]]])
                best = np.lexsort((name, -score))[: self.k]
                self.scores[row], self.found[row] = score[best], name[best]


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(uid, vec_id, v): floor(scale * x) of each component, for rows all of whose components are finite."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("double"))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return with_uid(vectors.select("vec_id", "embedding")).where(F.col("embedding").isNotNull() & fine).select("uid", F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))


def _upto(n: int):
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def top_k(vectors: DataFrame, is_query, k: int = 5, queries: int = QUERIES, candidates: int = CANDIDATES) -> DataFrame:
    """(query_uid, query_id, rank, vec_id, score) of each query's k largest inner products.

    ``vectors`` has uid, vec_id and v; ``is_query`` is a condition on it. Rows are dealt to blocks by a hash of
    their uid, with twice the blocks that even dealing needs; a query block is copied to each candidate block
    and the other way round, which is the least that an exact search in blocks can move.
    """
    base = vectors.withColumn("size", F.size("v"))
    n = base.agg(F.count("*"), F.count_if(is_query)).first()
    parts = [max(1, -(-n[0] * 5 // (4 * candidates))), max(1, -(-n[1] * 5 // (4 * queries)))]
    block = F.pmod(F.xxhash64("uid"), F.lit(parts[0]))
    q_block = F.pmod(F.xxhash64("uid"), F.lit(parts[1]))
    c = base.withColumn("pb", block).withColumn("qb", F.explode(_upto(parts[1])))
    q = base.where(is_query).withColumn("qb", q_block).withColumn("pb", F.explode(_upto(parts[0])))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_uid": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
        if not len(left) or not len(right):
            return none
        ids = right["vec_id"].astype("Int64").fillna(NO_ID - 1).to_numpy(np.int64)
        tree = DualTree(np.array(left["v"].tolist(), float), left["uid"].to_numpy(), np.array(right["v"].tolist(), float), ids, right["uid"].to_numpy(), k)
        tree.run()
        row, col = np.nonzero(tree.scores > -np.inf)
        found = tree.found[row, col]
        return pd.DataFrame({
            "query_uid": left["uid"].to_numpy()[row], "query_id": left["vec_id"].to_numpy()[row].astype("int64"),
            "vec_id": pd.Series(found, dtype="Int64").mask(found == NO_ID - 1),
            "score": tree.scores[row, col].astype("int64"),
        })

    met = q.groupBy("size", "qb", "pb").cogroup(c.groupBy("size", "qb", "pb")).applyInPandas(search, "query_uid long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def op5_exact_search(spark, sf_dir: str) -> DataFrame:
    vectors = materialize(integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    return top_k(vectors, F.col("vec_id") % 50 == 0).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


OP5_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), k AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id ASC NULLS LAST) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM k WHERE n <= 5
"""
