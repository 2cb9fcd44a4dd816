"""Mixing sources to target weights by the cube method.

Each source's target is a share of all words; a document of it is to be taken target / size times on average:
its whole part always, and once more with the inclusion probability that is left. The cube method draws those
extra copies so that both the number of documents and their words come out as expected: probabilities move
along directions that keep both totals (the null space of the constraints) until nearly all are 0 or 1, and the
few that are left land on the rounding that is nearest to the totals.

The flight runs in blocks of bounded size; each leaves at most two undecided documents, which fly on in the next
round's blocks until a source has one block, where it lands. Equal rows (same id, source and text) move among
themselves first, by arithmetic, so a row repeated without end is one unit.

Draws come from a seed and the documents' contents only: reruns agree whatever the partitions are.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a source whose
size is 0 has target 0; repeated rows share the copies that fall to them; an empty table gives an empty result;
other columns are kept by ``mix`` and not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, with_uid

WEIGHTS = (5, 2, 1)
#: Times that a document may be taken, at most.
REPEAT = 3
#: Undecided documents in a block.
BLOCK = 8192
SEED = 17
EPS = 1e-9


def _step(p: np.ndarray, u: np.ndarray, draw: float) -> np.ndarray:
    """One move along ``u`` to the border of the cube, up or down so that the expectation stays."""
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.min(np.where(u > 0, (1 - p) / u, np.where(u < 0, -p / u, np.inf)))
        down = np.min(np.where(u > 0, p / u, np.where(u < 0, (p - 1) / u, np.inf)))
    move = up if draw * (up + down) < down else -down
    return np.clip(p + move * u, 0.0, 1.0)


def _settle_large(p: np.ndarray, x: np.ndarray, order: np.ndarray, rng: np.random.Generator) -> None:
    """Moves each of ``order`` until it is decided; all other undecided units make up for it together.

    The direction is the unit itself less its projection on the constraints, with weights p (1 - p). A unit far
    larger than the others would otherwise stay undecided to the end.
    """
    for i in order:
        while EPS < p[i] < 1 - EPS:
            rest = np.flatnonzero((p > EPS) & (p < 1 - EPS))
            rest = rest[rest != i]
            w = p[rest] * (1 - p[rest])
            a, b, c = w.sum(), (w * x[rest]).sum(), (w * x[rest] ** 2).sum()
            det = a * c - b * b
            if len(rest) < 3 or det <= 1e-9 * a * c:
                return
            alpha, beta = (c - b * x[i]) / det, (a * x[i] - b) / det
            at = np.append(rest, i)
            p[at] = _step(p[at], np.append(-w * (alpha + beta * x[rest]), 1.0), rng.random())


def fly(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, large: int = 64) -> np.ndarray:
    """Flight phase: moves probabilities until at most two are undecided; keeps sum(p) and sum(p * size).

    The first units (``large`` of them, a third at most) are settled one by one, the others three at a time, in their order.
    """
    p, x = p.copy(), size.astype(float)
    _settle_large(p, x, np.flatnonzero((p > EPS) & (p < 1 - EPS))[: min(large, len(p) // 3)], rng)
    draws = rng.random(2 * len(p) + 16)
    held: list[int] = []
    k = 0
    for i in np.flatnonzero((p > EPS) & (p < 1 - EPS)).tolist():
        held.append(i)
        while len(held) > 2:
            a, b, c = held[:3]
            u = np.array([x[b] - x[c], x[c] - x[a], x[a] - x[b]])
            if not u.any():
                u = np.array([1.0, -1.0, 0.0])
            p[held] = _step(p[held], u, draws[k % len(draws)])
            k += 1
            left = [j for j in held if EPS < p[j] < 1 - EPS]
            if len(left) == len(held):  # rounding kept all three inside: settle the nearest one
                j = min(held, key=lambda j: min(p[j], 1 - p[j]))
                p[j] = round(p[j])
                left.remove(j)
            held = left
    p[p <= EPS] = 0.0
    p[p >= 1 - EPS] = 1.0
    return p


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Landing phase: the rounding of the undecided (few) that comes nearest to the words expected of them."""
    p = p.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_):
        want, many = float((p[open_] * size[open_]).sum()), float(p[open_].sum())
        cases = [(np.array([m >> j & 1 for j in range(len(open_))], float)) for m in range(1 << len(open_))]
        p[open_] = min(cases, key=lambda c: (abs(float((c * size[open_]).sum()) - want), abs(float(c.sum()) - many), tuple(c)))
    return p


def _unit_key(df: DataFrame) -> list[str]:
    return ["source", "doc_id", "h"]


def slim(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, source, size, h) of each row: words in the text, and a hash of the text."""
    text = F.coalesce("text", F.lit(""))
    # Words start where a character that is no white space follows one that is, or the beginning.
    words = F.size(F.split(F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     ")), " +"))
    size = F.when(F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     ")) == "", 0).otherwise(words).cast("long")
    return with_uid(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(text).alias("h")))


def ranked_sources(per: DataFrame) -> DataFrame:
    """``per`` with n: the place of its source in code point order, null last. Ranges are ranked one by one and
    offset by the counts before them, so any number of sources is ranked without one task seeing all."""
    per = with_uid(per.repartitionByRange(F.isnull("source"), F.col("source").asc()).sortWithinPartitions(F.isnull("source"), F.col("source").asc()), "at")
    per = materialize(per.withColumn("part", F.shiftrightunsigned("at", 33)))
    counts = sorted((r["part"], r["count"]) for r in per.groupBy("part").count().collect())  # a row for each partition
    before, total = {}, 0
    for part, n in counts:
        before[part] = total
        total += n
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("part")] if before else F.lit(0)
    return per.withColumn("n", offset + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at", "part")


def targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """(source, source_size, target): weighted shares of all words, each at most ``repeat`` times its source's.

    What a full source leaves over is shared among the others by weight, until none is above: each round is
    one aggregation over the sources.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = materialize(ranked_sources(per).withColumn("w", F.array(*map(F.lit, weights))[(F.col("n") % len(weights)).cast("int")].cast("double")))
    level, total = 0.0, None
    while True:
        full = F.col("w") * F.lit(level) >= F.col("source_size") * repeat
        got = per.agg(F.sum("source_size"), F.sum(F.when(full, F.col("source_size") * repeat).otherwise(0)), F.sum(F.when(~full, F.col("w")).otherwise(0.0))).first()
        if total is None:
            total = got[0] or 0
        if not got[2]:
            break
        new = (total - got[1]) / got[2]
        if new <= level:
            break
        level = new
    full = F.col("w") * F.lit(level) >= F.col("source_size") * repeat
    return per.select("source", "source_size", F.when(full, (F.col("source_size") * repeat).cast("double")).otherwise(F.col("w") * F.lit(level)).alias("target"))


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    other = right.select(*[F.col(c).alias(f"__{c}" if c in keys else c) for c in right.columns])
    on = [left[k].eqNullSafe(other[f"__{k}"]) for k in keys]
    return left.join(other, on, how).drop(*[f"__{k}" for k in keys])


def draw(units: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """Decides units (source, doc_id, h, size, p) with 0 < p < 1: the same columns, p being 0.0 or 1.0.

    Rounds of flight in blocks; a source that fits into one block lands. Small sources share a group.
    """
    kind = units.schema["doc_id"].dataType.simpleString()
    schema = f"source string, doc_id {kind}, h long, size long, p double, last boolean"
    done = None

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # Large documents first, so that those left undecided are small.
        rows = rows.sort_values(["size", "mix", "h"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        out = rows["p"].to_numpy().copy()
        size = rows["size"].to_numpy()
        last = rows["last"].to_numpy()
        name = rows["source_hash"].to_numpy()
        for s in np.unique(name):
            at = np.flatnonzero(name == s)
            rng = np.random.default_rng([seed, int(rows["round"].iloc[0]), int(s) & (1 << 63) - 1, int(rows["blk"].iloc[at[0]])])
            p = fly(out[at], size[at], rng)
            out[at] = land(p, size[at]) if last[at[0]] else p
        return rows.assign(p=out)[["source", "doc_id", "h", "size", "p", "last"]]

    cur, turn = units, 0
    while True:
        per = cur.groupBy("source").agg(F.count("*").alias("many"))
        dealt = _join_null_safe(cur, per, ["source"])
        total = cur.count()
        if not total:
            return done if done is not None else cur
        parts = F.ceil(F.col("many") / F.lit(float(block))).cast("long")
        mixed = F.xxhash64("doc_id", "h", F.lit(seed + turn))
        dealt = dealt.withColumn("mix", mixed).withColumn("source_hash", F.xxhash64("source")).withColumn("last", parts == 1)
        dealt = dealt.withColumn("blk", F.pmod("mix", parts)).withColumn("round", F.lit(turn))
        shared = F.pmod("source_hash", F.lit(max(1, total // block)))
        dealt = dealt.withColumn("g1", F.when(F.col("last"), shared).otherwise(F.col("source_hash")))
        out = materialize(dealt.groupBy("g1", "blk", "last").applyInPandas(run, schema))
        part = out.where("p = 0.0 or p = 1.0").drop("last")
        done = part if done is None else done.union(part)
        cur, turn = out.where("p > 0.0 and p < 1.0").drop("last"), turn + 1


def plan(rows: DataFrame, weights: Sequence[int] = WEIGHTS, repeat: int = REPEAT, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """Per unit of equal rows: source, doc_id, h, size, source_size, target, rows, each (copies of every row)
    and more (rows that get one copy more)."""
    units = rows.groupBy("source", "doc_id", "h", "size").agg(F.count("*").alias("rows"))
    units = _join_null_safe(units, targets(rows, weights, repeat), ["source"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.withColumn("ratio", F.least(ratio, F.lit(float(repeat)))).withColumn("each", F.floor(F.col("ratio") + EPS).cast("long"))
    units = units.withColumn("rest", F.greatest(F.col("ratio") - F.col("each"), F.lit(0.0)) * F.col("rows"))
    units = materialize(units.withColumn("whole", F.floor(F.col("rest") + EPS).cast("long")).withColumn("p", F.greatest(F.col("rest") - F.col("whole"), F.lit(0.0))))
    drawn = draw(units.where(f"p > {EPS}").select("source", "doc_id", "h", "size", "p"), block, seed).where("p = 1.0")
    drawn = drawn.select("source", "doc_id", "h", "size", F.lit(1).alias("extra"))
    units = _join_null_safe(units, drawn, ["source", "doc_id", "h", "size"], "left")
    more = F.col("whole") + F.coalesce("extra", F.lit(0))
    return units.select("source", "doc_id", "h", "size", "source_size", "target", "rows", "each", more.cast("long").alias("more"))


def copies(units: DataFrame) -> DataFrame:
    """A row for each document row again: ``units`` with copies, the number of times that it is taken."""
    part = F.explode(F.array(F.struct(F.col("more").alias("n"), F.lit(1).alias("x")), F.struct((F.col("rows") - F.col("more")).alias("n"), F.lit(0).alias("x"))))
    each = units.withColumn("s", part).where("s.n > 0").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("s.n"))))
    return each.withColumn("copies", F.col("each") + F.col("s.x")).drop("s", "i")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """``docs`` as mixed: each row as often as it is taken, with its own columns only."""
    rows = materialize(slim(docs))
    units = plan(rows, weights, repeat)
    # Equal rows are numbered by the partition they lie in, then across partitions.
    key = ["source", "doc_id", "h"]
    part = F.shiftrightunsigned("uid", 33)
    many = units.where("rows > 1 and more > 0 and more < rows").select(*key, F.col("rows").alias("same"))
    same = _join_null_safe(rows, many, key).withColumn("part", part)
    counts = same.groupBy(*key, "part").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(Window.partitionBy(*key).orderBy("part")) - F.col("n"))
    inside = same.withColumn("i", F.row_number().over(Window.partitionBy(*key, "part").orderBy("uid")))
    number = _join_null_safe(inside, counts.drop("n"), [*key, "part"]).select("uid", (F.col("i") + F.col("before")).alias("number"))
    took = _join_null_safe(rows, units.select(*key, "rows", "each", "more"), key).join(number, "uid", "left")
    extra = F.when(F.coalesce("number", F.lit(1)) <= F.col("more"), 1).otherwise(0)
    took = took.select("uid", (F.col("each") + extra).cast("int").alias("copies")).where("copies > 0")
    packed = with_uid(docs.select(F.struct("*").alias("row"))).join(took, "uid")
    return packed.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    rows = materialize(slim(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("uid"))
    return copies(plan(rows)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
