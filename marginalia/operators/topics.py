"""Topic models: LDA, and non-negative matrix factorisation by alternating coordinate descent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.clustering import LDA, LDAModel, LocalLDAModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.common import _py2java
from pyspark.mllib.linalg import Matrices, Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions.text import terms
from ..sources.tables import spread
from .works import top_per

#: Rows and entries of a block of sparse rows, at most (unless one row has more entries).
ROWS, ENTRIES = 128, 1 << 16
#: Parts of the topics that a reduction deals out, and partitions whose sums one task adds.
SLICES, ADDENDS = 10, 32


def fit_slice(docs: DataFrame, most: int | None, id_column: str = "id", seed: int | None = None) -> DataFrame:
    """The documents that a model is fitted on: the first ids, or with a seed a random choice, the same each time."""
    if most is None:
        return docs
    order = [F.col(id_column)] if seed is None else [F.xxhash64(F.col(id_column), F.lit(seed)), F.col(id_column)]
    return docs.orderBy(*order).limit(most)


def lda(
    docs: DataFrame, text: str = "text", id_column: str = "id", topics: int = 50, fit_docs: int | None = 100_000, features: int = 50_000,
    min_df: float = 10, max_df: float = 0.6, iterations: int = 10, online: bool = False, seed: int = 42, fit_seed: int | None = None,
) -> tuple[LDAModel, CountVectorizerModel, DataFrame]:
    """(model, vectorizer, topic vectors of all documents).

    Vocabulary and model come from ``fit_slice``; terms outside it drop out. Tokens are lower-cased, without stop
    words. ``online`` uses a part of the documents per iteration, else all of them.
    """
    tokens = docs.where(F.col(text).isNotNull()).select(F.col(id_column).alias("id"), terms(F.lower(text), 1).alias("terms"))
    fit_on = fit_slice(tokens, fit_docs, seed=fit_seed)
    n = fit_on.count()
    upper = float(2**62) if max_df >= 1.0 else max(1.0, max_df * n)
    vectorizer = CountVectorizer(inputCol="terms", outputCol="features", minDF=min_df, maxDF=upper, vocabSize=features).fit(fit_on)
    estimator = LDA(k=topics, maxIter=iterations, optimizer="online", subsamplingRate=0.05 if online else 1.0, seed=seed)
    if online:
        # Each iteration reads the term counts again.
        counted = vectorizer.transform(fit_on).select("features").persist(StorageLevel.MEMORY_AND_DISK)
        model = estimator.fit(counted)
        counted.unpersist()
        vectors = model.transform(vectorizer.transform(tokens)).select("id", vector_to_array("topicDistribution").cast("array<float>").alias("vec"))
        return model, vectorizer, vectors
    names = docs.sparkSession.sparkContext.broadcast(vectorizer.vocabulary)
    bayes = Bayes(topics, iterations, seed)
    state = bayes.fit(bayes.packed(spread(fit_on), names), len(vectorizer.vocabulary))
    # Documents that the model was fitted on go on from where its last iteration left them.
    vectors = bayes.transform(state if fit_docs is None else bayes.packed(tokens, names), dict(tokens.dtypes)["id"])
    return bayes.model(docs.sparkSession, estimator), vectorizer, vectors


def _psi(x: np.ndarray) -> np.ndarray:
    """Digamma of positive numbers."""
    # The sum of 1 / (x + i) for i under 6, first and last taken together, and so on.
    u = x * (x + 5)
    below = (2 * x + 5) * (1 / u + 1 / (u + 4) + 1 / (u + 6))
    x = x + 6
    y = 1 / (x * x)
    return np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240))) - below


def _psi1(x: np.ndarray) -> np.ndarray:
    """Trigamma of positive numbers."""
    below = sum(1 / (x + i) ** 2 for i in range(6))
    x = x + 6
    y = 1 / (x * x)
    return 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30))) + below


class Bayes:
    """Variational LDA over all documents in each iteration, with the steps of Spark's online optimizer.

    Its updates of topics and of the documents' prior, its start and its stop are kept. A document's inference
    goes on from its last iteration, in place of a random start, and runs for many documents of like length at a
    time. What isn't settled after ``ROUNDS`` steps goes on in the next iteration; ``transform`` settles all documents.
    Each part of the documents sends one sum as wide as the vocabulary per iteration.
    """

    #: Cells of a slice of documents x terms x topics; mean change of a document's weights that ends its inference.
    CELLS, CHANGE = 1 << 19, 1e-3
    #: Documents in a block, steps of their inference in one iteration of the fit.
    DOCS, ROUNDS = 512, 100
    STATE = "ids array<{}>, ends binary, at binary, tf binary, gamma binary, slice long, wide binary, few binary"

    def __init__(self, topics: int = 50, iterations: int = 10, seed: int = 42, offset: float = 1024, decay: float = 0.51):
        self.topics, self.iterations, self.seed, self.offset, self.decay = topics, iterations, seed, offset, decay
        self.alpha, self.eta, self.topic_terms = np.full(topics, 1 / topics), 1 / topics, np.zeros((topics, 0))

    @classmethod
    def packed(cls, tokens: DataFrame, names) -> DataFrame:
        """Blocks of (id, terms): ids, and for each entry its term's place in the broadcast ``names`` and its count.

        Documents without a known term are kept, with no entry.
        """
        kind = dict(tokens.dtypes)["id"]
        to = cls._schema(kind)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = pa.array(names.value, pa.string())
            for whole in batches:
                for lo in range(0, whole.num_rows, cls.DOCS):
                    b = whole.slice(lo, cls.DOCS)
                    place = pc.index_in(b.column("terms").flatten(), known)
                    doc = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(b.column("terms")), 0).to_numpy())
                    ok = place.is_valid().to_numpy(zero_copy_only=False)
                    key, tf = np.unique(doc[ok] * len(known) + pc.fill_null(place, -1).to_numpy()[ok], return_counts=True)
                    doc, at = np.divmod(key, len(known))
                    ends = np.r_[0, np.cumsum(np.bincount(doc, minlength=b.num_rows))]
                    yield cls._row(to, b.column("id"), ends.astype(np.int32).tobytes(), at.astype(np.int32).tobytes(), tf.astype(np.float32).tobytes())

        return tokens.select("id", "terms").mapInArrow(run, cls.STATE.format(kind))

    @classmethod
    def _schema(cls, kind: str) -> pa.Schema:
        return to_arrow_schema(_parse_datatype_string(cls.STATE.format(kind)))

    @staticmethod
    def _row(to: pa.Schema, *values: object) -> pa.RecordBatch:
        values = [*values, *[None] * (len(to) - len(values))]
        return pa.RecordBatch.from_arrays([pa.array([v.to_pylist() if isinstance(v, pa.Array) else v], t) for v, t in zip(values, to.types)], schema=to)

    @classmethod
    def _infer(cls, ends: np.ndarray, at: np.ndarray, tf: np.ndarray, gamma: np.ndarray, beta: np.ndarray, alpha: np.ndarray, wide: np.ndarray | None = None) -> None:
        """Settles the rows of ``gamma`` (documents x topics), or with ``wide`` moves them on and adds to it what they
        give the topics.

        ``beta`` is terms x topics, the exponential of the expected logarithm.
        """
        size = np.diff(ends)

        def slices(docs: np.ndarray):
            """(documents, their topics' weights of each term, its counts, terms), in order of length."""
            docs = docs[np.argsort(size[docs], kind="stable")]
            while len(docs):
                n = len(docs)
                while n > 1 and n * int(size[docs[n - 1]]) * beta.shape[1] > cls.CELLS:
                    n //= 2
                some, docs = docs[:n], docs[n:]
                j = np.arange(int(size[some[-1]]))
                real = j < size[some][:, None]
                place = np.where(real, ends[some][:, None] + j, 0)
                terms_ = np.where(real, at[place], 0)
                yield some, beta[terms_], np.where(real, tf[place], np.float32(0)), terms_

        def expected(g: np.ndarray) -> np.ndarray:
            return np.exp(_psi(g) - _psi(g.sum(axis=1, keepdims=True))).astype(np.float32)

        def share(b: np.ndarray, n: np.ndarray, theta: np.ndarray) -> np.ndarray:
            return n / ((b @ theta[:, :, None])[:, :, 0] + np.float32(1e-30))

        docs, least = np.flatnonzero(size > 0), 8
        while len(docs):
            late = []
            for left, b, n, _ in slices(docs):
                g, whole = gamma[left], len(left)
                theta, limit, rounds = expected(g), np.maximum(cls.CHANGE, 1e-7 * n.sum(axis=1)), 0
                # The last few of a slice go on with those of the others.
                while len(left) and (len(left) * least > whole or not least):
                    new = alpha + theta * (share(b, n, theta)[:, None, :] @ b)[:, 0, :]
                    on = np.abs(new - g).mean(axis=1) > limit
                    gamma[left] = g = new
                    theta, rounds = expected(g), rounds + 1
                    if wide is not None and rounds == cls.ROUNDS:
                        left = left[:0]
                    elif on.sum() < 0.75 * len(on):
                        b, n, g, theta, left, limit = b[on], n[on], g[on], theta[on], left[on], limit[on]
                late.append(left)
            docs, least = np.concatenate(late), 0
        if wide is not None:
            for some, b, n, terms_ in slices(np.flatnonzero(size > 0)):
                theta = expected(gamma[some])
                part = share(b, n, theta)
                for d, s in enumerate(size[some]):
                    wide[terms_[d, :s]] += part[d, :s, None] * theta[d]

    def _blocks_of(self):
        """A function from batches of the state to (row, ids, ends, at, tf, gamma); without a gamma all topics are alike."""
        k = self.topics

        def of(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = [batch.column(c)[i] for c in ("ids", "ends", "at", "tf", "gamma")]
                    ends, at, tf = (np.frombuffer(x.as_buffer(), t) for x, t in zip(row[1:4], (np.int32, np.int32, np.float32)))
                    if row[4].is_valid:
                        gamma = np.frombuffer(row[4].as_buffer(), np.float32).reshape(-1, k).astype(float)
                    else:
                        gamma = np.ones((len(ends) - 1, k))
                    yield row, ends, at, tf, gamma

        return of

    def _beta(self, spark: SparkSession):
        lam = self.topic_terms
        return spark.sparkContext.broadcast(np.ascontiguousarray(np.exp(_psi(lam) - _psi(lam.sum(axis=1, keepdims=True))).T.astype(np.float32)))

    def fit(self, blocks: DataFrame, v: int) -> DataFrame:
        """Fits the topics, returns the persisted blocks with each document's weights after the last iteration."""
        spark, k = blocks.sparkSession, self.topics
        self.topic_terms = np.random.default_rng(self.seed).gamma(100, 0.01, (k, v))
        tasks = max(1, min(blocks.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism))
        kind = dict(blocks.dtypes)["ids"][6:-1]
        to, of, infer, row = self._schema(kind), self._blocks_of(), self._infer, self._row
        state = blocks.coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)
        for t in range(1, self.iterations + 1):
            shared, alpha = self._beta(spark), self.alpha

            def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                beta = shared.value
                wide, few = np.zeros(beta.shape, np.float32), np.zeros(k + 1)
                for old, ends, at, tf, gamma in of(batches):
                    infer(ends, at, tf, gamma, beta, alpha, wide)
                    some = np.diff(ends) > 0
                    few += np.r_[(_psi(gamma) - _psi(gamma.sum(axis=1, keepdims=True)))[some].sum(axis=0), some.sum()]
                    yield row(to, old[0].values, *[x.as_py() for x in old[1:4]], gamma.astype(np.float32).tobytes())
                for i, part in enumerate(np.array_split(wide, SLICES, axis=1)):
                    yield row(to, None, None, None, None, None, i, np.ascontiguousarray(part).tobytes(), (few / SLICES).tobytes())

            before, state = state, state.where("slice is null").mapInArrow(step, self.STATE.format(kind)).persist(StorageLevel.MEMORY_AND_DISK)
            wide, few = add_sums(state.where("slice is not null").select("slice", "wide", "few"), v, k + 1, tasks)
            before.unpersist()
            shared.unpersist()
            if few[-1]:
                rho = (self.offset + t) ** -self.decay
                self.topic_terms = (1 - rho) * self.topic_terms + rho * (wide.T * shared.value.T + self.eta)
                # A Newton step for the documents' prior.
                n, a = few[-1], self.alpha
                slope, c, q = n * (few[:-1] / n - _psi(a) + _psi(a.sum())), n * _psi1(a.sum()), -n * _psi1(a)
                moved = a - rho * (slope - (slope / q).sum() / (1 / c + (1 / q).sum())) / q
                self.alpha = moved if (moved > 0).all() else a
        return state

    def transform(self, blocks: DataFrame, kind: str) -> DataFrame:
        """(id, vec): shares of the topics; zeros for documents without a known term."""
        shared, alpha, of, infer = self._beta(blocks.sparkSession), self.alpha, self._blocks_of(), self._infer
        to = to_arrow_schema(_parse_datatype_string(f"id {kind}, vec array<float>"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for old, ends, at, tf, gamma in of(batches):
                infer(ends, at, tf, gamma, shared.value, alpha)
                share = np.where((np.diff(ends) > 0)[:, None], gamma / gamma.sum(axis=1, keepdims=True), 0).astype(np.float32)
                vec = pa.ListArray.from_arrays(pa.array(np.arange(len(share) + 1) * share.shape[1], pa.int32()), pa.array(share.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(old[0].values.to_pylist(), to.types[0]), vec.cast(to.types[1])], schema=to)

        return blocks.where("slice is null").mapInArrow(run, f"id {kind}, vec array<float>")

    def model(self, spark: SparkSession, estimator: LDA) -> LDAModel:
        """As Spark's model, with the estimator's parameters."""
        sc, v = spark.sparkContext, self.topic_terms.shape[1]
        lam = _py2java(sc, Matrices.dense(v, self.topics, self.topic_terms.ravel()))
        old = sc._jvm.org.apache.spark.mllib.clustering.LocalLDAModel(lam, _py2java(sc, Vectors.dense(self.alpha)), self.eta, 100.0)
        made = LocalLDAModel(sc._jvm.org.apache.spark.ml.clustering.LocalLDAModel(estimator.uid, v, old, spark._jsparkSession))
        return estimator._copyValues(made)


def add_sums(sums: DataFrame, v: int, small: int, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums of (slice, wide, few), a matrix of ``v`` rows by slices of its columns, and of the ``small`` numbers.

    They are added per ``ADDENDS`` of the ``tasks`` that made them, then over these.
    """

    def add(part: pd.DataFrame) -> pd.DataFrame:
        wide, few = np.frombuffer(part["wide"].iloc[0], np.float32).astype(float), np.zeros(small)
        for x in part["wide"].iloc[1:]:
            wide += np.frombuffer(x, np.float32)
        for x in part["few"]:
            few += np.frombuffer(x)
        return pd.DataFrame({"slice": part["slice"].iloc[:1], "wide": [wide.astype(np.float32).tobytes()], "few": [few.tobytes()]})

    schema = "slice long, wide binary, few binary"
    if tasks > ADDENDS:
        sums = sums.withColumn("some", F.spark_partition_id() % ADDENDS).groupBy("slice", "some").applyInPandas(add, schema)
    total = sums.groupBy("slice").applyInPandas(add, schema).toPandas().sort_values("slice")
    wide = [np.frombuffer(x, np.float32).reshape(v, -1) if v else np.zeros((0, 1)) for x in total["wide"]]
    return np.concatenate(wide, axis=1).astype(float), np.sum([np.frombuffer(x) for x in total["few"]], axis=0)


def top_words(weights: DataFrame, most: int = 15) -> DataFrame:
    """(topic, top_words) from (topic, word, w): the heaviest words, ties by word, joined by |."""
    rows = top_per(weights, "topic", [F.desc("w"), F.asc("word")], most, rank="n")
    listed = F.array_sort(F.collect_list(F.struct("n", "word")))
    return rows.groupBy(F.col("topic").cast("long").alias("topic")).agg(F.array_join(F.transform(listed, lambda x: x["word"]), "|").alias("top_words"))


def lda_keywords(model: LDAModel, vectorizer: CountVectorizerModel, most: int = 15) -> DataFrame:
    """(topic, top_words): the heaviest words, joined by |."""
    top = model.describeTopics(most)
    known = top.sparkSession.createDataFrame(list(enumerate(vectorizer.vocabulary)), "i int, word string")
    rows = top.select("topic", F.explode(F.arrays_zip("termIndices", "termWeights")).alias("t")).select("topic", F.col("t.termIndices").alias("i"), F.col("t.termWeights").alias("w"))
    return top_words(rows.join(known, "i"), most)


def save_lda(model: LDAModel, vectorizer: CountVectorizerModel, path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    vectorizer.write().overwrite().save(f"{path}/vectorizer")


def load_lda(path: str) -> tuple[LDAModel, CountVectorizerModel]:
    """What ``save_lda`` wrote; needs a running session."""
    from pyspark.ml.clustering import DistributedLDAModel, LocalLDAModel

    kind = SparkSession.active().read.text(f"{path}/model/metadata").first()[0]
    return (DistributedLDAModel if "DistributedLDAModel" in kind else LocalLDAModel).load(f"{path}/model"), CountVectorizerModel.load(f"{path}/vectorizer")


class Nmf:
    """X ~ W H with non-negative factors, from the sparse rows of X.

    Rows are packed once into blocks, of which each holds its own distinct terms, so a block's products with H are
    small dense ones. H (topics x terms) is broadcast each round and bounded by the vocabulary. W is solved row by
    row from H, so rounds need no state on executors; the sums W'X and W'W are reduced in two steps, and H is
    solved from them topic by topic. H starts from the singular vectors of X (``nndsvda``: the positive or
    negative part of each, whichever is heavier, with the mean of X for zeros), found by subspace iteration, or
    at random.
    """

    def __init__(self, topics: int = 50, iterations: int = 300, inner: int = 8, seed: int = 42, tolerance: float = 1e-4, start: str = "nndsvda"):
        self.topics, self.iterations, self.inner, self.seed, self.tolerance, self.start = topics, iterations, inner, seed, tolerance, start
        self.h = np.zeros((topics, 0))
        self.vocabulary: list[str] = []
        self.objective: list[float] = []

    @staticmethod
    def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of rows: their ids, distinct terms, and for each entry its place in the dense block and weight."""
        for b in batches:
            size = b.column("at").value_lengths().to_numpy()
            at, ws = b.column("at").flatten().to_numpy(), b.column("ws").flatten().to_numpy()
            ends, lo = np.cumsum(size), 0
            while lo < len(size):
                base = ends[lo] - size[lo]
                hi = max(lo + 1, min(lo + ROWS, int(np.searchsorted(ends, base + ENTRIES, "right"))))
                some, place = np.unique(at[base : ends[hi - 1]], return_inverse=True)
                place = place + np.repeat(np.arange(hi - lo), size[lo:hi]) * len(some)
                cols = [some.astype(np.int32).tobytes(), place.astype(np.int32).tobytes(), ws[base : ends[hi - 1]].astype(np.float32).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([b.column("id")[lo:hi].to_pylist()], pa.list_(pa.int64())), *[pa.array([c], pa.binary()) for c in cols]], names=["ids", "some", "place", "ws"])
                lo = hi

    @staticmethod
    def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, np.ndarray, np.ndarray]]:
        """(ids, terms, dense rows over these terms) of each block."""
        for b in batches:
            for k in range(b.num_rows):
                some, place, ws = (np.frombuffer(b.column(c)[k].as_buffer(), t) for c, t in (("some", np.int32), ("place", np.int32), ("ws", np.float32)))
                ids = b.column("ids")[k]
                x = np.zeros((len(ids), len(some)), np.float32)
                x.ravel()[place] = ws
                yield ids, some, x

    @staticmethod
    def _solve(xh: np.ndarray, gram: np.ndarray, sweeps: int) -> np.ndarray:
        """W from X H' and H H', by coordinate descent from zero; topics x rows."""
        xh = np.ascontiguousarray(xh.T)
        w, diagonal = np.zeros_like(xh), np.maximum(gram.diagonal(), 1e-12)
        for _ in range(sweeps):
            for j in range(len(gram)):
                w[j] = np.maximum(0, w[j] + (xh[j] - gram[j] @ w) / diagonal[j])
        return w

    @classmethod
    def packed(cls, rows: DataFrame) -> DataFrame:
        """Blocks of (id, at, ws), lists of places in the sorted vocabulary and weights; ``fit`` and ``transform`` take
        them in place of weights."""
        return rows.mapInArrow(cls._pack, "ids array<long>, some binary, place binary, ws binary")

    def _blocks(self, weights: DataFrame) -> DataFrame:
        if "place" in weights.columns:
            return weights
        return self.packed(weights.join(self.numbers, "term").groupBy("id").agg(F.collect_list("i").alias("at"), F.collect_list("w").alias("ws")))

    def _reduced(self, blocks: DataFrame, step, small: int) -> tuple[np.ndarray, np.ndarray]:
        """The sums over all partitions of what ``step`` makes of one: a matrix of terms x columns and some numbers.

        A slice of columns travels as bytes; sums are added per ``ADDENDS`` partitions, then over these.
        """
        v = len(self.vocabulary)
        # Each task sends a sum as wide as the vocabulary: as many tasks as run at a time, however many parts there are.
        tasks = min(self.parts, blocks.sparkSession.sparkContext.defaultParallelism)
        blocks = blocks.coalesce(max(1, tasks))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wide, few = step(batches)
            for k, part in enumerate(np.array_split(wide, SLICES, axis=1)):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.ascontiguousarray(part, np.float32).tobytes()], pa.binary()), pa.array([(few / SLICES).tobytes()], pa.binary())], names=["slice", "wide", "few"])

        return add_sums(blocks.mapInArrow(run, "slice long, wide binary, few binary"), v, small, tasks)

    def _products(self, blocks: DataFrame, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """X'X Q, and for each column of X Q the squares of its positive and its negative part, then the sum of X."""
        dense, shared = self._dense, blocks.sparkSession.sparkContext.broadcast(q.astype(np.float32))

        def step(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
            q = shared.value
            out, few = np.zeros(q.shape, np.float32), np.zeros(2 * q.shape[1] + 1)
            for _, some, x in dense(batches):
                y = x @ q[some]
                out[some] += x.T @ y
                few += np.r_[(np.maximum(y, 0) ** 2).sum(axis=0), (np.minimum(y, 0) ** 2).sum(axis=0), x.sum(dtype=float)]
            return out, few

        found = self._reduced(blocks, step, 2 * q.shape[1] + 1)
        shared.unpersist()
        return found

    def _singular_start(self, blocks: DataFrame, rows: int, more: int = 10, rounds: int = 3) -> np.ndarray:
        k, v = self.topics, len(self.vocabulary)
        q = np.linalg.qr(np.random.default_rng(self.seed).standard_normal((v, min(v, k + more))))[0]
        for _ in range(rounds):
            z, _few = self._products(blocks, q)
            least, last = q, z
            q = np.linalg.qr(z)[0]
        value, e = np.linalg.eigh(least.T @ last)
        order = np.argsort(-value)[:k]
        vectors, s = least @ e[:, order], np.sqrt(np.maximum(value[order], 0))
        _, few = self._products(blocks, vectors)
        n = len(order)
        up, un, mean = np.sqrt(few[:n]), np.sqrt(few[n : 2 * n]), few[-1] / max(1, rows * v)
        h = np.full((k, v), mean)
        for j in range(n):
            p, m = np.maximum(vectors[:, j], 0), np.maximum(-vectors[:, j], 0)
            a, b = np.linalg.norm(p), np.linalg.norm(m)
            # The norms of X v are s times those of u; the first vector has one sign.
            side, size = (p / max(a, 1e-12), up[j] * a) if up[j] * a >= un[j] * b else (m / max(b, 1e-12), un[j] * b)
            h[j] = np.where(side > 0, np.sqrt(size) * side, mean)
        return h

    def fit(self, weights: DataFrame, vocabulary: DataFrame | list[str]) -> "Nmf":
        """``weights`` (id, term, w) or blocks of them, ``vocabulary`` (term), of bounded size, or its sorted terms."""
        spark, k, sweeps = weights.sparkSession, self.topics, self.inner
        self.vocabulary = vocabulary if isinstance(vocabulary, list) else [r["term"] for r in vocabulary.select("term").orderBy("term").collect()]
        self.numbers = spark.createDataFrame(list(enumerate(self.vocabulary)), "i int, term string")
        v, self.objective = len(self.vocabulary), []
        blocks = self._blocks(weights)
        own = blocks is not weights
        if own:
            blocks.persist(StorageLevel.MEMORY_AND_DISK)
        each = blocks.select(F.size("ids").alias("n"), F.spark_partition_id().alias("p"))
        rows, self.parts = each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_distinct("p")).first()
        if self.start == "nndsvda" and rows and v:
            self.h = self._singular_start(blocks, rows)
        else:
            self.h = np.random.default_rng(self.seed).random((k, v)) / max(1, v)
        solve, dense = self._solve, self._dense
        for _ in range(self.iterations if rows and v else 0):
            shared = spark.sparkContext.broadcast(self.h.astype(np.float32))

            def step(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
                h = shared.value
                ht, gram = np.ascontiguousarray(h.T), h @ h.T
                wx, ww, loss = np.zeros(ht.shape, np.float32), np.zeros(gram.shape), 0.0
                for _, some, x in dense(batches):
                    xh = x @ ht[some]
                    w = solve(xh, gram, sweeps)
                    wx[some] += x.T @ w.T
                    ww += w @ w.T
                    loss += float((x * x).sum(dtype=float) - 2 * (xh.T * w).sum(dtype=float) + ((gram @ w) * w).sum(dtype=float))
                return wx, np.r_[ww.ravel(), loss]

            wx, few = self._reduced(blocks, step, k * k + 1)
            ww, wx = few[:-1].reshape(k, k), wx.T
            self.objective.append(float(few[-1]))
            shared.unpersist()
            if len(self.objective) > 1 and self.objective[-2] - self.objective[-1] < self.tolerance * self.objective[0]:
                break
            for _ in range(2):
                for j in np.flatnonzero(ww.diagonal() > 1e-12):
                    self.h[j] = np.maximum(0, self.h[j] + (wx[j] - ww[j] @ self.h) / ww[j, j])
        if own:
            blocks.unpersist()
        return self

    def transform(self, weights: DataFrame, ids: DataFrame | None = None) -> DataFrame:
        """(id, vec); documents of ``ids`` without a known term get a zero vector."""
        spark, k, sweeps, solve, dense = weights.sparkSession, self.topics, self.inner * 4, self._solve, self._dense
        shared = spark.sparkContext.broadcast(self.h.astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h = shared.value
            ht, gram = np.ascontiguousarray(h.T), h @ h.T
            for ids, some, x in dense(batches):
                w = solve(x @ ht[some], gram, sweeps).T.astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(ids.as_py(), pa.int64()), pa.array(list(w), pa.list_(pa.float32()))], names=["id", "vec"])

        out = self._blocks(weights).mapInArrow(run, "id long, vec array<float>")
        if ids is not None:
            out = ids.select("id").join(out, "id", "left").withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(0.0).cast("float"), k)))
        return out

    def keywords(self, spark: SparkSession, most: int = 15) -> DataFrame:
        top = np.argsort(-self.h, axis=1, kind="stable")[:, :most]
        rows = [(t, self.vocabulary[i], float(self.h[t, i])) for t, row in enumerate(top.tolist()) for i in row]
        return top_words(spark.createDataFrame(rows, "topic long, word string, w double"), most)

    def save(self, spark: SparkSession, path: str) -> None:
        """The factors H and the vocabulary, as Parquet."""
        spark.createDataFrame([(t, h.tolist()) for t, h in enumerate(self.h)], "topic int, h array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/factors")
        self.numbers.coalesce(1).write.mode("overwrite").parquet(f"{path}/vocabulary")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Nmf":
        factors = spark.read.parquet(f"{path}/factors").orderBy("topic").collect()
        out = cls(len(factors))
        out.numbers = spark.read.parquet(f"{path}/vocabulary")
        out.vocabulary = [r["term"] for r in out.numbers.orderBy("i").collect()]
        out.h = np.array([r["h"] for r in factors]).reshape(len(factors), len(out.vocabulary))
        return out
