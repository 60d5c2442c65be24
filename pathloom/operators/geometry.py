"""Vector geometry: neighbours, their overlap, linear CKA, norms, principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import written

#: Rows of one block of the base side and of the query side.
BLOCK = 4096


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (null vectors stay)."""
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)


def nearest(base: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "vec") -> DataFrame:
    """(query_id, neighbor_id, rank, similarity): the k most similar rows of ``base`` by cosine for each query, without itself.

    Exact. Both sides are cut into blocks of bounded size by id hash; each pair of blocks is
    one matrix product that keeps k rows a query, and only those are shuffled. Equal
    similarities (to 6 digits) are ranked by id. Rows without vector are left out.
    """
    b = base.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    q = queries.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    n_b, n_q = (max(1, -(-df.count() // BLOCK)) for df in (b, q))
    cut = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    left = b.withColumn("bb", cut(n_b, 1)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    right = q.withColumn("qb", cut(n_q, 2)).withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(n_b - 1))))

    return _ranked(left.groupBy("bb", "qb").cogroup(right.groupBy("bb", "qb")).applyInPandas(_block_neighbours(k), _NEAR), k)


_NEAR = "query_id bigint, neighbor_id bigint, similarity double"


def _block_neighbours(k: int):
    """The k most similar rows of a block of base rows for each row of a block of queries, as a function of both blocks."""

    def run(base_block: pd.DataFrame, query_block: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "neighbor_id": np.zeros(0, np.int64), "similarity": np.zeros(0)})
        if base_block.empty or query_block.empty:
            return empty
        ids, asked = base_block["id"].to_numpy(), query_block["id"].to_numpy()
        sim = np.round(unit(np.stack(query_block["vec"])) @ unit(np.stack(base_block["vec"])).T, 6)
        sim[asked[:, None] == ids[None, :]] = -np.inf
        order = np.lexsort((np.broadcast_to(ids, sim.shape), -sim), axis=1)[:, :k]
        row = np.repeat(np.arange(len(asked)), order.shape[1])
        col = order.ravel()
        ok = np.isfinite(sim[row, col])
        return pd.DataFrame({"query_id": asked[row[ok]], "neighbor_id": ids[col[ok]], "similarity": sim[row[ok], col[ok]]})

    return run


def _ranked(part: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbor_id")
    return part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def centroids(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 42) -> np.ndarray:
    """Unit vectors in the middle of ``lists`` groups of the unit rows of ``sample`` (spherical k-means); fewer if there are fewer rows."""
    x = unit(sample)
    lists = min(lists, len(x))
    middle = x[np.random.Generator(np.random.PCG64(seed)).permutation(len(x))[:lists]]
    for _ in range(rounds):
        own = np.argmax(x @ middle.T, axis=1)
        total = np.zeros_like(middle)
        np.add.at(total, own, x)
        middle = np.where(np.linalg.norm(total, axis=1, keepdims=True) > 0, unit(total), middle)
    return middle


def nearest_indexed(base: DataFrame, queries: DataFrame, k: int, lists: int | None = None, probes: float = 0.25, fit_rows: int = 20_000, seed: int = 42, id_col: str = "vec_id", vec_col: str = "vec") -> DataFrame:
    """(query_id, neighbor_id, rank, similarity) as ``nearest``, found by an index: approximate, for collections too large to compare all.

    The index files every row of ``base`` under the nearest of ``lists`` centroids (by default as many as
    the root of the number of rows, 4,096 at most), which are fitted on the ``fit_rows`` rows with the
    least id hash and no others. A query looks into its nearest lists, a share ``probes`` of all. Long
    lists are cut into blocks, so a list that holds a third of all rows is spread. Recall depends on
    ``probes``; with 1.0 the result is that of ``nearest``. Rows without vector are left out.
    """
    b = base.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    q = queries.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    spark = base.sparkSession
    fit = b.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(fit_rows).toArrow().column("vec").to_pylist()
    if not fit:
        return spark.createDataFrame([], "query_id bigint, neighbor_id bigint, similarity double, rank int")
    middle = centroids(np.array(fit), lists or min(4096, max(1, int(b.count() ** 0.5))), seed=seed)
    shared, most = spark.sparkContext.broadcast(middle), max(1, round(probes * len(middle)))

    def filed(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    far = -(unit(np.array(batch.column("vec").to_pylist(), dtype=np.float64)) @ shared.value.T)
                    own = np.argsort(far, axis=1, kind="stable")[:, :n]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=[*batch.schema.names, "lists"])

        return run

    schema = "id bigint, vec array<double>, lists array<int>"
    left = written(b.mapInArrow(filed(1), schema).select("id", "vec", F.col("lists")[0].alias("list")), "lists")
    right = q.mapInArrow(filed(most), schema).select("id", "vec", F.explode("lists").alias("list"))
    blocks = F.broadcast(left.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("n")))  # at most one row a list
    left = left.join(blocks, "list").withColumn("bb", F.pmod(F.xxhash64("id", F.lit(1)), F.col("n")).cast("int"))
    right = right.join(blocks, "list").withColumn("bb", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cut = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(max(1, -(-q.count() * most // (BLOCK * len(middle)))))).cast("int")
    right = right.withColumn("qb", cut).select("list", "bb", "qb", "id", "vec")
    asked = right.select(F.col("list").alias("l"), F.col("bb").alias("b"), F.col("qb").alias("q"), "id", "vec")
    left = left.join(right.select("list", "bb", "qb").distinct(), ["list", "bb"]).select("list", "bb", "qb", "id", "vec")
    return _ranked(left.groupBy("list", "bb", "qb").cogroup(asked.groupBy("l", "b", "q")).applyInPandas(_block_neighbours(k), _NEAR), k)


def mutual_overlap(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """(query_id, overlap): share of the k neighbours that two neighbour tables have in common, per query."""
    common = first.select("query_id", "neighbor_id").join(second.select("query_id", "neighbor_id"), ["query_id", "neighbor_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return first.select("query_id").distinct().join(common, "query_id", "left").select("query_id", F.round(F.coalesce("n", F.lit(0)) / k, 6).alias("overlap"))


def moments(df: DataFrame, a: str, b: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n, sums of a, sums of b, a'a, b'b, a'b) over all rows: partial matrices per task, added up. Their size is that of the dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x, y = (np.array(batch.column(c).to_pylist(), dtype=np.float64) for c in ("__a", "__b"))
                m = [np.array([len(x)]), x.sum(0), y.sum(0), (x.T @ x).ravel(), (y.T @ y).ravel(), (x.T @ y).ravel()]
                total = m if total is None else [p + q for p, q in zip(total, m, strict=True)]
        if total is not None:
            flat = np.concatenate([t.astype(np.float64) for t in total])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat), pa.array(np.full(len(flat), len(total[1]), np.int32))], names=["i", "v", "d"])

    used = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("array<double>").alias("__a"), F.col(b).cast("array<double>").alias("__b"))
    got = used.mapInArrow(run, "i int, v double, d int").groupBy("i").agg(F.sum("v").alias("v"), F.max("d").alias("d")).orderBy("i").toPandas()
    if got.empty:
        z = np.zeros((0, 0))
        return 0, np.zeros(0), np.zeros(0), z, z, z
    v, d = got["v"].to_numpy(), int(got["d"].iloc[0])
    cut = np.cumsum([1, d, d, d * d, d * d, d * d])
    n, sa, sb, aa, bb, ab = np.split(v, cut[:-1])
    return int(n[0]), sa, sb, aa.reshape(d, d), bb.reshape(d, d), ab.reshape(d, d)


def linear_cka(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, cka): linear centred kernel alignment of two vector columns of the same dimension; 0 without variance.

    Computed in feature space, ||A'B||^2 / (||A'A|| ||B'B||), so no pair of rows is ever formed.
    """
    n, sa, sb, aa, bb, ab = moments(df, a, b)
    value = 0.0
    if n:
        aa, bb, ab = aa - np.outer(sa, sa) / n, bb - np.outer(sb, sb) / n, ab - np.outer(sa, sb) / n
        under = np.linalg.norm(aa) * np.linalg.norm(bb)
        value = float((ab**2).sum() / under) if under > 0 else 0.0
    return df.sparkSession.createDataFrame([(n, round(value, 6))], "n bigint, cka double")


def norm(vec: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def mean_norms(df: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, n, mean_norm)."""
    return df.groupBy(group).agg(F.count(vec).alias("n"), F.round(F.avg(norm(F.col(vec))), 5).alias("mean_norm"))


def principal_plane(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(id, x, y): projection on the first two principal components; signs make each component's largest weight positive."""
    n, s, _, m, _, _ = moments(df, vec, vec)
    if not n:
        return df.sparkSession.createDataFrame([], "id bigint, x double, y double")
    mean = s / n
    values, vectors = np.linalg.eigh(m / n - np.outer(mean, mean))
    axes = vectors[:, np.argsort(-values)[:2]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    dot = lambda w: F.aggregate(F.zip_with(F.col(vec), F.array(*[F.lit(float(x)) for x in w]), lambda p, q: p.cast("double") * q), F.lit(0.0), lambda acc, x: acc + x)
    shift = axes.T @ mean
    return df.filter(F.col(vec).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), *[F.round(dot(axes[:, j]) - float(shift[j]), 5).alias("xy"[j]) for j in range(2)])


def pooled(vectors: DataFrame, group: str, order: str, vec: str, how: str = "mean") -> DataFrame:
    """(group, vec): the last vector of a sequence by ``order``, or the mean of all."""
    if how == "last":
        return vectors.groupBy(group).agg(F.max_by(vec, order).alias("vec"))
    parts = vectors.select(group, F.posexplode(vec).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vec"))

