"""Operator 5: nearest neighbours by randomly rotated one-bit codes.

Every vector, less the mean and scaled to length one, is rotated by a seeded random orthogonal matrix and kept as the signs of its
components: packed bits, with its length and the inner product of its code and itself as correction scalars. The
inner product of a code and a rotated query, over that scalar, estimates the cosine without bias, and its error has a bound
of EPSILON x sqrt((1 - s^2) / s^2 / (d - 1)) for the scalar s. So codes give a lower bound of each distance, and only
vectors whose lower bound reaches the tenth best distance so far are compared exactly.

Queries go in blocks of at most QUERIES, each broadcast (bounded) to one pass over the index; the index is written and
has every row. A task keeps the best ``k`` of each query of the block.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

EPSILON, SEED, QUERIES = 3.0, 42, 1 << 14


def taking_part(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v``: rows whose vector is not null, not zero, and of finite components."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(v.isNotNull() & F.col(id_col).isNotNull() & fine & F.exists(v, lambda x: x != 0)).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def _matrix(column):
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def mean_vector(rows: DataFrame, dim: int) -> list[float]:
    """The mean over all rows: each task sends its sums."""

    def sums(batches):
        import numpy as np

        s, n = np.zeros(dim), 0
        for b in batches:
            m = _matrix(b.column(0))
            if len(m):
                s, n = s + m.sum(axis=0), n + len(m)
        yield pa.RecordBatch.from_arrays([pa.array([*range(dim)], pa.int32()), pa.array(s), pa.array([n] * dim, pa.int64())], ["i", "s", "n"])

    parts = rows.select("v").mapInArrow(sums, "i int, s double, n long")
    return [r.m for r in parts.groupBy("i").agg((F.sum("s") / F.sum("n")).alias("m")).orderBy("i").collect()]  # dim rows


def rotation(dim: int, seed: int = SEED):
    """A random orthogonal matrix, the same on every worker."""
    import numpy as np

    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def build_index(rows: DataFrame, dim: int, center: list[float], seed: int = SEED) -> DataFrame:
    """``vec_id, v, code, length, scale`` for every row, written."""

    def encode(batches):
        import numpy as np

        turn, c = rotation(dim, seed), np.array(center)
        for b in batches:
            m = _matrix(b.column(1))
            if not len(m):
                continue
            r = m - c
            length = np.sqrt((r * r).sum(axis=1))
            x = (r / np.where(length > 0, length, 1)[:, None]) @ turn
            scale = np.abs(x).sum(axis=1) / np.sqrt(dim)
            codes = np.packbits(x > 0, axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(scale)], ["vec_id", "v", "code", "length", "scale"])

    return common.materialize(rows.mapInArrow(encode, "vec_id long, v array<double>, code binary, length double, scale double"))


def search(index: DataFrame, dim: int, center: list[float], ids: list[int], vectors: list[list[float]], k: int, epsilon: float = EPSILON, seed: int = SEED) -> DataFrame:
    """``query_id, vec_id, score``: each task's best k for each query of a block.

    ``index`` has rows of one dimension without nulls, as build_index() writes them; its ids may be null or repeated, and tie by the smaller.
    ``ids`` and ``vectors`` are one bounded block; an empty index gives no rows.
    """
    block = index.sparkSession.sparkContext.broadcast((ids, vectors))

    def scan(batches):
        import numpy as np

        ids, vectors = (np.array(x) for x in block.value)
        turn, c = rotation(dim, seed), np.array(center)
        rq = vectors - c
        q_len = np.sqrt((rq * rq).sum(axis=1))
        q_rot = ((rq / np.where(q_len > 0, q_len, 1)[:, None]) @ turn).astype("f4")
        n_q = len(ids)
        best_d, best_id = np.full((n_q, k), np.inf), np.full((n_q, k), np.iinfo("i8").max)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            vec_id, m = b.column(0).to_numpy(), _matrix(b.column(1))
            bits = np.unpackbits(np.frombuffer(b"".join(b.column(2).to_pylist()), "u1").reshape(n, -1), axis=1)[:, :dim]
            signs = (bits.astype("f4") * 2 - 1) / np.float32(np.sqrt(dim))
            length, scale = b.column(3).to_numpy(), np.maximum(b.column(4).to_numpy(), 1e-9)
            error = epsilon * np.sqrt(np.maximum(1 - scale**2, 0) / scale**2 / max(dim - 1, 1)) + 1e-6
            for s in range(0, n_q, 1024):
                e = min(s + 1024, n_q)
                cos = np.minimum((q_rot[s:e] @ signs.T) / scale + error, 1)
                low = q_len[s:e, None] ** 2 + length**2 - 2 * q_len[s:e, None] * length * cos
                qi, vi = np.nonzero((low <= best_d[s:e, -1:] ** 2 * (1 + 1e-12) + 1e-12) & (vec_id != ids[s:e, None]))
                qi += s
                for at in range(0, len(qi), 1 << 18):
                    i, j = qi[at : at + (1 << 18)], vi[at : at + (1 << 18)]
                    acc = np.zeros(len(i))
                    for t in range(dim):
                        diff = vectors[i, t] - m[j, t]
                        acc += diff * diff
                    some = np.unique(i)
                    all_q = np.concatenate([np.repeat(some, k), i])
                    all_d = np.concatenate([best_d[some].ravel(), np.sqrt(acc)])
                    all_id = np.concatenate([best_id[some].ravel(), vec_id[j]])
                    order = np.lexsort((all_id, all_d, all_q))
                    first = np.searchsorted(all_q[order], some)
                    take = order[first[:, None] + np.arange(k)]
                    best_d[some], best_id[some] = all_d[take], all_id[take]
        found = np.isfinite(best_d)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, found.sum(axis=1)).astype("i8")), pa.array(best_id[found]), pa.array(best_d[found])], ["query_id", "vec_id", "score"])

    return index.mapInArrow(scan, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, dim: int | None = None, epsilon: float = EPSILON, block: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query (columns vec_id, v, as taking_part() gives) its k nearest rows.

    Distances are Euclidean, in double precision, of the vectors themselves; ties go to the smaller id. Rows with the query's id
    are no candidates. A query id that is repeated is asked once, with its smallest vector; repeated candidates are candidates each.
    Vectors of another dimension than ``dim`` (default: the most frequent, then the larger) take no part. No vectors: no rows.
    """
    spark = vectors.sparkSession
    common.small_batches(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if dim is None:
        top = vectors.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
        if top is None:
            return empty
        dim = top.d
    rows = vectors.where(F.size("v") == dim)
    asked = common.materialize(queries.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v")))
    n = asked.count()
    if not n:
        return empty
    center = mean_vector(rows, dim)
    index = build_index(rows, dim, center)
    blocks = -(-n // block)
    path, schema = common.work_dir(spark), "query_id long, rank int, vec_id long, score double"
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    for i in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).collect()  # about `block` rows
        if some:
            found = search(index, dim, center, [r.vec_id for r in some], [r.v for r in some], k, epsilon)
            ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
            if blocks == 1:
                return ranked
            ranked.write.mode("append").parquet(path)
    return common.read_work(spark, path, schema)


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = taking_part(common.read(spark, sf_dir, "embeddings"))
    return nearest(rows, rows.where(F.col("vec_id") % 100 == 0))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum([(q.e[i] - c.e[i]) * (q.e[i] - c.e[i]) FOR i IN range(1, len(q.e) + 1)])) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank, vec_id, score
FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
"""
