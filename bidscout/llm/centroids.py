r"""Centroid clustering with lower bounds that loosen by geometry.

Each vector carries its squared distance to its centroid and a lower bound of its
distance to all others. When centroids move, the vectors of a cluster lie in a
sphere around its old centroid. In the plane of that centre and of another
centroid's path, the tangent from the middle of the path to the sphere's disc bounds
how much nearer that centroid can have come to any of them: at most the path's
length times the sine of the tangent's angle, often far less than the path. The
lower bound loosens by the largest of these, and only vectors whose distance then
reaches the bound are ambiguous and scanned against all centroids.

Vectors are integers and every distance that decides is exact; bounds are doubles
with a margin, and only save scans. A round maps over the vectors, writes what it
found, and sums the vectors of each cluster (map-side first, one row for each
cluster and task). The driver has k centroids and k rows of sums a round.

Defined cases: vectors of other lengths, with nulls or non-finite numbers are left
out, as are those with a component beyond SPAN, whose distances a long can't hold;
repeated rows are vectors of their own; a null id ranks last as a first centroid,
equal ids rank by their components; fewer vectors than k give fewer clusters; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Components are within plus or minus SPAN, so that 64 squared differences are within a long.
SPAN = 1 << 27
#: Within EXACT, doubles hold sums of products exactly, and the fast product of matrices may be used.
EXACT = 1 << 19
#: Bounds are doubles: a vector is safe only by so much, relatively and in all.
MARGIN = 1e-9
#: Distances that are held at once.
HELD = 1 << 22


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, size: int, scale: float) -> DataFrame:
    """id, v: the vectors with size components, all there and finite, as floor(scale * x)."""
    x = F.transform(F.col(f"`{vector_col}`"), lambda c: F.lit(float(scale)) * c.cast("double"))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), x.alias("x")).filter(F.size("x") == size)
    # a null or NaN isn't within any bounds
    rows = rows.filter(F.forall("x", lambda c: F.coalesce((c >= -SPAN) & (c <= SPAN), F.lit(False))))
    return rows.select("id", F.transform("x", lambda c: F.floor(c).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of seed:id, in that order."""
    rank = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), "UTF-8"), 256)
    rows = vectors.select(rank.alias("rank"), "v").orderBy(F.asc_nulls_last("rank"), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of v to those of c, exact."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:
        a, b = v.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.empty((len(v), len(c)), np.int64)
    for j, centre in enumerate(c):
        d = v - centre
        out[:, j] = (d * d).sum(1)
    return out


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, what its vectors' lower bounds lose: no other centroid can have come nearer to any of them by more.

    radius is the largest distance of a cluster's vectors from its old centroid.
    """
    k = len(old)
    out = np.zeros(k)
    a, b = old.astype(np.float64), new.astype(np.float64)
    path = b - a
    length = np.sqrt((path * path).sum(1))
    moved = np.flatnonzero(length > 0)
    if not len(moved):
        return out
    along = path[moved] / length[moved, None]
    middle = (a[moved] + b[moved]) / 2
    for i in range(k):
        to = a[i] - middle
        y = (to * along).sum(1)
        square = (to * to).sum(1)
        x = np.sqrt(np.maximum(square - y * y, 0))
        r, far = radius[i] * (1 + MARGIN) + MARGIN, np.sqrt(square)
        angle = np.arctan2(y, x) + np.arcsin(np.minimum(1, r / np.maximum(far, r)))
        share = np.where(x > r, np.sin(np.minimum(angle, np.pi / 2)), 1.0)
        share = np.where(y + r <= 0, 0.0, np.maximum(share, 0.0))  # all of the sphere is nearer to where it was
        nearer = share * length[moved]
        nearer[moved == i] = 0
        out[i] = nearer.max(initial=0) * (1 + MARGIN) + MARGIN
    return out


def assigned(state: DataFrame, centroids: np.ndarray, loosened: np.ndarray | None) -> DataFrame:
    """id, v, cluster, distance, lower, scanned. loosened: what each cluster's lower bounds lose; None scans all."""
    kinds = f"id {state.schema['id'].dataType.simpleString()}, v array<int>, cluster int, distance long, lower double, scanned boolean"
    k, size = centroids.shape
    names = ["id", "v", "cluster", "distance", "lower", "scanned"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n = len(part)
            v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, size)
            cluster, distance, lower, scanned = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n), np.ones(n, bool)
            if loosened is not None:
                cluster = part.column(2).to_numpy().copy()
                d = v - centroids[cluster]
                distance = (d * d).sum(1)
                lower = part.column(4).to_numpy() - loosened[cluster]
                scanned = np.sqrt(distance.astype(np.float64)) * (1 + MARGIN) + MARGIN >= lower
            open_rows = np.flatnonzero(scanned)
            for at in range(0, len(open_rows), max(1, HELD // k)):
                rows = open_rows[at : at + max(1, HELD // k)]
                every = squares(v[rows], centroids)
                best = every.argmin(1)  # ties: the smaller number
                cluster[rows], distance[rows] = best, every[np.arange(len(rows)), best]
                every[np.arange(len(rows)), best] = np.iinfo(np.int64).max
                lower[rows] = np.sqrt(every.min(1).astype(np.float64))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(lower), pa.array(scanned)], names=names)

    return state.mapInArrow(run, kinds)


def sums(state: DataFrame, size: int) -> dict[int, tuple[int, int, list[int]]]:
    """By cluster: vectors, the largest squared distance, the sum of each component."""
    columns = [F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(size)]
    rows = state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), *columns).collect()
    return {r["cluster"]: (r["n"], r["far"], [r[f"s{i}"] for i in range(size)]) for r in rows}


def clustered(df: DataFrame, k: int = 40, rounds: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, scale: float = 256.0, seed: str = "2") -> tuple[DataFrame, np.ndarray]:
    """(id_col, cluster, distance (squared), scanned (in the last assignment)) for each vector, and the centroids."""
    vectors = cut(whole_vectors(df, id_col, vector_col, size, scale), "vectors")
    centroids = first_centroids(vectors, k, seed)
    state = vectors.select("id", "v")
    if not len(centroids):
        centroids = np.zeros((0, size), np.int64)
        state = state.selectExpr("id", "v", "0 AS cluster", "0L AS distance", "0D AS lower", "true AS scanned")
    else:
        state = cut(assigned(state, centroids, None), "clusters")
        for _ in range(rounds):
            found = sums(state, size)
            new = centroids.copy()
            radius = np.zeros(len(centroids))
            for cluster, (n, far, total) in found.items():
                new[cluster] = [s // n for s in total]
                radius[cluster] = np.sqrt(float(far))
            state = cut(assigned(state, new, loosening(centroids, new, radius)), "clusters")
            centroids = new
    return state.select(F.col("id").alias(id_col), "cluster", "distance", "scanned"), centroids


def op12_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clustered(table(spark, sf_dir, "embeddings"))
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(inertia.values())
    rows = [(c, n, total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, n in inertia.items()]
    each = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.drop("scanned").join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 40, rounds: int = 5) -> str:
    near = "SELECT rid, v, num, d FROM (SELECT x.rid, x.v, c.num, CAST(list_inner_product(x.f, x.f) - 2 * list_inner_product(x.f, c.f) + list_inner_product(c.f, c.f) AS BIGINT) AS d FROM x CROSS JOIN {c} c) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, num) = 1"
    parts = [
        "e AS (SELECT vec_id, list_transform(embedding, lambda t: CAST(t AS DOUBLE)) AS q FROM embeddings)",
        "x AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(q, lambda t: CAST(floor(256 * t) AS BIGINT)) AS v, list_transform(q, lambda t: floor(256 * t)) AS f FROM e WHERE len(q) = 64 AND len(list_filter(q, lambda t: t IS NOT NULL AND isfinite(t))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS num, v, f FROM x QUALIFY num < {k})",
    ]
    for r in range(rounds):
        parts += [
            f"a{r} AS MATERIALIZED ({near.format(c=f'c{r}')})",
            f"u{r} AS (SELECT num, pos, sum(t)::BIGINT AS s, count(*) AS n FROM (SELECT num, unnest(v) AS t, unnest(range(64)) AS pos FROM a{r}) GROUP BY ALL)",
            f"m{r} AS (SELECT num, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS v FROM u{r} GROUP BY num)",
            f"c{r + 1} AS MATERIALIZED (SELECT num, v, list_transform(v, lambda t: CAST(t AS DOUBLE)) AS f FROM (SELECT c.num, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.num = c.num))",
        ]
    parts.append(f"z AS MATERIALIZED ({near.format(c=f'c{rounds}')})")
    return "WITH " + ",\n".join(parts) + f"""
SELECT x.vec_id, CAST(z.num AS INT) AS cluster, z.d AS distance, CAST(sum(z.d) OVER (PARTITION BY z.num) AS BIGINT) AS cluster_inertia, CAST(sum(z.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM z JOIN x ON x.rid = z.rid JOIN c{rounds} c ON c.num = z.num
"""


OP12_SQL = _sql()
