"""Centroid clustering in exact integers with partial-distance search.

Squared differences are summed over the dimensions of highest variance first.  A centroid is given
up as soon as its sum is strictly above the best whole distance so far; the others finish all
dimensions, so distances and ties are exact.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.llm.sparkside import cut, read

CENTROIDS, ROUNDS, DIMENSIONS, SCALE = 16, 3, 64, 64
#: Dimensions added between two looks at what can be given up, and rows worked on at a time.
BLOCK, SLAB = 8, 2048
#: Vectors within NARROW are worked on in 64-bit integers, others in Python's.  For a narrow vector and
#: a narrow centroid a distance is at most DIMENSIONS * 2 ** 42, so a centroid beyond FAR never wins there.
NARROW, FAR = 1 << 20, 1 << 25
#: Sums travel in pieces of so many bits, so that they are exact however large.
LIMB_BITS = 40
LARGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Centroids:
    """Centroids by number, and the dimensions from the highest variance to the lowest."""

    rows: tuple[tuple[int, ...], ...]
    order: tuple[int, ...]

    def digests(self) -> list[str]:
        return [sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.rows]


def usable(vector_col: str = "embedding", dimensions: int = DIMENSIONS):
    """Whether a vector has all its components, none of them null or not finite."""
    v = F.col(vector_col).cast("array<double>")
    return F.coalesce((F.size(v) == dimensions) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def _whole(x: float, scale: int) -> int:
    """floor(scale * x); beyond 2 ** 53 a double is a whole number itself, and scale * x may be none."""
    return scale * int(x) if abs(x) >= 1 << 53 else int(np.floor(scale * x))


def _slabs(column, scale: int):
    """Rows of a list column as (from, scaled narrow rows, their places, {place: wide row})."""
    width = len(column.flatten()) // max(1, len(column))
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
    for at in range(0, len(values), SLAB):
        part = values[at : at + SLAB]
        narrow = (np.abs(part) <= NARROW / (2 * scale)).all(axis=1)
        wide = {int(i): tuple(_whole(float(x), scale) for x in part[i]) for i in np.flatnonzero(~narrow)}
        yield at, np.floor(part[narrow] * scale).astype(np.int64), np.flatnonzero(narrow), wide


def nearest(points: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each point; the smaller number on ties."""
    points, centroids = points[:, order], centroids[:, order]
    head = ((points[:, None, :BLOCK] - centroids[None, :, :BLOCK]) ** 2).sum(axis=2)
    all_rows = np.arange(len(points))
    # Whoever is nearest so far is finished first: its distance is the best that the others must meet.
    start = head.argmin(axis=1)
    best = head[all_rows, start] + ((points[:, BLOCK:] - centroids[start, BLOCK:]) ** 2).sum(axis=1)
    row, number = np.nonzero(head <= best[:, None])
    other = number != start[row]
    row, number = row[other], number[other]
    part = head[row, number]
    for at in range(BLOCK, points.shape[1], BLOCK):
        part = part + ((points[row, at : at + BLOCK] - centroids[number, at : at + BLOCK]) ** 2).sum(axis=1)
        alive = part <= best[row]
        row, number, part = row[alive], number[alive], part[alive]
    row, number, part = np.concatenate([all_rows, row]), np.concatenate([start, number]), np.concatenate([best, part])
    by = np.lexsort((number, part, row))
    first = by[np.concatenate([[True], row[by][1:] != row[by][:-1]])] if len(by) else by
    return number[first], part[first]


def _nearest_wide(point: tuple[int, ...], rows, order) -> tuple[int, int]:
    """As nearest() for one point in Python's integers."""
    best = None
    for number, centroid in enumerate(rows):
        total = 0
        for d in order:
            total += (point[d] - centroid[d]) ** 2
            if best is not None and total > best[1]:
                break
        else:
            if best is None or total < best[1]:
                best = (number, total)
    return best


def _assigner(centroids: Centroids):
    """A function from a slab's rows to (numbers and distances of the narrow ones, {place: (number, distance)})."""
    rows, order = centroids.rows, np.array(centroids.order)
    clipped = np.array([[max(-FAR, min(FAR, x)) for x in c] for c in rows], dtype=np.int64)
    fast = any(max(map(abs, c)) <= NARROW for c in rows)

    def assign(narrow, wide):
        found = {i: _nearest_wide(p, rows, centroids.order) for i, p in wide.items()}
        if fast or not len(narrow):
            return nearest(narrow, clipped, order) if len(narrow) else (np.zeros(0, int), np.zeros(0, int)), found
        pairs = [_nearest_wide(tuple(map(int, p)), rows, centroids.order) for p in narrow]
        return (np.array([n for n, _ in pairs]), np.array([min(d, LARGEST) for _, d in pairs], dtype=np.int64)), found

    return assign


def _limbs(total: int):
    """(place, piece with the total's sign) for the pieces of a whole number that are not zero."""
    sign, rest, place = (-1 if total < 0 else 1), abs(total), 0
    while rest:
        if piece := rest & ((1 << LIMB_BITS) - 1):
            yield place, sign * piece
        rest, place = rest >> LIMB_BITS, place + 1


def _sums(centroids: Centroids, scale: int):
    """Arrow function: vectors to the sums of their components by cluster; dimension -1 counts the vectors."""

    def run(batches):
        assign, k = _assigner(centroids), len(centroids.rows)
        counts, totals, rare = np.zeros(k, dtype=np.int64), np.zeros((k, len(centroids.order)), dtype=np.int64), {}
        for batch in batches:
            for _, narrow, _, wide in _slabs(batch.column(0), scale):
                (number, _), found = assign(narrow, wide)
                counts += np.bincount(number, minlength=k)
                totals += (np.arange(k)[:, None] == number).astype(np.int64) @ narrow
                for i, (n, _) in found.items():
                    counts[n] += 1
                    rare[n] = [a + b for a, b in zip(rare.get(n, [0] * len(wide[i])), wide[i])]
        out = []
        for n in range(k):
            whole = [int(a) + b for a, b in zip(totals[n], rare.get(n, [0] * totals.shape[1]))]
            out += [(n, d, place, piece) for d, total in [(-1, int(counts[n])), *enumerate(whole)] for place, piece in _limbs(total)]
        columns = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["cluster", "dimension", "place", "piece"])

    return run


def _spread(dimensions: int, scale: int):
    """Arrow function: vectors to count, sum and sum of squares of every dimension."""

    def run(batches):
        n, s, q = 0, np.zeros(dimensions), np.zeros(dimensions)
        for batch in batches:
            values = np.clip(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions) * scale, -FAR, FAR)
            n, s, q = n + len(values), s + values.sum(axis=0), q + (values**2).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dimensions), type=pa.int64()), pa.array([n] * dimensions, type=pa.int64()), pa.array(s), pa.array(q)], names=["dimension", "n", "s", "q"]
        )

    return run


def fit_centroids(
    vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> Centroids:
    """The centroids of all usable vectors after `rounds` rounds of assignment and exact floored means.

    Components count as floor(scale * x).  The first centroids are the k vectors with the smallest
    SHA-256 of `1:<id>` (vectors without an id last, of equal ids those with smaller components
    first); fewer vectors give fewer centroids, none gives none.  Empty clusters keep their centroid.
    A round reads the vectors once and shuffles one partial sum per task, cluster and dimension; only
    the sums over all of them, k * dimensions numbers, reach the driver.
    """
    kept = vectors.filter(usable(vector_col, dimensions)).select(F.col(id_col).cast("string").alias("i"), F.col(vector_col).cast("array<double>").alias("v"))
    first = kept.orderBy(F.sha2(F.concat(F.lit("1:"), "i"), 256).asc_nulls_last(), "v").limit(k).collect()
    rows = tuple(tuple(_whole(x, scale) for x in r["v"]) for r in first)
    if not rows:
        return Centroids((), tuple(range(dimensions)))
    spread = kept.select("v").mapInArrow(_spread(dimensions, scale), "dimension bigint, n bigint, s double, q double")
    parts = sorted(tuple(r) for r in spread.groupBy("dimension").agg(F.sum("n"), F.sum("s"), F.sum("q")).collect())
    centroids = Centroids(rows, tuple(d for d, n, s, q in sorted(parts, key=lambda r: (-(r[3] / r[1] - (r[2] / r[1]) ** 2), r[0]))))
    for _ in range(rounds):
        sums = kept.select("v").mapInArrow(_sums(centroids, scale), "cluster bigint, dimension bigint, place bigint, piece bigint")
        totals: dict[tuple[int, int], int] = {}
        for n, d, place, piece in sums.groupBy("cluster", "dimension", "place").agg(F.sum("piece")).collect():
            totals[n, d] = totals.get((n, d), 0) + (piece << (LIMB_BITS * place))
        moved = [
            tuple(totals.get((n, d), 0) // count for d in range(dimensions)) if (count := totals.get((n, -1), 0)) else old
            for n, old in enumerate(centroids.rows)
        ]
        centroids = Centroids(tuple(moved), centroids.order)
    return centroids


def assign_clusters(vectors: DataFrame, centroids: Centroids, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, cluster int, distance bigint: the nearest centroid of every usable vector.

    Distances are squared and in scaled units; one beyond the range of a bigint is given as its
    largest value.  Rows that are repeated stay repeated.  Without centroids the result is empty.
    """

    def run(batches):
        assign = _assigner(centroids)
        for batch in batches:
            number, distance = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows, dtype=np.int64)
            for at, narrow, places, wide in _slabs(batch.column(1), scale):
                (number[at + places], distance[at + places]), found = assign(narrow, wide)
                for i, (n, d) in found.items():
                    number[at + i], distance[at + i] = n, min(d, LARGEST)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number), pa.array(distance)], names=[id_col, "cluster", "distance"])

    kept = vectors.filter(usable(vector_col, len(centroids.order)) & F.lit(bool(centroids.rows)))
    kind = vectors.schema[id_col].dataType.simpleString()
    return kept.select(F.col(id_col), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, f"`{id_col}` {kind}, cluster int, distance bigint")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of every vector with 64 finite components.

    Vectors of another length, without a value, or with a null or non-finite component are left out;
    null ids are kept.  No usable vectors give no rows.
    """
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    centroids = fit_centroids(vectors)
    found = cut(assign_clusters(vectors, centroids))
    # One row per centroid at most: its inertia and digest.
    inertia = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    whole = min(LARGEST, sum(inertia.values()))
    table = [(n, min(LARGEST, inertia[n]), whole, d) for n, d in enumerate(centroids.digests()) if n in inertia]
    about = spark.createDataFrame(table, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    rounds = "".join(
        f"""
), a{r} AS (
  SELECT i, v, any_value(vec_id) AS vec_id, min(d * {CENTROIDS} + c) AS m FROM (
    SELECT k.i, k.v, k.vec_id, c.c, list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept k CROSS JOIN c{r} c
  ) GROUP BY i, v
), c{r + 1} AS (
  SELECT c.c, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM (
      SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT m % {CENTROIDS} AS c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{r}) GROUP BY c, j
    ) GROUP BY c
  ) n ON n.c = c.c"""
        for r in range(ROUNDS)
    )
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, CAST(v AS HUGEINT[]) AS v FROM (
    SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {CENTROIDS}
  ){rounds}
), last AS (
  SELECT vec_id, min(d * {CENTROIDS} + c) AS m FROM (
    SELECT k.i, k.vec_id, c.c, list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept k CROSS JOIN c{ROUNDS} c
  ) GROUP BY i, vec_id
), done AS (
  SELECT vec_id, CAST(m % {CENTROIDS} AS INTEGER) AS cluster, CAST(m // {CENTROIDS} AS BIGINT) AS distance FROM last
)
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256
FROM done JOIN c{ROUNDS} ON c{ROUNDS}.c = done.cluster
"""


OP11_SQL = _sql()
