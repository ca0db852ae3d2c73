"""Centroid clustering in exact integers.

Vectors are turned into integers once and kept as blocks in the shared folder. Each round
every block works out |x|^2 - 2 x.c + |c|^2 for all centroids in one matrix product. In
float64 this is exact as long as no sum on the way reaches 2^53, which the lengths of a
block's longest vector and the longest centroid bound; where they don't, the block takes
64-bit integers, and where these could overflow Python's own. treeAggregate adds up the
blocks' sums, whose size depends on the clusters alone, so that the driver holds clusters
times components numbers. A lost executor's blocks are read again from the folder.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table

#: Contract of the query: components, clusters, rounds, and what a component is multiplied with.
DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 40, 5, 256
#: Vectors in a block; 4 MB of integers.
BLOCK_ROWS = 8192
_EXACT, _LONG = 1 << 53, (1 << 63) - 1


@dataclass
class Block:
    """ids and integers (n, components) of a block; longest bounds the length of its vectors from above."""

    ids: np.ndarray
    present: np.ndarray
    values: np.ndarray
    longest: int


def _above(squared: int) -> int:
    """A whole number not below the root of squared."""
    return math.isqrt(squared) + 1


def whole_components(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite doubles: 64-bit integers, or Python's where they don't fit."""
    if not len(vectors) or np.abs(vectors).max() < 2.0**62 / scale:
        return np.floor(vectors * float(scale)).astype(np.int64)
    #: A double from 2^53 on is whole, and is multiplied as such.
    return np.array([[int(x) * scale if abs(x) >= _EXACT else math.floor(x * scale) for x in row] for row in vectors.tolist()], object)


def _pack(values: np.ndarray) -> tuple[bytes, bool]:
    if values.dtype != object:
        return values.astype("<i8").tobytes(), False
    return ",".join(str(x) for x in values.ravel()).encode(), True


def _unpack(ids: bytes, present: bytes, data: bytes, wide: bool, longest: bytes, dim: int) -> Block:
    flat = np.array([int(x) for x in data.split(b",")], object) if wide else np.frombuffer(data, "<i8")
    return Block(np.frombuffer(ids, "<i8"), np.frombuffer(present, bool), flat.reshape(-1, dim), int(longest))


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Batches of (id, vector) as blocks of integers; vectors of another length or with null or non-finite components go."""
    for batch in batches:
        column = batch.column(1)
        lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        taken = np.flatnonzero(lengths == dim)
        if not len(taken):
            continue
        flat = column.take(pa.array(taken)).flatten().cast(pa.float64())
        values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
        finite = np.isfinite(values).all(axis=1)
        taken, values = taken[finite], values[finite]
        ids = batch.column(0).take(pa.array(taken))
        present, numbers = np.asarray(ids.is_valid()), ids.fill_null(0).to_numpy(zero_copy_only=False)
        for lo in range(0, len(taken), BLOCK_ROWS):
            part = slice(lo, lo + BLOCK_ROWS)
            whole = whole_components(values[part], scale)
            data, wide = _pack(whole)
            most = sum(int(x) ** 2 for x in np.abs(whole).max(axis=0).tolist())
            row = [numbers[part].astype("<i8").tobytes(), present[part].tobytes(), data, wide, str(_above(most)).encode()]
            kinds = (pa.binary(), pa.binary(), pa.binary(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["ids", "present", "data", "wide", "longest"])


_BLOCK = "ids binary, present binary, data binary, wide boolean, longest binary"


def distances(block: Block, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (n, centroids), exact: doubles, 64-bit integers or Python's, as the bounds ask."""
    squares = [sum(int(x) ** 2 for x in c) for c in centroids.tolist()]
    bound = (block.longest + _above(max(squares))) ** 2
    if bound < _EXACT:
        x, c = block.values.astype(np.float64), centroids.astype(np.float64)
    elif bound <= _LONG:
        x, c = block.values.astype(np.int64), centroids.astype(np.int64)
    else:
        x, c = block.values.astype(object), centroids.astype(object)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + np.array(squares, dtype=x.dtype)[None, :]


def _assigned(block: Block, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of a block's vectors; of equally near ones the first."""
    d = distances(block, centroids)
    nearest = np.asarray(d.argmin(axis=1), np.int64)
    return nearest, d[np.arange(len(d)), nearest]


def _sums(block: Block, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums of components, counts, summed distances) by centroid, in Python's integers."""
    nearest, distance = _assigned(block, centroids)
    k, order = len(centroids), np.argsort(nearest, kind="stable")
    counts = np.bincount(nearest, minlength=k)
    sums, far = np.zeros((k, block.values.shape[1]), object), np.zeros(k, object)
    #: A block's sums are below rows times the longest length, and 64 bits hold them unless vectors are wide.
    narrow = block.values.dtype != object and len(order) * block.longest <= _LONG
    values = (block.values if narrow else block.values.astype(object))[order]
    exact = distance.dtype != object and len(order) * int(distance.max()) <= _LONG
    distance = (distance.astype(np.int64) if exact else np.array([int(x) for x in distance], object))[order]
    ends = np.cumsum(counts)
    for c in np.flatnonzero(counts):
        own = slice(ends[c] - counts[c], ends[c])
        sums[c] = [int(x) for x in values[own].sum(axis=0)]
        far[c] = int(distance[own].sum())
    return sums, counts.astype(object), far


def _floor_means(centroids: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    moved = [[int(s) // int(n) for s in row] if n else [int(x) for x in old] for row, n, old in zip(sums, counts, centroids.tolist(), strict=True)]
    return narrowed(moved)


def narrowed(rows: list[list[int]]) -> np.ndarray:
    """Centroids as 64-bit integers where they fit with room for a product's sign."""
    fits = all(abs(x) < 1 << 62 for row in rows for x in row)
    return np.array(rows, np.int64 if fits else object).reshape(len(rows), -1)


def _first_centroids(vectors: DataFrame, seed: str, clusters: int, dim: int, scale: int) -> np.ndarray:
    """The vectors whose id has the smallest hash; equal ids in order of their components."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.where((F.size("vector") == dim) & finite)
    order = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.select(order.alias("order"), "vector").orderBy("order", "vector").limit(clusters).collect()
    if not rows:
        return np.zeros((0, dim), np.int64)
    whole = whole_components(np.array([r["vector"] for r in rows], np.float64).reshape(-1, dim), scale)
    return narrowed([[int(x) for x in row] for row in whole.tolist()])


def cluster(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIMENSIONS, scale: int = SCALE, seed: str = "2:"
) -> tuple[DataFrame, np.ndarray]:
    """(a row per vector, the centroids).

    Rows are vec_id long, cluster int, distance long, cluster_inertia long, inertia long
    and centroid_sha256 string. Vectors that are null, of another length, or hold null or
    non-finite components take no part; without any there are no rows. Fewer vectors than
    clusters give a cluster each. Rows without an id and repeated rows count as any
    other. A figure beyond 64 bits is null; assignments and centroids are exact even then.
    """
    spark = vectors.sparkSession
    named = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector_column}`").cast("array<double>").alias("vector"))
    centroids = _first_centroids(named, seed, clusters, dim, scale)
    if not len(centroids):
        return spark.createDataFrame([], _RESULT), centroids
    blocks = stage_table(named.mapInArrow(lambda batches: _blocks(batches, dim, scale), _BLOCK), "blocks")

    def gathered(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sent = spark.sparkContext.broadcast(centroids)
        k = len(centroids)
        nothing = (np.zeros((k, dim), object), np.zeros(k, object), np.zeros(k, object))
        add = lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2])
        rows = blocks.rdd.map(lambda r: _unpack(bytes(r[0]), bytes(r[1]), bytes(r[2]), r[3], bytes(r[4]), dim))
        found = rows.treeAggregate(nothing, lambda acc, b: add(acc, _sums(b, sent.value)), add, 2)
        sent.unpersist()
        return found

    for _ in range(rounds):
        sums, counts, _far = gathered(centroids)
        centroids = _floor_means(centroids, sums, counts)
    far = [int(x) for x in gathered(centroids)[2]]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return blocks.mapInArrow(lambda batches: _placed(batches, centroids, far, names, dim), _RESULT), centroids


_RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _long(x: int) -> int | None:
    return int(x) if x <= _LONG else None


def _placed(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, far: list[int], names: list[str], dim: int) -> Iterator[pa.RecordBatch]:
    inertia, own = _long(sum(far)), [_long(x) for x in far]
    for batch in batches:
        for row in batch.to_pylist():
            block = _unpack(row["ids"], row["present"], row["data"], row["wide"], row["longest"], dim)
            nearest, distance = _assigned(block, centroids)
            n = len(nearest)
            columns = [
                pa.array(block.ids, pa.int64(), mask=~block.present), pa.array(nearest.astype(np.int32)), pa.array([_long(x) for x in distance.tolist()], pa.int64()),
                pa.array([own[c] for c in nearest], pa.int64()), pa.array([inertia] * n, pa.int64()), pa.array([names[c] for c in nearest], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _RESULT.split(", ")])


def clustering_sql(table: str = "embeddings", clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIMENSIONS, scale: int = SCALE) -> str:
    """DuckDB SQL of the same rows, with the distance as a plain sum of squared differences."""
    parts = [
        f"k AS (SELECT row_number() OVER () AS r, vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS HUGEINT) FOR x IN embedding] AS q FROM {table}"
        f" WHERE len(embedding) = {dim} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {dim})",
        "e AS (SELECT r, p.i, q[p.i] AS x FROM k, (SELECT unnest(range(1, " + str(dim + 1) + ")) AS i) p)",
        f"o AS (SELECT q, row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) - 1 AS c FROM k QUALIFY c < {clusters})",
        f"c0 AS (SELECT c, p.i, q[p.i] AS m FROM o, (SELECT unnest(range(1, {dim + 1})) AS i) p)",
    ]
    for t in range(rounds + 1):
        parts.append(f"d{t} AS (SELECT r, c, sum((x - m) * (x - m)) AS d FROM e JOIN c{t} USING (i) GROUP BY r, c)")
        parts.append(f"a{t} AS (SELECT r, c, d FROM d{t} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if t < rounds:
            parts.append(f"n{t} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{t} JOIN e USING (r) GROUP BY c, i)")
            parts.append(f"c{t + 1} AS (SELECT c, i, CASE WHEN n IS NULL THEN m ELSE (s - ((s % n) + n) % n) // n END AS m FROM c{t} LEFT JOIN n{t} USING (c, i))")
    last = rounds
    parts.append(f"h AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY c)")
    return (
        f"WITH {', '.join(p.replace(' AS (', ' AS MATERIALIZED (', 1) for p in parts)} SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{last} JOIN k USING (r) JOIN h USING (c)"
    )
