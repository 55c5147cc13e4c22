"""Centroid clustering by sort-means, exact in integers.

Each round orders, for every centroid, the other centroids by their distance from it. A vector
first measures its distance d to the centroid it was assigned to, then takes the others in that
centroid's order and stops at the first that lies strictly beyond 2 d of it: by the triangle
inequality no centroid from there on is nearer than d, nor as near. Squared distances are
integers, so "beyond" is D > 4 d without rounding, and ties go to the smaller number.

Vectors stay in blocks (ids, a matrix, the assignment), one for each Arrow batch, and never move
between tasks: a round maps the blocks and adds up k sums. The centroids, k times the number of
components, are all that goes through the driver. The blocks of the last round are persisted
and not checkpointed, as a lost block is computed again from the source and the centroids so far.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ensolith.lineage import cut
from ensolith.llm.textops import give_back_memory

LARGEST = 1 << 63
_BLOCK = "ids array<long>, body binary, assigned binary, distance binary, sums array<array<long>>"
_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("body", pa.binary()), ("assigned", pa.binary()), ("distance", pa.binary()), ("sums", pa.list_(pa.list_(pa.int64())))])


def integer_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): floor(scale * x) of the vectors with exactly ``dims`` finite components.

    A vector with a component beyond 2^27 after scaling is left out as well: squared distances
    would not fit in 64 bits.
    """
    x = F.col(vector_col).cast("array<double>")
    fine = F.coalesce((F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < (1 << 27))), F.lit(False))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("int")).alias("v"))


def nearest(x: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(numbers, squared distances, distances computed) of the nearest centroids, scanned from the assignment before."""
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(apart + np.where(np.eye(len(centroids), dtype=bool), -1, 0), axis=1, kind="stable")
    square = lambda rows, numbers: ((x[rows] - centroids[numbers]) ** 2).sum(axis=1)
    rows = np.arange(len(x))
    first = square(rows, before)
    best, number, computed = first.copy(), before.astype(np.int64), len(x)
    for place in range(1, len(centroids)):
        other = order[before[rows], place]
        near = apart[before[rows], other] <= 4 * first[rows]
        rows, other = rows[near], other[near]
        if not len(rows):
            break
        d = square(rows, other)
        computed += len(rows)
        better = (d < best[rows]) | ((d == best[rows]) & (other < number[rows]))
        best[rows[better]], number[rows[better]] = d[better], other[better]
    return number, best, computed


def _sums(x: np.ndarray, number: np.ndarray, distance: np.ndarray, k: int) -> list[list[int]]:
    """For each cluster: vectors, their distances (in units of 2^31 and the rest), their sums by component."""
    out = []
    for c in range(k):
        own = number == c
        out.append([int(own.sum()), int((distance[own] >> 31).sum()), int((distance[own] & (2**31 - 1)).sum()), *x[own].sum(axis=0).tolist()])
    return out


def _round(dims: int, centroids: list[list[int]], last: bool):
    """A map over batches of vectors or blocks to blocks assigned to the centroids; of the last round without the vectors."""
    points = np.array(centroids, np.int64).reshape(-1, dims)

    def one(ids, x, before):
        number, distance, _ = nearest(x, before, points)
        body = None if last else x.astype(np.int32).tobytes()
        return pa.RecordBatch.from_pylist([{"ids": ids, "body": body, "assigned": number.astype(np.int32).tobytes(), "distance": distance.tobytes() if last else None, "sums": _sums(x, number, distance, len(points))}], _ARROW)

    def run(batches):
        for batch in batches:
            if batch.schema.names[0] == "id":
                if batch.num_rows:
                    x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)
                    yield one(batch.column("id").to_pylist(), x, np.zeros(len(x), np.int64))
            else:
                for r in batch.select(["ids", "body", "assigned"]).to_pylist():
                    yield one(r["ids"], np.frombuffer(r["body"], np.int32).reshape(-1, dims).astype(np.int64), np.frombuffer(r["assigned"], np.int32))
        give_back_memory()

    return run


def _totals(blocks: DataFrame, k: int) -> list[list[int]]:
    """The sums of all blocks: k rows of exact integers."""
    places = blocks.select(F.posexplode("sums").alias("cluster", "s")).select("cluster", F.posexplode("s").alias("at", "x"))
    found = places.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    out: list[dict[int, int]] = [{} for _ in range(k)]
    for r in found:
        out[r["cluster"]][r["at"]] = int(r["x"])
    return [[row[p] for p in sorted(row)] for row in out]


def sort_means(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(assigned vectors, final centroids): (id, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256) for every vector kept.

    Centroids start as the k kept vectors of the smallest sha256 of ``<seed>:<id>`` (rows without
    an id are no such vectors but are assigned; of rows that share an id the smaller vector
    comes first). Each round assigns all vectors, then moves every centroid that has some to the
    floor of their mean; at the end they are assigned once more. With fewer than k vectors there
    are fewer centroids (if no vector has an id, the one centroid is zero), with none no rows. Repeated rows count as often as they stand. Other
    columns are ignored. An inertia beyond 64 bits is given as the largest long.
    """
    kept = integer_vectors(vectors, dims, scale, id_col, vector_col)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    centroids = [r["v"] for r in kept.where("id is not null").orderBy(name, "id", "v").limit(k).collect()]  # k rows
    many = len(centroids)
    if not many:
        centroids, many = [[0] * dims], 1
    state, persisted = kept, None
    for _ in range(rounds):
        state = state.mapInArrow(_round(dims, centroids, False), _BLOCK).persist(StorageLevel.MEMORY_AND_DISK)
        totals = _totals(state, many)
        centroids = [[s // t[0] for s in t[3:]] if t and t[0] else c for c, t in zip(centroids, totals)]
        if persisted is not None:
            persisted.unpersist()
        persisted = state
    done = cut(state.mapInArrow(_round(dims, centroids, True), _BLOCK))
    if persisted is not None:
        persisted.unpersist()
    inertia = [(t[1] << 31) + t[2] if t else 0 for t in _totals(done, many)]
    whole = min(sum(inertia), LARGEST - 1)
    inertia = [min(x, LARGEST - 1) for x in inertia]
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def rows(batches):
        for batch in batches:
            for r in batch.to_pylist():
                number = np.frombuffer(r["assigned"], np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["ids"], pa.int64()), pa.array(number), pa.array(np.frombuffer(r["distance"], np.int64)), pa.array(inertia, pa.int64()).take(pa.array(number)), pa.array(np.full(len(number), whole, np.int64)), pa.array(prints).take(pa.array(number))],
                    names=[id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return done.select("ids", "assigned", "distance").mapInArrow(rows, f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"), centroids


def oracle(k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024) -> str:
    """DuckDB SQL for the rows of ``sort_means``, every vector against every centroid."""
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings WHERE len(embedding) = {dims} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m FROM (SELECT v, sha256('{seed}:' || vec_id) AS h FROM v ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(f"d{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min((list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v, m)]), c)) AS b FROM v, c{r} GROUP BY vec_id)")
        if r < rounds:
            parts.append(f"e{r} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT b[2] AS c, unnest(v) AS x, unnest(range({dims})) AS i FROM d{r}) GROUP BY c, i)")
            parts.append(f"f{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM e{r} GROUP BY c)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(f{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN f{r} USING (c))")
    return f"WITH {', '.join(parts)} SELECT vec_id, CAST(b[2] AS INTEGER) AS cluster, CAST(b[1] AS BIGINT) AS distance, CAST(sum(b[1]) OVER (PARTITION BY b[2]) AS BIGINT) AS cluster_inertia, CAST(sum(b[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM d{rounds} JOIN c{rounds} ON b[2] = c"
