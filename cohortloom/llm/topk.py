"""Exact top-k search by a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it: (pivot, ring) is an annulus, stored in blocks of bounded size. For a
query q at distance d from a pivot, every vector x of the ring [lo, hi] is at least max(0, d - hi, lo - d) away, and since
2 q.x = |q|^2 + |x|^2 - |q - x|^2, that bounds the inner products of the whole annulus. Queries expand the annuli in order of that bound,
in waves; after each wave the k-th score so far closes every annulus whose bound lies below it. What is opened is scored
exactly with whole numbers, so the result is exact whatever the pivots are; they only decide how much is opened.

The annuli's directory (at most ``pivots * rings`` entries) is all that tasks share. Requests go to the blocks; many copies of one
vector fill several blocks of one annulus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.texts import Key
from cohortloom.session import cut_lineage

K = 20
SCALE = 64
SAMPLE = 4096
PIVOTS = 32
RINGS = 32
BLOCK = 2048
QUERIES = 256
WAVES = (1, 8, None)  # annuli that are expanded by the end of each wave


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part: an id, no null and no non-finite component."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))  # NaN is above infinity
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & fine)


def whole(column: pa.Array, dims: int) -> np.ndarray:
    """floor(64 x) of every component, as doubles; shorter vectors end in zeros."""
    counts = np.diff(column.offsets.to_numpy())
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False))
    out = np.zeros((len(counts), dims))
    out[np.repeat(np.arange(len(counts)), counts), np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
    return out


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0))


def choose_pivots(sample: np.ndarray, many: int, rounds: int = 4) -> np.ndarray:
    """Farthest-first start and a few rounds of means; equal vectors count once."""
    sample = np.unique(sample, axis=0)
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen = [0]
    far = distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(many, len(sample)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(sample, sample[chosen[-1:]])[:, 0])
    centers = sample[chosen]
    for _ in range(rounds):
        near = distances(sample, centers).argmin(axis=1)
        centers = np.stack([sample[near == k].mean(axis=0) if (near == k).any() else c for k, c in enumerate(centers)])
    return centers


def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 2048):
            yield b.slice(i, 2048)


def search(embeddings: DataFrame, k: int = K, every: int = 20, max_pivots: int = PIVOTS, max_rings: int = RINGS, block: int = BLOCK,
           sample_rows: int = SAMPLE, waves=WAVES, watch: list[tuple[int, int]] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of every query (rows whose id ``every`` divides).

    Null vectors, null ids and vectors with a null or non-finite component take no part; shorter vectors count as ending in zeros.
    An error is raised if components are so large that a score might not fit a long (dimensions x (64 x)^2 of 2^63 and more). Ties go to the smaller vec_id. Rows that repeat a query's id are its own row and no candidate
    of it; other repeated rows are candidates each. Of query rows with one id, each different vector is searched and ranked
    together. An empty table gives no rows; columns other than vec_id and embedding are not read.
    """
    rows = usable(embeddings)
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    n, dims = size["n"], max(1, size["dims"] or 0)
    bound = int(SCALE * (size["most"] or 0)) + 1
    if bound * bound * dims >= 1 << 63:
        raise OverflowError(f"scores of {dims} components up to {bound} do not fit a long")
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if bound < np.iinfo(t).max)
    exact = bound * bound * dims < 2**52  # products of doubles are then exact, else whole numbers are multiplied
    take = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 20)) < int(min(1.0, 0.9 * sample_rows / max(n, 1)) * (1 << 20))
    sample = rows.where(take).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").toArrow().combine_chunks()
    sample = whole(sample.column("v").combine_chunks() if sample.num_rows else pa.array([], pa.list_(pa.float64())), dims)
    pivots = choose_pivots(sample, int(np.clip(np.sqrt(n) / 4, 1, max_pivots)))
    rings = int(np.clip(n / (len(pivots) * 512), 1, max_rings))
    near = distances(sample, pivots)
    home = near.argmin(axis=1) if len(sample) else np.zeros(0, int)
    edges = [np.unique(np.quantile(near[home == p, p], np.linspace(0, 1, rings + 1)[1:-1])) if (home == p).any() else np.zeros(0) for p in range(len(pivots))]

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in spread(batches):
            x = whole(b.column("v"), dims)
            d = distances(x, pivots)
            p = d.argmin(axis=1)
            own = d[np.arange(len(x)), p]
            ring = np.fromiter((np.searchsorted(edges[i], v) for i, v in zip(p, own)), np.int64, len(x))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(p * max_rings + ring), pa.array(own), pa.array((x * x).sum(axis=1)),
                                              pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())], ["vec_id", "annulus", "distance", "square", "v"])

    located = cut_lineage(rows.mapInArrow(locate, "vec_id long, annulus long, distance double, square double, v binary"))
    found = located.groupBy("annulus").agg(F.count("*").alias("n"), F.min("distance").alias("lo"), F.max("distance").alias("hi"), F.max("square").alias("square")).collect()
    found.sort()
    annulus, many, low, high, square = (np.array([r[i] for r in found], t) for i, t in enumerate((np.int64, np.int64, float, float, float)))
    chunks = -(-many // block)
    # The directory is bounded by pivots * rings entries; the number of blocks of an annulus is looked up in it.
    parts = F.create_map(*[x for a, c in zip(annulus.tolist(), chunks.tolist()) for x in (F.lit(a), F.lit(c))]) if len(found) else F.create_map(F.lit(0).cast("long"), F.lit(1))
    salted = located.withColumn("block", F.col("annulus") * F.lit(1 << 32) + F.pmod(F.xxhash64("vec_id", F.lit(9)), F.element_at(parts, F.col("annulus"))))

    def pack(key: Key, table: pa.Table) -> pa.Table:
        return pa.table([pa.array([key[0].as_py()]), pa.array([table.column("vec_id").to_numpy().tobytes()]), pa.array([b"".join(table.column("v").to_pylist())])], names=["block", "ids", "matrix"])

    index = cut_lineage(salted.select("block", "vec_id", "v").groupBy("block").applyInArrow(pack, "block long, ids binary, matrix binary"))
    asked = located.where(F.col("vec_id") % every == 0).select("vec_id", "v", "annulus").distinct()
    asked = cut_lineage(asked)
    groups = max(1, -(-asked.count() // QUERIES))
    # Neighbours ask for the same blocks: queries are dealt by pivot, and by id within it.
    asked = asked.select("vec_id", "v", F.pmod(F.xxhash64(F.floor(F.col("annulus") / max_rings), F.pmod(F.xxhash64("vec_id"), F.lit(max(1, groups // len(pivots))))), F.lit(groups)).alias("block"))
    queries = cut_lineage(asked.groupBy("block").applyInArrow(pack, "block long, ids binary, matrix binary"))
    shares = max(1, groups // 64)

    def vectors(data: bytes) -> np.ndarray:
        return np.frombuffer(data, kind).reshape(-1, dims)

    def open_blocks(first: int, last: int | None, skip_first: bool):
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    group, ids, matrix, known = (batch.column(c)[r].as_py() for c in ("block", "ids", "matrix", "least"))
                    ids, x = np.frombuffer(ids, np.int64), vectors(matrix)
                    least = np.full(len(ids), -np.inf)
                    for e in known or []:
                        least[e["place"]] = np.nextafter(float(e["score"]), -np.inf)  # a long may lie between two doubles
                    q = x.astype(float)
                    d, own = distances(q, pivots)[:, annulus // max_rings], (q * q).sum(axis=1)[:, None]
                    # Distances and bounds are rounded, in proportion to the lengths: the slack covers that.
                    away = np.maximum(0, np.maximum(d - high, low - d) - 1e-6 * (1 + d) - 2e-7 * (np.sqrt(own) + np.sqrt(square)))
                    most = np.minimum((own + square - away**2) / 2, np.sqrt(own * square)) + 1e-9 * (own + square) + 1e-3
                    order = np.argsort(-most, axis=1, kind="stable")
                    rank = np.argsort(order, axis=1)
                    opened = (rank >= first) & (rank < (len(annulus) if last is None else last)) & (most >= least[:, None])
                    for a in np.flatnonzero(opened.any(axis=0)):
                        for c in range(int(chunks[a]) if last != 1 else 1):
                            need = opened[:, a] & ~((rank[:, a] == 0) & (c == 0)) if skip_first else opened[:, a]
                            if need.any():
                                yield pa.RecordBatch.from_arrays([pa.array([int(annulus[a]) << 32 | c]), pa.array([group % shares]), pa.array([group]), pa.array([np.flatnonzero(need).tobytes()]),
                                                                  pa.array([ids[need].tobytes()]), pa.array([x[need].tobytes()]), pa.array([least[need].tobytes()])],
                                                                 ["block", "share", "asked_by", "place", "query", "x", "least"])
        return ask

    def score(key: Key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            ids, y = np.frombuffer(left.column("ids")[0].as_py(), np.int64), vectors(left.column("matrix")[0].as_py())
            by_id = np.argsort(ids, kind="stable")
            ids, y = ids[by_id], y[by_id].astype(float if exact else np.int64)
            for r in right.to_pylist():
                query, place, least = np.frombuffer(r["query"], np.int64), np.frombuffer(r["place"], np.int64), np.frombuffer(r["least"], float)
                points = vectors(r["x"]).astype(y.dtype) @ y.T
                for i in range(len(query)):
                    good = np.flatnonzero((points[i] >= least[i]) & (ids != query[i]))
                    good = good[np.argsort(-points[i][good], kind="stable")[:k]]  # ids rise, so ties go to the smaller
                    out.append((r["asked_by"], int(place[i]), int(query[i]), ids[good], points[i][good].astype(np.int64)))
        sizes = [len(o[3]) for o in out]
        flat = lambda j, t: np.repeat(np.array([o[j] for o in out], t), sizes) if out else np.zeros(0, t)
        both = lambda j: np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64)
        return pa.table([flat(0, np.int64), flat(1, np.int32), flat(2, np.int64), both(3), both(4)], names=["asked_by", "place", "query_id", "vec_id", "score"])

    best, begin = None, 0
    best_first = Window.partitionBy("asked_by", "place").orderBy(F.desc("score"), "vec_id")
    for end in waves:
        if best is None:
            with_least = queries.withColumn("least", F.lit(None).cast("array<struct<place:int,score:bigint>>"))
        else:
            closed = best.groupBy("asked_by", "place").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") >= k)
            closed = closed.groupBy(F.col("asked_by").alias("block")).agg(F.collect_list(F.struct("place", "score")).alias("least"))  # at most the queries of a group
            with_least = queries.join(closed, "block", "left")
        requests = with_least.mapInArrow(open_blocks(begin if begin > 1 else 0, end, begin == 1), "block long, share long, asked_by long, place binary, query binary, x binary, least binary")
        # A block is copied to the shares that ask for it, and to no others.
        requests = cut_lineage(requests)
        if watch is not None:
            count = index.select("block", (F.length("ids") / 8).alias("n"))
            pairs = requests.join(count, "block").agg(F.sum(F.length("query") / 8 * F.col("n")).cast("long")).first()[0]
            watch.append((pairs or 0, n * queries.agg(F.sum(F.length("ids") / 8).cast("long")).first()[0]))
        wanted = requests.select(F.col("block").alias("_b"), F.col("share").alias("_s")).distinct()
        copies = index.join(wanted, F.col("block") == F.col("_b")).drop("block")
        hits = copies.groupBy("_b", "_s").cogroup(requests.groupBy("block", "share")).applyInArrow(score, "asked_by long, place int, query_id long, vec_id long, score long")
        hits = hits if best is None else best.unionByName(hits)
        best = cut_lineage(hits.withColumn("_r", F.row_number().over(best_first)).where(F.col("_r") <= k).drop("_r"))
        begin = end
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM good q JOIN good c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 20
"""


def op1_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors, by whole inner product, of every twentieth vector."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
