"""Approximate nearest neighbours by a permutation index.

Pivots are vectors of a sample. Every vector is represented by its pivots in order of nearness (the first ``prefix`` of them) and posted
in the inverted files of its ``lists`` nearest pivots. A query opens the files of its own nearest pivots; postings are ranked by the
footrule distance between the two orders, and those within a radius, and in any case the best of every block, are reranked by
their true distance.

How many files a query opens and the radius are fitted on the sample, where the true neighbours are known: both are the quantile
``recall`` over neighbours in the sample. Neighbours in the whole table are nearer than those in a sample of it, so the whole table's
recall lies above. On vectors without structure (the given ones fill the sphere evenly) that opens most files; on clustered vectors few.
Both hold for queries that lie among the pivots as the sample does. A query farther from them (its second nearest pivot is beyond the same
quantile of the sample's) sees all pivots from one side, so their order says little: it opens all files and reranks all postings.

Equal vectors are one posting with their least ids, so a crowd of copies costs nothing. Postings of a file are cut into blocks of bounded
size, and a block is copied only to the groups of queries that ask for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm.texts import Key
from cohortloom.llm.topk import distances
from cohortloom.session import cut_lineage, local_table

K = 10
SAMPLE = 4096
PIVOTS = 1024
PREFIX = 256
LISTS = 2
BLOCK = 2048
GROUP = 256  # queries that travel together
SHARE = 64  # groups that one copy of a block serves
RECALL = 0.98
CALIBRATION = 256
COPIES = 4096  # query rows with one vector that travel as one row


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) of the different rows that take part: an id, no null or non-finite component, not all zero; -0 counts as 0."""
    v = F.transform("embedding", lambda x: x + F.lit(0).cast("float"))
    far = F.lit(float("inf"))
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < far)) & F.exists(v, lambda x: x != 0)  # NaN is above infinity
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & fine).dropDuplicates()


def name_of(v: Column) -> list[Column]:
    """128 bits that stand for a vector in joins."""
    return [F.xxhash64(F.lit(1), v).alias("h1"), F.xxhash64(F.lit(2), v).alias("h2")]


def matrix(column: pa.Array, dims: int, kind) -> np.ndarray:
    """Rows of a list column; shorter vectors end in zeros."""
    counts = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(counts), dims), kind)
    out[np.repeat(np.arange(len(counts)), counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of every row, nearest first; ties go to the smaller number."""
    return np.argsort(distances(x.astype(float), pivots), axis=1, kind="stable")[:, :prefix].astype(np.uint16)


def apart(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of every row to its second nearest pivot (the nearest may be the row itself); to the only one, if there is one."""
    at = min(1, len(pivots) - 1)
    return np.partition(distances(x.astype(float), pivots), at, axis=1)[:, at]


def positions(order: np.ndarray, pivots: int) -> np.ndarray:
    """Place of every pivot in every row's order; the prefix length where it is not in it."""
    out = np.full((len(order), pivots), order.shape[1], np.int16)
    np.put_along_axis(out, order.astype(np.int64), np.arange(order.shape[1], dtype=np.int16)[None, :], axis=1)
    return out


def footrule(query: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Footrule distance of one order to every row of ``place`` (pivots x rows), with pivots outside a prefix placed right behind it."""
    n = len(query)
    own = place[query]
    return (np.abs(own - np.arange(n, dtype=np.int16)[:, None]) + own).sum(axis=0, dtype=np.int32) + (n * (n + 1) // 2 - n * n)


def calibrate(sample: np.ndarray, order: np.ndarray, pivots: int, lists: int, k: int, recall: float) -> tuple[int, int]:
    """(files to open, radius) that reach the share ``recall`` of the nearest ``k`` within the sample."""
    if len(sample) < 2:
        return pivots, np.iinfo(np.int32).max
    place = positions(order, pivots)
    asked = np.unique(np.linspace(0, len(sample) - 1, CALIBRATION).astype(int))
    opened, far = [], []
    for i in asked:
        d = ((sample - sample[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[:min(k, len(sample) - 1)]
        opened.append(place[i][order[near, :lists].astype(int)].min(axis=1))
        far.append(footrule(order[i].astype(int), place[near].T))
    quantile = lambda x: int(np.quantile(np.concatenate(x), recall, method="higher"))
    return min(quantile(opened) + 1, order.shape[1]), quantile(far)


def search(embeddings: DataFrame, k: int = K, every: int = 100, max_pivots: int = PIVOTS, prefix: int = PREFIX, lists: int = LISTS, block: int = BLOCK,
           sample_rows: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: ``k`` near rows of every query (rows whose id ``every`` divides), by Euclidean distance.

    Null, empty and zero vectors, null ids and vectors with a null or non-finite component take no part; shorter vectors count as
    ending in zeros. Ties go to the smaller vec_id. Equal rows count once; rows that repeat a query's id are its own row and no
    candidate of it, and of query rows with one id each different vector is searched and ranked together. A query gets ``k`` rows
    wherever there are as many candidates: one whose files hold fewer opens all of them. An empty table gives no rows;
    columns other than vec_id and embedding are not read.
    """
    kind = np.float32 if isinstance(embeddings.schema["embedding"].dataType.elementType, T.FloatType) else np.float64
    rows = cut_lineage(usable(embeddings))
    least = Window.partitionBy("v").orderBy("vec_id")
    copies = rows.withColumn("_r", F.row_number().over(least)).where(F.col("_r") <= k + 1)  # more copies are never needed
    nodes = cut_lineage(copies.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    size = nodes.agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("rows"), F.max(F.size("v")).alias("dims")).first()
    n, dims = size["n"], max(1, size["dims"] or 0)
    take = F.pmod(F.xxhash64("v", F.lit(5)), F.lit(1 << 20)) < int(min(1.0, 0.9 * sample_rows / max(n, 1)) * (1 << 20))
    sample = nodes.where(take).orderBy(F.xxhash64("v", F.lit(6)), "v").limit(sample_rows).select("v").toArrow().column("v").combine_chunks()
    sample = matrix(sample, dims, kind).astype(float) if len(sample) else np.zeros((1, dims))
    many = int(np.clip(np.sqrt(n), 1, min(max_pivots, len(sample))))
    pivots = sample[:many]  # the sample is in random order
    length, posted = min(prefix, many), min(lists, many)
    first, radius = calibrate(sample, orders(sample, pivots, length), many, posted, k, recall)
    covered = float(np.quantile(apart(sample, pivots), recall, method="higher"))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                x = matrix(b.column("v"), dims, kind)
                order = orders(x, pivots, length)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns) if b.schema.names[i] != "v"), pa.array(order[:, :posted].astype(np.int32).tolist(), pa.list_(pa.int32())),
                                                  pa.array([o.tobytes() for o in order], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())],
                                                 [*(c for c in b.schema.names if c != "v"), "files", "perm", "v"])

    located = cut_lineage(nodes.select("ids", "v").mapInArrow(locate, "ids array<long>, files array<int>, perm binary, v binary"))
    posts = located.withColumn("file", F.explode("files")).drop("files")
    sizes = posts.groupBy("file").agg(F.count("*").alias("n")).collect()  # at most max_pivots rows
    chunks = np.zeros(many, np.int64)
    for r in sizes:
        chunks[r["file"]] = -(-r["n"] // block)
    directory = F.broadcast(local_table(rows.sparkSession, [(i, int(c)) for i, c in enumerate(chunks)], "file int, chunks long"))
    salted = posts.join(directory, "file").withColumn("block", F.col("file").cast("long") * F.lit(1 << 32) + F.pmod(F.xxhash64("v", F.lit(9)), F.col("chunks")))

    def pack(key: Key, table: pa.Table) -> pa.Table:
        ids = table.column("ids").combine_chunks()
        return pa.table([pa.array([key[0].as_py()]), pa.array([np.diff(ids.offsets.to_numpy()).astype(np.int32).tobytes()]), pa.array([ids.flatten().to_numpy().tobytes()]),
                         *(pa.array([b"".join(table.column(c).to_pylist())]) for c in ("perm", "v"))], names=["block", "counts", "ids", "perm", "v"])

    index = cut_lineage(salted.select("block", "ids", "perm", "v").groupBy("block").applyInArrow(pack, "block long, counts binary, ids binary, perm binary, v binary"))

    asked = rows.where(F.col("vec_id") % every == 0)
    def isolate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in locate(batches):
            x = np.frombuffer(b"".join(b.column("v").to_pylist()), kind).reshape(b.num_rows, dims)
            yield b.append_column("apart", pa.array(apart(x, pivots)))

    asked_for = asked.select("v").dropDuplicates().select(*name_of(F.col("v")), "v")
    queries = cut_lineage(asked_for.mapInArrow(isolate, "h1 long, h2 long, files array<int>, perm binary, v binary, apart double"))
    groups = max(1, -(-queries.count() // GROUP))
    near = F.pmod(F.xxhash64(F.col("files")[0], F.pmod(F.col("h1"), F.lit(max(1, groups // many)))), F.lit(groups))  # neighbours ask for the same files

    def bundle(key: Key, table: pa.Table) -> pa.Table:
        names = np.stack([table.column(c).to_numpy() for c in ("h1", "h2")], axis=1)
        return pa.table([pa.array([key[0].as_py()]), pa.array([names.tobytes()]), *(pa.array([b"".join(table.column(c).to_pylist())]) for c in ("perm", "v"))], names=["group", "names", "perm", "v"])

    def ask(opened: int):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for g in batch.to_pylist():
                    names = np.frombuffer(g["names"], np.int64).reshape(-1, 2)
                    perm, x = np.frombuffer(g["perm"], np.uint16).reshape(len(names), -1), np.frombuffer(g["v"], kind).reshape(len(names), -1)
                    wanted = positions(perm, many) < opened if opened < many else np.ones((len(names), many), bool)
                    for a in np.flatnonzero(wanted.any(axis=0) & (chunks > 0)):
                        who = wanted[:, a]
                        own = [pa.array([m[who].tobytes()]) for m in (names, perm, x)]
                        for c in range(int(chunks[a])):
                            yield pa.RecordBatch.from_arrays([pa.array([int(a) << 32 | c]), pa.array([g["group"] // SHARE]), *own], ["block", "share", "names", "perm", "v"])
        return go

    def rerank(opened: int, radius: int):
        def go(key: Key, left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            if left.num_rows and right.num_rows:
                b = left.to_pylist()[0]
                counts, ids = np.frombuffer(b["counts"], np.int32), np.frombuffer(b["ids"], np.int64)
                begin = np.cumsum(counts) - counts
                perm, y = np.frombuffer(b["perm"], np.uint16).reshape(len(counts), -1), np.frombuffer(b["v"], kind).reshape(len(counts), -1).astype(float)
                place = np.ascontiguousarray(positions(perm, many).T)
                file, homes = key[0].as_py() >> 32, perm[:, :posted].astype(np.int64)
                before = np.arange(posted)[None, :] < (homes == file).argmax(axis=1)[:, None]  # nearer files of the same posting
                for r in right.to_pylist():
                    names = np.frombuffer(r["names"], np.int64).reshape(-1, 2)
                    orders_, x = np.frombuffer(r["perm"], np.uint16).reshape(len(names), -1), np.frombuffer(r["v"], kind).reshape(len(names), -1).astype(float)
                    where = positions(orders_, many)
                    for i in range(len(names)):
                        seen = (before & (where[i][homes] < opened)).any(axis=1) if opened < many else before.any(axis=1)
                        fresh = np.flatnonzero(~seen)  # a posting counts in the nearest of its files that the query opens
                        if not len(fresh):
                            continue
                        f = footrule(orders_[i].astype(np.int64), place)[fresh]
                        ranked = np.argsort(f, kind="stable")
                        chosen = fresh[ranked[:max(k + 1, int(np.searchsorted(f[ranked], radius, "right")))]]
                        d = np.sqrt(((y[chosen] - x[i]) ** 2).sum(axis=1))
                        best = np.lexsort((ids[begin[chosen]], d))[:k + 1]
                        for j in best:
                            at = chosen[j]
                            own = ids[begin[at]:begin[at] + counts[at]]
                            out.append((names[i, 0], names[i, 1], own, np.full(len(own), d[j])))
            lengths = [len(o[2]) for o in out]
            flat = lambda j: np.repeat(np.array([o[j] for o in out], np.int64), lengths) if out else np.zeros(0, np.int64)
            both = lambda j, t: np.concatenate([o[j] for o in out]) if out else np.zeros(0, t)
            return pa.table([flat(0), flat(1), both(2, np.int64), both(3, float)], names=["h1", "h2", "vec_id", "score"])
        return go

    def found(queries: DataFrame, opened: int, radius: int) -> DataFrame:
        bundles = queries.withColumn("group", near).select("group", "h1", "h2", "perm", "v").groupBy("group").applyInArrow(bundle, "group long, names binary, perm binary, v binary")
        requests = cut_lineage(bundles.mapInArrow(ask(opened), "block long, share long, names binary, perm binary, v binary"))
        copies = requests.select(F.col("block").alias("_b"), F.col("share").alias("_s")).distinct()
        sent = index.join(copies, F.col("block") == F.col("_b")).drop("block")
        hits = sent.groupBy("_b", "_s").cogroup(requests.groupBy("block", "share")).applyInArrow(rerank(opened, radius), "h1 long, h2 long, vec_id long, score double")
        ranked = Window.partitionBy("h1", "h2").orderBy("score", "vec_id")
        return cut_lineage(hits.withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") <= k + 1).drop("_r"))

    best = found(queries.where(F.col("apart") <= covered), first, radius)
    enough = best.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min(k + 1, size["rows"] or 0))
    short = cut_lineage(queries.join(enough, ["h1", "h2"], "left_anti"))  # and those that are not covered
    if not short.isEmpty():
        best = best.join(short.select("h1", "h2"), ["h1", "h2"], "left_anti").unionByName(found(short, many, np.iinfo(np.int32).max))
    # Query rows with one vector travel together, so a crowd of them is few rows of the join.
    crowd = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(max(1, asked.count() // COPIES)))
    together = asked.select("vec_id", *name_of(F.col("v"))).groupBy("h1", "h2", crowd.alias("part")).agg(F.collect_list("vec_id").alias("queries"))
    each = together.join(best, ["h1", "h2"]).select(F.explode("queries").alias("query_id"), "vec_id", "score").where(F.col("query_id") != F.col("vec_id"))
    ranked = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return each.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_permutation_index(spark, sf_dir: str) -> DataFrame:
    """Ten near vectors, by Euclidean distance, of every hundredth vector."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
