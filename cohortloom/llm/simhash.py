"""Near duplicates by SimHash fingerprints and pivot distance tables.

Fingerprints of whole texts link when at most ``radius`` bits differ. Equal fingerprints are one node. Two linked fingerprints agree
on one of ``radius + 1`` disjoint parts of the bits (or, with more parts, on a choice of them), so nodes are dealt by the value of
such a part: distances to pivots alone give no key that both sides share. Among the nodes of one value, a table holds the Hamming
distances to many reference fingerprints: a pair whose coordinates differ by more than ``radius`` anywhere is discarded, and
the survivors are verified bit by bit. Each task hands on a star per group of links, never the links themselves, and large and
small stars are merged until nothing changes.

A value that holds more than ``crowd`` nodes is cut into chunks, and every pair of chunks is a group of its own, so no group grows
without a bound and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.texts import Key, mix64, slices, split_words
from cohortloom.session import cut_lineage

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
PIVOTS = 16
CROWD = 4096
GROUP_ROWS = 100_000


def fingerprints_of(texts: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """Fingerprint of every text: a bit is set if it is set in over half of the shingles' hashes (repeats included)."""
    parts, counts = split_words(texts, lower=True)
    many = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    hash_, out = xxhash.xxh64_intdigest, np.zeros(len(texts), np.uint64)

    def shingles(words: list[bytes]):
        if len(words) < width:
            return [b" ".join(words)] if words else []
        return map(b" ".join, zip(*(words[k:] for k in range(width))))

    codes = np.fromiter((hash_(s, SEED) for s in chain.from_iterable(map(shingles, parts))), np.uint64, int(many.sum()))
    row = np.repeat(np.arange(len(texts)), many)
    votes = np.zeros((len(texts), BITS), np.int64)
    for i in range(0, len(codes), 1 << 16):  # a bounded bit matrix
        part = row[i:i + (1 << 16)]
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        bits = np.unpackbits(codes[i:i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes[part[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return np.packbits(2 * votes > many[:, None], axis=1).view(">u8").reshape(-1).astype(np.uint64)


def fingerprints(documents: DataFrame, keep: list[str], width: int = SHINGLE) -> DataFrame:
    """The columns in ``keep`` (as _0, _1, ...), the fingerprint as a long, and a number of the row."""
    fields = [documents.schema[c] for c in keep]
    schema = ", ".join([*(f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)), "fp long", "row long"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for b, texts in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([*b.columns[:len(fields)], pa.array(fingerprints_of(texts, width).view(np.int64)), pa.array(np.arange(at, at + len(texts)))],
                                             [*(f"_{i}" for i in range(len(fields))), "fp", "row"])
            at += len(texts)

    kept = documents.select(*[F.col(f"`{f.name}`").alias(f"_{i}") for i, f in enumerate(fields)], F.col("text").alias("_text"))
    return kept.mapInArrow(measure, schema)


def parts_for(nodes: int, radius: int = RADIUS) -> int:
    """How many parts the bits are cut into: enough that a value of the shared parts is met by few random nodes."""
    parts = radius + 1
    while parts < 16 and nodes / 2 ** (BITS * (parts - radius) // parts) > 16:
        parts += 1
    return parts


def masks(parts: int, radius: int = RADIUS) -> list[int]:
    """Bits that two linked fingerprints share for at least one of these masks: every choice of ``parts - radius`` parts."""
    edges = [BITS * k // parts for k in range(parts + 1)]
    own = [sum(1 << b for b in range(edges[k], edges[k + 1])) for k in range(parts)]
    return [sum(own[k] for k in choice) for choice in combinations(range(parts), parts - radius)]


def pivots(many: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed pseudo-random numbers, the same everywhere."""
    return mix64(np.arange(1, many + 1) * 7919)


def roots_of(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smaller root wins; repeated until all pairs have met."""
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        parent = roots_of(parent)
    return parent


def stars(value: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links among the nodes that share a value, as (node, least node of its group); every node may stand in several values."""
    code, at = np.unique(fp, return_inverse=True)
    tables = np.stack([np.bitwise_count(code ^ p).astype(np.int8) for p in pivots()])
    order = np.lexsort((tables[0][at], value))
    value, at = value[order], at[order]
    near = tables[0][at]
    parent = np.arange(len(code))
    left, step = np.arange(len(at)), 0
    while len(left):  # neighbours at growing steps; a row stays while its first coordinate is close enough
        step += 1
        left = left[left + step < len(at)]
        left = left[(value[left] == value[left + step]) & (near[left + step] - near[left] <= radius)]
        a, b = at[left], at[left + step]
        new = parent[a] != parent[b]
        a, b = a[new], b[new]
        for t in tables[1:]:
            close = np.abs(t[a] - t[b]) <= radius
            a, b = a[close], b[close]
        linked = np.bitwise_count(code[a] ^ code[b]) <= radius
        parent = unite(parent, a[linked], b[linked])
    moved = parent != np.arange(len(code))
    return code[moved], code[parent[moved]]


def links(nodes: DataFrame, count: int, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """Stars (node, root) over distinct fingerprints ``fp`` that connect exactly what linked pairs connect."""
    share = masks(parts_for(count, radius), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in share]
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("mask", "value"))
    keyed = keyed.select("fp", F.xxhash64("mask", "value").alias("value"))
    crowds = keyed.groupBy("value").agg(F.count("*").alias("many")).where(F.col("many") > crowd).select("value", F.ceil(F.col("many") / crowd).alias("chunks"))
    crowds = cut_lineage(crowds)  # at most a (crowd)th of the rows; Spark chooses how to join it
    dealt = keyed.join(crowds, "value", "left")
    own = F.pmod(F.xxhash64("fp", F.lit(3)), F.col("chunks"))
    # A chunk meets every other chunk in the group of that pair; two chunks of a pair also cover the pairs inside each.
    meets = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.xxhash64("value", F.least(own, c), F.greatest(own, c)))
    meets = F.when(F.col("chunks").isNull(), F.array("value")).otherwise(F.filter(meets, lambda v: v != F.xxhash64("value", own, own)))
    groups = dealt.select("fp", F.explode(meets).alias("value"))
    buckets = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count * len(share) // GROUP_ROWS))

    def meet(key: Key, table: pa.Table) -> pa.Table:
        a, b = stars(table.column("value").to_numpy(), table.column("fp").to_numpy().view(np.uint64), radius)
        return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return groups.withColumn("bucket", F.pmod("value", F.lit(buckets))).groupBy("bucket").applyInArrow(meet, "a long, b long")


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with a link: large and small stars in turn, each round written to the shared folder."""
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    for _ in range(most_rounds):
        both = pairs.union(pairs.select(F.col("b"), F.col("a")).toDF("a", "b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small_least.select("a", F.col("m").alias("b")))
        pairs = cut_lineage(small.where(F.col("a") != F.col("b")).distinct())
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return pairs.toDF("node", "root")
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def components(prints: DataFrame) -> DataFrame:
    """(fp, component): for every distinct fingerprint the fingerprint that names its component; unlinked ones are left out."""
    nodes = cut_lineage(prints.select("fp").distinct())
    return connected(links(nodes, nodes.count()))


def near_duplicates(documents: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id that links reach) of every row.

    A null or empty text has fingerprint zero and links like any other. Repeated rows stay, with one component. A null doc_id is
    no name: its row gets the least id of its component, or null if there is none. An empty table gives no rows; columns
    other than doc_id and text are not read.
    """
    prints = cut_lineage(fingerprints(documents, ["doc_id"], width).withColumnRenamed("_0", "doc_id"))
    group = components(prints)
    own = prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    named = own.join(group.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "doc_id")
    named = cut_lineage(named)
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_print = named.join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(documents: DataFrame, width: int = SHINGLE) -> DataFrame:
    """One row of every component, the one with the least doc_id (a null id comes last), with the columns of ``documents``."""
    names = documents.columns
    stored = cut_lineage(fingerprints(documents, names, width))
    at = f"_{names.index('doc_id')}"
    group = components(stored)
    first = stored.groupBy("fp").agg(F.min(F.struct(F.col(at).isNull().alias("no_id"), F.col(at).alias("id"), "row")).alias("first"))
    named = first.join(group.withColumnRenamed("node", "fp"), "fp", "left").select(F.coalesce("root", "fp").alias("root"), "first")
    keep = named.groupBy("root").agg(F.min("first").alias("first")).select("first.row")
    return stored.join(keep, "row", "left_semi").select(*[F.col(f"_{i}").alias(n) for i, n in enumerate(names)])


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
