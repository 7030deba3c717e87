"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces of documents are dealt into shards of bounded size. On every shard several islands evolve populations of packings, each in
its own task: crossover injects whole well-filled sequences of one parent into the other, removes what is now there twice, lets
sequences exchange pieces for displaced ones that fill them better, and places what is left by best fit. Between rounds the islands of a shard send their elites to the next island. Sequences
that stay badly filled are opened and packed again together with those of other shards.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.texts import Key, slices
from cohortloom.llm.tokens import WORDS_KEPT, word_tokens
from cohortloom.session import cut_lineage

CAPACITY = 4096
END_ID = 1
SHARD = 4096
ISLANDS = 2
ROUNDS = 2
POPULATION = 4
GENERATIONS = 8
ELITES = 2
WELL_FILLED = 0.999
OPENED_BELOW = 0.98
LEVELS = 4
BIN_BITS = 24
SLICE_BYTES = 8 << 20  # of text whose words are looked up together
BIGGEST = 1 << 62
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
Packing = list[list[int]]


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, words: int = WORDS_KEPT, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Token ids of every whole text and the end id, cut into pieces; a row per piece with a number that spreads rows over shards.

    A worker knows the ids of some ``words`` words and looks up about ``slice_bytes`` of text at once: less of both saves memory and costs time.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seen = TaskContext.get().partitionId() << 40, 0
        for b, texts in slices(batches, size=slice_bytes):
            ids, counts = word_tokens(tokenizer, words).ids(texts)
            flat, at = ids.astype("<u4"), 0
            out: list[tuple] = []
            for doc, n in zip(b.column("doc_id").to_pylist(), counts.tolist()):
                own = np.append(flat[at:at + n], np.uint32(end_id)).astype("<u4")
                at += n
                for k in range(0, n + 1, capacity):
                    part = own[k:k + capacity]
                    out.append((doc, k // capacity, k, len(part), zlib.crc32(part.tobytes()), base + seen + len(out)))
            seen += len(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), *[pa.int64()] * 4))],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "number"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECE + ", number long")


def best_fit(order: list[int], length: list[int], bins: Packing, free: list[int], capacity: int) -> None:
    """Place pieces into the bin with the least room that suffices; ``free`` holds room << BIN_BITS | bin, sorted."""
    mask = (1 << BIN_BITS) - 1
    for i in order:
        n = length[i]
        k = bisect_left(free, n << BIN_BITS)
        if k == len(free):
            bins.append([i])
            if n < capacity:
                insort(free, (capacity - n) << BIN_BITS | len(bins) - 1)
            continue
        key = free.pop(k)
        at, room = key & mask, (key >> BIN_BITS) - n
        bins[at].append(i)
        if room:
            insort(free, room << BIN_BITS | at)


def packed(order: list[int], length: list[int], capacity: int) -> Packing:
    bins: Packing = []
    best_fit(order, length, bins, [], capacity)
    return bins


def fitness(bins: Packing, length: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; then uneven filling, which leaves room together."""
    return len(bins), -sum((sum(length[i] for i in b) / capacity) ** 2 for b in bins)


def exchange(bins: Packing, displaced: list[int], length: list[int], capacity: int) -> list[int]:
    """Bins that are not full give one piece, or two, for one or two displaced pieces that fill them better; returns what is displaced then.

    The pieces that are left over are smaller, so best fit places them more easily.
    """
    free = sorted((length[i], i) for i in displaced)
    for b in bins:
        room = capacity - sum(length[i] for i in b)
        if not room or not free:
            continue
        best = (0, (), ())
        for out in [(i,) for i in b] + [(i, j) for k, i in enumerate(b) for j in b[k + 1:]][:64]:
            held = sum(length[i] for i in out)
            most = held + room
            k = bisect_right(free, (most, BIGGEST)) - 1
            if k >= 0 and free[k][0] - held > best[0]:
                best = (free[k][0] - held, out, (free[k],))
            low, high = 0, len(free) - 1
            while low < high:  # the pair with the largest sum that fits
                both = free[low][0] + free[high][0]
                if both > most:
                    high -= 1
                else:
                    if both - held > best[0]:
                        best = (both - held, out, (free[low], free[high]))
                    low += 1
            if best[0] == room:
                break
        gain, out, into = best
        if gain:
            for piece in into:
                free.remove(piece)
                b.append(piece[1])
            for i in out:
                b.remove(i)
                insort(free, (length[i], i))
    return [i for _, i in free]


def crossover(mother: Packing, father: Packing, length: list[int], capacity: int, random) -> Packing:
    """Whole well-filled bins of the father enter; the mother's bins that share a piece with them are opened, and their other
    pieces are placed by best fit, largest first."""
    good = [b for b in father if sum(length[i] for i in b) >= WELL_FILLED * capacity]
    take = [good[k] for k in random.permutation(len(good))[:max(1, len(good) // 4)]] if good else []
    there = {i for b in take for i in b}
    bins, displaced = [list(b) for b in take], []
    worst = max(0, len(mother) // 50)  # a few of the mother's worst bins are opened too
    open_ = set(sorted(range(len(mother)), key=lambda k: sum(length[i] for i in mother[k]))[:worst])
    for k, b in enumerate(mother):
        if k in open_ or not there.isdisjoint(b):
            displaced += [i for i in b if i not in there]
        else:
            bins.append(list(b))
    displaced = exchange(bins, displaced, length, capacity)
    free = sorted((capacity - s) << BIN_BITS | k for k, b in enumerate(bins) if (s := sum(length[i] for i in b)) < capacity)
    best_fit(sorted(displaced, key=lambda i: (-length[i], i)), length, bins, free, capacity)
    return bins


def evolve(length: list[int], population: list[Packing], capacity: int, seed: list[int], generations: int = GENERATIONS) -> list[Packing]:
    """Best packings first. Stops as soon as the best one needs no more bins than the tokens do."""
    random = np.random.default_rng(seed)
    least = -(-sum(length) // capacity)
    n = len(length)
    if not population:
        population = [packed(list(range(n)), length, capacity)]  # pieces come in falling length: best fit decreasing
    while len(population) < POPULATION and len(population[0]) > least:
        noise = random.uniform(0.8, 1.2, n)
        population.append(packed(sorted(range(n), key=lambda i: -length[i] * noise[i]), length, capacity))
    value = lambda b: fitness(b, length, capacity)
    population.sort(key=value)
    for _ in range(generations):
        if len(population[0]) <= least or len(population) < 2:
            break
        a, b = random.choice(len(population), 2, replace=False)
        population = sorted([*population, crossover(population[min(a, b)], population[max(a, b)], length, capacity, random)], key=value)[:POPULATION]
    return population


def to_bytes(population: list[Packing], n: int) -> bytes:
    out = np.zeros((min(len(population), ELITES), n), np.int32)
    for row, bins in zip(out, population):
        for k, b in enumerate(bins):
            row[b] = k
    return out.tobytes()


def from_bytes(data: bytes | None, n: int) -> list[Packing]:
    if not data or not n:
        return []
    found = []
    for row in np.frombuffer(data, np.int32).reshape(-1, n):
        order = np.argsort(row, kind="stable")
        found.append([b.tolist() for b in np.split(order, np.flatnonzero(np.diff(row[order])) + 1)])
    return found


ISLAND = "shard long, island int, items binary, elites binary, bins int, filled double"


def island_row(shard: int, island: int, items: np.ndarray, population: list[Packing], capacity: int) -> pa.Table:
    length = items[4].tolist()
    bins, filled = fitness(population[0], length, capacity) if population else (0, 0.0)
    return pa.table([pa.array([shard]), pa.array([island], pa.int32()), pa.array([items.tobytes()]), pa.array([to_bytes(population, items.shape[1])], pa.binary()),
                     pa.array([bins], pa.int32()), pa.array([filled])], names=["shard", "island", "items", "elites", "bins", "filled"])


def pack_level(rows: DataFrame, shards: int, capacity: int, islands: int, rounds: int) -> DataFrame:
    """One level: every shard packed by its islands. Adds shard, bin, offset and the bin's filling to the pieces."""

    def settle(key: Key, table: pa.Table) -> pa.Table:
        shard, island = (k.as_py() for k in key)
        doc = table.column("doc_id")
        items = np.stack([doc.fill_null(0).to_numpy(), doc.is_null().to_numpy().astype(np.int64), *(table.column(c).to_numpy().astype(np.int64) for c in ("piece", "start", "length", "ids_crc32", "number"))])
        items = items[:, np.lexsort((items[6], -items[4]))][:6]
        return island_row(shard, island, items, evolve(items[4].tolist(), [], capacity, [shard, island, 0]), capacity)

    def further(r: int):
        def go(key: Key, table: pa.Table) -> pa.Table:
            shard, island = (k.as_py() for k in key)
            items = np.frombuffer(table.column("items")[0].as_py(), np.int64).reshape(6, -1)
            n = items.shape[1]
            population = from_bytes(table.column("elites")[0].as_py(), n) + from_bytes(table.column("guests")[0].as_py(), n)
            return island_row(shard, island, items, evolve(items[4].tolist(), population, capacity, [shard, island, r]), capacity)
        return go

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                items = np.frombuffer(b["items"], np.int64).reshape(6, -1)
                row = np.frombuffer(b["elites"], np.int32)[:items.shape[1]].astype(np.int64)
                order = np.argsort(row, kind="stable")
                part, row = items[:, order], row[order]
                filled = np.bincount(row, weights=part[4]).astype(np.int64)
                offset = np.cumsum(part[4]) - part[4] - (np.cumsum(filled) - filled)[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[0], mask=part[1] == 1), pa.array(part[2], pa.int32()), *(pa.array(part[k]) for k in (3, 4, 5)),
                     pa.array(np.full(len(row), b["shard"])), pa.array(row), pa.array(offset), pa.array(filled[row])],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "shard", "bin", "offset", "filled"])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("number"), F.lit(shards)))
    state = dealt.withColumn("island", F.explode(F.array(*[F.lit(k) for k in range(islands)]))).groupBy("shard", "island").applyInArrow(settle, ISLAND)
    for r in range(1, rounds):
        state = cut_lineage(state)
        guests = state.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.col("elites").alias("guests"))
        state = state.join(guests, ["shard", "island"]).groupBy("shard", "island").applyInArrow(further(r), ISLAND)
    best = state.groupBy("shard").agg(F.min_by(F.struct("items", "elites"), F.struct("bins", "filled", "island")).alias("b")).select("shard", "b.items", "b.elites")
    return best.mapInArrow(unfold, PIECE + ", shard long, bin long, offset long, filled long")


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, shard: int = SHARD, islands: int = ISLANDS,
         rounds: int = ROUNDS, levels: int = LEVELS, words: int = WORDS_KEPT, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. A longer document is cut into pieces of ``capacity`` tokens, the last one shorter.
    Repeated rows and null ids are packed like any others (rows are dealt by their own number). An empty table gives no rows;
    columns other than doc_id and text are not read.
    """
    rest, done = cut_lineage(pieces(documents, tokenizer, capacity, end_id, words, slice_bytes)), []
    for level in range(levels):
        shards = max(1, -(-rest.count() // shard))
        out = cut_lineage(pack_level(rest, shards, capacity, islands, rounds))
        name = (F.lit(level) * F.lit(1 << 59) + F.col("shard") * F.lit(1 << BIN_BITS) + F.col("bin")).alias("sequence_id")
        whole = out if shards == 1 or level == levels - 1 else out.where(F.col("filled") >= OPENED_BELOW * capacity)
        done.append(whole.select("doc_id", "piece", "start", "length", "ids_crc32", name, "offset"))
        if whole is out:
            break
        rest = out.where(F.col("filled") < OPENED_BELOW * capacity).withColumn("number", F.col("shard") * F.lit(1 << 40) + F.col("bin") * F.lit(1 << 13) + F.col("offset"))
    result = done[0]
    for other in done[1:]:
        result = result.unionByName(other)
    return result


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
