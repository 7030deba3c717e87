"""Near copies by word shingles: an exact set-similarity join of whole texts.

Two texts link if the Jaccard similarity of their sets of ``width``-word shingles reaches ``similarity``. Fingerprints and their pivot tables
(``simhash``) come first: texts whose fingerprints they link are compared and, if they are similar, are one group from then on. They give no radius
that is sure to reach every pair, so the others are found by prefixes: in one order of all shingles, a set of s shingles and any set
that links with it share one of the first s - ceil(similarity s) + 1 of each. The order puts frequent shingles last and the others by
hash; it decides how many pairs are compared, never which pairs link. Which are frequent comes from a sample and then, exactly, from
the prefixes themselves: keys that many nodes meet by are moved back, and the prefixes are taken once more. Equal sets are one node.

Prefixes travel packed, by key; most keys belong to one node and end there. Of the others every pair of nodes that shares enough keys is
compared by the whole sets, unless that is many pairs: then each key's nodes are first compared with one of them, and pairs that are connected by now are left out.
Candidate pairs meet by a label that pairs of one crowd share (a star's lead, the least common key). Each task hands on no more links than
connect its texts, so links grow with the texts and not with the square of a crowd, and only links are merged into components.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.simhash import SEED, connected, fingerprints_of, links
from cohortloom.llm.texts import Key, give_back, slices, split_words
from cohortloom.session import bounded_broadcast, cut_lineage

WIDTH = 5
SIMILARITY = 0.8
SAMPLE = 4096  # documents that show which shingles are frequent
FREQUENT = 4  # of the sample
MOST_FREQUENT = 400_000  # shingles that are moved back at all; an order of any of them is right
CROWDED = 8  # nodes that meet by one key
BUCKET_ROWS = 400_000
FLUSH = 500_000
BUCKET_PAIRS = 20_000
BUCKET_BYTES = 4 << 20  # of texts that are compared in one task
CROWD = 256  # nodes of one key that meet each other in one group
PAIRS = 4  # compared per prefix entry without a round of stars first
STAR_ROUNDS = 8


def shingle_set(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; fewer than ``width`` words are one shingle, none are the empty set."""
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    hash_ = xxhash.xxh64_intdigest
    return np.unique(np.array([hash_(s, SEED) for s in map(b" ".join, zip(*(words[k:] for k in range(width))))], np.uint64))


def name_of(codes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(codes.tobytes(), SEED)


def prefix_size(size: int, similarity: float = SIMILARITY) -> int:
    """Entries of a set's prefix; 0 if no other set can link with it."""
    return size - ceil(similarity * size - 1e-9) + 1 if size / (size + 1) >= similarity - 1e-9 else 0


def prefix(codes: np.ndarray, frequent: np.ndarray, rank: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """First shingles of a sorted set; ``frequent`` (sorted) come last, in the order of ``rank``."""
    many = prefix_size(len(codes), similarity)
    if not many or not len(frequent):
        return codes[:many]
    at = np.minimum(np.searchsorted(frequent, codes), len(frequent) - 1)
    late = np.where(frequent[at] == codes, rank[at] + 1, 0)
    return codes[np.argsort(late, kind="stable")[:many]]


def measured(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """All columns (as _0, _1, ...), the text's set as ``node``, its fingerprint, a number of the row and the text's bytes."""
    fields = documents.schema.fields
    schema = ", ".join([*(f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)), "node long", "fp long", "row long", "bytes long"])
    text = f"_{documents.columns.index('text')}"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for b, texts in slices(batches, text):
            names = np.array([name_of(shingle_set(w, width)) for w in split_words(texts, lower=True)[0]], np.uint64)
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            prints = fingerprints_of(texts).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names.view(np.int64)), pa.array(prints), pa.array(np.arange(at, at + len(texts))), pa.array(size)],
                                             [*b.schema.names, "node", "fp", "row", "bytes"])
            at += len(texts)

    return documents.select(*[F.col(f"`{f.name}`").alias(f"_{i}") for i, f in enumerate(fields)]).mapInArrow(measure, schema)


def sets(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """(node, codes) of rows (node, text)."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, own in slices(batches):
            for i, words in enumerate(split_words(own, lower=True)[0]):
                codes = shingle_set(words, width).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("node").slice(i, 1), pa.array([codes], pa.list_(pa.int64()))], ["node", "codes"])

    return texts.select("node", "text").mapInArrow(build, "node long, codes array<long>")


def frequent_shingles(texts: DataFrame, count: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) that several documents of a bounded sample hold, and their ranks, the most frequent last."""
    take = F.pmod(F.xxhash64("row", F.lit(7)), F.lit(1 << 20)) < int(min(1.0, SAMPLE / max(count, 1)) * (1 << 20))
    often = sets(texts.where(take), width).select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    rows = often.orderBy(F.desc("n"), "code").limit(MOST_FREQUENT).toArrow()
    codes, n = rows.column("code").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(codes)
    rank = np.empty(len(codes), np.int64)
    rank[np.lexsort((codes, n))] = np.arange(len(codes))
    return codes[order], rank[order]


def with_crowded(crowded: DataFrame, frequent: np.ndarray, rank: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles and the keys (key, n) by which many nodes meet, in the order of their frequency; ``share`` is the sample's part of all documents."""
    rows = crowded.orderBy(F.desc("n"), "key").limit(MOST_FREQUENT).toArrow()
    codes, n = rows.column("key").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    # A sampled shingle outside all prefixes is at least as frequent as the sample says; ranks only have to be some order.
    known = frequent[~np.isin(frequent, codes)]
    codes = np.concatenate([codes, known])
    n = np.concatenate([n.astype(float), FREQUENT / share + rank[~np.isin(frequent, codes[:len(rows)])]])
    order = np.argsort(codes)
    place = np.empty(len(codes), np.int64)
    place[np.lexsort((codes, n))] = np.arange(len(codes))
    return codes[order], place[order]


def dealt_prefixes(texts: DataFrame, entries: int, frequent: np.ndarray, rank: np.ndarray, kinds: dict[str, type], width: int, similarity: float) -> DataFrame:
    """Prefix entries by bucket of the key, packed: ``keys``, and of every entry its set's ``nodes`` and ``sizes`` as the types in ``kinds``."""
    buckets = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries // BUCKET_ROWS))
    names = ["bucket", "keys", *kinds]

    def packed(keys: list[np.ndarray], own: dict[str, list[int]]) -> pa.RecordBatch:
        many = [len(k) for k in keys]
        columns = [np.concatenate(keys), *(np.repeat(np.array(own[c], np.uint64).astype(t), many) for c, t in kinds.items())]
        bucket = (columns[0] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, columns = bucket[order], [c[order] for c in columns]
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        cut = [(a, b) for a, b in zip(starts, [*starts[1:], len(bucket)])]
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), *(pa.array([x[a:b].tobytes() for a, b in cut], pa.binary()) for x in columns)], names)

    def entries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, own, held = [], {"nodes": [], "sizes": []}, 0
        for _, part in slices(batches):
            for words in split_words(part, lower=True)[0]:
                codes = shingle_set(words, width)
                first = prefix(codes, frequent, rank, similarity)
                if len(first):
                    keys.append(first.copy())
                    own["nodes"].append(name_of(codes))
                    own["sizes"].append(len(codes))
                    held += len(first)
            if held > FLUSH:
                yield packed(keys, own)
                keys, own, held = [], {"nodes": [], "sizes": []}, 0
        if held:
            yield packed(keys, own)

    return texts.select("text").mapInArrow(entries_of, "bucket long, " + ", ".join(f"{c} binary" for c in names[1:]))


def unpacked(table: pa.Table, kinds: dict[str, type]) -> list[np.ndarray]:
    """Entries of one bucket in the order of key and node, each pair of them once (exact copies are one node)."""
    columns = [np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in {"keys": np.uint64, **kinds}.items()]
    order = np.lexsort((columns[1], columns[0]))
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
    return [c[new] for c in columns]


def crowded_keys(texts: DataFrame, entries: int, frequent: np.ndarray, rank: np.ndarray, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(key, n) of keys in the prefixes of ``CROWDED`` nodes or more; nodes are told apart by 16 bits, which is enough to order keys by."""
    kinds = {"nodes": np.uint16}

    def count(key: Key, table: pa.Table) -> pa.Table:
        k, n = np.unique(unpacked(table, kinds)[0], return_counts=True)
        return pa.table([pa.array(k[n >= CROWDED].view(np.int64)), pa.array(n[n >= CROWDED])], names=["key", "n"])

    return dealt_prefixes(texts, entries, frequent, rank, kinds, width, similarity).groupBy("bucket").applyInArrow(count, "key long, n long")


def shared_keys(texts: DataFrame, entries: int, frequent: np.ndarray, rank: np.ndarray, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(key, node, size) of prefix entries whose key several nodes hold."""
    kinds = {"nodes": np.uint64, "sizes": np.int32}

    def meet(key: Key, table: pa.Table) -> pa.Table:
        k, node, size = unpacked(table, kinds)
        same = k[1:] == k[:-1]
        many = np.zeros(len(k), bool)
        many[1:] |= same
        many[:-1] |= same
        return pa.table([pa.array(k[many].view(np.int64)), pa.array(node[many].view(np.int64)), pa.array(size[many])], names=["key", "node", "size"])

    return dealt_prefixes(texts, entries, frequent, rank, kinds, width, similarity).groupBy("bucket").applyInArrow(meet, "key long, node long, size int")


def sizes_fit(a: Column, b: Column, similarity: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * F.lit(similarity) - 1e-9


def enough_keys(a: Column, b: Column, keys: Column, similarity: float) -> Column:
    """Whether sets of these sizes can link if their prefixes share so many keys: of the set whose prefix ends first, only what follows can be shared besides."""
    need = F.ceil(F.lit(similarity / (1 + similarity)) * (a + b) - 1e-9)
    behind = F.greatest(F.ceil(a * F.lit(similarity) - 1e-9), F.ceil(b * F.lit(similarity) - 1e-9)) - 1
    return keys + behind >= need


def verified(pairs: DataFrame, texts: DataFrame, first: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of nodes whose whole sets reach the similarity, without those that the others of their bucket connect.

    Pairs (a, b, label) of one label meet in one bucket, so most texts travel once; ``first`` names a row of every node. Buckets hold about
    ``BUCKET_BYTES`` of text: the nodes of a label are cut into chunks by their bytes, and every pair of chunks is dealt by itself.
    """
    pairs = cut_lineage(pairs)
    own = pairs.select("label", F.explode(F.array("a", "b")).alias("node")).distinct()
    own = cut_lineage(own.join(first.select("node", "first.row", "first.bytes"), "node"))
    many = own.groupBy("label").agg(F.ceil(2 * F.sum("bytes") / BUCKET_BYTES).alias("chunks")).where(F.col("chunks") > 1)
    chunks = F.coalesce("chunks", F.lit(1).cast("long"))
    own = own.join(many, "label", "left").select("label", "node", "row", "bytes", F.pmod(F.xxhash64("node", F.lit(1)), chunks).alias("chunk"))
    one, two = (own.select("label", F.col("node").alias(c), F.col("chunk").alias(f"chunk_{c}"), F.col("row").alias(f"row_{c}"), F.col("bytes").alias(f"bytes_{c}")) for c in "ab")
    group = F.xxhash64("label", F.least("chunk_a", "chunk_b"), F.greatest("chunk_a", "chunk_b")).alias("group")
    dealt = cut_lineage(pairs.join(one, ["label", "a"]).join(two, ["label", "b"]).select("a", "b", "row_a", "row_b", "bytes_a", "bytes_b", group))
    ends = F.explode(F.array(*[F.struct(F.col(c).alias("node"), F.col(f"row_{c}").alias("row"), F.col(f"bytes_{c}").alias("bytes")) for c in "ab"])).alias("end")
    places = cut_lineage(dealt.select("group", ends).select("group", "end.*").distinct())
    size = places.agg(F.sum("bytes").alias("bytes")).first()["bytes"] or 0
    buckets = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES), -(-dealt.count() // BUCKET_PAIRS))
    bucket = F.pmod(F.xxhash64("group", F.lit(2)), F.lit(buckets)).alias("bucket")
    sent = places.select(bucket, "node", "row").distinct()
    sent = texts.select("row", "text").join(bounded_broadcast(sent, 1_000_000), "row").select("bucket", "node", "text")

    def compare(key: Key, left: pa.Table, right: pa.Table) -> pa.Table:
        whole = {}
        for batch in right.to_batches():
            for b, words_of in slices(iter([batch])):
                for node, words in zip(b.column("node").to_pylist(), split_words(words_of, lower=True)[0]):
                    whole[node] = shingle_set(words, width)
        tree, good = {}, []
        for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist()):
            if new := (i := root_in(tree, a)) != (j := root_in(tree, b)):
                common = len(np.intersect1d(whole[a], whole[b], assume_unique=True))
                if new := common >= similarity * (len(whole[a]) + len(whole[b]) - common) - 1e-9:
                    tree[i] = j
            good.append(new)
        give_back()
        return left.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return dealt.select("a", "b", bucket).groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(compare, "a long, b long")


def root_in(tree: dict[int, int], node: int) -> int:
    """Root of a node; the way there is halved."""
    while (up := tree.get(node, node)) != node:
        tree[node] = node = tree.get(up, up)
    return node


def meetings(met: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join of ``met`` (key, node, size, root) with itself on key, for columns (key, one, two).

    A key of more than ``CROWD`` nodes (``counts`` has n by key) is cut into chunks, and every pair of chunks is a group of its own; nodes of one
    chunk meet in its group with itself only (``one`` = ``two``), which the join has to ask for.
    """
    chunks = F.ceil(F.col("n") / CROWD)
    dealt = met.join(counts.select("key", "n"), "key").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(4)), chunks))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), chunks.cast("long") - 1)))
    dealt = dealt.withColumns({"one": F.least("chunk", "other"), "two": F.greatest("chunk", "other")}).drop("n", "other")
    right = dealt.select("key", "one", "two", F.col("chunk").alias("chunk_b"), F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("root").alias("root_b"))
    return dealt, right


def linked_prints(prints: DataFrame, texts: DataFrame, first: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of similar nodes whose fingerprints (node, fp) are equal or linked: one pair per node and per link of a star."""
    lead = cut_lineage(prints.groupBy("fp").agg(F.min("node").alias("lead")))
    stars = links(lead.select("fp"), lead.count()).distinct()
    alike = prints.join(lead, "fp").select(F.col("node").alias("one"), F.col("lead").alias("two"))
    far = stars.join(lead.select(F.col("fp").alias("a"), F.col("lead").alias("one")), "a").join(lead.select(F.col("fp").alias("b"), F.col("lead").alias("two")), "b")
    pairs = alike.union(far.select("one", "two")).where(F.col("one") != F.col("two"))
    pairs = pairs.groupBy(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).agg(F.min("two").alias("label"))
    return verified(pairs, texts, first, width, similarity)


def components(shared: DataFrame, texts: DataFrame, first: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, pairs_per_entry: int = PAIRS, found: DataFrame | None = None) -> DataFrame:
    """(node, root) of every node with a link; ``shared`` has the keys that nodes meet by, ``found`` pairs that link already."""
    group, before = None if found is None else connected(cut_lineage(found)), None
    for turn in range(STAR_ROUNDS + 1):
        met = shared.withColumn("root", F.col("node")) if group is None else cut_lineage(shared.join(group, "node", "left").withColumn("root", F.coalesce("root", "node")))
        counts = met.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inside"))
        counts = cut_lineage(counts.where(F.col("n") * F.col("n") > F.col("inside")))
        left = counts.agg(F.sum("n").alias("entries"), F.sum((F.col("n") * F.col("n") - F.col("inside")) / 2).alias("pairs")).first()
        met = cut_lineage(met.join(counts.select("key"), "key", "left_semi"))
        shared = met.drop("root")  # a key of one root has one for good
        many = left["pairs"] or 0
        # Texts that share passages and are not similar stay apart whatever leads: once stars stop halving the pairs, they are done.
        stars = many > pairs_per_entry * max(left["entries"] or 0, 1000) and turn < STAR_ROUNDS and (before is None or 2 * many <= before)
        before = many
        if stars:
            lead = met.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "size", "root")).alias("lead"))
            both = met.join(lead, "key").where((F.col("root") != F.col("lead.root")) & sizes_fit(F.col("size"), F.col("lead.size"), similarity))
            both = both.select("node", F.col("lead.node").alias("b"), "size", F.col("lead.size").alias("size_b"), F.col("lead.node").alias("label"))
        else:
            one, two = meetings(met, counts)
            once = (F.col("one") == F.col("two")) | (F.col("chunk") != F.col("chunk_b"))
            both = one.join(two, ["key", "one", "two"]).where(once & (F.col("node") < F.col("b")) & (F.col("root") != F.col("root_b")) & sizes_fit(F.col("size"), F.col("size_b"), similarity))
            both = both.select("node", "b", "size", "size_b", F.col("key").alias("label"))
        # A star misses keys that another node leads, so half of them will do; what it passes over is met in the last turn.
        pairs = both.groupBy("node", "b", "size", "size_b").agg(F.count("*").alias("keys"), F.min("label").alias("label"))
        pairs = pairs.where(enough_keys(F.col("size"), F.col("size_b"), F.col("keys") * (2 if stars else 1), similarity))
        pairs = pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"), "label")
        found = verified(pairs, texts, first, width, similarity)
        group = connected(cut_lineage(found if group is None else group.toDF("a", "b").union(found)))
        if not stars:
            return group


def drop_near_copies(documents: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, pairs_per_entry: int = PAIRS) -> DataFrame:
    """One row of every group that links connect, the one with the least doc_id (a null id comes last), with the columns of ``documents``.

    Letters A-Z count as lower case and words are cut at ASCII spaces, as for the fingerprints. Texts with equal sets are copies,
    so null and empty texts are one group; repeated rows are copies of each other; an empty table gives no rows. Texts of any length are compared
    whole; a pair of very long ones is a task of its own.
    """
    names = documents.columns
    stored = cut_lineage(measured(documents, width))
    texts = stored.select("node", "row", "bytes", F.col(f"_{names.index('text')}").alias("text"))
    at = f"_{names.index('doc_id')}"
    first = cut_lineage(stored.groupBy("node").agg(F.min(F.struct(F.col(at).isNull().alias("no_id"), F.col(at).alias("id"), "row", "bytes")).alias("first")))
    size = stored.agg(F.count("*").alias("n"), F.sum("bytes").alias("chars")).first()
    frequent, rank = frequent_shingles(texts, size["n"], width)
    # Some six characters a word, and a prefix of some fifth of the words.
    crowded = cut_lineage(crowded_keys(texts, (size["chars"] or 0) // 30, frequent, rank, width, similarity))
    frequent, rank = with_crowded(crowded, frequent, rank, min(1.0, SAMPLE / max(size["n"], 1)))
    shared = cut_lineage(shared_keys(texts, (size["chars"] or 0) // 30, frequent, rank, width, similarity))
    prints = stored.select("node", "fp").distinct()  # sets forget repeats and order, so one may have several
    found = linked_prints(prints, texts, first, width, similarity)
    group = components(shared, texts, first, width, similarity, pairs_per_entry, found)
    named = first.join(group, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    keep = named.groupBy("root").agg(F.min("first").alias("first")).select("first.row")
    return stored.join(keep, "row", "left_semi").select(*[F.col(f"_{i}").alias(n) for i, n in enumerate(names)])
