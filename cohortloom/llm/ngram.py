"""Language-model scoring with Elias-Fano n-gram tries.

The model is an interpolated bigram model with absolute discounting over all training documents. It is never gathered in one place:
contexts are dealt over shards, and every shard holds a trie of its contexts (level 1) and their successors (level 2). All
sequences of a trie are monotone and stored as Elias-Fano codes in a memory-mapped file: pointers from contexts to successors,
cumulative counts, and successors relative to their context; next to the successors stand 16-bit codes of the quantised discounted
counts, the numerators of the smoothed probabilities.

Documents stay in blocks of about a million tokens. A block sends every shard its distinct bigrams once, with their training counts,
as packed arrays; the shard merges the counts of all blocks, builds its trie, looks every asked bigram up by search among the
successors of its context, and answers in the same order; the block then scores its documents. Two shuffles of packed rows do it
all. Contexts so frequent that one shard would be crowded are cut by successor over several shards, and each reports its part
of the context's count to every block.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.texts import Key, Numbering, fold_is_zero, may_teach, slices, split_words

FOLDS = 10
SHARD_BYTES = 24 << 20
BLOCK_TOKENS = (1 << 20, 1 << 21)
TOKENS_PER_PAIR = 4096
WORD_BITS = 40
DISCOUNT = 0.75
CODE_EXACT = 4096
CHUNK = 1 << 16
HOT_SAMPLE = 64


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 11)


# The begin of a text as a context and its end as a token; another seed keeps them apart from words.
MARKS = np.array([xxhash.xxh64_intdigest(m, 12) for m in (b"begin", b"end")], np.uint64)


# ---- the trie of one shard


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary, both in a memory-mapped file; decoded chunk by chunk."""

    def __init__(self, values: np.ndarray, store: Store):
        self.n = len(values)
        top = int(values[-1]) + 1 if self.n else 1
        self.low = max(0, (top // max(self.n, 1)).bit_length() - 1)
        high = (values >> np.uint64(self.low)).astype(np.int64) + np.arange(self.n)  # positions of the ones
        self.select = high[::CHUNK].copy()
        bits = np.zeros(int(high[-1]) + 1 if self.n else 0, bool)
        bits[high] = True
        self.high = store.put(np.packbits(bits))
        parts = []
        for i in range(0, self.n if self.low else 0, CHUNK):
            wide = np.unpackbits(values[i:i + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - self.low:]
            parts.append(np.packbits(wide))  # CHUNK values fill whole bytes
        self.lows = store.put(np.concatenate(parts) if parts else np.zeros(0, np.uint8))

    def chunk(self, k: int) -> np.ndarray:
        """Values k * CHUNK up to the next chunk."""
        many = min(CHUNK, self.n - k * CHUNK)
        begin = int(self.select[k])
        end = int(self.select[k + 1]) if k + 1 < len(self.select) else 8 * len(self.high)
        first = begin // 8
        ones = np.flatnonzero(np.unpackbits(self.high[first:-(-end // 8)])) + 8 * first
        ones = ones[np.searchsorted(ones, begin):][:many]
        value = (ones - k * CHUNK - np.arange(many)).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            at = k * CHUNK * self.low // 8
            wide = np.unpackbits(self.lows[at:at + -(-many * self.low // 8)], count=many * self.low).reshape(many, self.low)
            full = np.zeros((many, 64), np.uint8)
            full[:, 64 - self.low:] = wide
            value |= np.packbits(full, axis=1).view(">u8").reshape(-1).astype(np.uint64)
        return value

    def all(self) -> np.ndarray:
        return np.concatenate([self.chunk(k) for k in range(len(self.select))]) if self.n else np.zeros(0, np.uint64)


class Store:
    """A file without a name in the task's own folder: it goes when the task ends, also if it fails."""

    def __init__(self):
        self.file = tempfile.TemporaryFile()

    def put(self, values: np.ndarray) -> np.ndarray:
        if not values.nbytes:
            return values
        self.file.seek(0, 2)
        at = -(-self.file.tell() // 64) * 64
        self.file.seek(at)
        self.file.write(values.tobytes())
        self.file.flush()
        return np.memmap(self.file, values.dtype, "r", at, values.shape)


def codebook() -> np.ndarray:
    """log10 of the discounted counts that the codes stand for; 0: absent. Small counts are exact, larger ones within 0.03 %."""
    exact = np.arange(1, CODE_EXACT + 1)
    wide = CODE_EXACT * np.exp(np.arange(1, (1 << 16) - CODE_EXACT) * 5e-4)
    return np.concatenate([[-np.inf], np.log10(np.concatenate([exact, wide]) - DISCOUNT)])


def codes_of(counts: np.ndarray) -> np.ndarray:
    wide = CODE_EXACT + np.rint(np.log(np.maximum(counts, 1) / CODE_EXACT) / 5e-4)
    return np.where(counts <= CODE_EXACT, counts, np.minimum(wide, (1 << 16) - 1)).astype(np.uint16)


class Trie:
    """Contexts 0..n-1 and their successors, from sorted keys ``context << WORD_BITS | successor`` with positive counts."""

    def __init__(self, contexts: int, keys: np.ndarray, counts: np.ndarray):
        store = Store()
        context = (keys >> np.uint64(WORD_BITS)).astype(np.int64)
        self.contexts = contexts
        self.pointers = EliasFano(np.searchsorted(context, np.arange(contexts + 1)).astype(np.uint64), store)
        total = np.bincount(context, weights=counts, minlength=contexts).astype(np.uint64)
        self.totals = EliasFano(np.cumsum(total, dtype=np.uint64), store)
        self.successors = EliasFano(keys, store)
        self.codes = store.put(codes_of(counts))

    def context_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens after each context, and its number of different successors."""
        return np.diff(self.totals.all(), prepend=np.uint64(0)).astype(np.int64), np.diff(self.pointers.all()).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Codes of sorted keys (0: absent): the successor search of every key runs inside its context's range."""
        out = np.zeros(len(keys), np.uint16)
        for k in range(len(self.successors.select)):
            here = self.successors.chunk(k)
            a, b = np.searchsorted(keys, here[0]), np.searchsorted(keys, here[-1], "right")
            at = np.searchsorted(here, keys[a:b])
            hit = here[np.minimum(at, len(here) - 1)] == keys[a:b]
            out[a:b][hit] = self.codes[k * CHUNK:k * CHUNK + len(here)][at[hit]]
        return out


# ---- blocks of documents


def press(**parts) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(parts, protocol=5))


def unpress(data: bytes) -> dict:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


@dataclass
class Bigrams:
    """Distinct (context, successor) of a block in the order in which shards get them."""

    context: np.ndarray
    word: np.ndarray
    shard: np.ndarray
    of_token: np.ndarray


def bigrams(tokens: np.ndarray, lengths: np.ndarray, begin: int, base: np.ndarray, cuts: np.ndarray, spread: np.ndarray, shards: int) -> Bigrams:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(lengths) - lengths] = begin
    many = len(base)
    key, of_token = np.unique(before.astype(np.int64) * many + tokens, return_inverse=True)
    context, word = key // many, key % many
    shard = (base[context].astype(np.int64) + spread[word].astype(np.int64) % cuts[context]) % shards
    order = np.argsort(shard, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return Bigrams(context[order], word[order], shard[order], place[of_token])


def block_rows(block: int, words: Numbering, tokens: np.ndarray, lengths: np.ndarray, docs: list, teach: np.ndarray, hot: dict[int, int], shards: int):
    """The row that keeps the block's documents, and a row of packed bigrams for every shard."""
    code = np.concatenate([MARKS, np.fromiter(map(word_hash, words), np.uint64, len(words))])
    base = (code % np.uint64(shards)).astype(np.uint32)
    order = np.lexsort((code, base))
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    code, base = code[order], base[order]
    cuts = np.fromiter((hot.get(c, 1) for c in code.tolist()), np.uint32, len(code)) if hot else np.ones(len(code), np.uint32)
    spread = (code >> np.uint64(48)).astype(np.uint16)
    tokens, begin, end = rank[tokens], int(rank[0]), int(rank[1])
    b = bigrams(tokens, lengths, begin, base, cuts, spread, shards)
    counts = np.bincount(b.of_token, weights=np.repeat(teach, lengths), minlength=len(b.word)).astype(np.uint32)
    yield -block - 1, block, -1, press(tokens=tokens, lengths=lengths.astype(np.uint32), docs=docs, begin=begin, end=end, base=base, cuts=cuts, spread=spread,
                                       hot=code[cuts > 1], hot_at=np.flatnonzero(cuts > 1))
    edges = np.searchsorted(b.shard, np.arange(shards + 1))
    small = (code >> np.uint64(64 - WORD_BITS))
    for s in range(shards):
        i, j = edges[s], edges[s + 1]
        starts = np.flatnonzero(np.diff(b.context[i:j], prepend=-1))
        own = small[b.word[i:j]]
        yield s, block, s, press(contexts=code[b.context[i:j][starts]], many=np.diff(starts, append=j - i).astype(np.uint32), low=own.astype(np.uint32),
                                 high=(own >> np.uint64(32)).astype(np.uint8), counts=counts[i:j])


def answer(rows: list[dict], shard: int, hot: dict[int, int]) -> list[bytes]:
    """Merge the blocks' counts, build the trie and look all asked bigrams up."""
    asked = [unpress(r["payload"]) for r in rows]
    contexts, of_row = np.unique(np.concatenate([a["contexts"] for a in asked]), return_inverse=True)
    many = np.concatenate([a["many"] for a in asked])
    small = np.concatenate([a["low"].astype(np.uint64) | a["high"].astype(np.uint64) << np.uint64(32) for a in asked])
    keys, place = np.unique(np.repeat(of_row.astype(np.uint64), many) << np.uint64(WORD_BITS) | small, return_inverse=True)
    counts = np.bincount(place, weights=np.concatenate([a["counts"] for a in asked]), minlength=len(keys)).astype(np.int64)
    trie = Trie(len(contexts), keys[counts > 0], counts[counts > 0])
    codes, (total, kinds) = trie.find(keys)[place], trie.context_counts()
    is_hot = np.fromiter((c in hot for c in contexts.tolist()), bool, len(contexts)) if hot else np.zeros(len(contexts), bool)
    is_word = ~is_hot & (contexts != MARKS[0])
    shared = {"tokens": int(total.sum()), "words": int((is_word & (total > 0)).sum()), "once": int((is_word & (total == 1)).sum()), "twice": int((is_word & (total == 2)).sum()),
              "begin": int(total[contexts == MARKS[0]].sum()), "hot": contexts[is_hot], "hot_total": total[is_hot], "hot_kinds": kinds[is_hot]}
    out, c, k = [], 0, 0
    for a in asked:
        n, m = len(a["contexts"]), len(a["low"])
        at = of_row[c:c + n]
        out.append(press(codes=codes[k:k + m], total=total[at].astype(np.uint64), kinds=kinds[at].astype(np.uint32), shared=shared))
        c, k = c + n, k + m
    return out


def score_block(docs: dict, answers: list[dict], shards: int) -> dict[str, np.ndarray]:
    """Scores of a block's documents from the answers of all shards, in order of shard."""
    lengths = docs["lengths"].astype(np.int64)
    b = bigrams(docs["tokens"], lengths, docs["begin"], docs["base"], docs["cuts"], docs["spread"], shards)
    total, kinds = (np.zeros(len(docs["base"]), np.int64) for _ in range(2))
    starts = np.flatnonzero(np.diff(b.context, prepend=-1) | np.diff(b.shard, prepend=-1))
    total[b.context[starts]] = np.concatenate([a["total"] for a in answers])
    kinds[b.context[starts]] = np.concatenate([a["kinds"] for a in answers])
    shared = [a["shared"] for a in answers]
    hot, hot_total, hot_kinds = (np.concatenate([s[k] for s in shared]) for k in ("hot", "hot_total", "hot_kinds"))
    name, at = np.unique(hot, return_inverse=True)  # a context cut over shards is the sum of its parts
    hot_total, hot_kinds = (np.bincount(at, weights=w, minlength=len(name)).astype(np.int64) for w in (hot_total, hot_kinds))
    if len(docs["hot"]):
        own = np.searchsorted(name, docs["hot"])
        total[docs["hot_at"]], kinds[docs["hot_at"]] = hot_total[own], hot_kinds[own]
    begins = sum(s["begin"] for s in shared)
    tokens = sum(s["tokens"] for s in shared)
    is_word = name != MARKS[0]
    begins += int(hot_total[~is_word].sum())
    words = sum(s["words"] for s in shared) + int((hot_total[is_word] > 0).sum()) + (begins > 0)
    once, twice = (sum(s[k] for s in shared) for k in ("once", "twice"))
    count = total.copy()
    count[docs["end"]] = begins  # every document ends once
    cut = np.clip(once / max(once + 2 * twice, 1), 0.1, 0.9)
    single = np.where(count > 0, count - cut, cut * words) / max(tokens, 1) if tokens else np.ones(len(count))
    seen = np.maximum(total, 1)[b.context]
    follow = np.where(total[b.context] > 0, (10 ** codebook()[np.concatenate([a["codes"] for a in answers])] + DISCOUNT * kinds[b.context] * single[b.word]) / seen, single[b.word])
    base = np.log10((count + 0.1) / (tokens + 0.1 * (words + 1)))
    begin = np.cumsum(lengths) - lengths
    sums = lambda v: np.add.reduceat(v, begin) if len(begin) else np.zeros(0)
    return {"n_tokens": lengths, "n_known": sums((count[docs["tokens"]] > 0).astype(np.int64)), "train_tokens": np.full(len(lengths), tokens, np.int64),
            "base_score": sums(base[docs["tokens"]]), "score": sums(np.log10(np.minimum(follow, 1))[b.of_token])}  # a quantised count may lie 0.03 % too high


# ---- the plan

PACKED = "dest long, block long, shard int, payload binary"
RESULT = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def hot_contexts(documents: DataFrame, shards: int) -> dict[int, int]:
    """Words so frequent that they would crowd a shard, by hash, and over how many shards their successors are cut. Taken from a
    sample of documents: it decides only where contexts live, never a count or a score."""
    if shards < 2:
        return {}
    words = documents.where(F.pmod(F.xxhash64("text"), F.lit(HOT_SAMPLE)) == 0).select(F.explode(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+")).alias("word"))
    counted = words.where(F.col("word") != "").groupBy("word").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    least = max(0.5 / shards, 1e-4)  # so there are at most 10,000 of them
    return {word_hash(r["word"].encode("utf-8", "surrogatepass")): int(min(shards, np.ceil(2 * shards * r["n"] / total))) for r in counted.where(F.col("n") > least * total).collect()}


def score_documents(documents: DataFrame, teach, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every whole text, learning from rows where ``teach`` holds.

    A null or empty text is the end token alone. Repeated rows are learned and scored each; a null id is kept. If no row
    teaches, every score is 0. An empty table gives no rows; columns other than doc_id and text are not read. Words are told apart
    by 64-bit hashes as contexts and by their first 40 bits among the successors of one context.
    """
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    hot = hot_contexts(documents, shards)
    limit = int(np.clip(shards * TOKENS_PER_PAIR, *BLOCK_TOKENS))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        words, tokens, lengths, docs, teaches, held = Numbering(), [], [], [], [], 0

        def close():
            rows = block_rows(block, words, np.concatenate(tokens), np.concatenate(lengths), docs, np.concatenate(teaches), hot, shards)
            for r in rows:  # one packed row at a time
                yield pa.RecordBatch.from_arrays([pa.array([r[0]]), pa.array([r[1]]), pa.array([r[2]], pa.int32()), pa.array([r[3]], pa.binary())], ["dest", "block", "shard", "payload"])

        for b, texts in slices(batches):
            parts, counts = split_words(texts, lower=True)
            out = np.full(int(counts.sum()) + len(texts), 1, np.int64)  # 0 and 1 are the marks
            inside = np.ones(len(out), bool)
            inside[np.cumsum(counts + 1) - 1] = False
            out[inside] = np.fromiter(map(words.__getitem__, chain.from_iterable(parts)), np.int64, int(counts.sum())) + 2
            tokens.append(out), lengths.append(counts + 1), teaches.append(b.column("_teach").to_numpy(zero_copy_only=False))
            docs.extend(b.column("doc_id").to_pylist())
            held += len(out)
            if held >= limit:
                yield from close()
                block += 1
                words, tokens, lengths, docs, teaches, held = Numbering(), [], [], [], [], 0
        if held:
            yield from close()

    def serve(key: Key, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return table
        rows = table.to_pylist()
        return table.set_column(3, "payload", pa.array(answer(rows, key[0].as_py(), hot), pa.binary()))

    def finish(key: Key, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["shard"])
        docs = unpress(rows[0]["payload"])
        out = score_block(docs, [unpress(r["payload"]) for r in rows[1:]], shards)
        return pa.table([pa.array(docs["docs"], pa.int64()), *(pa.array(v) for v in out.values())], names=["doc_id", *out])

    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", teach.alias("_teach"))
    asked = own.mapInArrow(read, PACKED)
    answered = asked.groupBy("dest").applyInArrow(serve, PACKED)
    return answered.groupBy("block").applyInArrow(finish, RESULT)


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    """Score all documents by what nine tenths of them teach."""
    found = score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), may_teach("doc_id", FOLDS))
    return found.select("doc_id", fold_is_zero("doc_id", FOLDS).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
