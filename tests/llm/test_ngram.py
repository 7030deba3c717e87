import collections
import zlib

import numpy as np
import pytest

from cohortloom.llm import ngram as G
from cohortloom.llm.texts import may_teach
from tests.llm.tables import ODD, PROSE, documents, odd_documents


def words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split() + [None]


def teaches(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 != 0


def brute(rows):
    """(tokens, known, base, score) of each text, from plain counts."""
    single, pair, context, kinds = (collections.Counter() for _ in range(4))
    for i, t, _ in rows:
        if teaches(i):
            w = words(t)
            single.update(w)
            pair.update(zip(["begin", *w[:-1]], w))
    for (v, _), c in pair.items():
        context[v] += c
        kinds[v] += 1
    n, many = sum(single.values()), len(single)
    once, twice = (sum(c == k and w is not None for w, c in single.items()) for k in (1, 2))
    cut = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)

    def unigram(w):
        return ((single[w] - cut) if single[w] else cut * many) / n if n else 1.0

    def chance(v, w):
        if not context[v]:
            return unigram(w)
        return (max(pair[v, w] - G.DISCOUNT, 0) + G.DISCOUNT * kinds[v] * unigram(w)) / context[v]

    out = []
    for i, t, _ in rows:
        w = words(t)
        out.append((str(i), len(w), sum(single[x] > 0 for x in w), n, sum(np.log10((single[x] + 0.1) / (n + 0.1 * (many + 1))) for x in w),
                    sum(np.log10(chance(v, x)) for v, x in zip(["begin", *w[:-1]], w))))
    return sorted(out)


def compare(df, rows, **options):
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in G.score_documents(df, may_teach("doc_id", 10), **options).collect())
    want = brute(rows)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want], rel=1e-9)
    for g, w in zip(got, want):  # counts over 4096 are quantised, by at most 0.025 % a token
        most = 1.1e-4 * g[1] if max(map(len, (t or "" for _, t, _ in rows))) > 100_000 else 0
        assert abs(g[5] - w[5]) <= most + 1e-9 * abs(w[5])


def test_odd_rows(spark):
    compare(odd_documents(spark), ODD)


def prose(n=300):
    r = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(400)]
    return [(i, " ".join(["the" if r.random() < 0.3 else vocabulary[int(k)] for k in r.zipf(1.4, 80) % 400]), "a") for i in range(n)]


@pytest.mark.parametrize("size", [24 << 20, 4000])
def test_shards_and_frequent_contexts(spark, size):
    rows = prose()
    df = documents(spark, rows).repartition(5)
    if size == 4000:
        hot = G.hot_contexts(df, 30)
        assert hot == {} or max(hot.values()) > 1
    compare(df, rows, shard_bytes=size)


def test_cut_contexts(spark, monkeypatch):
    rows = prose(120)
    hot = {G.word_hash(b"the"): 4, G.word_hash(b"w1"): 3, G.word_hash(b"never"): 2}
    monkeypatch.setattr(G, "hot_contexts", lambda documents, shards: hot)
    compare(documents(spark, rows), rows, shard_bytes=4000)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK_TOKENS", (500, 500))
    rows = prose(100)
    compare(documents(spark, rows), rows, shard_bytes=9000)


def test_nothing_teaches(spark):
    rows = [(None, PROSE, "a"), (None, None, "a")]
    compare(documents(spark, rows), rows)
    assert G.score_documents(documents(spark, []), may_teach("doc_id", 10)).count() == 0


@pytest.mark.parametrize("n,top", [(0, 10), (1, 1), (1000, 1001), (70_000, 2**40), (131_072, 140_000), (65_537, 2**62)])
def test_elias_fano_round_trip(n, top):
    values = np.sort(np.random.default_rng(n).integers(0, top, n).astype(np.uint64))
    assert np.array_equal(G.EliasFano(values, G.Store()).all(), values)


def test_trie_finds_exactly_what_it_holds():
    r = np.random.default_rng(9)
    keys = np.unique(r.integers(0, 500, 150_000).astype(np.uint64) << np.uint64(G.WORD_BITS) | r.integers(0, 2**40, 150_000).astype(np.uint64))
    counts = r.zipf(1.5, len(keys)) % 10**7 + 1
    held = r.random(len(keys)) < 0.7
    trie = G.Trie(501, keys[held], counts[held])
    codes = trie.find(keys)
    assert np.array_equal(codes > 0, held)
    value = 10 ** G.codebook()[codes[held]] + G.DISCOUNT
    assert np.allclose(value, counts[held], rtol=5e-4)
    small = counts[held] <= G.CODE_EXACT
    assert np.array_equal(np.rint(value[small]), counts[held][small])
    total, kinds = trie.context_counts()
    context = (keys[held] >> np.uint64(G.WORD_BITS)).astype(int)
    assert np.array_equal(total, np.bincount(context, weights=counts[held], minlength=501)) and np.array_equal(kinds, np.bincount(context, minlength=501))


def test_held_out_text_is_likelier_than_by_single_words(spark):
    """Texts of few phrases: what follows a word is not what is frequent."""
    r = np.random.default_rng(6)
    phrases = [" ".join(f"v{k}" for k in r.integers(0, 200, 6)) for _ in range(40)]
    rows = [(i, " ".join(phrases[k] for k in r.integers(0, 40, 12)), "a") for i in range(400)]
    got = G.score_documents(documents(spark, rows), may_teach("doc_id", 10)).collect()
    held = [r for r in got if not teaches(r.doc_id)]
    assert sum(r.score for r in held) > 0.7 * sum(r.base_score for r in held)
