import zlib
from functools import cache

import numpy as np
import pytest

from cohortloom.llm import packing as P
from cohortloom.llm.tokens import WordTokens
from tests.llm.tables import ODD, PROSE, documents, odd_documents

tokenizers = pytest.importorskip("tokenizers")
PATH = P.tokenizer_path()
STRANGE = ["I'll don't it's <|endoftext|> a<|startoftext|>b", "É é ÀÇ ſ ΑΣ Σ ς İstanbul x_y_z !!?? 12ab34 \x1c\x85 　z", "日本語テキスト test. a!!b \x0b\x0c z's 'S", " ́x ý", "ﬁ ×a×b÷ Aª º a‍b ​ q",
           "word's, (word) [word]; WORD%%% wörd&&& naïve... éa", "  x y"]


@cache
def tokenizer():
    return tokenizers.Tokenizer.from_file(PATH)


def whole(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def test_words_give_the_ids_of_the_whole_text():
    texts = [t or "" for _, t, _ in ODD] + STRANGE
    ids, counts = WordTokens(PATH).ids([t.encode() for t in texts])
    at = 0
    for t, n in zip(texts, counts.tolist()):
        assert ids[at:at + n].tolist() == whole(t)
        at += n


def check(rows, expected, capacity=P.CAPACITY):
    """Pieces are those of the texts, and sequences are gapless and not too long."""
    want = sorted((str(i), k // capacity, k, min(capacity, len(ids) - k), zlib.crc32(np.array(ids[k:k + capacity], "<u4").tobytes())) for i, ids in expected for k in range(0, len(ids), capacity))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("options", [{}, {"shard": 4, "islands": 3, "rounds": 3}])
def test_odd_rows(spark, options):
    rows = P.pack(odd_documents(spark), PATH, **options).collect()
    check(rows, [(i, whole(t) + [1]) for i, t, _ in ODD])


def test_few_sequences(spark):
    texts = [(i, " ".join(["word"] * (5 + (i * 37) % 90)), "a") for i in range(600)]
    rows = P.pack(documents(spark, texts), PATH, capacity=128, shard=150).collect()
    used = check(rows, [(i, whole(t) + [1]) for i, t, _ in texts], 128)
    assert used <= 1.02 * -(-sum(r.length for r in rows) // 128) + 1


def test_empty(spark):
    assert P.pack(documents(spark, []), PATH).count() == 0


def test_crossover_keeps_every_piece_once():
    r = np.random.default_rng(1)
    length = np.sort(r.integers(1, 60, 300))[::-1].tolist()
    a = P.packed(list(range(300)), length, 100)
    b = P.packed(r.permutation(300).tolist(), length, 100)
    for _ in range(20):
        child = P.crossover(a, b, length, 100, r)
        assert sorted(i for x in child for i in x) == list(range(300))
        assert all(sum(length[i] for i in x) <= 100 for x in child)
        a = child


def test_evolution_never_gets_worse_and_repeats():
    r = np.random.default_rng(2)
    length = np.sort(r.integers(20, 60, 200))[::-1].tolist()
    start = P.packed(list(range(200)), length, 100)
    one, two = (P.evolve(length, [], 100, [1, 2], 20) for _ in range(2))
    assert one == two and P.fitness(one[0], length, 100) <= P.fitness(start, length, 100)
    assert P.from_bytes(P.to_bytes(one, 200), 200)[0] is not None
    assert [sorted(b) for b in P.from_bytes(P.to_bytes(one, 200), 200)[0]] == [sorted(b) for b in one[0]]


def test_prose_fits(spark):
    rows = P.pack(documents(spark, [(i, PROSE, "a") for i in range(50)]), PATH).collect()
    assert check(rows, [(i, whole(PROSE) + [1]) for i in range(50)]) == 1


def triplets(seed=0, many=60, capacity=1000):
    """Lengths that fill ``many`` sequences to the brim, three by three; best fit decreasing misses that by far."""
    r = np.random.default_rng(seed)
    out = []
    for _ in range(many):
        a = int(r.integers(380, 490))
        b = int(r.integers(250, (capacity - a) // 2 + 1))
        out += [a, b, capacity - a - b]
    return sorted(out, reverse=True)


def test_islands_beat_best_fit_decreasing(monkeypatch):
    made = []
    original = P.crossover
    monkeypatch.setattr(P, "crossover", lambda *a: made.append(1) or original(*a))
    for seed in range(4):
        length = triplets(seed)
        plain = P.packed(list(range(len(length))), length, 1000)
        own = P.evolve(length, [], 1000, [seed, 0, 0])
        assert len(own[0]) <= len(plain) - 2 and sorted(i for b in own[0] for i in b) == list(range(len(length)))
        assert all(sum(length[i] for i in b) <= 1000 for b in own[0])
    assert len(made) == 4 * P.GENERATIONS


def test_packing_beats_best_fit_decreasing(spark):
    length = triplets(1)
    texts = [(i, " ".join(["word"] * (n - 1)), "a") for i, n in enumerate(length)]
    rows = P.pack(documents(spark, texts), PATH, capacity=1000).collect()
    used = check(rows, [(i, whole(t) + [1]) for i, t, _ in texts], 1000)
    assert 60 <= used <= len(P.packed(list(range(len(length))), length, 1000)) - 2
