import random

import numpy as np
import pytest

import corpus_pipeline as C
from cohortloom.llm import near_copies as N
from tests.llm.tables import ODD, PROSE, documents, odd_documents


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(b" ".join(words[i:i + 5]) for i in range(len(words) - 4)) or frozenset([b" ".join(words)] if words else [])


def linked(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b) > 0


def kept(rows):
    """Least id of each group, by search over all pairs."""
    own = [(i, shingles(t)) for i, t, _ in rows]
    left, out = set(range(len(own))), []
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            group.add(k := todo.pop())
            near = {j for j in left if linked(own[k][1], own[j][1])}
            left -= near
            todo += near
        out.append(min((own[k][0] is None, own[k][0] or 0) for k in group))
    return sorted(i for none, i in out if not none)


def near_copies(seed=3, bases=30, copies=8):
    """Texts with 0 to 4 replaced, added or dropped words: similarities on both sides of 0.8."""
    r = random.Random(seed)
    rows, common = [], [f"c{i}" for i in range(12)]
    for b in range(bases):
        base = [f"w{r.randrange(4000)}" for _ in range(r.choice([4, 5, 8, 9, 30, 60, 120, 200]))] + (common if b % 3 == 0 else [])
        for _ in range(copies):
            words = list(base)
            for _ in range(r.randint(0, 4)):
                at = r.randrange(len(words))
                words[at:at + 1] = r.choice([[], ["new"], [words[at], f"x{r.randrange(9)}"], [f"y{r.randrange(999)}"]])
            rows.append((len(rows) + 1, " ".join(words), "a"))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("pairs", [4, 0])
def test_equals_all_pairs(spark, monkeypatch, pairs):
    monkeypatch.setattr(N, "SAMPLE", 60)
    monkeypatch.setattr(N, "CROWD", 3)
    monkeypatch.setattr(N, "BUCKET_BYTES", 2000)
    rows = near_copies()
    got = sorted(r.doc_id for r in N.drop_near_copies(documents(spark, rows), pairs_per_entry=pairs).collect())
    assert got == kept(rows)


@pytest.mark.parametrize("frequent", [4, 10**9])
def test_a_shingle_in_half_the_documents(spark, monkeypatch, frequent):
    """A passage that half of the documents share links none of them, also if no sample has shown it."""
    monkeypatch.setattr(N, "CROWD", 16)
    monkeypatch.setattr(N, "FREQUENT", frequent)
    r = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(9))
    rows = [(i, " ".join(f"w{r.randrange(9000)}" for _ in range(40)) + (f" {passage}" if i % 2 else ""), "a") for i in range(200)]
    rows += [(500 + i, rows[i][1] + " more", "b") for i in range(0, 60)]
    assert sorted(x.doc_id for x in N.drop_near_copies(documents(spark, rows)).collect()) == kept(rows) == list(range(200))


def test_stage_drops_planted_near_copies(spark, tmp_path):
    """Some five-word shingles differ, more than 3 bits of 64 as a rule: similarity 0.8 to 0.95."""
    r = random.Random(9)
    rows = []
    for b in range(20):
        words = [f"w{r.randrange(5000)}" for _ in range(150)]
        near = [*words[:40], "edited", *words[41:100], "again", *words[101:]]
        rows += [(b, " ".join(words), "a"), (100 + b, " ".join(near), "b")]
        assert linked(shingles(rows[-1][1]), shingles(rows[-2][1])) and rows[-1][1] != rows[-2][1]
    got = C.near_duplicates_stage(spark, documents(spark, rows), str(tmp_path))
    assert tuple(got.columns) == C.COLUMNS
    assert sorted(x.doc_id for x in got.collect()) == list(range(20))


def test_prefixes_of_linked_sets_meet():
    r = np.random.default_rng(4)
    for _ in range(300):
        n = int(r.integers(4, 80))
        pool = np.unique(r.integers(1, 2**63, 2 * n + 9).astype(np.uint64))
        a = np.sort(r.permutation(pool)[:n])
        b = np.sort(np.unique(np.concatenate([r.permutation(a)[:int(np.ceil(0.9 * n))], r.permutation(pool)[:int(r.integers(0, 1 + n // 9))]])))
        frequent = np.sort(r.permutation(pool)[:n])
        rank = r.permutation(n)
        if not np.array_equal(a, b) and 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)):
            assert len(np.intersect1d(N.prefix(a, frequent, rank), N.prefix(b, frequent, rank)))


def test_odd_rows(spark):
    df = odd_documents(spark)
    got = N.drop_near_copies(df)
    assert got.columns == df.columns
    rows = got.collect()
    assert sorted(x.doc_id for x in rows if x.doc_id is not None) == kept(ODD)
    assert [x.doc_id for x in rows if x.text == PROSE] == [1]


def test_empty(spark):
    assert N.drop_near_copies(documents(spark, [])).count() == 0
    assert N.drop_near_copies(documents(spark, [(None, None, None)] * 3)).count() == 1


def test_fingerprints_link_first(spark, monkeypatch):
    """The stage links by fingerprints and their pivot tables, and only similar texts; the prefixes find the rest."""
    rows = near_copies(bases=12)
    far = " ".join(f"w{i}" for i in range(300))
    rows += [(1001, far, "a"), (1002, far + " more", "a"), (1003, far.upper() + " other", "a")]
    met = []
    whole = N.linked_prints
    monkeypatch.setattr(N, "linked_prints", lambda *args: met.append(whole(*args).collect()) or whole(*args))
    got = sorted(r.doc_id for r in C.near_duplicates_stage(spark, documents(spark, rows), "").collect())
    assert got == kept(rows) and 1001 in got and not {1002, 1003} & set(got)
    own = {N.name_of(N.shingle_set((t or "").lower().encode().split())): shingles(t) for _, t, _ in rows}
    names = {np.uint64(k).view(np.int64).item(): v for k, v in own.items()}
    assert met[0] and all(linked(names[a], names[b]) and names[a] != names[b] for a, b in met[0])


def test_links_grow_with_the_texts(spark, monkeypatch):
    """A crowd of near copies is merged from few links, not from all its pairs, also where every pair meets."""
    r = random.Random(2)
    base = [f"w{r.randrange(9000)}" for _ in range(150)]
    rows = [(i, " ".join([*base[:2 * i], f"own{i}", *base[2 * i + 1:]]), "a") for i in range(60)]
    merged, whole = [], N.connected
    monkeypatch.setattr(N, "connected", lambda edges: merged.append(edges.count()) or whole(edges))
    monkeypatch.setattr(N, "linked_prints", lambda *args: spark.createDataFrame([], "a long, b long"))
    got = sorted(x.doc_id for x in N.drop_near_copies(documents(spark, rows), pairs_per_entry=10**9).collect())
    assert got == kept(rows) == [0]
    assert 59 <= max(merged) <= 10 * len(rows) < 60 * 59 / 2
