import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortloom.llm import simhash as S
from tests.llm.tables import ODD, PROSE, documents, odd_documents


def fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    codes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def classes(prints):
    """Least index that links reach, by search over all pairs."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(prints))]


def test_fingerprints():
    texts = [t for _, t, _ in ODD] + ["A B C d", "a b c d"]
    assert S.fingerprints_of([(t or "").encode() for t in texts]).tolist() == [fingerprint(t) for t in texts]


def ball(seed=1, centers=60, copies=12):
    r = random.Random(seed)
    out = []
    for _ in range(centers):
        c = r.getrandbits(64)
        for _ in range(copies):
            out.append(c)
            for _ in range(r.randint(0, 3)):
                c ^= 1 << r.randrange(64)
    return sorted(set(out))


def rooted(spark, prints, **options):
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(6)
    found = {r.node: r.root for r in S.connected(S.links(nodes, len(prints), **options)).collect()}
    return [found.get(p, p) for p in signed]


@pytest.mark.parametrize("crowd", [4096, 3])
def test_components(spark, crowd):
    prints = ball()
    got, want = rooted(spark, prints, crowd=crowd), classes(prints)
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want)))


@pytest.mark.parametrize("parts", [4, 5, 6, 8])
def test_masks_lose_no_link(parts):
    masks = S.masks(parts)
    r = random.Random(2)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for _ in range(3):
            b ^= 1 << r.randrange(64)
        assert any(a & m == b & m for m in masks)


def test_parts_grow():
    assert [S.parts_for(n) for n in (0, 10**6, 10**9)] == sorted(S.parts_for(n) for n in (0, 10**6, 10**9)) and S.parts_for(10**9) > 4


def test_pivots_discard_only_far_pairs():
    """The tables may keep a pair that is no link, never drop one."""
    prints = np.array(ball(7, 5, 40), np.uint64)
    a, b = S.stars(np.zeros(len(prints), np.int64), prints)
    parent = S.unite(np.arange(len(prints)), np.searchsorted(prints, a), np.searchsorted(prints, b))
    want = classes(prints.tolist())
    assert len(set(parent.tolist())) == len(set(want)) == len(set(zip(parent.tolist(), want)))


def test_rows(spark):
    rows = S.near_duplicates(odd_documents(spark)).collect()
    assert len(rows) == len(ODD)
    prints = [int(r.fingerprint, 16) for r in rows]
    assert sorted((str(r.doc_id), p) for r, p in zip(rows, prints)) == sorted((str(i), fingerprint(t)) for i, t, _ in ODD)
    root = classes(prints)
    for k, r in enumerate(rows):
        ids = [x.doc_id for x, c in zip(rows, root) if c == root[k] and x.doc_id is not None]
        assert r.component_id == (min(ids) if ids else None)


def test_one_row_of_each_group_stays(spark):
    df = odd_documents(spark)
    kept = S.drop_near_duplicates(df)
    assert kept.columns == df.columns
    rows = kept.select("doc_id", "text").collect()
    root = classes([fingerprint(t) for _, t, _ in ODD])
    assert len(rows) == len(set(root))
    assert sorted(r.doc_id for r in rows if r.text == PROSE) == [1]


def test_large_group_of_copies(spark):
    r = random.Random(5)
    words = [f"w{r.randrange(500)}" for _ in range(400)]
    rows = [(i, " ".join(words if i % 3 else [*words[:-1], f"x{i % 40}"]), "a") for i in range(1500)] + [(5000 + i, f"{i} " * 30 + PROSE[i:], "a") for i in range(50)]
    got = S.near_duplicates(documents(spark, rows))
    prints = {r.doc_id: int(r.fingerprint, 16) for r in got.collect()}
    unique = sorted(set(prints.values()))
    root = dict(zip(unique, classes(unique)))
    want = {}
    for i in sorted(prints):
        want.setdefault(root[prints[i]], i)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: want[root[p]] for i, p in prints.items()}


def test_empty(spark):
    assert S.near_duplicates(documents(spark, [])).count() == 0
    assert S.drop_near_duplicates(documents(spark, [])).count() == 0
    assert S.near_duplicates(documents(spark, [(None, None, None)] * 3)).where(F.col("component_id").isNull()).count() == 3
