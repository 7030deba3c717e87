import pytest

from cohortloom.llm import mixing
from tests.llm.tables import documents, odd_documents


def brute(sizes, weights=(5, 2, 1)):
    """Targets by repeated sharing: cap, share the rest again, until nothing changes."""
    ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % 3] for i, (s, _) in enumerate(ordered)}
    size, full = dict(ordered), set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        w = sum(weight[s] for s in size if s not in full)
        target = {s: 2.0 * size[s] if s in full else weight[s] * left / w for s in size}
        over = {s for s in size if target[s] > 2 * size[s]} - full
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [[("a", 100), ("b", 100), ("c", 100)], [("a", 1), ("b", 1000), ("c", 5)], [("z", 7), (None, 50), ("m", 0), ("k", 9)], [("a", 3)]])
def test_targets(sizes):
    got = {p.source: p.target for p in mixing.targets(sizes)}
    want = brute(sizes)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_no_sources():
    assert mixing.targets([]) == []


def test_odd_rows(spark):
    rows = mixing.mix_report(odd_documents(spark)).collect()
    assert len(rows) == 17
    assert all(0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in rows)
    assert {r.size for r in rows if r.doc_id in (4, 5, 6)} == {0}
    again = mixing.mix_report(odd_documents(spark)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_near_target_and_copies(spark):
    df = documents(spark, [(i, "w " * (1 + i % 37), "abcd"[i % 4]) for i in range(2000)])
    rows = mixing.mix_report(df).collect()
    for s in "abcd":
        own = [r for r in rows if "abcd"[r.doc_id % 4] == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 37
        assert own[0].source_size == sum(r.size for r in own)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    times = {r.doc_id: r.n for r in mixed.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    assert times == {r.doc_id: r.taken // r.size for r in rows if r.taken}


def test_one_hot_draw(spark):
    """All rows share a draw: they are taken together or not."""
    df = documents(spark, [(None, "a b c", "a")] * 9 + [(None, "a b c", "b")] * 3)
    rows = mixing.mix_report(df).collect()
    assert len({r.taken for r in rows if r.source_size == 27}) == 1


def test_empty(spark):
    assert mixing.mix_report(documents(spark, [])).count() == 0
    assert mixing.mix(documents(spark, [])).count() == 0
