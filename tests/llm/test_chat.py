import itertools
import random

import numpy as np
import pytest

from cohortloom.llm import chat as H

SCHEMA = "conv_id long, turn long, role string, text string, action string, rendered string, _run long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def legal(roles):
    if roles[:1] == ["system"]:
        roles = roles[1:]
    return len(roles) >= 2 and len(roles) % 2 == 0 and all(r == ("user", "assistant")[k % 2] for k, r in enumerate(roles))


def brute(roles):
    """Least cost over all choices for a short conversation."""
    best = 10**9
    kinds = ("system", "user", "assistant")
    for acts in itertools.product([(k, m) for k in kinds for m in (False, True)], repeat=len(roles)):
        turns, cost, fine = [], 0, True
        for (kind, merged), role in zip(acts, roles):
            cost += H.RELABEL * (kind != role)
            if merged:
                fine &= bool(turns) and turns[-1] == kind
                cost += H.MERGE
            else:
                turns.append(kind)
            if not fine:
                break
        if not fine or cost >= best:
            continue
        # fewest empty turns that make the turns legal
        for extra in range(0, 2 * len(turns) + 3):
            if cost + H.INSERT * extra >= best:
                break
            if fits(tuple(turns), extra):
                best = cost + H.INSERT * extra
                break
    return best


def fits(turns, extra):
    n = len(turns) + extra
    shapes = [["user", "assistant"] * (n // 2)] if n % 2 == 0 else [["system"] + ["user", "assistant"] * (n // 2)]
    for shape in shapes:
        it = iter(shape)
        if legal(shape) and all(t in it for t in turns):
            return True
    return False


def cost_of(rows):
    return sum(H.MERGE * (r.action == "merge") + H.RELABEL * (r.new_role != r.role) + H.INSERT * r.inserted for r in rows)


def parse(rendered):
    parts = rendered.split("<|")
    return [p.split("|>")[0] for p in parts[1:] if not p.startswith("end")]


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_least_cost(spark, n):
    cases = list(itertools.product(["system", "user", "assistant", "tool"], repeat=n))
    if n == 4:
        cases = random.Random(1).sample(cases, 40)
    rows = [(c, t, r, f"text {t}") for c, roles in enumerate(cases) for t, r in enumerate(roles)]
    got = {}
    for r in H.repair(table(spark, rows)).collect():
        got.setdefault(r.conv_id, []).append(r)
    for c, roles in enumerate(cases):
        own = sorted(got[c], key=lambda r: r.turn)
        assert cost_of(own) == brute(roles), roles
        text = "".join(r.rendered for r in own)
        turns = parse(text)
        assert legal(turns) and len(turns) == sum(r.opened for r in own)
        assert [f"text {t}" in text for t in range(n)] == [True] * n
        assert text.count(H.CLOSE) == len(turns) and text.endswith(H.CLOSE)


def test_legal_conversations_stay(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 5, "user", ""), (2, 9, "assistant", None)]
    got = sorted(H.repair(table(spark, rows)).collect(), key=lambda r: (r.conv_id, r.turn))
    assert all(r.action == "keep" and r.inserted == 0 for r in got)
    assert "".join(r.rendered for r in got if r.conv_id == 1) == "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n<|assistant|>\na<|end|>\n"


def test_runs_join(spark, monkeypatch):
    """A conversation over many blocks and partitions costs what it costs in one piece."""
    r = random.Random(3)
    roles = [r.choice(["user", "user", "assistant", "system", None]) for _ in range(3000)]
    rows = [(7, t, role, f"t{t}") for t, role in enumerate(roles)] + [(c, t, r.choice(["user", "assistant"]), "x") for c in (*range(5), *range(8, 40)) for t in range(5)]
    monkeypatch.setattr(H, "RUN", 64)
    got = H.repair(table(spark, rows).repartition(6)).collect()
    assert len(got) == len(rows)
    own = sorted((x for x in got if x.conv_id == 7), key=lambda x: x.turn)
    codes = [H.STATES.index(x) if x in H.STATES[1:] else 0 for x in roles]
    assert len(own) == 3000
    assert cost_of(own) == int((H.run_cost(np.array(codes))[H.START] + H.END_COST).min())
    turns = parse("".join(x.rendered for x in own))
    assert legal(turns) and len(turns) == sum(x.opened for x in own)


def test_matrices():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 64):
        roles = r.integers(0, 4, n)
        m = H.run_cost(roles)
        step = np.where(np.eye(4), 0, H.FAR)
        for x in roles:
            step = H.join(step, H.STEP[x])
        assert np.array_equal(m, step)
        begin, end = H.chain_states([m])
        steps = H.solve(roles.tolist(), begin, end)
        assert len(steps) == n and steps[-1][0] == end


def test_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (None, 1, None, "b"), (1, None, "user", "c"), (1, None, "user", "c"), (1, None, None, None), (2, 0, "USER", ""), (3, 0, "assistant", "z" * 200_000), (4, 1, "user", "u"), (4, 1, "assistant", "v")]
    got = H.repair(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for c in (None, 1, 2, 3, 4):
        own = sorted((r for r in got if r.conv_id == c), key=lambda r: (r.turn if r.turn is not None else -1, r.role or "", "text"))
        assert all(r.action in ("keep", "relabel", "merge") for r in own)
    assert H.repair(table(spark, [])).count() == 0
