import random

import pytest

from tramline.llm import role_repair as R

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(roles):
    best = []

    def go(k, state, cost):
        if k == len(roles):
            best.append(cost + R.end_cost(state))
        else:
            for price, target, _, _ in R.steps(state, roles[k]):
                go(k + 1, target, cost + price)

    go(0, "start", 0)
    return min(best)


@pytest.mark.parametrize("seed", range(60))
def test_pieces_give_the_cheapest_repair(seed):
    chance = random.Random(seed)
    roles = [chance.choice(["system", "user", "assistant", None]) for _ in range(chance.randint(1, 7))]
    cuts = sorted(chance.sample(range(len(roles) + 1), min(2, len(roles))))
    bounds = [0, *cuts, len(roles)]
    parts = [roles[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    borders, cost = R.border_states([R.piece_costs(p) for p in parts])
    assert cost == cheapest(roles)
    steps = [s for p, a, z in zip(parts, borders, borders[1:], strict=False) for s in R.solve(p, a, z)]
    assert sum(s[0] for s in steps) + R.end_cost(borders[-1]) == cost


def rendered(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (repr(r.conv_id), r.piece)):
        out.setdefault(r.conv_id, []).append(r)
    return out


def roles_of(text):
    return [line[2:-2] for line in text.split("\n") if line.startswith("<|") and line != "<|end|>"]


def test_repaired_conversations_are_legal(spark):
    chance = random.Random(4)
    rows, want = [], {}
    for conv in range(40):
        roles = [chance.choice(["system", "user", "assistant", "tool", None, "Human"]) for _ in range(chance.randint(1, 6))]
        rows += [(conv, k, role, f"t{k}") for k, role in enumerate(roles)]
        want[conv] = cheapest([R.known_role(r) for r in roles])
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for conv, pieces in rendered(R.repair(frame)).items():
        assert sum(p.cost for p in pieces) == want[conv]
        text = "".join(p.rendered for p in pieces)
        roles = roles_of(text)
        assert text.count("<|end|>") == len(roles)
        state = "start"
        for role in roles:
            assert role in R.NEXT[state]
            state = role
        assert state == R.FINAL
        turns = [p.turn for p in pieces if p.turn is not None]
        assert turns == sorted(turns) and len(turns) == sum(r[0] == conv for r in rows)
        assert len({p.piece for p in pieces}) == len(pieces)


def test_legal_conversations_stay(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (2, 0, "user", "q"), (2, 1, "assistant", "r")]
    pieces = rendered(R.repair(spark.createDataFrame(rows, SCHEMA)))
    assert all(p.cost == 0 and p.action == "keep" for ps in pieces.values() for p in ps)
    assert "".join(p.rendered for p in pieces[2]) == "<|user|>\nq\n<|end|>\n<|assistant|>\nr\n<|end|>\n"


def test_one_conversation_over_many_partitions(spark):
    chance = random.Random(8)
    roles = [chance.choice(["user", "assistant", "system"]) for _ in range(3000)]
    rows = [(7, k, role, f"t{k}") for k, role in enumerate(roles)] + [(8, 0, "user", "x")]
    found = R.repair(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    mine = sorted((p for p in found if p.conv_id == 7), key=lambda p: p.piece)
    _, cost = R.border_states([R.piece_costs(roles)])
    assert sum(p.cost for p in mine) == cost
    state = "start"
    for role in roles_of("".join(p.rendered for p in mine)):
        assert role in R.NEXT[state]
        state = role
    assert state == R.FINAL


def test_unusual_rows(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", None), (1, None, None, None), (1, 0, "user", ""), (2, 0, "assistant", "x" * 100_000),
            (3, 0, "user", "same"), (3, 0, "user", "same"), (3, 1, "assistant", "y")]
    frame = spark.createDataFrame([(*r, "z", 5) for r in rows], SCHEMA + ", rendered string, piece long")
    pieces = rendered(R.repair(frame))
    assert set(pieces) == {None, 1, 2, 3}
    for ps in pieces.values():
        assert roles_of("".join(p.rendered for p in ps))[-1] == "assistant"
    assert [p.action for p in pieces[3]] == ["keep", "merge", "keep"]
    assert R.repair(spark.createDataFrame([], SCHEMA)).count() == 0
