"""Minimum-cost repair of the roles of conversations.

Legal conversations are those an automaton accepts: a system turn may open them, then user and
assistant turns alternate, beginning with a user turn and ending with an assistant turn. Every
turn gets a role of the automaton and an action: it opens a turn or is merged into the one before,
under its own role or a new one, and empty turns may be inserted before it and at the end. Each step
has a cost, and dynamic programming over (turn, state) finds the cheapest sequence; of equal ones,
the one with the earliest difference in favour of the state that comes first in ``STATES``.

A conversation may be too long for one task. Rows are therefore range-partitioned by conversation
and turn, and each partition's piece of a conversation is reduced to the cheapest cost from every
state to every state. The pieces of a conversation, one row per partition at most, are combined in
order, which fixes the states between them, and each piece is then solved on its own.

The result has one row per rendered piece of text: a turn of the input, with the mark that opens or
continues its turn, or an inserted empty turn. Read in the order of ``piece``, the texts of a
conversation make up the whole rendered sequence, however long it is.

Results for unusual input: an unknown or null role is no role, so any new role costs the same; a
null text is empty; turns with the same number are ordered by role, then a hash of the text; a null turn number
comes first; rows with a null conversation id are one conversation; an empty table gives no rows.
"""

import json

import pyarrow as pa
from pyspark.sql import functions as F

from .storage import cut, text_of

# States of the automaton (the role of the open turn), roles and their legal steps.
STATES = ("start", "system", "user", "assistant")
NEXT = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
FINAL = "assistant"
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
MERGE, RELABEL, NAME, INSERT = 10, 25, 15, 30
OPEN, CLOSE = "<|{role}|>\n", "\n<|end|>\n"
NEVER = 1 << 60


def known_role(role):
    role = (role or "").strip().lower()
    role = ALIASES.get(role, role)
    return role if role in STATES[1:] else None


def _inserts():
    """From state to state: the cheapest list of empty turns that leads there."""
    paths = {}
    for source in STATES:
        paths[source, source] = ()
        frontier = [source]
        while frontier:
            state = frontier.pop(0)
            for target in NEXT[state]:
                if (source, target) not in paths:
                    paths[source, target] = (*paths[source, state], target)
                    frontier.append(target)
    return paths


INSERTS = _inserts()


def steps(state, role):
    """(cost, new state, merged, inserted roles) of every way to place a turn after ``state``."""
    out = []
    for target in STATES[1:]:
        rename = 0 if role == target else NAME if role is None else RELABEL
        if state == target:
            out.append((MERGE + rename, target, True, ()))
        best = None
        for before in STATES:
            if target in NEXT[before] and (state, before) in INSERTS:
                path = INSERTS[state, before]
                if best is None or len(path) < len(best):
                    best = path
        if best is not None:
            out.append((INSERT * len(best) + rename, target, False, best))
    return out


STEPS = {(s, r): steps(s, r) for s in STATES for r in (*STATES[1:], None)}


def piece_costs(roles):
    """Cheapest cost from every state before the roles to every state after them."""
    table = []
    for source in STATES:
        cost = {source: 0}
        for role in roles:
            new = {}
            for state, so_far in cost.items():
                for price, target, _, _ in STEPS[state, role]:
                    if so_far + price < new.get(target, NEVER):
                        new[target] = so_far + price
            cost = new
        table.append([cost.get(state, NEVER) for state in STATES])
    return table


def end_cost(state):
    return INSERT * len(INSERTS[state, FINAL]) if (state, FINAL) in INSERTS else NEVER


def solve(roles, first, last):
    """The cheapest steps from ``first`` to ``last``, the earliest states first among equals."""
    after = [{last: 0}]
    for role in reversed(roles):
        costs = {}
        for state in STATES:
            best = min((p + after[-1].get(t, NEVER) for p, t, _, _ in STEPS[state, role]), default=NEVER)
            if best < NEVER:
                costs[state] = best
        after.append(costs)
    after.reverse()
    state, out = first, []
    for place, role in enumerate(roles):
        step = min(
            (s for s in STEPS[state, role] if s[1] in after[place + 1]),
            key=lambda s: (s[0] + after[place + 1][s[1]], STATES.index(s[1]), s[2], len(s[3])),
        )
        out.append(step)
        state = step[1]
    return out


def border_states(tables):
    """States before, between and after pieces, from their cost tables in order."""
    after = [[end_cost(s) for s in STATES]]
    for table in reversed(tables):
        after.append([min(min(row[k] + after[-1][k] for k in range(len(STATES))), NEVER) for row in table])
    after.reverse()
    borders = [0]
    for place, table in enumerate(tables):
        row = table[borders[-1]]
        borders.append(min(range(len(STATES)), key=lambda k: (row[k] + after[place + 1][k], k)))
    return [STATES[k] for k in borders], after[0][0]


def _pieces(batches):
    """Runs of one (conversation, part) of sorted rows, as lists of (pos, role, text)."""
    name, rows = None, []
    for batch in batches:
        for conv, part, pos, role, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if rows and name != (conv, part):
                yield name, rows
                rows = []
            name = (conv, part)
            rows.append((pos, role, text))
    if rows:
        yield name, rows


def _out(rows, schema):
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), schema.types, strict=True)], names=schema.names
    )


_REPAIRED = pa.schema([
    ("conv_id", pa.int64()), ("piece", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("action", pa.string()),
    ("cost", pa.int64()), ("rendered", pa.string()),
])


def _render(found, borders, is_last):
    """Rows of one piece. ``piece`` numbers leave room for the empty turns before a row and at the end."""
    (conv, _), rows = found
    state, out = borders[0], []
    for (pos, _, (turn, role, text)), step in zip(rows, solve([known_role(r[1]) for r in rows], *borders), strict=True):
        price, target, merged, inserted = step
        at = pos * 8
        opened = state != "start"
        for empty in inserted:
            out.append((conv, at, None, empty, "insert", INSERT, (CLOSE if opened else "") + OPEN.format(role=empty)))
            at, opened, price = at + 1, True, price - INSERT
        action = "merge" if merged else "keep"
        if known_role(role) != target:
            action = "relabel and merge" if merged else "relabel"
        start = "\n" if merged else (CLOSE if opened else "") + OPEN.format(role=target)
        out.append((conv, at, turn, target, action, price, start + text))
        state = target
    if is_last:
        at = rows[-1][0] * 8 + 7 - len(INSERTS[state, FINAL])
        for empty in INSERTS[state, FINAL]:
            out.append((conv, at, None, empty, "insert", INSERT, CLOSE + OPEN.format(role=empty)))
            at += 1
        conv, at, turn, role, action, price, text = out[-1]
        out[-1] = (conv, at, turn, role, action, price, text + CLOSE)
    return out


def repair(conversations):
    """conv_id, piece, turn, role, action, cost, rendered: pieces of all repaired conversations."""
    text = text_of()
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), text.alias("text"),
    )
    order = ["conv_id", "turn", "role", F.xxhash64("text")]
    placed = cut(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos"), "turn", "role", "text")
    )
    kinds = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("costs", pa.string())])

    def costs(batches):
        for batch in _groups(((conv, part, json.dumps(piece_costs([known_role(r[1]) for r in found])))
                              for (conv, part), found in _pieces(batches)), 2000):
            yield _out(batch, kinds)

    # One row per conversation and partition; a conversation's pieces are at most one per partition.
    tables = placed.select("conv_id", "part", "pos", "role", F.lit("").alias("text")).mapInArrow(costs, "conv_id long, part int, costs string")
    states = pa.schema([("conv_id", pa.int64()), ("parts", pa.list_(pa.int32())), ("borders", pa.list_(pa.string())), ("cost", pa.int64())])

    def between(batches):
        for batch in batches:
            out = []
            for conv, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pieces = sorted(pieces, key=lambda p: p["part"])
                borders, cost = border_states([json.loads(p["costs"]) for p in pieces])
                out.append((conv, [p["part"] for p in pieces], borders, cost))
            if out:
                yield _out(out, states)

    borders = (
        tables.groupBy("conv_id").agg(F.collect_list(F.struct("part", "costs")).alias("pieces"))
        .mapInArrow(between, "conv_id long, parts array<int>, borders array<string>, cost long")
    )
    known = borders.select(
        F.col("conv_id"), F.posexplode("parts").alias("k", "part"), "borders", (F.size("parts") - 1).alias("top")
    ).select(
        F.col("conv_id").alias("c"), F.col("part").alias("p"),
        F.element_at("borders", F.col("k") + 1).alias("first"), F.element_at("borders", F.col("k") + 2).alias("last"),
        (F.col("k") == F.col("top")).alias("is_last"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    joined = placed.join(known, same).select(
        "conv_id", "part", "pos", F.struct("turn", "role", "text").alias("row"), "first", "last", "is_last"
    )

    def finish(batches):
        def solved():
            for (conv, part), found in _solved_pieces(batches):
                first, last, is_last = found[0][3:]
                rows = [(pos, role, (turn, role, words)) for pos, role, (turn, _, words), *_ in found]
                yield from _render(((conv, part), rows), (first, last), is_last)

        for group in _groups(solved(), 4000):
            yield _out(group, _REPAIRED)

    ready = joined.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "pos")
    return ready.mapInArrow(
        finish, "conv_id long, piece long, turn long, role string, action string, cost long, rendered string"
    )


def _solved_pieces(batches):
    name, rows = None, []
    for batch in batches:
        for conv, part, pos, row, first, last, is_last in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            if rows and name != (conv, part):
                yield name, rows
                rows = []
            name = (conv, part)
            rows.append((pos, row["role"], (row["turn"], row["role"], row["text"]), first, last, is_last))
    if rows:
        yield name, rows


def _groups(rows, size):
    group = []
    for row in rows:
        group.append(row)
        if len(group) == size:
            yield group
            group = []
    if group:
        yield group
