"""Undo of selections against a plain stack."""

import random

import pytest

from kinframe.operators import selection as SEL

LOG = "session string, seq long, path string, checked boolean"


def plain(log, keep):
    """What a stack of bounded depth does, step by step."""
    undone, state = set(), {}
    for session in {r[0] for r in log}:
        stack, now = [], {}
        mine = {}
        for r in log:
            if r[0] == session:
                mine.setdefault(r[1], []).append(r)
        for seq in sorted(mine):
            rows = [r for r in mine[seq] if r[2] is not None]
            if rows:
                wanted = {}
                for r in rows:
                    wanted[r[2]] = wanted.get(r[2], False) or r[3]
                stack.append((seq, {p: now.get(p) for p in wanted}))
                del stack[:-keep]
                now.update(wanted)
            elif stack:
                k, old = stack.pop()
                undone.add((session, k))
                now.update(old)
        state.update({(session, p): c for p, c in now.items() if c is not None})
    return undone, state


def random_log(rng, sessions, length, undos, stride):
    log = []
    for s in sessions:
        seq = 0
        for _ in range(length):
            seq += rng.randint(1, stride)
            if rng.random() < undos:
                log.append((s, seq, None, None))
            else:
                log += [(s, seq, f"p{rng.randrange(6)}", rng.random() < 0.5) for _ in range(rng.randint(1, 3))]
    rng.shuffle(log)
    return log


@pytest.mark.parametrize("keep,undos,stride", [(1, 0.5, 1), (3, 0.45, 40_000), (3, 0.3, 1), (7, 0.5, 90_000), (200, 0.4, 5)])
def test_equals_a_stack(spark, keep, undos, stride):
    log = random_log(random.Random(keep), ["a", "b", None], 150, undos, stride)
    undone, state = plain(log, keep)
    df = spark.createDataFrame(log, LOG)
    got = SEL.steps(df, keep).collect()
    assert {(r.session, r.seq) for r in got if r.undone} == undone
    assert len(got) == len({(r[0], r[1]) for r in log})
    assert {(r.session, r.path): r.checked for r in SEL.selected(df, keep).collect()} == state


def test_a_full_memory_forgets_the_first_steps(spark):
    """250 steps and as many undos: the first 50 stay."""
    log = [("s", i, f"p{i}", True) for i in range(250)] + [("s", i, None, None) for i in range(250, 500)]
    got = SEL.steps(spark.createDataFrame(log, LOG)).where("undone").collect()
    assert {r.seq for r in got} == set(range(50, 250))


def test_state_at_a_step_and_over_items(spark):
    log = [("s", 1, "a", True), ("s", 1, "b", True), ("s", 2, "a", False), ("s", 3, None, None), ("t", 1, "a", False)]
    df = spark.createDataFrame(log, LOG)
    items = spark.createDataFrame([("a", False), ("b", False), ("c", True), (None, True)], "path string, checked boolean")
    now = lambda until: {r.path: r.checked for r in SEL.apply_log(items, df, "s", until=until).collect()}
    assert now(1) == {"a": True, "b": True, "c": True, None: True}
    assert now(2) == {"a": False, "b": True, "c": True, None: True}
    assert now(None) == now(1)


def test_a_step_logs_only_what_changes(spark):
    state = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "path string, checked boolean")
    wanted = spark.createDataFrame([("a", True), ("b", True), ("b", False), ("c", False), ("x", True), (None, True)], "path string, checked boolean")
    assert {(r.path, r.checked) for r in SEL.changes(state, wanted).collect()} == {("b", True), ("c", False)}


def test_empty_log(spark):
    empty = spark.createDataFrame([], LOG)
    assert SEL.steps(empty).count() == SEL.selected(empty).count() == 0
    with pytest.raises(ValueError):
        SEL.steps(empty, 0)
