"""Cycles, satisfaction and audits against loops over small machines."""

import random

import pytest

from lintweave.operators import ctl
from lintweave.sources.work import Work


def machines(rng, n):
    out = {}
    for m in range(n):
        size = rng.randrange(1, 9)
        edges = {(rng.randrange(size), rng.randrange(size)) for _ in range(rng.randrange(2 * size))}
        if rng.random() < 0.4:
            edges |= {(i, (i + 1) % size) for i in range(size)}
        labels = {p: {s for s in range(size) if rng.random() < 0.5} for p in "abc"[: rng.randrange(1, 4)]}
        out[m] = (set(range(size)), {0} if rng.random() < 0.8 else {0, size - 1}, edges, labels)
    return out


def by_hand(machine, f):
    """The operators' fixpoints as they are defined; a path ends where there is no successor."""
    states, _, edges, labels = machine
    after = {s: {t for u, t in edges if u == s} for s in states}
    sat = lambda x: by_hand(machine, x)

    def fix(step, start):
        while (new := step(start)) != start:
            start = new
        return start

    match f:
        case ("true",):
            return states
        case ("p", name):
            return labels.get(name, set())
        case ("not", x):
            return states - sat(x)
        case ("and", x, y):
            return sat(x) & sat(y)
        case ("or", x, y):
            return sat(x) | sat(y)
        case ("imply", x, y):
            return (states - sat(x)) | sat(y)
        case ("EX", x):
            return {s for s in states if after[s] & sat(x)}
        case ("AX", x):
            return {s for s in states if after[s] <= sat(x)}
        case ("EF", x):
            return fix(lambda z: sat(x) | {s for s in states if after[s] & z}, set())
        case ("AF", x):
            return fix(lambda z: sat(x) | {s for s in states if after[s] and after[s] <= z}, set())
        case ("EG", x):
            return fix(lambda z: {s for s in z if not after[s] or after[s] & z}, sat(x))
        case ("AG", x):
            return fix(lambda z: {s for s in z if after[s] <= z}, sat(x))
        case ("EU", x, y):
            return fix(lambda z: sat(y) | {s for s in sat(x) if after[s] & z}, set())
        case ("AU", x, y):
            return fix(lambda z: sat(y) | {s for s in sat(x) if after[s] and after[s] <= z}, set())


def tables(spark, known):
    rows = lambda it, schema: spark.createDataFrame(list(it), schema)
    states = rows(((m, s) for m, x in known.items() for s in x[0]), "model long, state long")
    initial = rows(((m, s) for m, x in known.items() for s in x[1]), "model long, state long")
    edges = rows(((m, s, t) for m, x in known.items() for s, t in x[2]), "model long, source long, target long")
    labels = rows(((m, s, p) for m, x in known.items() for p, own in x[3].items() for s in own), "model long, state long, proposition string")
    return ctl.Machines(states, initial, edges, labels, Work(spark, "ctl"))


def formula(rng, depth):
    if not depth or rng.random() < 0.15:
        return ("p", rng.choice("abcd")) if rng.random() < 0.9 else ("true",)
    op = rng.choice(["not", "and", "or", "imply", "EX", "AX", "EF", "AF", "EG", "AG", "EU", "AU"])
    return (op, *(formula(rng, depth - 1) for _ in range(2 if op in ("and", "or", "imply", "EU", "AU") else 1)))


def test_satisfied(spark):
    rng = random.Random(8)
    known = machines(rng, 40)
    asked = [(op, ("p", "a")) for op in ("EX", "AX", "EF", "AF", "EG", "AG")] + [("AU", ("p", "a"), ("p", "b")), ("EU", ("p", "a"), ("p", "b"))] + [formula(rng, 2) for _ in range(5)] + [formula(rng, 3)]
    got = {tuple(r) for r in tables(spark, known).satisfied(asked).collect()}
    assert got == {(i, m, s) for i, f in enumerate(asked) for m, x in known.items() for s in by_hand(x, f)}


def test_components(spark):
    rng = random.Random(4)
    known = machines(rng, 30)
    # a ring with a tail, two rings with a bridge, a long chain
    ring = lambda a, n: {(a + i, a + (i + 1) % n) for i in range(n)}
    known |= {100: (set(range(26)), {0}, ring(0, 20) | {(i, i + 1) for i in range(19, 25)}, {}), 101: (set(range(20)), {0}, ring(0, 8) | ring(12, 8) | {(i, i + 1) for i in range(7, 12)}, {}), 102: (set(range(15)), {0}, {(i, i + 1) for i in range(14)}, {})}
    t = tables(spark, known)
    want = set()
    for m, (states, _, edges, _) in known.items():
        reach = {s: set() for s in states}
        for _ in states:
            reach = {s: reach[s] | {t for u, t in edges if u == s} | {v for u, t in edges if u == s for v in reach[t]} for s in states}
        want |= {(m, s, min([s, *(t for t in reach[s] if s in reach[t])]), s in reach[s]) for s in states}
    assert {tuple(r) for r in ctl.components(t.states, t.transitions, t.work).collect()} == want


def test_empty(spark):
    t = tables(spark, {1: ({0}, {0}, set(), {"a": {0}})})
    assert [tuple(r) for r in t.satisfied([("EG", ("p", "a")), ("AF", ("p", "b"))]).collect()] == [(0, 1, 0)]
    none = ctl.Machines(t.states.limit(0), t.initial.limit(0), t.transitions, t.labels.limit(0), t.work)
    assert none.satisfied([("AG", ("p", "a"))]).count() == 0


LOOP = ({0, 1, 2}, {0}, {(0, 1), (1, 0), (1, 2), (2, 2)}, {"idle": {0}, "busy": {1}, "done": {2}, "bad": set()})
P = lambda n: ("p", n)
CASES = [
    # name, kind, expect, note, formula, violation, status, reason
    ("no_bad", "safety", True, None, ("AG", ("not", ("and", P("idle"), P("busy")))), None, "VACUOUS", "impossible violation"),
    ("no_done", "safety", True, None, ("AG", ("not", P("done"))), None, "FAIL", "fails"),
    ("no_done_known", "safety", False, "a task may end", ("AG", ("not", P("done"))), None, "REFUTED", "fails as expected"),
    ("no_note", "safety", False, "  ", ("AG", ("not", P("done"))), None, "INVALID", "no note"),
    ("unknown", "safety", True, None, ("AG", ("not", P("panic"))), None, "INVALID", "undefined proposition"),
    ("invariant", "liveness", True, None, ("AG", ("not", P("done"))), None, "INVALID", "no progress claimed"),
    ("possible", "liveness", True, None, ("AG", ("EF", P("done"))), None, "INVALID", "only possible progress"),
    ("inevitable", "liveness", True, None, ("AF", P("done")), None, "FAIL", "fails"),
    ("starts", "liveness", True, None, ("AG", ("imply", P("idle"), ("AF", P("busy")))), None, "PASS", "holds"),
    ("shapeless", "safety", True, None, ("AG", ("EX", ("true",))), None, "INVALID", "no violation"),
    ("no_deadlock", "safety", True, None, ("AG", ("EX", ("true",))), ("not", P("busy")), "PASS", "holds"),
    ("holds_after_all", "reach", False, "said", ("EF", P("done")), None, "FAIL", "holds"),
    ("nothing", "safety", True, None, None, None, "INVALID", "no formula"),
]


@pytest.mark.parametrize("vacuity", [True, False])
def test_audit(spark, vacuity):
    t = tables(spark, {7: LOOP})
    formulas = {n: f for n, *_, f, _, _, _ in CASES if f} | {f"{n}!": v for n, *_, v, _, _ in CASES if v}
    rows = [(7, n, kind, expect, note, n if f else None, f"{n}!" if v else None) for n, kind, expect, note, f, v, _, _ in CASES]
    done = ctl.audit(t, spark.createDataFrame(rows, "model long, property string, kind string, expect boolean, note string, formula string, violation string"), formulas, vacuity)
    got = {r.property: (r.status, r.reason) for r in done.collect()}
    want = {n: (status, reason) for n, *_, status, reason in CASES}
    if not vacuity:
        want |= {"no_bad": ("PASS", "holds"), "shapeless": ("PASS", "holds")}
    assert got == want
    found = {r.message: (r.severity, r.rule_code) for r in ctl.issues(done).collect()}
    assert found["Property unknown: undefined proposition (panic)"] == ("ERROR", "FORMAL-PROPERTY-INVALID")
    assert found["Property no_done_known: fails as expected"] == ("WARNING", "FORMAL-PROPERTY-REFUTED") and "Property starts: holds" not in found


@pytest.mark.parametrize("whole", [0, 12])
def test_large_models(spark, whole):
    """Models that are searched by joins, and both kinds at once, equal those that come whole."""
    rng = random.Random(5)
    known = machines(rng, 12)
    t = tables(spark, known)
    asked = {"until": ("AU", P("a"), P("b")), "ever": ("AF", P("a")), "calm": ("AG", ("not", P("b"))), "next": ("EX", P("d"))}
    rows = spark.createDataFrame([(m, n, "other", True, None, n, None) for m in known for n in asked], "model long, property string, kind string, expect boolean, note string, formula string, violation string")
    there = ctl.Machines(t.states, t.initial, t.transitions, t.labels, t.work, whole)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(ctl.audit(there, rows, asked), ctl.audit(t, rows, asked))
    assert same(ctl.components(t.states, t.transitions, t.work, whole), ctl.components(t.states, t.transitions, t.work))


def test_small_models_without_rounds(spark, monkeypatch):
    monkeypatch.setattr(ctl, "spread", lambda *a, **k: pytest.fail("a round of joins"))
    t = tables(spark, {7: LOOP})
    assert t.satisfied([("AF", P("done")), ("EF", P("done"))]).count() == 4
    assert ctl.components(t.states, t.transitions, t.work).count() == 3
