"""Branching-time properties of state machines as tables: cycles, satisfaction and the audit of declared properties.

states, initial (model, state), transitions (model, source, target), labels (model, state, proposition). A path ends at a
state without successors: there EX and EG of what follows are decided by that state alone. Formulas are nested tuples, a
bounded configuration: ("p", name), ("true",), ("not", f), ("and" | "or" | "imply", f, g), ("EX" | "AX" | "EF" | "AF" |
"EG" | "AG", f), ("EU" | "AU", f, g).

Models of up to WHOLE rows (states, transitions and labels) come together, each in one row of an Arrow batch, in one shuffle.
Larger ones are searched by joins, a few edges a round: all of them at once, and all subformulas of one height and kind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintweave.sources.work import Work

#: Edges that a round of a search follows before what it found is written.
HOPS = 4
#: Rows of a model that isn't searched by joins, and of the models that Python works on at once.
WHOLE, SLICE = 1024, 1 << 17
LIVENESS = ("liveness", "response", "deadlock_freedom", "progress")
SAFETY = ("safety", "deadlock_freedom", "mutual_exclusion")


def spread(seed: DataFrame, edges: DataFrame, work: Work, hops: int = HOPS) -> DataFrame:
    """(model, state) reached from seed (model, state) along edges (model, source, target), seed included.

    The known states are a growing table of parts, so that a round writes only what is new.
    """
    name, parts = work.name(), 1
    steps = edges.select("model", F.col("source").alias("state"), "target")
    frontier = work.put(seed.select("model", "state").distinct(), name)
    while not frontier.isEmpty():
        waves = [frontier]
        for _ in range(hops):
            waves.append(waves[-1].join(steps, ["model", "state"]).select("model", F.col("target").alias("state")).distinct())
        new = reduce(DataFrame.unionByName, waves[1:]).distinct().join(work.all(frontier, name, parts), ["model", "state"], "left_anti")
        frontier = work.put(new, name, parts)
        parts += 1
    return work.all(frontier, name, parts)


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select("model", F.col("target").alias("source"), F.col("source").alias("target"))


def large_models(tables: list[DataFrame], work: Work, whole: int) -> DataFrame:
    """(model): those with more than so many rows in tables (model, ...)."""
    rows = reduce(DataFrame.unionByName, (x.select("model") for x in tables))
    return work.put(rows.groupBy("model").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > whole).select("model"))


def _cut(batch: pa.RecordBatch, lists: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Slices of a batch in which the lists of some columns hold SLICE items, or which are one row."""
    sizes = np.sum([batch.column(i).value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for i in lists], axis=0)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= SLICE or i + 1 == len(sizes):
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0


def strong(edges: list[tuple]) -> tuple[dict, set]:
    """Of each state with an edge, its strongly connected component's smallest state; and the states on cycles (Tarjan)."""
    after: dict = {}
    for s, t in edges:
        after.setdefault(s, []).append(t)
        after.setdefault(t, [])
    number, low, open_, component, cyclic = {}, {}, [], {}, {s for s, t in edges if s == t}
    for root in after:
        path = [] if root in number else [(root, iter(after[root]))]
        while path:
            s, rest = path[-1]
            if s not in number:
                number[s] = low[s] = len(number)
                open_.append(s)
            t = next((t for t in rest if t not in component), None)
            if t is None:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[s])
                if low[s] == number[s]:
                    at = open_.index(s) if open_[-1] != s else len(open_) - 1
                    own, open_ = open_[at:], open_[:at]
                    component |= dict.fromkeys(own, min(own))
                    cyclic.update(own if len(own) > 1 else ())
            elif t in number:
                low[s] = min(low[s], number[t])
            else:
                path.append((t, iter(after[t])))
    return component, cyclic


def components(states: DataFrame, edges: DataFrame, work: Work, whole: int = WHOLE) -> DataFrame:
    """(model, state, component, cyclic): strongly connected components by their smallest state; cyclic if on a cycle."""
    large = large_models([states, edges], work, whole)
    both = states.select("model", "state", F.lit(None).cast(edges.schema["target"].dataType).alias("target")).unionByName(edges.select("model", F.col("source").alias("state"), "target"))
    edge = F.when(F.col("target").isNotNull(), F.struct("state", "target"))
    rows = both.join(large, "model", "left_anti").groupBy("model").agg(F.collect_set(F.when(F.col("target").isNull(), F.col("state"))).alias("states"), F.collect_list(edge).alias("edges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _cut(batch, (1, 2)):
                owner, state, component, cyclic = [], [], [], []
                for i, (own, sources, targets) in enumerate(zip(*(part.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                    found, on = strong(list(zip(sources, targets, strict=True)))
                    owner += [i] * len(own)
                    state += own
                    component += [found.get(s, s) for s in own]
                    cyclic += [s in on for s in own]
                kind = part.schema.field(1).type.value_type
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())), pa.array(state, kind), pa.array(component, kind), pa.array(cyclic, pa.bool_())], ["model", "state", "component", "cyclic"])

    kinds = [states.schema[x].dataType.simpleString() for x in ("model", "state")]
    found = rows.select("model", "states", "edges.state", "edges.target").mapInArrow(run, f"model {kinds[0]}, state {kinds[1]}, component {kinds[1]}, cyclic boolean")
    if large.isEmpty():
        return found
    return found.unionByName(searched_components(states.join(large, "model", "left_semi"), edges.join(large, "model", "left_semi"), work))


def searched_components(states: DataFrame, edges: DataFrame, work: Work) -> DataFrame:
    """The components of large models, by joins.

    States without an edge from or to their region are trimmed, again and again. In each region that is left, what a pivot
    reaches and what reaches it meet in its component; the other three parts are regions of the next round. Pivots are
    drawn by hash, so that regions shrink evenly.
    """
    every = states.select("model", "state").distinct()
    live = work.put(edges.filter("source <> target").select("model", F.lit(0).cast("long").alias("region"), "source", "target").distinct())
    found = work.put(every.withColumn("component", F.col("state")).limit(0))
    count = live.count()
    while count:
        inner = live.select("model", "region", F.col("source").alias("state")).intersect(live.select("model", "region", F.col("target").alias("state")))
        kept = live
        for end in ("source", "target"):
            kept = kept.join(inner.withColumnRenamed("state", end), ["model", "region", end], "left_semi")
        live, before = work.put(kept), count
        count = live.count()
        if count < before or not count:
            continue
        # nothing to trim: every region splits around its pivot
        keyed = live.select(F.struct("model", "region").alias("model"), "source", "target")
        members = keyed.select("model", F.explode(F.array("source", "target")).alias("state")).distinct()
        pivots = members.groupBy("model").agg(F.min_by("state", F.struct(F.xxhash64("state"), "state")).alias("state"))
        reached = [spread(pivots, e, work).withColumn(flag, F.lit(True)) for e, flag in ((keyed, "fore"), (reverse(keyed), "back"))]
        marked = members.join(reached[0], ["model", "state"], "left").join(reached[1], ["model", "state"], "left").fillna(False, ["fore", "back"])
        marked = work.put(marked)
        own = marked.filter("fore AND back").drop("fore", "back")
        least = own.groupBy("model").agg(F.min("state").alias("component"))
        found = work.put(found.unionByName(own.join(least, "model").select("model.model", "state", "component")))
        rest = marked.filter("NOT (fore AND back)").select("model.model", "state", F.xxhash64("model.region", "fore", "back").alias("region"))
        ends = [rest.select("model", F.col("state").alias(x), F.col("region").alias(f"{x}_region")) for x in ("source", "target")]
        live = live.drop("region").join(ends[0], ["model", "source"]).join(ends[1], ["model", "target"]).filter("source_region = target_region")
        live = work.put(live.select("model", F.col("source_region").alias("region"), "source", "target"))
        count = live.count()
    loops = edges.filter("source = target").select("model", F.col("source").alias("state"))
    many = found.groupBy("model", "component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("model", "component")
    cyclic = found.join(many, ["model", "component"], "left_semi").select("model", "state").unionByName(loops).distinct().withColumn("on", F.lit(True))
    rows = every.join(found, ["model", "state"], "left").join(cyclic, ["model", "state"], "left")
    return rows.select("model", "state", F.coalesce("component", "state").alias("component"), F.coalesce("on", F.lit(False)).alias("cyclic"))


def basis(f: tuple) -> tuple:
    """The same formula by propositions, not, and, or, EX, EU and EG."""
    op, rest = f[0], f[1:]
    if op in ("p", "true"):
        return f
    no = lambda x: x[1] if x[0] == "not" else ("not", x)
    a = basis(rest[0])
    b = basis(rest[1]) if len(rest) > 1 else None
    match op:
        case "not":
            return no(a)
        case "and" | "or" | "EU":
            return (op, a, b)
        case "EX" | "EG":
            return (op, a)
        case "imply":
            return ("or", no(a), b)
        case "AX":
            return no(("EX", no(a)))
        case "EF":
            return ("EU", ("true",), a)
        case "AF":
            return no(("EG", no(a)))
        case "AG":
            return no(("EU", ("true",), no(a)))
        case "AU":
            return no(("or", ("EU", no(b), ("and", no(a), no(b))), ("EG", no(b))))
    raise ValueError(f"unknown operator {op}")


def propositions(f: tuple) -> set[str]:
    return {f[1]} if f[0] == "p" else set().union(*(propositions(x) for x in f[1:]))


def eventuality(f: tuple) -> str | None:
    """universal if progress is claimed on all paths somewhere in f, existential if only on some, None if it isn't."""
    own = {"AF": "universal", "AU": "universal", "EF": "existential", "EU": "existential"}.get(f[0])
    found = {own, *(eventuality(x) for x in f[1:] if isinstance(x, tuple))}
    return "universal" if "universal" in found else "existential" if "existential" in found else None


def violation(f: tuple) -> tuple | None:
    """What a property of the form AG not x excludes."""
    return f[1][1] if f[0] == "AG" and f[1][0] == "not" else None


class Batch:
    """The graph of a batch's models, (states, sources, targets, at, names, starts) of each: a number for each state."""

    def __init__(self, rows: list[tuple]):
        self.first, sources, targets, self.labels, starts, leaves = [0], [], [], {}, [], []
        for states, source, target, at, names, start in rows:
            place = {s: self.first[-1] + i for i, s in enumerate(states)}
            self.first.append(self.first[-1] + len(states))
            leaves += [place[s] for s in source if s in place]
            both = [(place[s], place[t]) for s, t in zip(source, target, strict=True) if s in place and t in place]
            sources += [s for s, _ in both]
            targets += [t for _, t in both]
            starts += [place[s] for s in start if s in place]
            for s, name in zip(at, names, strict=True):
                if s in place:
                    self.labels.setdefault(name, []).append(place[s])
        self.n = self.first[-1]
        self.sources, self.targets = np.array(sources, np.int64), np.array(targets, np.int64)
        self.initial, self.ends = self.mask(starts), ~self.mask(leaves)
        self.known: dict[tuple, np.ndarray] = {}

    def mask(self, places: list[int]) -> np.ndarray:
        out = np.zeros(self.n, bool)
        out[places] = True
        return out

    def before(self, z: np.ndarray) -> np.ndarray:
        """The states from which an edge leads into z."""
        out = np.zeros(self.n, bool)
        out[self.sources[z[self.targets]]] = True
        return out

    def holds(self, f: tuple) -> np.ndarray:
        """The states that satisfy a formula of basis."""
        if f not in self.known:
            self.known[f] = self._holds(f)
        return self.known[f]

    def _holds(self, f: tuple) -> np.ndarray:
        match f:
            case ("true",):
                return np.ones(self.n, bool)
            case ("p", name):
                return self.mask(self.labels.get(name, []))
            case ("not", x):
                return ~self.holds(x)
            case ("and", x, y):
                return self.holds(x) & self.holds(y)
            case ("or", x, y):
                return self.holds(x) | self.holds(y)
            case ("EX", x):
                return self.before(self.holds(x))
            case ("EU", x, y):
                found, new = self.holds(y), self.holds(y)
                while new.any():
                    new = self.before(new) & self.holds(x) & ~found
                    found = found | new
                return found
            case ("EG", x):
                found, kept = None, self.holds(x)
                while found is None or (found != kept).any():
                    found, kept = kept, kept & (self.ends | self.before(kept))
                return found
        raise ValueError(f"unknown operator {f[0]}")


@dataclass
class Machines:
    """States, initial states, transitions and labels of all models; models of up to ``whole`` rows aren't searched by joins."""

    states: DataFrame
    initial: DataFrame
    transitions: DataFrame
    labels: DataFrame
    work: Work
    whole: int = WHOLE

    def _large(self) -> DataFrame:
        return large_models([self.states, self.transitions, self.labels], self.work, self.whole)

    def _of(self, models: DataFrame, names: list[str]) -> Machines:
        """The machines of some models."""
        own = [x.join(models, "model", "left_semi") for x in (self.states, self.initial, self.transitions, self.labels.filter(F.col("proposition").isin(names)))]
        return Machines(*(self.work.put(x) for x in own), self.work, self.whole)

    def _packed(self, large: DataFrame, names: list[str]) -> DataFrame:
        """(model, states, sources, targets, at, names, starts): a row for each model that isn't large."""
        no = lambda x, to: F.lit(None).cast(to).alias(x)
        kind = self.states.schema["state"].dataType
        rows = lambda df, state, **has: df.select("model", F.col(state).alias("state"), *(F.col(has[x]).alias(x) if x in has else no(x, to) for x, to in (("target", kind), ("name", "string"))))
        parts = [rows(self.states, "state"), rows(self.transitions, "source", target="target"), rows(self.labels.filter(F.col("proposition").isin(names)), "state", name="proposition"), rows(self.initial, "state")]
        each = reduce(DataFrame.unionByName, (x.withColumn("k", F.lit(i)) for i, x in enumerate(parts))).join(large, "model", "left_anti")
        of = lambda i, *columns: F.when(F.col("k") == i, F.struct(*columns) if len(columns) > 1 else F.col(columns[0]))
        own = each.groupBy("model").agg(F.collect_set(of(0, "state")).alias("states"), F.collect_list(of(1, "state", "target")).alias("edges"), F.collect_list(of(2, "state", "name")).alias("labels"), F.collect_list(of(3, "state")).alias("starts"))
        return own.select("model", "states", F.col("edges.state").alias("sources"), "edges.target", F.col("labels.state").alias("at"), "labels.name", "starts")

    def satisfied(self, formulas: list[tuple]) -> DataFrame:
        """(node, model, state) where formulas hold; node is a formula's place in the list."""
        roots, names = [basis(f) for f in formulas], sorted(set().union(*map(propositions, formulas)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in _cut(batch, (1, 2, 4)):
                    graph = Batch(list(zip(*(part.column(i).to_pylist() for i in range(1, 7)), strict=True)))
                    owner, states = np.repeat(np.arange(part.num_rows), np.diff(graph.first)), part.column(1).flatten()
                    for node, f in enumerate(roots):
                        at = np.flatnonzero(graph.holds(f))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), node, np.int32)), part.column(0).take(pa.array(owner[at])), states.take(pa.array(at))], ["node", "model", "state"])

        large = self._large()
        kinds = [self.states.schema[x].dataType.simpleString() for x in ("model", "state")]
        found = self._packed(large, names).mapInArrow(run, f"node int, model {kinds[0]}, state {kinds[1]}")
        return found if large.isEmpty() else found.unionByName(self._of(large, names).searched(formulas))

    def judged(self, formulas: list[tuple]) -> DataFrame:
        """(model, told, possible, broken): the formulas' propositions that a state of the model has, and of each formula
        whether a state satisfies it and whether an initial one doesn't."""
        roots, names = [basis(f) for f in formulas], sorted(set().union(*map(propositions, formulas)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in _cut(batch, (1, 2, 4)):
                    rows = list(zip(*(part.column(i).to_pylist() for i in range(1, 7)), strict=True))
                    graph = Batch(rows)
                    count = lambda z: np.diff(np.concatenate([[0], np.cumsum(z)])[graph.first]) > 0
                    flags = [np.stack([count(z) for z in some], axis=1).tolist() for some in ([graph.holds(f) for f in roots], [graph.initial & ~graph.holds(f) for f in roots])]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sorted(set(x[4])) for x in rows], pa.list_(pa.string())), *(pa.array(x, pa.list_(pa.bool_())) for x in flags)], ["model", "told", "possible", "broken"])

        large = self._large()
        found = self._packed(large, names).mapInArrow(run, f"model {self.states.schema['model'].dataType.simpleString()}, told array<string>, possible array<boolean>, broken array<boolean>")
        if large.isEmpty():
            return found
        m = self._of(large, names)
        sat = self.work.put(m.searched(formulas))
        nodes = F.explode(F.sequence(F.lit(0), F.lit(len(formulas) - 1))).alias("node")
        broken = m.initial.select("model", "state", nodes).join(sat, ["model", "node", "state"], "left_anti").select("model", "node").distinct()
        place = lambda rows, name: rows.groupBy("model").agg(F.collect_set("node").alias(name))
        rows = large.join(m.labels.groupBy("model").agg(F.array_sort(F.collect_set("proposition")).alias("told")), "model", "left")
        for name, own in (("possible", sat.select("model", "node").distinct()), ("broken", broken)):
            rows = rows.join(place(own, name), "model", "left")
        flag = lambda name: F.transform(F.sequence(F.lit(0), F.lit(len(formulas) - 1)), lambda i: F.coalesce(F.array_contains(name, i), F.lit(False))).alias(name)
        return found.unionByName(rows.select("model", F.coalesce("told", F.array().cast("array<string>")).alias("told"), flag("possible"), flag("broken")))

    def searched(self, formulas: list[tuple]) -> DataFrame:
        """As satisfied, by joins for all models."""
        every = self.work.put(self.states.select("model", "state").distinct())
        edges = self.work.put(self.transitions.select("model", "source", "target").distinct())
        height: dict[tuple, int] = {}

        def visit(f: tuple) -> int:
            if f not in height:
                height[f] = 1 + max((visit(x) for x in f[1:] if isinstance(x, tuple)), default=0)
            return height[f]

        roots = [basis(f) for f in formulas]
        for f in roots:
            visit(f)
        known: dict[tuple, DataFrame] = {}
        for level in range(1, max(height.values(), default=0) + 1):
            own = [f for f, h in height.items() if h == level]
            for f in own:
                match f:
                    case ("true",):
                        known[f] = every
                    case ("p", name):
                        known[f] = self.labels.filter(F.col("proposition") == name).select("model", "state").distinct().join(every, ["model", "state"], "left_semi")
                    case ("not", x):
                        known[f] = every.join(known[x], ["model", "state"], "left_anti")
                    case ("and", x, y):
                        known[f] = known[x].join(known[y], ["model", "state"], "left_semi")
                    case ("or", x, y):
                        known[f] = known[x].unionByName(known[y]).distinct()
                    case ("EX", x):
                        known[f] = edges.join(known[x].withColumnRenamed("state", "target"), ["model", "target"]).select("model", F.col("source").alias("state")).distinct()
            for op, run in (("EU", self._until), ("EG", self._globally)):
                if some := [f for f in own if f[0] == op]:
                    found = run(some, known, every, edges)
                    known |= {f: found.filter(F.col("node") == i).drop("node") for i, f in enumerate(some)}
            known |= {f: self.work.put(known[f]) for f in own if f[0] in ("and", "or", "not", "EX", "p")}
        out = [known[f].select(F.lit(i).alias("node"), "model", "state") for i, f in enumerate(roots)]
        return reduce(DataFrame.unionByName, out)

    def _within(self, parts: list[DataFrame], edges: DataFrame, ends: tuple[str, ...]) -> DataFrame:
        """Edges whose ends lie in the i-th part, for each i, in a model of their own for each."""
        out = []
        for i, part in enumerate(parts):
            own = edges
            for end in ends:
                own = own.join(part.withColumnRenamed("state", end), ["model", end], "left_semi")
            out.append(own.select(F.struct("model", F.lit(i).alias("node")).alias("model"), "source", "target"))
        return self.work.put(reduce(DataFrame.unionByName, out))

    def _until(self, some: list[tuple], known: dict, every: DataFrame, edges: DataFrame) -> DataFrame:
        steps = self._within([known[f[1]] for f in some], edges, ("source",))
        seeds = reduce(DataFrame.unionByName, (known[f[2]].select(F.struct("model", F.lit(i).alias("node")).alias("model"), "state") for i, f in enumerate(some)))
        return spread(seeds, reverse(steps), self.work).select("model.model", "model.node", "state")

    def _globally(self, some: list[tuple], known: dict, every: DataFrame, edges: DataFrame) -> DataFrame:
        steps = self._within([known[f[1]] for f in some], edges, ("source", "target"))
        inside = self.work.put(reduce(DataFrame.unionByName, (known[f[1]].select(F.struct("model", F.lit(i).alias("node")).alias("model"), "state") for i, f in enumerate(some))))
        ends = every.join(edges.select("model", F.col("source").alias("state")), ["model", "state"], "left_anti")
        stops = inside.join(ends.select(F.col("model").alias("own"), "state"), (F.col("model.model") == F.col("own")) & (inside["state"] == ends["state"]), "left_semi")
        cycles = components(inside, steps, self.work, self.whole).filter("cyclic").select("model", "state")
        return spread(cycles.unionByName(stops), reverse(steps), self.work).select("model.model", "model.node", "state")


def audit(machines: Machines, properties: DataFrame, formulas: dict[str, tuple], check_vacuity: bool = True) -> DataFrame:
    """(model, property, kind, status, reason, orphans) of properties (model, property, kind, expect, note, formula, violation).

    formula and violation name formulas. The first that applies: INVALID without a formula, with propositions that no state
    of the model has, with a liveness kind that claims no progress or only possible progress, or without a violation where
    the kind needs one; VACUOUS if no state of the model satisfies the violation; INVALID if it is expected to fail without a
    note; PASS, REFUTED (fails as expected) or FAIL, by the model's initial states.
    """
    spark = properties.sparkSession
    names = list(formulas)
    derived = [(n, violation(f)) for n, f in formulas.items()]
    extra = [v for _, v in derived if v]
    place = {v: len(names) + i for i, v in enumerate(extra)}
    table = spark.createDataFrame([(n, i, eventuality(formulas[n]), place.get(v), sorted(propositions(formulas[n]))) for i, (n, v) in enumerate(derived)], "formula string, node int, progress string, own_violation int, used array<string>")
    asked = properties.join(F.broadcast(table), "formula", "left").join(F.broadcast(table.select(F.col("formula").alias("violation"), F.col("node").alias("said"))), "violation", "left")
    asked = asked.withColumn("excluded", F.coalesce("said", "own_violation"))
    key = ["model", "property"]
    flag = lambda c, i: F.coalesce(F.get(c, F.col(i)), F.lit(False))
    missing = F.array_except("used", F.coalesce("told", F.array().cast("array<string>")))
    rows = asked.join(machines.judged([*formulas.values(), *extra]), "model", "left")
    rows = rows.withColumns({"orphans": F.when(F.size(missing) > 0, missing), "possible": F.when(flag("possible", "excluded"), True), "broken": F.when(flag("broken", "node"), True)})
    live, safe = F.col("kind").isin(*LIVENESS), F.col("kind").isin(*SAFETY)
    holds, vacuity = F.col("broken").isNull(), F.lit(check_vacuity)
    say = lambda status, reason: F.struct(F.lit(status).alias("status"), reason.alias("reason"))
    why = (
        F.when(F.col("node").isNull(), say("INVALID", F.lit("no formula")))
        .when(F.col("orphans").isNotNull(), say("INVALID", F.lit("undefined proposition")))
        .when(live & F.col("progress").isNull(), say("INVALID", F.lit("no progress claimed")))
        .when(live & (F.col("progress") == "existential"), say("INVALID", F.lit("only possible progress")))
        .when(vacuity & safe & F.col("excluded").isNull(), say("INVALID", F.lit("no violation")))
        .when(vacuity & F.col("excluded").isNotNull() & F.col("possible").isNull(), say("VACUOUS", F.lit("impossible violation")))
        .when(~F.col("expect") & (F.trim(F.coalesce("note", F.lit(""))) == ""), say("INVALID", F.lit("no note")))
        .when(holds & F.col("expect"), say("PASS", F.lit("holds")))
        .when(~holds & ~F.col("expect"), say("REFUTED", F.lit("fails as expected")))
        .otherwise(say("FAIL", F.when(holds, "holds").otherwise("fails")))
    )
    return rows.select(*key, "kind", why.alias("why"), "orphans").select(*key, "kind", "why.status", "why.reason", "orphans")


# Rules of the formal gate by status.
RULES = {"VACUOUS": "FORMAL-PROPERTY-VACUOUS", "INVALID": "FORMAL-PROPERTY-INVALID", "REFUTED": "FORMAL-PROPERTY-REFUTED", "FAIL": "FORMAL-VERIFICATION-FAILED"}


def issues(audited: DataFrame, path: str = "model") -> DataFrame:
    """Issues (gate, severity, path, line, rule_code, message) of what an audit found; a refutation is a warning."""
    rule = F.create_map(*(F.lit(x) for pair in RULES.items() for x in pair))[F.col("status")]
    said = F.concat(F.lit("Property "), "property", F.lit(": "), "reason", F.coalesce(F.concat(F.lit(" ("), F.array_join("orphans", ", "), F.lit(")")), F.lit("")))
    rows = audited.filter("status <> 'PASS'")
    return rows.select(F.lit("Formal").alias("gate"), F.when(F.col("status") == "REFUTED", "WARNING").otherwise("ERROR").alias("severity"), F.col(path).cast("string").alias("path"), F.lit(1).alias("line"), rule.alias("rule_code"), said.alias("message"))
