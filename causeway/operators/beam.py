"""The beam search of explain over rules that a worker holds whole: the rules are sent once, and no state crosses a shuffle."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: The most effects and preconditions a worker holds (about 150 bytes each); searches by more rules join instead.
MAX_HELD = 2_000_000
#: How much a task remembers of earlier searches: facts asked for and results (some 100 bytes each).
MAX_REMEMBERED = 1_000_000
_UNIT = 1_000_000_000  # totals are whole numbers of 1e-9, so that sums are exact
_ROWS = 20_000  # rows handed over together


@dataclass
class Held:
    """Rules by number; scopes by number. An effect is (gain, regulation_id, arguments, rule, scope), those of one pred and val from the best to the worst."""

    effects: dict[tuple, list[tuple]]
    pre: list[tuple]  # of each rule its preconditions: (pred, val, arguments)
    counts: dict[tuple, list[tuple]]  # of each pred and val the rules that derive it: (scope, number)
    scopes: list[tuple]
    asked: set[str]  # the preds of preconditions


def _texts(column: pa.Array) -> list[str | None]:
    """The texts of a column, equal ones as one object."""
    d = column.dictionary_encode()
    words = [*d.dictionary.to_pylist(), None]
    return [words[i] for i in d.indices.fill_null(-1).to_numpy(zero_copy_only=False).tolist()]


def _lists(column: pa.Array, e: list) -> list[tuple]:
    """The elements e of a column of arrays as a tuple a row, empty for null."""
    at, out = 0, []
    for n in column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).tolist():
        out.append(tuple(e[at : at + n]) if n else ())
        at += n
    return out


def _pairs(column: pa.Array) -> list[tuple]:
    """The tuples of pairs of a column of PAIRS."""
    flat = column.flatten()
    return _lists(column, list(zip(_texts(flat.field("k")), _texts(flat.field("v")))))


def _facts(column: pa.Array) -> list[tuple]:
    """The tuples of facts (pred, val, arguments) of a column of arrays of FACT."""
    flat = column.flatten()
    return _lists(column, list(zip(_texts(flat.field("pred")), _texts(flat.field("val")), _pairs(flat.field("args")))))


def hold(effects: DataFrame, pre: DataFrame, counts: DataFrame) -> Held:
    """What is asked of the rules, on the driver. effects: pred, val, args, regulation_id, gain, scope; pre: regulation_id, pre (arrays of FACT); counts: pred, val, scope, n."""
    number: dict[tuple, int] = {}
    # equal values are one object, here and in the workers
    seen: dict = {}
    one = lambda x: seen.setdefault(x, x)
    rule: dict[str, int] = {}
    conditions, of, by = [], defaultdict(list), defaultdict(list)
    for b in pre.toArrow().to_batches():
        for k, c in zip(b["regulation_id"].to_pylist(), _facts(b["pre"])):
            rule[k] = len(conditions)
            conditions.append(tuple(one((one(p), one(v), one(a))) for p, v, a in c))
    conditions.append(())
    ids = {k: k for k in rule}
    for b in effects.toArrow().to_batches():
        for p, v, a, k, g, s in zip(_texts(b["pred"]), _texts(b["val"]), _pairs(b["args"]), b["regulation_id"].to_pylist(), b["gain"].to_pylist(), _pairs(b["scope"])):
            of[one(p), one(v)].append((round(g * _UNIT), ids.get(k, k), one(a), rule.get(k, len(rule)), number.setdefault(s, len(number))))
    for v in of.values():
        v.sort(key=lambda e: (-e[0], e[1]))
    for b in counts.toArrow().to_batches():
        for p, v, s, n in zip(_texts(b["pred"]), _texts(b["val"]), _pairs(b["scope"]), b["n"].to_pylist()):
            by[one(p), one(v)].append(one((number.setdefault(s, len(number)), n)))
    return Held(dict(of), conditions, dict(by), list(number), {p[0] for c in conditions for p in c if p[0] is not None})


def _bind(pattern: tuple, target: tuple, bound: tuple) -> tuple | None:
    """The bindings under which the arguments of a pattern are among those of a target, or null; see explain.unify."""
    new = []
    for k, v in pattern:
        there = [y for x, y in target if x == k]
        if not there:
            return None
        if v == "*":
            continue
        if v is not None and v.startswith("?"):
            new.append((v, there[0]))
        elif v not in there:
            return None
    if not new:
        return bound
    out = tuple(dict.fromkeys((*bound, *new)))
    return out if len({k for k, _ in out}) == len(out) else None


def _ordered(x):
    """x so that it can be compared, null first."""
    return tuple(map(_ordered, x)) if isinstance(x, tuple) else (x is not None, x if x is not None else "")


@dataclass
class Memory:
    """Earlier searches with the same parameters. A search is told by its open goals, the number of those that no rule derives and
    the part of the context that scopes name; of the known facts only those matter that it asks for, by pred and value."""

    scoped: set[tuple]  # the pairs of all scopes
    contexts: dict[frozenset, tuple[dict, dict]]  # per context: which scopes fit, how many rules derive a fact
    searches: dict[tuple, dict[frozenset, dict[tuple, list]]]  # by what tells a search: the facts asked for, those known of them, the result
    size: int = 0

    def recall(self, key: tuple, known: tuple) -> list | None:
        for asked, results in self.searches.get(key, {}).items():
            if (x := results.get(_told(asked, known))) is not None:
                return x
        return None

    def keep(self, key: tuple, asked: frozenset, known: tuple, result: list) -> None:
        if self.size > MAX_REMEMBERED:
            self.searches.clear()
            self.size = 0
        by = self.searches.setdefault(key, {})
        self.size += 10 * len(result) + 10 + (0 if asked in by else len(asked))
        by.setdefault(asked, {})[_told(asked, known)] = result


def memory(h: Held) -> Memory:
    return Memory({p for s in h.scopes for p in s}, {}, {})


def _told(asked: frozenset, known: tuple) -> tuple:
    """The known facts that are asked for."""
    return tuple(f for f in known if f[:2] in asked or (f[0], "*") in asked)


def search(h: Held, goals: tuple, known: tuple, context: tuple, beam: int, steps: int, top: int, assumption: int, length: int, most: int, normalised: bool, memory: Memory | None = None) -> list[tuple]:
    """(score, path, assumed) of the best explanations of one observation, scores and costs in units of 1e-9.

    The candidates of a state lie from the best to the worst, and so do their
    totals; the states' lists are merged only until the beam is full. No step is
    made once every state has more open goals than there are steps, as each
    closes one. With a memory a search like an earlier one is not made again.
    """
    goals = tuple(dict.fromkeys(goals))
    if not 0 < len(goals) <= steps:
        return []
    named = lambda g: "|".join(x for x in g[:2] if x is not None)
    # those that no rule derives in any scope need no more than their names
    if not any(g[:2] in h.counts for g in goals):
        return [(-assumption * len(goals), (), tuple(map(named, goals)))] if len(goals) <= most else []
    pairs, fitting, rivals, results, facts = {c for c in context if None not in c}, {}, {}, {}, defaultdict(list)
    if memory is not None:
        scope = frozenset(pairs & memory.scoped)
        fitting, rivals = memory.contexts.setdefault(scope, ({}, {}))
        if len(rivals) > 50_000:
            rivals.clear()
    known = tuple(dict.fromkeys(known))
    for f in known:
        if f[0] in h.asked:
            facts[f[0]].append(f)

    def fits(scope: int) -> bool:
        if (x := fitting.get(scope)) is None:
            x = fitting[scope] = all(p in pairs for p in h.scopes[scope])
        return x

    def count(pred: str, val: str) -> int:
        if (x := rivals.get((pred, val))) is None:
            if (c := h.counts.get((pred, val))) is None:
                return 0
            x = rivals[pred, val] = sum(n for s, n in c if fits(s))
        return x

    def conditions(rule: int, bound: tuple) -> tuple:
        """(bound, goals) by the preconditions of a rule; see explain._preconditions."""
        new = []
        for pred, val, args in h.pre[rule]:
            if args and bound:
                has = dict(bound)
                args = tuple((k, has.get(v, v) if v is not None and v.startswith("?") else v) for k, v in args)
            for f in facts.get(pred, ()):
                if (val == "*" or val == f[1]) and (b := _bind(args, f[2], bound)) is not None:
                    bound = b
                    break
            else:
                new.append((pred, val, args, count(pred, val)))
        return bound, tuple(new)

    goals = [(*g, count(g[0], g[1])) for g in goals]
    bare = tuple(named(g) for g in goals if not g[3])
    if len(bare) > most:
        return []
    open_ = tuple(g for g in goals if g[3])
    if memory is not None:
        like = (open_, len(bare), scope)
        if (x := memory.recall(like, known)) is not None:
            return [(score, path, (*bare, *assumed)) for score, path, assumed in x]
    out, front, past = [], [(assumption * len(bare), (), bare, open_, ())], len(bare)
    heap, at = [], []

    def advance(i: int, j: int) -> bool:
        """The next candidate of a state is put on the heap, if there is one."""
        cost, path, _, bound, goal, _, rules = at[i]
        while j < len(rules):
            gain, key, args, rule, scope = rules[j]
            j += 1
            if key in path or not fits(scope) or (b := _bind(args, goal[2], bound) if args else bound) is None:
                continue
            heapq.heappush(heap, (cost - gain + length, (*path, key), i, j, rule, b))
            return True
        return False

    while True:
        by = (lambda s: max(1, len(s[1]))) if normalised else lambda s: 1
        out += [(s[0], by(s), s[1], s[2]) for s in front if not s[3]]
        front = [s for s in front if s[3]]
        if not any(len(s[3]) <= steps - past for s in front):
            break
        past += 1
        heap.clear()
        at.clear()
        for i, (cost, path, assumed, goals, bound) in enumerate(front):
            k = min(range(len(goals)), key=lambda k: goals[k][3])
            goal = goals[k]
            at.append((cost, path, assumed, bound, goal, (*goals[:k], *goals[k + 1 :]), h.effects.get(goal[:2], ()) if goal[3] and None not in goal[:2] else ()))
            # a goal is assumed only where no rule derives it
            if not advance(i, 0) and len(assumed) < most:
                heapq.heappush(heap, (cost + assumption, path, i, -1, -1, bound))
        taken = []
        while heap and (len(taken) < beam or heap[0][:2] == taken[-1][:2]):
            taken.append(x := heapq.heappop(heap))
            if x[3] >= 0:
                advance(x[2], x[3])
        front = []
        for cost, path, i, j, rule, bound in taken:
            _, _, assumed, _, goal, rest, _ = at[i]
            if j < 0:
                front.append((cost, path, (*assumed, named(goal)), rest, bound))
            else:
                if (r := results.get((rule, bound))) is None:
                    r = results[rule, bound] = conditions(rule, bound)
                front.append((cost, path, assumed, tuple(dict.fromkeys((*r[1], *rest))), r[0]))
        if len(front) > beam:
            front = sorted(front, key=lambda s: (*s[:3], _ordered(s[3]), _ordered(s[4])))[:beam]
    # halves are rounded away from 0
    scored = [(-((2 * cost + n) // (2 * n)) if cost >= 0 else (2 * -cost + n) // (2 * n), path, assumed) for cost, n, path, assumed in out]
    best = sorted(scored, key=lambda x: (-x[0], x[1], x[2]))[:top]
    if memory is not None:
        memory.keep(like, frozenset(p[:2] for rule, _ in results for p in h.pre[rule]), known, [(score, path, assumed[len(bare) :]) for score, path, assumed in best])
    return best


def searched(h: Held, observations: DataFrame, beam: int, steps: int, top: int, assumption_cost: float, length_cost: float, most: int, normalised: bool) -> DataFrame:
    """(observation_id, rank, score, rules, assumed) of each observation: observation_id, goals, known, context."""
    sent = observations.sparkSession.sparkContext.broadcast(h)
    costs = round(assumption_cost * _UNIT), round(length_cost * _UNIT)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, rows = sent.value, []
        earlier = memory(h)
        names = ["observation_id", "rank", "score", "rules", "assumed"]
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.float64(), pa.string(), pa.int64()))], names)
        for b in batches:
            for key, goals, known, context in zip(b.column(0).to_pylist(), *map(_facts, b.columns[1:3]), _pairs(b.column(3))):
                for i, (score, path, assumed) in enumerate(search(h, goals, known, context, beam, steps, top, *costs, most, normalised, earlier)):
                    rows.append((key, i + 1, score / _UNIT, ",".join(path), len(assumed)))
            if len(rows) >= _ROWS:
                yield made()
                rows.clear()
        if rows:
            yield made()

    return observations.select("observation_id", "goals", "known", "context").mapInArrow(walk, "observation_id string, rank long, score double, rules string, assumed long")
