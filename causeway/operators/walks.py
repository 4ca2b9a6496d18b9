"""Walks in a graph that a worker holds whole: the edges are sent once, and no path crosses a shuffle."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

# Fixed value: the most edges a worker holds (about 60 bytes each); operators on larger graphs join instead.
MAX_EDGES = 2_000_000
SEP = " > "
_CELLS, _ROWS = 4_000_000, 50_000  # pairs of a start and a node looked at together; rows handed over together


@dataclass
class Held:
    """Nodes are numbered in the order of their names with SEP behind; the edges of a node lie together, by the number of their end."""

    names: pa.Array
    first: np.ndarray  # of the edges of each node, and their number at last
    dst: np.ndarray
    w: np.ndarray
    bad: np.ndarray
    plain: bool  # no name with SEP begins another with SEP, so that paths are ordered as their nodes are


def hold(edges: DataFrame) -> Held:
    """The edges (src, dst, w, and if there is one bad), one per pair of nodes, on the driver."""
    t = edges.toArrow().combine_chunks()
    src, dst = (t[c].cast(pa.string()) for c in ("src", "dst"))
    known = sorted({x: None for c in (src, dst) for x in c.unique().to_pylist()}, key=lambda x: (x + SEP).encode())
    ends = [(x + SEP).encode() for x in known]
    names = pa.array(known, pa.string())
    a, b = (pc.index_in(c, value_set=names).to_numpy().astype(np.int64) for c in (src, dst))
    order = np.lexsort((b, a))
    bad = t["bad"].to_numpy() if "bad" in t.column_names else np.zeros(len(a), bool)
    return Held(names, np.searchsorted(a[order], np.arange(len(known) + 1)), b[order], t["w"].to_numpy()[order], bad[order].astype(bool), not any(y.startswith(x) for x, y in zip(ends, ends[1:])))


def _rounded(x: float) -> float:
    """x as Spark rounds it to nine places."""
    return float(Decimal(repr(float(x))).quantize(Decimal("1e-9"), ROUND_HALF_UP))


def _ahead(g: Held, end: int, depth: int) -> list[np.ndarray]:
    """For 0 to depth edges: the largest product of weights with which a walk of at most so many edges comes from each node to end; -1 where none does."""
    at = np.full(len(g.names), -1.0)
    at[end] = 1.0
    out, some = [at], np.flatnonzero(np.diff(g.first))
    for _ in range(depth):
        to = out[-1][g.dst]
        nxt = out[-1].copy()
        nxt[some] = np.maximum(nxt[some], np.maximum.reduceat(np.where(to < 0, -1.0, g.w * to), g.first[some]))
        out.append(nxt)
    return out


def heaviest(g: Held, names: list[str], start: int, end: int, ahead: list[np.ndarray], depth: int, most: int) -> Iterator[tuple[str, float]]:
    """The `most` simple paths from start to end of at most depth edges that come first by rounded weight from large to small, then name.

    Open paths wait in the order of the most weight and the first name they
    can still get, so a path that is taken with its end reached comes before
    all that are not yet known.
    """
    heap = [(-np.inf, names[start].encode(), (start,), 1.0)]
    while heap and most:
        _, name, path, weight = heapq.heappop(heap)
        if path[-1] == end:
            yield name.decode(), weight
            most -= 1
            continue
        if len(path) > depth:
            continue
        at = slice(g.first[path[-1]], g.first[path[-1] + 1])
        best = ahead[depth - len(path)][g.dst[at]]
        for i in np.flatnonzero(best >= 0):
            to = int(g.dst[at][i])
            if to not in path:
                w = weight * float(g.w[at][i])
                # products in another order differ in the last places, so what is still open counts a trifle more
                bound = w if to == end else w * float(best[i]) * (1 + 1e-12)
                heapq.heappush(heap, (-_rounded(bound), name + (SEP + names[to]).encode(), (*path, to), w))


def heaviest_paths(g: Held, pairs: DataFrame, depth: int, most: int) -> DataFrame:
    """(start, end, path, weight): heaviest() of each pair (start, end); weight is not rounded yet."""
    sent = pairs.sparkSession.sparkContext.broadcast(g)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        names = g.names.to_pylist()
        number, last, ahead = {x: i for i, x in enumerate(names)}, None, None
        for b in batches:
            for s, e in zip(*(b.column(i).to_pylist() for i in (0, 1))):
                if s not in number or e not in number:
                    continue
                if last != e:
                    last, ahead = e, _ahead(g, number[e], depth)
                if rows := list(heaviest(g, names, number[s], number[e], ahead, depth, most)):
                    yield pa.RecordBatch.from_pydict({"start": [s] * len(rows), "end": [e] * len(rows), "path": [p for p, _ in rows], "weight": [w for _, w in rows]})

    return pairs.select("start", "end").mapInArrow(walk, "start string, end string, path string, weight double")


def _chains(g: Held, starts: np.ndarray, named: bool) -> Iterator[pa.RecordBatch]:
    """shortcuts() of a run of starts, level by level.

    What is known lies in the order of its names, and so do the next nodes of
    each; the first chain that meets a node is therefore the first by name.
    """
    n, k = len(g.names), len(starts)
    deg = np.diff(g.first)
    level, met = np.zeros(k * n, np.int8), np.empty(k * n, np.int64)
    row, node = np.arange(k), starts
    w, bad, via, hops = np.ones(k), np.zeros(k, bool), g.names.take(pa.array(starts)) if named else None, 0
    while len(node):
        many = deg[node]
        up = np.repeat(np.arange(len(node)), many)
        edge = np.arange(len(up)) + np.repeat(g.first[node] - (np.cumsum(many) - many), many)
        edge, up = (x[g.dst[edge] != starts[row[up]]] for x in (edge, up))
        key = row[up] * n + g.dst[edge]
        hops += 1

        def firsts(which: np.ndarray) -> np.ndarray:
            own = np.flatnonzero(which)
            met[key[own][::-1]] = own[::-1]  # of equal keys the first stays
            return own[met[key[own]] == own]

        new = firsts(level[key] == 0)
        # a pair with an edge of its own is reached in one hop; its shortest longer chain is one of two
        again = firsts(level[key] == 1) if hops == 2 else new[:0]
        level[key[new]] = min(hops, 3)
        out = np.concatenate([new, again])
        nodes, rows, ws, bads = g.dst[edge[out]], row[up[out]], w[up[out]] * g.w[edge[out]], bad[up[out]] | g.bad[edge[out]]
        vias = pc.binary_join_element_wise(via.take(pa.array(up[out])), g.names.take(pa.array(nodes)), SEP) if named else None
        if hops > 1:
            good = np.flatnonzero(~bads)
            for i in range(0, len(good), _ROWS):
                at = good[i : i + _ROWS]
                cols = {"src": g.names.take(pa.array(starts[rows[at]])), "dst": g.names.take(pa.array(nodes[at]))} | ({"via": vias.take(pa.array(at))} if named else {}) | {"hops": pa.array(np.full(len(at), hops, np.int64))} | ({"weight": pa.array(ws[at])} if named else {})
                yield pa.RecordBatch.from_pydict(cols)
        go = np.flatnonzero(deg[nodes[: len(new)]] > 0)
        row, node, w, bad, via = rows[go], nodes[go], ws[go], bads[go], vias.take(pa.array(go)) if named else None


def chains(g: Held, spark: SparkSession, named: bool = True) -> DataFrame:
    """(src, dst, via, hops, weight), or (src, dst, hops) unless named: of each pair of nodes its shortest chain of two edges or more, first by name, if none of its edges is bad; weight is not rounded yet."""
    sent = spark.sparkContext.broadcast(g)
    starts = np.flatnonzero(np.diff(g.first))
    run = max(1, _CELLS // max(1, len(g.names)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for i in range(0, len(ids), run):
                yield from _chains(sent.value, starts[ids[i : i + run]], named)

    tasks = max(1, min(len(starts), 8 * spark.sparkContext.defaultParallelism))
    return spark.range(0, len(starts), 1, tasks).mapInArrow(walk, "src string, dst string, via string, hops long, weight double" if named else "src string, dst string, hops long")
