"""Parent-child rows of unknown depth to full hierarchies, with cycle detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.text import reference_key
from causeway.session import discard, materialize, materialize_counted
from causeway.skew import HOT_ROWS, salted_join


def latest_state(df: DataFrame, key: str, version: str, tie: list[str]) -> DataFrame:
    """One row per key: the one with the greatest version (null versions are oldest), ties by the greatest `tie` columns.

    An aggregate with partial combination, so a key repeated in a third of all rows is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in (key, version, *tie)]
    best = F.max(F.struct(F.col(version), *[F.col(c) for c in tie], *[F.col(c) for c in rest])).alias("__best")
    return df.groupBy(key).agg(best).select(key, *[F.col("__best")[c].alias(c) for c in (version, *tie, *rest)])


def edges(df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(id, key, parent): the parent is the key of an existing row or null.

    Rows with a null id are no nodes. References are compared in the form of
    reference_key. Ids whose keys are equal are one node, named by the smallest id.
    """
    nodes = df.select(F.col(id_col).alias("id"), reference_key(F.col(id_col)).alias("key"), reference_key(F.col(parent_col)).alias("parent")).where("key is not null")
    nodes = nodes.groupBy("key").agg(F.min(F.struct("id", "parent")).alias("v")).select("key", "v.id", "v.parent")
    known = nodes.select(F.col("key").alias("parent"), F.lit(True).alias("known"))
    # a parent may be named by a third of all rows
    return salted_join(nodes, known, ["parent"], "left").select("id", "key", F.when(F.col("known"), F.col("parent")).alias("parent"))


def roots_and_depths(edge: DataFrame, with_path: bool = False) -> DataFrame:
    """(id, key, root_id, depth[, path]) for each node of edges().

    Levels spread from the roots by joins of the unfinished frontier with the
    nodes its links end at: a link that ends at a finished node takes over its
    root, depth and path, any other is extended by the link it meets, so each
    round finishes twice as many levels as the one before and a chain of n
    links takes log2(n) joins. A round that finishes nothing proves that what
    is left never reaches a root: those nodes lie on or run into a cycle and
    get depth -1 and, as root, the smallest id of that cycle. A root has depth
    0 and itself as root. path: ids from the node to its root, null where the
    depth is -1.

    Empty input gives an empty result. Each round is written to the shared
    folder, so no plan grows with the depth and lost executors cost one round.
    """
    start = edge.select(
        "id",
        "key",
        F.coalesce("parent", "key").alias("link"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"),
        F.col("parent").isNull().alias("done"),
        *([F.array("id").alias("path")] if with_path else []),
    )
    start, n = materialize_counted(start, "nodes", open=F.count_if(~F.col("done")), all=F.count("*"))
    total = n["all"]
    # finished nodes are kept per round and only joined as a union
    finished, front, left = [start.where("done")], start.where("not done"), n["open"]
    while left:
        ends = finished[0]
        for f in finished[1:]:
            ends = ends.unionByName(f)
        cols = ["key", "link", "depth", "done", *(["path"] if with_path else [])]
        ends = ends.select(cols).unionByName(front.select(cols))
        ends = ends.select(F.col("key").alias("link"), F.col("link").alias("__link"), F.col("depth").alias("__depth"), F.col("done").alias("__done"), *([F.col("path").alias("__path")] if with_path else []))
        step = _join(front.drop("done"), ends, left).select(
            "id", "key", F.col("__link").alias("link"), (F.col("depth") + F.col("__depth")).alias("depth"), F.col("__done").alias("done"), *([F.concat("path", "__path").alias("path")] if with_path else [])
        )
        step, n = materialize_counted(step, "level", done=F.count_if("done"), open=F.count_if(~F.col("done")))
        if not n["done"]:
            break
        finished.append(step.where("done"))
        front, left = step.where("not done"), n["open"]
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    names = edge.select(F.col("key").alias("link"), F.col("id").alias("root_id"))
    keep = ["id", "key", "root_id", "depth", *(["path"] if with_path else [])]
    out = _join(out, names, total).select(keep)
    if left:
        stuck = _cycle_roots(edge.join(front.select("key"), "key", "leftsemi"), left)
        out = out.unionByName(stuck.select("id", "key", "root_id", F.lit(-1).cast("long").alias("depth"), *([F.lit(None).cast("array<string>").alias("path")] if with_path else [])))
    return out


def _join(rows: DataFrame, ends: DataFrame, n: int) -> DataFrame:
    """rows join ends on link, unique in ends; where the n rows suffice for a hot link, with salt."""
    return salted_join(rows, ends, ["link"]) if n >= HOT_ROWS else rows.join(ends, "link")


def _cycle_roots(edge: DataFrame, n: int) -> DataFrame:
    """(id, key, root_id) of nodes that all lead to cycles: the smallest id on the cycle.

    Links are doubled until they are at least n long; then each ends on its
    cycle, and the smallest id over the n steps from there is the cycle's.
    """
    state = materialize(edge.select("id", "key", F.col("parent").alias("link"), F.col("id").alias("least")), "cycle")
    length = 1
    while length < n:
        ends = state.select(F.col("key").alias("link"), F.col("link").alias("__link"), F.col("least").alias("__least"))
        new = materialize(state.join(ends, "link").select("id", "key", F.col("__link").alias("link"), F.least("least", "__least").alias("least")), "cycle")
        discard(state)
        state, length = new, 2 * length
    ends = state.select(F.col("key").alias("link"), F.col("least").alias("root_id"))
    return state.join(ends, "link").select("id", "key", "root_id")


def descendants(edge: DataFrame) -> DataFrame:
    """(ancestor_id, id, distance): every ancestor-descendant pair outside cycles.

    Read off the finished paths, so the pairs need no further join.
    """
    paths = roots_and_depths(edge, with_path=True).where("depth > 0")
    return paths.select("id", F.posexplode("path").alias("distance", "ancestor_id")).where("distance > 0").select("ancestor_id", "id", F.col("distance").cast("long").alias("distance"))


def hierarchy_found(df: DataFrame, id_col: str, parent_col: str, version: str, tie: str) -> DataFrame:
    """(id, root_id, depth) for each row that has a parent; see roots_and_depths."""
    now = latest_state(df.select(id_col, parent_col, version, tie), id_col, version, [tie])
    # read by every round, so computed once
    edge = materialize(edges(now, id_col, parent_col), "edges")
    return roots_and_depths(edge).where("depth <> 0").select("id", "root_id", "depth")
