"""Long spans that stand verbatim in several documents, and the fuzzy passages around them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.rolling import code_points, mix, window_hashes
from causeway.session import discard, materialize
from causeway.skew import hot_of_counts, salted_join

#: The least length of a span, and the length of the seeds: every span holds a whole run of
#: SPAN - SEED + 1 seeds, of which exactly one is elected.
SPAN, SEED = 160, 80
#: Characters of several texts, and windows of one text, handled at once in a Python worker.
_BATCH_CHARS, _BLOCK_WINDOWS = 1 << 20, 1 << 22
#: Of a hash the leading bits decide an election, and the place inside the block decides ties.
_POSITION_BITS = 26
#: Chaining: what a match is worth per character, and what a gap costs per character of it and of its skew.
GAP_COST, SKEW_COST = 0.05, 0.25
#: Gaps up to this many characters on both sides are aligned; longer ones end a passage.
MAX_GAP = 400


def elected(points: np.ndarray, ends: np.ndarray, span: int = SPAN, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(seed hash, segment hash, text, start of the segment, windows in it) of texts that stand one after another in points.

    ends: where each text ends. Every window of `span` characters of a text
    elects the seed with the smallest hash inside it, of equals the first. The
    windows that elect the same seed are neighbours; together they make that
    seed's segment. Which seed a window elects depends on its characters only,
    so equal windows of two texts elect equal seeds at equal places.
    """
    starts_of = np.r_[0, ends[:-1]].astype(np.int64)
    n_windows = len(points) - span + 1
    runs = [_runs(points, ends, lo, min(lo + _BLOCK_WINDOWS, n_windows), span, seed) for lo in range(0, max(0, n_windows), _BLOCK_WINDOWS)]
    if not runs:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    at, text, first, last, h, head, tail = (np.concatenate(x) for x in zip(*runs, strict=True))
    # a run that goes on in the next block is one
    begins = np.ones(len(at), dtype=bool)
    begins[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (first[1:] != last[:-1] + 1)
    ends_ = np.r_[begins[1:], True] if len(at) else begins
    at, text, first, h, head, last, tail = at[begins], text[begins], first[begins], h[begins], head[begins], last[ends_], tail[ends_]
    n = last - first + 1
    # a segment is its first and last window, and how far apart they are
    key = mix(head * np.uint64(3) + mix(tail + n.astype(np.uint64)))
    return h, key, text, first - starts_of[text], n


def _runs(points: np.ndarray, ends: np.ndarray, lo: int, hi: int, span: int, seed: int) -> tuple[np.ndarray, ...]:
    """(place of the seed, text, first window, last window, seed hash, hashes of both windows) of the runs of windows lo..hi that elect one seed."""
    h, whole = window_hashes(points[lo : hi + span - 1], seed, span)
    w, bits = span - seed + 1, np.uint64((1 << _POSITION_BITS) - 1)
    # the smallest (leading bits of the hash, position) of w neighbours, from those of 2, 4, 8, ...
    best, size = (h & ~bits) | np.arange(len(h), dtype=np.uint64), 1
    while size * 2 <= w:
        best, size = np.minimum(best[:-size], best[size:]), size * 2
    if w > size:
        best = np.minimum(best[: len(h) - w + 1], best[w - size : len(h) - size + 1])
    at = (best & bits).astype(np.int64)
    place = np.arange(lo, hi)
    text = np.searchsorted(ends, place, side="right")
    inside = place + span <= ends[text]
    change = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(inside & np.r_[True, change | ~inside[:-1]])
    last = np.flatnonzero(inside & np.r_[change | ~inside[1:], True])
    return at[first] + lo, text[first], first + lo, last + lo, h[at[first]], whole[first], whole[last]


_SEEDS = "seed long, seg long, doc {kind}, start int, n int"


def _groups(lengths: list[int]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, n in enumerate(lengths):
        size += n
        if size >= _BATCH_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def _seed_rows(span: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _groups([len(t) for t in texts]):
                part = texts[lo:hi]
                hashes, key, text, start, n = elected(code_points("".join(part)), np.cumsum([len(t) for t in part]), span, seed)
                doc = batch.column(0).take(pa.array(text + lo))
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(key.view(np.int64)), doc, pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["seed", "seg", "doc", "start", "n"])

    return run


_ENDS = ("lo_doc", "lo_start", "hi_doc", "hi_start")


def _window_rows(span: int):
    """The windows of chosen segments: (key, seed, seg, j, lo_doc, lo_start, hi_doc, hi_start) for each window j of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, js = [], [], []
            segs = batch.column(1)
            flat = segs.flatten()
            start, n = flat.field("start").to_pylist(), flat.field("n").to_pylist()
            k = 0
            for text, size in zip(batch.column(0).to_pylist(), np.diff(segs.offsets.to_numpy()), strict=True):
                for i in range(k, k + int(size)):
                    (h,) = window_hashes(code_points(text[start[i] : start[i] + n[i] + span - 1]), span)
                    keys.append(h.view(np.int64))
                    rows.append(np.full(len(h), i))
                    js.append(np.arange(len(h)))
                k += int(size)
            if not keys:
                continue
            take, j = pa.array(np.concatenate(rows)), np.concatenate(js)
            col = {c: flat.field(c).take(take) for c in ("seed", "seg", *_ENDS)}
            for c in ("lo_start", "hi_start"):
                col[c] = pa.array(col[c].to_numpy() + j.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), col["seed"], col["seg"], pa.array(j.astype(np.int32)), *[col[c] for c in _ENDS]], names=["key", "seed", "seg", "j", *_ENDS])

    return run


def needed_texts(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows (doc, text) of docs (doc): filtered before the texts are moved for a join."""
    return rows.join(materialize(docs.distinct(), "needed"), "doc", "leftsemi")


def shared_members(docs: DataFrame, span: int = SPAN, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(passage, doc, start, length): the passages that several documents hold, with every place where each holds them.

    The whole relation behind shared_matches, which names one partner only: two
    documents share a span exactly if they are in a passage together. A passage
    is a segment or, where segments differ, a window of one; so a document has
    no more rows than windows, and no pairs are made.
    """
    return _shared(docs, span, seed, doc_id, text)[1]


def shared_matches(docs: DataFrame, span: int = SPAN, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, partner, a, b, n): characters a..a+n of doc are characters b..b+n of partner, n >= span.

    The matches of joined seeds: for every window of `span` characters of a
    document that stands in another document too, some match covers it. For
    each only one other document is named, the first or, for that one itself,
    the last to hold it, so the matches of a passage that a third of all
    documents share grow with the number of documents and not with its square.

    1. Seeds are elected (about one per 40 characters) and those of a single
       document are dropped, by counts combined before the shuffle.
    2. Occurrences whose whole segment is the same are one class. A class with
       two documents is a match as it is.
    3. A seed of several classes marks where passages begin and end: there the
       windows of one member of each class are compared one by one.
    4. What a class found goes back to its members by a join with salted hot keys.
    """
    return _shared(docs, span, seed, doc_id, text)[0]


def _shared(docs: DataFrame, span: int, seed: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """shared_matches() and shared_members() over the same tables."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= span))
    seeds = materialize(rows.mapInArrow(_seed_rows(span, seed), _SEEDS.format(kind=kind)), "seeds")
    counts = seeds.groupBy("seed").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("c"))
    shared = materialize(counts.where("lo <> hi").select("seed", "c"), "shared-seeds")
    members = materialize(salted_join(seeds, shared.select("seed"), ["seed"], "leftsemi", hot=hot_of_counts(shared, ["seed"], "c")), "seed-members")
    discard(seeds)
    place = F.struct("doc", "start", "n")
    classes = members.groupBy("seed", "seg").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count("*").alias("c"))
    classes = materialize(classes, "segment-classes")
    whole = classes.where("lo.doc <> hi.doc").select("seed", "seg", F.lit(0).alias("j"), "lo.n", F.struct("lo.doc", "lo.start").alias("lo"), F.struct("hi.doc", "hi.start").alias("hi"))
    # seeds with several classes: the windows of one member of each
    several = classes.groupBy("seed").agg(F.count("*").alias("k"))
    at = salted_join(classes, several.where("k > 1").select("seed"), ["seed"], "leftsemi", hot=hot_of_counts(several, ["seed"], "k"))
    ends = F.struct("seed", "seg", F.col("lo.start").alias("start"), "lo.n", F.col("lo.doc").alias("lo_doc"), F.col("lo.start").alias("lo_start"), F.col("hi.doc").alias("hi_doc"), F.col("hi.start").alias("hi_start"))
    wanted = materialize(at.groupBy(F.col("lo.doc").alias("doc")).agg(F.collect_list(ends).alias("segs")), "wanted")  # at most a document's seeds
    texts = needed_texts(rows, wanted.select("doc"))
    windows = wanted.join(texts, "doc").select("text", "segs").mapInArrow(_window_rows(span), f"key long, seed long, seg long, j int, lo_doc {kind}, lo_start int, hi_doc {kind}, hi_start int")
    windows = materialize(windows, "windows")
    lo, hi = F.struct(F.col("lo_doc").alias("doc"), F.col("lo_start").alias("start")), F.struct(F.col("hi_doc").alias("doc"), F.col("hi_start").alias("start"))
    same = windows.groupBy("key").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.count("*").alias("c")).where("lo.doc <> hi.doc")
    same = materialize(same, "shared-windows")
    # a class with two documents has its match already
    open_ = windows.where("lo_doc = hi_doc").select("seed", "seg", "j", "key")
    single = salted_join(open_, same.drop("c"), ["key"], hot=hot_of_counts(same, ["key"], "c")).select("seed", "seg", "j", F.lit(1).alias("n"), "lo", "hi")
    # a class's windows, at most span - seed + 1 of them, as one list of runs
    runs = whole.unionByName(single).groupBy("seed", "seg").agg(F.array_sort(F.collect_list(F.struct("j", "n", "lo", "hi"))).alias("runs"))
    found = salted_join(members.select("doc", "start", "seed", "seg"), runs, ["seed", "seg"], hot=hot_of_counts(classes, ["seed", "seg"], "c"))
    run = F.col("r")
    other = F.when(run["lo"]["doc"] != F.col("doc"), run["lo"]).otherwise(run["hi"])
    matches = found.select("doc", "start", F.explode("runs").alias("r")).select(
        "doc", other["doc"].alias("partner"), (F.col("start") + run["j"]).alias("a"), other["start"].alias("b"), (run["n"] + span - 1).alias("n")
    )
    # a seed of one class: the segment is the passage; of several: each window that stands in two documents
    hot = hot_of_counts(classes, ["seed", "seg"], "c")
    alone = classes.join(several.where("k = 1"), "seed", "leftsemi").where("lo.doc <> hi.doc").select("seed", "seg", F.lit(0).alias("j"), "lo.n", F.xxhash64("seed", "seg").alias("passage"))
    apart = salted_join(windows.select("seed", "seg", "j", "key"), same.select("key"), ["key"], "leftsemi", hot=hot_of_counts(same, ["key"], "c")).select("seed", "seg", "j", F.lit(1).alias("n"), F.col("key").alias("passage"))
    places = alone.unionByName(apart).groupBy("seed", "seg").agg(F.collect_list(F.struct("passage", "j", "n")).alias("places"))  # at most a segment's windows
    held = salted_join(members.select("doc", "start", "seed", "seg"), places, ["seed", "seg"], hot=hot).select("doc", "start", F.explode("places").alias("p"))
    return matches, held.select("p.passage", "doc", (F.col("start") + F.col("p.j")).alias("start"), (F.col("p.n") + span - 1).alias("length"))


class Fenwick:
    """Prefix maxima over positions, with the index that reached them."""

    def __init__(self, size: int) -> None:
        self.score, self.index = [-np.inf] * (size + 1), [-1] * (size + 1)

    def put(self, i: int, score: float, index: int) -> None:
        i += 1
        while i < len(self.score):
            if score > self.score[i]:
                self.score[i], self.index[i] = score, index
            i += i & -i

    def best(self, i: int) -> tuple[float, int]:
        """The greatest score put at a position <= i."""
        i += 1
        score, index = -np.inf, -1
        while i > 0:
            if self.score[i] > score:
                score, index = self.score[i], self.index[i]
            i -= i & -i
        return score, index


def merged(matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Matches (a, b, n) on one diagonal that touch or overlap, as one."""
    out: list[tuple[int, int, int]] = []
    for a, b, n in sorted(set(matches), key=lambda m: (m[0] - m[1], m[0])):
        if out and out[-1][0] - out[-1][1] == a - b and a <= out[-1][0] + out[-1][2]:
            p = out[-1]
            out[-1] = (p[0], p[1], max(p[2], a + n - p[0]))
        else:
            out.append((a, b, n))
    return sorted(out)


def chains(matches: list[tuple[int, int, int]], gap_cost: float = GAP_COST, skew_cost: float = SKEW_COST, max_gap: int = MAX_GAP) -> list[list[tuple[int, int, int]]]:
    """Collinear chains of matches (a, b, n), best first; every match is in exactly one.

    A match may follow one that starts before it in both texts. Following costs
    gap_cost for each character between them in the two texts, which splits
    into a part of either match, so the best predecessor is a prefix maximum
    over the starts in b, kept in a Fenwick tree while a is swept; the skew of
    the gap is charged once the predecessor is known, and a step that costs
    more than it brings, or leaves a gap above max_gap, starts a new chain.
    """
    ms = sorted(matches)
    ranks = {b: i for i, b in enumerate(sorted({b for _, b, _ in ms}))}
    tree = Fenwick(len(ranks))
    score, before = [0.0] * len(ms), [-1] * len(ms)
    swept = 0
    for i, (a, b, n) in enumerate(ms):
        # predecessors must start strictly earlier in a
        while swept < i and ms[swept][0] < a:
            k, swept = swept, swept + 1
            tree.put(ranks[ms[k][1]], score[k] + gap_cost * (ms[k][0] + ms[k][2] + ms[k][1] + ms[k][2]), k)
        score[i] = float(n)
        _, k = tree.best(ranks[b] - 1) if ranks[b] else (0, -1)
        if k >= 0:
            pa_, pb, pn = ms[k]
            ga, gb = a - (pa_ + pn), b - (pb + pn)
            gain = score[k] - gap_cost * (max(0, ga) + max(0, gb)) - skew_cost * abs(ga - gb) - max(0, -min(ga, gb))
            if gain > 0 and max(ga, gb) <= max_gap:
                score[i], before[i] = n + gain, k
    used, out = [False] * len(ms), []
    for i in sorted(range(len(ms)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(ms[i])
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def edits(x: str, y: str) -> int:
    """Edit distance, a row at a time."""
    if not x or not y:
        return len(x) + len(y)
    if len(x) < len(y):
        x, y = y, x
    yp = code_points(y)
    row = np.arange(len(y) + 1)
    ramp = np.arange(len(y) + 1)
    for i, c in enumerate(code_points(x), 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (yp != c))
        row = np.minimum.accumulate(new - ramp) + ramp
    return int(row[-1])


def aligned(x: str, y: str, chain: list[tuple[int, int, int]], span: int) -> tuple[list[tuple[int, int, int]], int, int]:
    """(verbatim blocks, edits, length) of a chain over the texts x and y.

    Each match is compared character by character and cut to where it holds,
    then extended as far as the texts agree, and the gaps between matches are
    aligned by edit distance. Blocks are at least `span` long.
    """
    blocks, wrong, last = [], 0, None
    for a, b, n in chain:
        if x[a : a + n] != y[b : b + n]:  # a collision of hashes
            continue
        while a + n < len(x) and b + n < len(y) and x[a + n] == y[b + n]:
            n += 1
        while a > 0 and b > 0 and x[a - 1] == y[b - 1]:
            a, b, n = a - 1, b - 1, n + 1
        if last and a - b == last[0] - last[1] and a <= last[0] + last[2]:
            continue
        if last:
            wrong += edits(x[last[0] + last[2] : max(a, last[0] + last[2])], y[last[1] + last[2] : max(b, last[1] + last[2])])
        blocks.append((a, b, n))
        last = (a, b, n)
    length = blocks[-1][0] + blocks[-1][2] - blocks[0][0] if blocks else 0
    return [m for m in blocks if m[2] >= span], wrong, length


_CHAINED = "doc {kind}, partner {kind}, chains array<struct<chain:int,a:int,b:int,n:int>>, a_lo int, a_hi int, b_lo int, b_hi int"


def _chain_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc, partner, matches in zip(pdf.doc, pdf.partner, pdf.matches, strict=True):
            found = chains(merged([(int(m["a"]), int(m["b"]), int(m["n"])) for m in matches]))
            every = [{"chain": i, "a": a, "b": b, "n": n} for i, c in enumerate(found) for a, b, n in c]
            reach = [pick(m[k] + (m["n"] if pick is max else 0) for m in every) for k in "ab" for pick in (min, max)]
            out.append((doc, partner, every, *reach))
        yield pd.DataFrame(out, columns=["doc", "partner", "chains", "a_lo", "a_hi", "b_lo", "b_hi"])


def _align_rows(span: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, partner, found, x, a0, y, b0 in zip(pdf.doc, pdf.partner, pdf.chains, pdf.text, pdf.a_lo, pdf.other, pdf.b_lo, strict=True):
                by: dict[int, list[tuple[int, int, int]]] = {}
                for m in found:
                    by.setdefault(int(m["chain"]), []).append((int(m["a"]) - a0, int(m["b"]) - b0, int(m["n"])))
                for i, chain in by.items():
                    blocks, wrong, length = aligned(x, y, chain, span)
                    if blocks:
                        a, b = blocks[0][0] + a0, blocks[0][1] + b0
                        ends = (blocks[-1][0] + blocks[-1][2] + a0, blocks[-1][1] + blocks[-1][2] + b0)
                        out.append((doc, partner, i, a, ends[0], b, ends[1], wrong, 1 - wrong / max(1, length), [{"a": m[0] + a0, "n": m[2]} for m in blocks]))
            yield pd.DataFrame(out, columns=["doc", "partner", "chain", "a_start", "a_end", "b_start", "b_end", "edits", "identity", "blocks"])

    return run


def _stretch(text: str, lo: str, hi: str):
    """The characters lo..hi of a text."""
    return F.substring(F.col(text), F.col(lo) + 1, F.col(hi) - F.col(lo))


def passages(docs: DataFrame, span: int = SPAN, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, partner, chain, a_start, a_end, b_start, b_end, edits, identity, blocks): passages doc shares with partner.

    The matches of shared_matches, chained per pair and aligned on the texts of
    both. A passage is fuzzy: its verbatim blocks, each at least `span`
    characters, may have gaps between them, which edits and identity measure.
    Every verbatim span that doc shares with any document lies in a block of
    one of its passages. Blocks are extended beyond their matches as far as the
    texts agree, by at most `span` characters at either end of all that the
    pair shares. Per pair and side one stretch of text is shipped, from a span
    before its first match to a span after its last, cut off where the text
    meets the pair; a partner that many documents name is spread by salt.

    Null, empty and short texts and null ids have no passage. Rows with equal
    doc_id are one document, so what they share with each other does not count.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    found = shared_matches(docs, span, seed, doc_id, text)
    # the matches of a pair are at most as many as the document's windows
    pairs = found.groupBy("doc", "partner").agg(F.collect_set(F.struct("a", "b", "n")).alias("matches"))
    chained = pairs.mapInPandas(_chain_rows, _CHAINED.format(kind=kind))
    wider = [F.greatest(F.col(c) - span, F.lit(0)).alias(c) if c.endswith("lo") else (F.col(c) + span).alias(c) for c in ("a_lo", "a_hi", "b_lo", "b_hi")]
    chained = materialize(chained.select("doc", "partner", "chains", *wider), "chains")
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= span))
    # partners share with the documents that name them, so they are among these
    texts = needed_texts(rows, chained.select("doc"))
    both = salted_join(chained, texts.select(F.col("doc").alias("partner"), F.col("text").alias("other")), ["partner"]).withColumn("other", _stretch("other", "b_lo", "b_hi"))
    both = both.join(texts, "doc").withColumn("text", _stretch("text", "a_lo", "a_hi")).select("doc", "partner", "chains", "a_lo", "b_lo", "text", "other")
    return both.mapInPandas(_align_rows(span), f"doc {kind}, partner {kind}, chain int, a_start int, a_end int, b_start int, b_end int, edits int, identity double, blocks array<struct<a:int,n:int>>")


def shared_chars(passage: DataFrame) -> DataFrame:
    """(doc, shared_chars): the characters of each document that lie in at least one verbatim block."""
    spans = passage.select("doc", F.explode("blocks").alias("m")).select("doc", F.col("m.a").alias("a"), (F.col("m.a") + F.col("m.n")).alias("e")).distinct()
    # the union of intervals: each adds what lies beyond the furthest end before it
    ordered = spans.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("a", "e"))).alias("s"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum"))
    total = F.aggregate("s", zero, lambda acc, x: F.struct(F.greatest(acc["end"], x["e"]).alias("end"), (acc["sum"] + F.greatest(F.lit(0), x["e"] - F.greatest(acc["end"], x["a"]))).cast("long").alias("sum")))
    return ordered.select("doc", total["sum"].alias("shared_chars"))
