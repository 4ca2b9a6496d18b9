"""Encoding of a corpus with a public tokenizer by reuse of content-defined chunks."""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.rolling import code_points, window_hashes
from causeway.session import materialize_counted

#: Where the vocabulary files are; every node must have them there.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

# Fixed value: the pattern by which byte_bpe_50k splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

WINDOW = 16  # characters the rolling hash sees
MEAN, LEAST, MOST = 256, 64, 8192  # characters of a chunk; MEAN is a power of two
_BATCH_CHARS = 1 << 20  # characters handled at once in a Python worker


@lru_cache(maxsize=4)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each character of the base plane: 0 space, 1 letter, 2 number, 3 other, 4 not relied on.

    Only old and stable blocks are classed, so the result does not depend on
    the Unicode version of any library.
    """
    table = np.full(0x10000, 4, dtype=np.uint8)
    for lo, hi in ((0x20, 0x7F), (0xC0, 0x180), (0x410, 0x450), (0x3001, 0x3003), (0x4E00, 0x9FA6), (0xFF01, 0xFF10)):
        for c in range(lo, hi):
            kind = unicodedata.category(chr(c))[0]
            table[c] = {"L": 1, "N": 2}.get(kind, 3)
    for c in " \t\n\r\x0b\x0c":
        table[ord(c)] = 0
    return table


def certain_starts(points: np.ndarray) -> np.ndarray:
    """The positions at which a piece of the pattern starts whatever stands further left or right.

    No alternative of PATTERN spans a change of class after a character that is
    no space, but for a contraction after an apostrophe; and none looks back,
    or ahead past anything but space. So a text cut there is encoded part by part.
    """
    if len(points) < 2:
        return np.zeros(0, dtype=np.int64)
    table = _classes()
    c = np.where(points < 0x10000, table[np.minimum(points, 0xFFFF)], 4)
    left, right = c[:-1], c[1:]
    sure = (left != right) & (left != 0) & (left < 4) & (right < 4) & ~((points[:-1] == ord("'")) & (right == 1))
    return np.flatnonzero(sure) + 1


def cuts(hashes: np.ndarray, length: int) -> list[int]:
    """The ends of the chunks of a text with these rolling hashes: where the hash says so, at least LEAST and at most MOST apart."""
    if length <= LEAST:
        return [length]
    marks = np.flatnonzero((hashes & np.uint64(MEAN - 1)) == 0) + WINDOW
    out, at = [], 0
    while length - at > LEAST:
        i = np.searchsorted(marks, at + LEAST)
        end = int(marks[i]) if i < len(marks) else length
        end = min(end, at + MOST, length)
        out.append(end)
        at = end
    if not out or out[-1] < length:
        out.append(length)
    return out


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about _BATCH_CHARS characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _BATCH_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _int_lists(lists: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(lists) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


#: Characters of chunks whose ids a task keeps at most, twice over.
_KEPT_CHARS = 1 << 23


class ChunkIds:
    """The encoded chunks of a task: head and tail texts around the ids of the middle, between the first and last certain start.

    Bounded: once the kept chunks have _KEPT_CHARS characters they become the
    older half, from which chunks that come again are taken over, and what was
    the older half is dropped.
    """

    def __init__(self, encode) -> None:
        self.encode, self.new, self.old, self.size, self.encoded = encode, {}, {}, 0, 0

    def get(self, chunk: str, starts: np.ndarray, begin: int) -> tuple[str, list[int] | None, str]:
        """starts: the certain starts of the text around, in whose characters the chunk begins at `begin`."""
        known = self.new.get(chunk)
        if known is not None:
            return known
        known = self.old.get(chunk)
        if known is None:
            self.encoded += 1
            # a start at the chunk's own first or last border says nothing
            i, j = np.searchsorted(starts, begin, side="right"), np.searchsorted(starts, begin + len(chunk), side="left")
            if j > i:
                a, b = int(starts[i]) - begin, int(starts[j - 1]) - begin
                known = chunk[:a], (self.encode(chunk[a:b]) if b > a else []), chunk[b:]
            else:
                known = chunk, None, ""
        self.new[chunk] = known
        self.size += len(chunk)
        if self.size > _KEPT_CHARS:
            self.old, self.new, self.size = self.new, {}, 0
        return known


def _encode_texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode_ordinary
        kept, joint = ChunkIds(encode), lru_cache(maxsize=1 << 16)(encode)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in _groups(texts):
                part, out, at = texts[lo:hi], [], 0
                points = code_points("".join(part))
                hashes, starts = window_hashes(points, WINDOW)[0], certain_starts(points)
                for t in part:
                    done, pending, a = [], "", 0
                    # the last WINDOW - 1 starts of a text reach into the next one and are left out
                    for b in cuts(hashes[at : at + max(0, len(t) - WINDOW + 1)], len(t)):
                        head, body, tail = kept.get(t[a:b], starts, at + a)
                        pending += head
                        if body is not None:  # else no certain start inside: the join reaches on into the next chunk
                            done += joint(pending)
                            done += body
                            pending = tail
                        a = b
                    out.append(done + list(joint(pending)))
                    at += len(t)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _int_lists(out)], names=["doc_id", "ids"])

    return run


def _once(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text) without the repeats of equal doc_id and text.

    Only their 64-bit names are shuffled; where none repeats, which is counted,
    the texts stay where they are, and else only those that do are moved.
    """
    named = rows.withColumn("text_key", F.xxhash64(F.col("text").isNull(), "text"))
    counts = named.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "text_key")
    repeated, n = materialize_counted(counts, "repeated", n=F.count("*"))
    if not n["n"]:
        return rows
    same = named["doc_id"].eqNullSafe(repeated["doc_id"]) & (named["text_key"] == repeated["text_key"])
    single = named.join(repeated, same, "left_anti")
    several = named.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text_key"])
    return single.unionByName(several).select("doc_id", "text")


def encode_corpus(docs: DataFrame, vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each whole text, without special tokens.

    1. A rolling hash over WINDOW characters cuts texts into chunks whose
       borders depend on the content only, so a passage shared by documents
       falls into the same chunks wherever it stands.
    2. Of each chunk the middle, between its first and last certain_starts(),
       is encoded once in a task and reused for every document that has it
       (see ChunkIds). No text is shuffled for it.
    3. The joins of a text's chunks are repaired: what stands between the last
       certain start of one chunk and the first of the next is encoded anew,
       over as many chunks as it takes to reach a certain start on either side.
       From there on both agree with the encoding of the whole text, so the
       result is exact.

    Empty and null texts give an empty list. Rows with equal doc_id and text
    give one row, equal doc_ids with different texts one row each; a null
    doc_id is kept as any other. Further columns are not read.
    """
    rows = _once(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_encode_texts(vocabulary), f"doc_id {kind}, ids array<int>")


def token_counts(docs: DataFrame, vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(doc_id, n_tokens) of encode_corpus."""
    return encode_corpus(docs, vocabulary).select("doc_id", F.size("ids").cast("long").alias("n_tokens"))
