"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

The global packing is exact best-fit decreasing, yet the driver never sees a document: pieces of
one length are interchangeable, and so are open bins with equal room, so the plan is computed
from the histogram of lengths (at most ``capacity`` classes) with a segment tree over remaining
capacities.  Each tree search places a whole run of equal pieces.  The plan's size depends on
``capacity``, not on the number of documents; tasks then look up their pieces' places in it.

Defined cases: a null text is an empty one and yields one piece holding only the end token; an
empty table yields no rows; repeated rows are packed once each; other columns are ignored; ties
(equal lengths) are placed in the order of task and arrival, which is arbitrary but valid.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import shared_dir, stored, table

#: Pieces remembered by a worker's cache of encodings before it starts afresh.
CACHE_ENTRIES = 150_000


class SegmentTree:
    """Over remaining capacities 0..n: which of them have open bins; ``tightest`` is O(log n)."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, capacity: int, bins: int) -> None:
        i = capacity + self.size
        while i:
            self.open[i] += bins
            i >>= 1

    def tightest(self, least: int) -> int:
        """The smallest capacity >= least with an open bin, or -1."""
        i = least + self.size
        if self.open[i]:
            return least
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i + (not self.open[2 * i])
                return i - self.size
            i >>= 1
        return -1


def best_fit_plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over ``counts`` pieces of each length.

    Returns runs (length, first rank, pieces, first sequence, pieces a sequence, offset of the
    first) and the number of sequences.  Rank r of the run goes to sequence
    ``first sequence + (r - first rank) // pieces a sequence``.
    """
    tree, spans = SegmentTree(capacity), {}
    runs: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0

    def put(room: int, first: int, bins: int) -> None:
        if room and bins:
            spans.setdefault(room, []).append((first, bins))
            tree.add(room, bins)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                room = capacity
                each = room // length
                first, bins = sequences, -(-left // each)
                sequences += bins
            else:
                first, bins = spans[room].pop()
                tree.add(room, -bins)
                each = room // length
            n = min(left, bins * each)
            runs.append((length, rank, n, first, each, capacity - room))
            full, rest = divmod(n, each)
            put(room - each * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            put(room, first + full + bool(rest), bins - full - bool(rest))
            left -= n
            rank += n
    return np.array(runs, np.int64).reshape(-1, 6), sequences


class Encoder:
    """Token ids as little-endian uint32 bytes, by the public byte-level BPE's own ranks.

    A blank between two non-blank characters always starts a pre-token, so a text can be cut
    there and each part encoded by itself: parts repeat, and repeated parts come from a cache.
    Texts with other white-space runs are encoded whole.  Added tokens (content -> id) are found
    first, as ``tokenizers`` does, and what lies between them is encoded by itself.
    """

    runs = re.compile(r" \s|\s |^\s|\s$")

    def __init__(self, rank_file: str, pattern: str, added: tuple[tuple[str, int], ...] = ()):
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.model = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, bytes] = {}
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in added}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None

    def ids(self, text: str) -> bytes:
        return np.asarray(self.model.encode_ordinary(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.split is None or not any(t in text for t in self.added):
            return self.plain(text)
        return b"".join(self.added.get(part) or self.plain(part) for part in self.split.split(text))

    def plain(self, text: str) -> bytes:
        return self.ids(text) if self.runs.search(text) else self.words(text)

    def words(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        cache, out = self.cache, [self.ids(head)]
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        for w in rest:
            got = cache.get(w)
            if got is None:
                got = cache[w] = self.ids(" " + w)
            out.append(got)
        return b"".join(out)


_encoders: dict[tuple, Encoder] = {}


def encoder(rank_file: str, pattern: str, added: tuple[tuple[str, int], ...] = ()) -> Encoder:
    key = (rank_file, pattern, added)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def added_tokens(file: str) -> tuple[tuple[str, int], ...]:
    """(content, id) of the added tokens in a tokenizer's json file; those with white-space or word rules have no counterpart here."""
    with open(file, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens") or []
    if any(t.get(k) for t in found for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{file}: an added token has rules beyond its text")
    return tuple((t["content"], int(t["id"])) for t in found)


PIECES = "doc_id string, piece int, start long, length long, ids_crc32 long, task long, local long"


def pieces(docs: DataFrame, rank_file: str, pattern: str, capacity: int, end_id: int = 0, added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """Tokenise whole texts and cut those longer than ``capacity``; the first piece is the short one.

    ``task`` and ``local`` count a piece among its task's pieces of equal length, which is what
    turns into a global rank without sorting any length class in one place.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, task, seen = encoder(rank_file, pattern, added), TaskContext.get().partitionId(), {}
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf.doc_id.tolist(), pdf.text.tolist(), strict=True):
                ids = encode(text or "") + end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                start, k, view = 0, 0, memoryview(ids)
                while start < n:
                    stop = start + (first if k == 0 else capacity)
                    length = stop - start
                    local = seen.get(length, 0)
                    seen[length] = local + 1
                    rows.append((doc_id, k, start, length, zlib.crc32(view[4 * start : 4 * stop]), task, local))
                    start, k = stop, k + 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])
        encode.cache.clear()  # the worker lives on

    # ids go as strings: a null beside them would make them floats
    return docs.select(F.col("doc_id").cast("long").cast("string"), "text").mapInPandas(cut, PIECES).withColumn("doc_id", F.col("doc_id").cast("long"))


def pack(docs: DataFrame, capacity: int = 2048, rank_file: str | None = None, pattern: str | None = None, end_id: int = 0) -> DataFrame:
    """Pack (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    added: tuple[tuple[str, int], ...] = ()
    if rank_file is None or pattern is None:
        import public_tokenizers

        added = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
        rank_file, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    at = shared_dir(docs.sparkSession)
    cut = stored(pieces(docs, rank_file, pattern, capacity, end_id, added), f"{at}/pieces")
    tally = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tally.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # at most ``capacity`` rows, whatever the input
    counts = {int(r.length): int(r.n) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = best_fit_plan(counts, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    span = int(runs[:, :3].max(initial=0).max(initial=0)) + 1 if len(runs) else 1
    keys = runs[:, 0] * span + runs[:, 1]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rank = pdf.base.to_numpy(np.int64) + pdf.local.to_numpy(np.int64)
            length = pdf.length.to_numpy(np.int64)
            run = runs[np.searchsorted(keys, length * span + rank, "right") - 1] if len(pdf) else runs[:0]
            slot = rank - run[:, 1]
            pdf["sequence_id"] = run[:, 3] + slot // np.maximum(run[:, 4], 1)
            pdf["offset"] = run[:, 5] + slot % np.maximum(run[:, 4], 1) * length
            yield pdf.drop(columns=["task", "local", "base"])

    placed = cut.join(offsets, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "task", "local", "base").withColumn("doc_id", F.col("doc_id").cast("string"))
    return placed.mapInPandas(place, "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumn("doc_id", F.col("doc_id").cast("long"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
