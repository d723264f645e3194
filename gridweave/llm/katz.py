"""Katz back-off language model: Good-Turing discounted counts, exactly normalised back-off weights.

The model is a bigram model over unigrams; the n-gram tables are what is large.  Tasks count in
batches: a batch keeps its texts as numbered tokens and asks for each of its distinct n-grams
once.  N-grams are named by 64-bit hashes and dealt by ranges of them to buckets, as blocks of packed
numbers, so that a frequent word or history is one number in one block and never a hot key.

1. Batches send their n-grams with training counts; a bucket adds them up, writes its part of the
   count table (partitioned by kind), and answers each batch in its own order, marking the one
   batch that owns an n-gram.
2. Counts of counts (a few numbers) give the Good-Turing discounts.  Owners sum, for each history,
   the discounted counts and the lower-order probability of its seen continuations; buckets add
   these sums up and write the table of histories, from which the back-off weight follows.
3. Batches evaluate every token: the discounted bigram where it was seen, else the history's
   weight times the lower order's probability, recursively down to the unknown word.

Words unseen in training share one class, so each distribution sums to one over the vocabulary
and that class.  Where Good-Turing gives no usable discount (too few counts of counts), absolute
discounting stands in; a history without discountable continuations gets one pseudo-count for
all unseen ones.

Defined cases: null texts are empty and consist of the end only; a null doc_id is no held-out
row; repeated rows are scored alike and each counts; other columns are ignored; an empty table
gives no rows; without training rows every token is unknown.
"""

from __future__ import annotations

import contextlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import discard, shared_dir, stored, table

#: An executor holds a batch or a bucket for each core, in Spark and in Python: their sizes bound its memory.
K, BATCH_TOKENS, BUCKET_GRAMS, BATCH_ROWS = 5, 1_500_000, 2_000_000, 1000
START, END = b" start", b" end"  # no word holds a blank
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


START_KEY = np.uint64(xxhash.xxh3_64_intdigest(START))


def squeezed(b: bytes) -> bytes:
    """The length, then zstd: shuffles compress without coding by frequency."""
    return len(b).to_bytes(8, "little") + (pa.compress(b, "zstd", asbytes=True) if b else b"")


def unsqueezed(b: bytes) -> bytes:
    n = int.from_bytes(b[:8], "little")
    return pa.decompress(b[8:], n, "zstd", asbytes=True) if n else b""


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte planes apart: the zero planes compress away."""
    return squeezed(np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes())


def keys_of(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(unsqueezed(b), np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_numbers(n: np.ndarray) -> bytes:
    """Byte planes of 32-bit numbers: the upper ones are mostly zero."""
    return squeezed(np.ascontiguousarray(n.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes())


def numbers_of(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unsqueezed(b), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, ascending; each key's place among them; where each comes first."""
    order = np.argsort(keys, kind="stable")
    keys, new = keys[order], np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    place = np.empty(len(keys), np.uint32)
    place[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return keys[new], place, order[new]


def pack_counts(n: np.ndarray) -> bytes:
    """One byte a count; larger ones follow with their places."""
    large = np.flatnonzero(n >= 255)
    return squeezed(np.int64(len(n)).tobytes() + np.minimum(n, 255).astype(np.uint8).tobytes() + large.astype(np.int64).tobytes() + n[large].astype(np.int64).tobytes())


def counts_of(b: bytes) -> np.ndarray:
    b = unsqueezed(b)
    n = int(np.frombuffer(b, np.int64, 1)[0])
    out, rest = np.frombuffer(b, np.uint8, n, 8).astype(np.int64), np.frombuffer(b[8 + n :], np.int64)
    out[rest[: len(rest) // 2]] = rest[len(rest) // 2 :]
    return out


def pack_sums(x: np.ndarray) -> bytes:
    return squeezed(np.ascontiguousarray(x.T).tobytes())


def sums_of(b: bytes) -> np.ndarray:
    return np.frombuffer(unsqueezed(b)).reshape(2, -1).T


@contextlib.contextmanager
def rows_at_once(spark: SparkSession, rows: int = 1):
    """What Python gets at a time: rows of megabytes one by one, texts not by ten thousands."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


BATCH = "batch string, ids array<string>, held array<boolean>, lens array<long>, vocab binary, tokens binary"


def encode(docs: DataFrame, held: Callable[[int | None], bool]) -> DataFrame:
    """Batches of whole documents as numbered tokens; number 0 is the start, 1 the end."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, made = TaskContext.get().partitionId(), count()

        def fresh() -> tuple:
            number: defaultdict[bytes, int] = defaultdict(count(2).__next__)
            return number, [], [], [], []

        def batch(number: dict, ids: list, flags: list, lens: list, parts: list) -> pd.DataFrame:
            vocab = np.fromiter(map(xxhash.xxh3_64_intdigest, [START, END, *number]), np.uint64, len(number) + 2)
            return pd.DataFrame({"batch": [f"{task}-{next(made)}"], "ids": [ids], "held": [flags], "lens": [lens], "vocab": [vocab.tobytes()], "tokens": [pack_numbers(np.concatenate(parts))]})

        state, total = fresh(), 0
        for pdf in frames:
            for doc_id, text in zip(pdf.doc_id.tolist(), pdf.text.tolist(), strict=True):
                number, ids, flags, lens, parts = state
                words = (text or "").encode("utf-8", "surrogatepass").lower().split()
                t = np.ones(len(words) + 1, np.uint32)
                t[:-1] = np.fromiter(map(number.__getitem__, words), np.uint32, len(words))
                # ids go as strings: a null beside them would make them floats
                key = int(doc_id) if isinstance(doc_id, str) else None
                ids.append(doc_id if isinstance(doc_id, str) else None)
                flags.append(held(key))
                lens.append(len(t))
                parts.append(t)
                total += len(t)
                if total >= BATCH_TOKENS:
                    yield batch(*state)
                    state, total = fresh(), 0
        if state[1]:
            yield batch(*state)

    return docs.select(F.col("doc_id").cast("long").cast("string"), "text").mapInPandas(run, BATCH)


class Batch:
    """A stored batch: its distinct words and pairs, where they go, and the answers to them."""

    def __init__(self, r, buckets: int):
        self.name, self.buckets = r.batch, buckets
        self.lens = np.array(r.lens, np.int64)
        self.vocab, self.tokens = np.frombuffer(r.vocab, np.uint64), numbers_of(r.tokens)
        self.first = np.cumsum(self.lens) - self.lens
        codes = np.zeros(len(self.tokens), np.uint64)
        codes[1:] = self.tokens[:-1]
        codes[self.first] = 0
        codes <<= np.uint64(32)
        codes |= self.tokens
        codes, self.pair, _ = distinct(codes)
        self.v, self.w = (codes >> np.uint64(32)).astype(np.uint32), codes.astype(np.uint32)
        self.train = np.repeat(~np.array(r.held, bool), self.lens)
        self.keys = {"w": self.vocab, "p": mixed(mixed(self.vocab[self.v] * MIX) ^ self.vocab[self.w])}

    def counts(self, gram: str) -> np.ndarray:
        if gram == "p":
            return np.bincount(self.pair, self.train, len(self.v)).astype(np.int64)
        n = np.bincount(self.tokens, self.train, len(self.vocab)).astype(np.int64)
        n[0] = self.train[self.first].sum()
        return n

    def places(self, gram: str) -> Iterator[tuple[int, np.ndarray]]:
        """Each bucket's n-grams by key, as places in the batch's own order."""
        order = np.argsort(self.keys[gram], kind="stable")
        # a bucket is a range of keys: however many there are, the keys of a block lie close
        b = (self.keys[gram][order] >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)
        cut = np.searchsorted(b, np.arange(self.buckets + 1, dtype=np.uint64))
        for i in range(self.buckets):
            if cut[i] < cut[i + 1]:
                yield i, order[cut[i] : cut[i + 1]]

    def answered(self, gram: str, answers: list, of: Callable) -> np.ndarray:
        got = {a["bucket"]: of(a) for a in answers if a["gram"] == gram}
        out = None
        for i, at in self.places(gram):
            if out is None:
                out = np.zeros((len(self.keys[gram]), *got[i].shape[1:]), got[i].dtype)
            out[at] = got[i]
        return out


def questions(store: DataFrame, buckets: int) -> DataFrame:
    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                b = Batch(r, buckets)
                for gram in ("w", "p"):
                    n, keys = b.counts(gram), b.keys[gram]
                    blocks = [(i, pack_keys(keys[at]), pack_counts(n[at])) for i, at in b.places(gram)]
                    yield pd.DataFrame(blocks, columns=["bucket", "keys", "counts"]).assign(gram=gram, batch=b.name)[["gram", "bucket", "batch", "keys", "counts"]]

    return store.mapInPandas(ask, "gram string, bucket int, batch string, keys binary, counts binary")


COUNTED = "kind string, gram string, bucket int, batch string, keys binary, counts binary, r int, n long"


def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket of one kind of n-gram: its part of the count table, its answers, its counts of counts."""
    gram, bucket = pdf.gram.iloc[0], int(pdf.bucket.iloc[0])
    pdf = pdf.sort_values("batch")
    parts = [keys_of(k) for k in pdf["keys"]]
    keys, place, first = distinct(np.concatenate(parts))
    total = np.bincount(place, np.concatenate([counts_of(c) for c in pdf.counts]), len(keys)).astype(np.int64)
    answer = total[place] * 2
    answer[first] += 1
    seen = total > 0
    rows = [("model", gram, bucket, None, pack_keys(keys[seen]), pack_counts(total[seen]), None, None)]
    at = 0
    for batch, n in zip(pdf.batch, map(len, parts), strict=True):
        rows.append(("answer", gram, bucket, batch, None, pack_counts(answer[at : at + n]), None, None))
        at += n
    own = total[seen & ~((keys == START_KEY) & (gram == "w"))]
    for r in range(1, K + 2):
        rows.append(("stats", gram, bucket, None, None, None, r, int((own == r).sum())))
    rows += [("stats", gram, bucket, None, None, None, 0, int(own.sum())), ("stats", gram, bucket, None, None, None, -1, len(own))]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in COUNTED.split(", ")]).astype({"r": "Int64", "n": "Int64"})


def discounts(n: dict[int, int]) -> np.ndarray:
    """Katz's Good-Turing discount ratios d[r], 1 above K; absolute discounting where they are unusable."""
    d = np.ones(K + 1)
    d[0] = 0
    n1 = n.get(1, 0)
    cut = (K + 1) * n.get(K + 1, 0) / n1 if n1 else 1.0
    absolute = n1 / (n1 + 2 * n[2]) if n1 and n.get(2) else 0.5
    for r in range(1, K + 1):
        good = np.nan
        if n.get(r) and n.get(r + 1) and cut < 1:
            good = ((r + 1) * n[r + 1] / n[r] / r - cut) / (1 - cut)
        d[r] = good if 0 < good < 1 else (r - absolute) / r
    return d


class Estimates:
    """What is known of the whole corpus: a few numbers."""

    def __init__(self, stats: dict[tuple[str, int], int]):
        get = lambda gram: {r: v for (g, r), v in stats.items() if g == gram}
        self.total, self.types = stats.get(("w", 0), 0), stats.get(("w", -1), 0)
        self.dw, self.dp = discounts(get("w")), discounts(get("p"))
        kept = self.total - sum((1 - self.dw[r]) * r * stats.get(("w", r), 0) for r in range(1, K + 1))
        self.pseudo = 1 if kept >= self.total else 0
        self.unknown = (self.total + self.pseudo - kept) / (self.total + self.pseudo) if self.total else 1.0

    def discounted(self, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.where(c > K, c, c * d[np.minimum(c, K)])

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.discounted(c, self.dw) / max(self.total + self.pseudo, 1), self.unknown)

    def backoff(self, c: np.ndarray, mass: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each history's denominator and weight; a history never seen passes the lower order on."""
        denominator = c + (mass >= c)
        left = np.maximum(denominator - mass, 0) / np.maximum(denominator, 1)
        return denominator, np.where(c > 0, left / np.maximum(1 - lower, 1e-300), 1.0)


def sums(asked: DataFrame, estimates: Estimates, buckets: int) -> DataFrame:
    """Each batch's part of the sums of its histories."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                b = Batch(r, buckets)
                number = lambda a: counts_of(a["counts"])
                w, p = b.answered("w", r.answers, number) >> 1, b.answered("p", r.answers, number)
                own = (p & 1).astype(bool) & (p >> 1 > 0)
                c, v = p[own] >> 1, b.v[own]
                part = np.c_[np.bincount(v, estimates.discounted(c, estimates.dp), len(b.vocab)), np.bincount(v, estimates.unigram(w[b.w[own]]), len(b.vocab))]
                blocks = [(i, pack_keys(b.vocab[at]), pack_sums(part[at])) for i, at in b.places("w")]
                yield pd.DataFrame(blocks, columns=["bucket", "keys", "sums"]).assign(gram="h", batch=b.name)[["gram", "bucket", "batch", "keys", "sums"]]

    return asked.mapInPandas(add, "gram string, bucket int, batch string, keys binary, sums binary")


SUMMED = "kind string, gram string, bucket int, batch string, keys binary, sums binary"


def add_histories(pdf: pd.DataFrame) -> pd.DataFrame:
    bucket = int(pdf.bucket.iloc[0])
    pdf = pdf.sort_values("batch")
    parts = [keys_of(k) for k in pdf["keys"]]
    keys, place, _ = distinct(np.concatenate(parts))
    summed = np.concatenate([sums_of(x) for x in pdf.sums])
    total = np.c_[np.bincount(place, summed[:, 0], len(keys)), np.bincount(place, summed[:, 1], len(keys))]
    seen = total[:, 0] > 0
    rows = [("model", "h", bucket, None, pack_keys(keys[seen]), pack_sums(total[seen]))]
    at = 0
    for batch, n in zip(pdf.batch, map(len, parts), strict=True):
        rows.append(("answer", "h", bucket, batch, None, pack_sums(total[place[at : at + n]])))
        at += n
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SUMMED.split(", ")])


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(asked: DataFrame, estimates: Estimates, buckets: int) -> DataFrame:
    e = estimates

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                b = Batch(r, buckets)
                number = lambda a: counts_of(a["counts"])
                w, p = b.answered("w", r.answers, number) >> 1, b.answered("p", r.answers, number) >> 1
                h = b.answered("w", [{**a.asDict(), "gram": "w"} if hasattr(a, "asDict") else {**a, "gram": "w"} for a in r.histories], lambda a: sums_of(a["sums"]))
                denominator, weight = e.backoff(w, h[:, 0], h[:, 1])
                # order 1, then order 2 where the pair was seen, else the history's weight times order 1
                one = e.unigram(w)
                two = np.where(p > 0, e.discounted(p, e.dp) / np.maximum(denominator[b.v], 1), weight[b.v] * one[b.w])
                add = lambda x, b=b: np.add.reduceat(x, b.first) if len(b.first) else x
                known = np.where(np.arange(len(w)) == 0, 0, w)[b.tokens]
                yield pd.DataFrame({
                    "doc_id": pd.array([None if i is None else int(i) for i in r.ids], "Int64"), "held_out": list(r.held), "n_tokens": b.lens, "n_known": add((known > 0).astype(np.int64)), "train_tokens": e.total,
                    "base_score": add(np.log10((known + 1) / (e.total + e.types + 1))), "score": add(np.log10(two)[b.pair]),
                })

    return asked.mapInPandas(run, SCORES)


def katz_scores(docs: DataFrame, held: Callable[[int | None], bool]) -> DataFrame:
    """Train on the rows that ``held`` (of doc_id) does not hold out; score every row."""
    spark = docs.sparkSession
    at = shared_dir(spark)
    with rows_at_once(spark, BATCH_ROWS):
        store = stored(encode(docs, held), f"{at}/batches")
    tokens = store.agg(F.sum(F.expr("aggregate(lens, 0L, (a, x) -> a + x)"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(tokens // BUCKET_GRAMS))
    counted = questions(store, buckets).groupBy("gram", "bucket").applyInPandas(add_up, COUNTED)
    with rows_at_once(spark):
        grams = stored(counted, f"{at}/counts", "kind")
    stats = {(r.gram, int(r.r)): int(r.n) for r in grams.where("kind = 'stats'").groupBy("gram", "r").agg(F.sum("n").alias("n")).collect()}
    estimates = Estimates(stats)
    answers = grams.where("kind = 'answer'").groupBy("batch").agg(F.collect_list(F.struct("gram", "bucket", "counts")).alias("answers"))
    asked = store.join(answers, "batch")
    summed = sums(asked, estimates, buckets).groupBy("gram", "bucket").applyInPandas(add_histories, SUMMED)
    with rows_at_once(spark):
        histories = stored(summed, f"{at}/histories", "kind")
    back = histories.where("kind = 'answer'").groupBy("batch").agg(F.collect_list(F.struct("gram", "bucket", "sums")).alias("histories"))
    with rows_at_once(spark):
        out = stored(score(asked.join(back, "batch"), estimates, buckets), f"{at}/scores")
    discard(spark, f"{at}/batches", f"{at}/counts/kind=answer", f"{at}/histories/kind=answer")
    return out


def op1_katz_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"), lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2)
