"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, with evidence.

Terms are lower-cased words; every word in at least ``MIN_DOCS`` of the examples spans the space,
however many there are.  A term weighs its TF-IDF times ``phi ** POWER``, where phi is its
correlation with the label over the examples (the root of chi-square over their number): topics
that all texts share then hide no rare telling word.  The labelled examples are a bounded sample
(``per_class`` of each label, by hash of doc_id, less exact copies of one label), so their index is
small enough to travel with the tasks, and every document is scored where it is read: no shuffle of
texts.

The index holds each term's postings in order of blocks of examples (as an array over all examples
where they are many), with the term's largest weight in each block.  A query leaves out the terms whose postings are long for what they weigh, up to a
rest of length ``SLACK``, which bounds what they can add.  It visits the blocks of high upper
bounds first, then the others that can still hold one of the k best; what an example has, plus the
rest, decides whether its cosine is computed in full from its own vector.  So the k nearest are
exact (ties to the smaller doc_id).  Their votes, weighted by similarity, are calibrated by a
logistic fit to leave-one-out votes of the examples.

Defined cases: null and empty texts, and texts without any term of the space, get the rate of toxic
labels among the sampled examples without a term, copies included, or, if there are none, the
calibrated score of no votes; labels that are null or whose document is missing are ignored; several
labels of one document count as toxic if any is; without usable labels the score is 0.25;
repeated rows are scored alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import crc_mod, shared_dir, stored, table

PER_CLASS, MIN_DOCS, POWER, K, BLOCK, SLACK = 4096, 2, 1.5, 15, 1024, 0.01
#: Scores of texts remembered by a task.
CACHE_ENTRIES = 20_000
#: Rows of which the best one counts when a threshold is sought.
GROUP = 16
#: Blocks whose bound is at least this share of the highest one are visited first, together.
FIRST = 0.25
#: From this share of the examples on, a term's postings are an array.
OFTEN = 0.03
#: More than single precision can be off by.
MARGIN = 1e-5
LETTERS = re.compile(r"[^\W\d_]+")

Pair = tuple[np.ndarray, np.ndarray]


#: Characters known to be letters.
KNOWN: set[str] = set()
#: Different other characters of a text that are worth replacing one by one.
OTHERS = 100


def words_of(text: str | None) -> Counter:
    """The runs of ``LETTERS``, found by splitting where no letter is."""
    text = (text or "").lower()
    others = set(text) - KNOWN
    KNOWN.update(letters := set(filter(LETTERS.fullmatch, others)))
    others -= letters
    if len(others) > OTHERS:
        return Counter(LETTERS.findall(text))
    for c in others:
        text = text.replace(c, " ")
    return Counter(text.split())


def vector(text: str | None, number: dict[str, int]) -> Pair:
    """The numbers of a text's terms, ascending, and their counts."""
    found = words_of(text)
    terms = np.fromiter(map(number.get, found, repeat(-1)), np.int64, len(found))
    n = np.fromiter(found.values(), float, len(found))
    turn = np.argsort(terms)
    turn = turn[np.searchsorted(terms[turn], 0) :]
    return terms[turn], n[turn]


def pair_of(vector: dict[int, float] | Pair) -> Pair:
    if isinstance(vector, dict):
        terms = np.array(sorted(vector), np.int64)
        return terms, np.array([vector[t] for t in terms.tolist()], float)
    return vector


def runs_of(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers first[0]..last[0]-1, first[1]..last[1]-1 and so on."""
    n = last - first
    return np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())


class BlockMaxIndex:
    """Unit vectors of labelled examples; ``nearest`` is exact."""

    def __init__(self, ids: list[int], labels: list[int], vectors: list[dict[int, float] | Pair], terms: int):
        pairs = [pair_of(v) for v in vectors]
        heaviest = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in pairs]
        order = sorted(range(len(ids)), key=lambda i: (heaviest[i], ids[i]))
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.labels = np.array([labels[i] for i in order], float)
        self.ends = np.r_[0, np.cumsum([len(pairs[i][0]) for i in order])].astype(np.int64)
        self.terms = np.concatenate([pairs[i][0] for i in order] + [np.zeros(0, np.int32)]).astype(np.int32)
        self.weights = np.concatenate([pairs[i][1] for i in order] + [np.zeros(0)])
        self.wide = terms

    def build(self) -> None:
        """The postings, from the examples' own vectors; made where they are first searched, not in the driver."""
        blocks = max(1, -(-len(self.ids) // BLOCK))
        row = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.ends))
        turn = np.argsort(self.terms, kind="stable")  # rows ascend within a term
        self.rows, self.posted = row[turn].astype(np.int64), self.weights[turn].astype(np.float32)
        self.df = np.bincount(self.terms, minlength=self.wide)
        self.padded = -(-max(len(self.ids), 1) // GROUP) * GROUP
        cell = self.terms[turn].astype(np.int64) * blocks + self.rows // BLOCK
        self.most = np.zeros(self.wide * blocks, np.float32)
        np.maximum.at(self.most, cell, self.posted)
        self.most = self.most.reshape(self.wide, blocks)
        # a list that holds a good part of all rows is kept as an array over them
        often = np.flatnonzero(self.df >= max(GROUP, len(self.ids) * OFTEN))
        self.place = np.full(self.wide, -1, np.int32)
        self.place[often] = np.arange(len(often))
        where = self.place[self.terms[turn]]
        rows = self.rows[where >= 0]
        # block by block, so that what a query takes of one stays in the processor's cache
        self.full = np.zeros((blocks, len(often), BLOCK), np.float32)
        self.full[rows // BLOCK, where[where >= 0], rows % BLOCK] = self.posted[where >= 0]
        self.taken = np.empty((len(often), BLOCK), np.float32)
        self.whole = np.zeros(self.wide)
        self.rows, self.posted, cell = self.rows[where < 0], self.posted[where < 0], cell[where < 0]
        self.starts = np.searchsorted(cell, np.arange(self.wide * blocks + 1)).astype(np.int32)

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("ids", "labels", "ends", "terms", "weights", "wide")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    def nearest(self, query: dict[int, float] | Pair, k: int, skip: int | None = None) -> list[tuple[float, int, float]]:
        """(similarity, doc_id, label) of the k most similar examples with a common term."""
        terms, weights = pair_of(query)
        if not len(terms) or not len(self.ids):
            return []
        if not hasattr(self, "rows"):
            self.build()
        self.whole[terms] = weights
        try:
            return self.search(terms, weights, k, skip)
        finally:
            self.whole[terms] = 0

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int | None) -> list[tuple[float, int, float]]:
        cheap = np.argsort(weights**2 / (1 + np.minimum(self.df[terms], GROUP * GROUP)), kind="stable")
        out = int(np.searchsorted(np.cumsum(weights[cheap] ** 2), SLACK**2))
        rest = math.sqrt(float((weights[cheap[:out]] ** 2).sum()))
        kept = cheap[out:]
        at, w = terms[kept], weights[kept].astype(np.float32)
        bound = w @ self.most[at] + rest + MARGIN
        blocks, best = len(bound), []
        often = self.place[at] >= 0
        held, heavy = self.place[at[often]], w[often]
        at, w = at[~often], w[~often]
        high = bound >= FIRST * bound.max()
        for part in (np.flatnonzero(high), np.flatnonzero(~high)):
            least = -best[-1][0] if len(best) == k else 0.0
            part = part[bound[part] >= least]
            if not len(part):
                break
            cell = (at[:, None] * blocks + part).ravel()
            first, last = self.starts[cell], self.starts[cell + 1]
            run = runs_of(first, last)
            score = np.bincount(self.rows.take(run), np.repeat(np.repeat(w, len(part)), last - first) * self.posted.take(run), self.padded).astype(float, copy=False)
            for b in part.tolist() if len(held) else ():
                here = score[b * BLOCK : (b + 1) * BLOCK]
                here += (heavy @ self.full[b].take(held, axis=0, out=self.taken[: len(held)], mode="clip"))[: len(here)]
            # one may be skipped; what an example has already cannot fall: k + 1 groups of rows have one of at least this
            tops = score.reshape(GROUP, -1).max(axis=0)  # neighbours in order are alike and go to different groups
            if len(tops) > k + 1:
                least = max(least, float(np.partition(tops, -k - 1)[-k - 1]))
            if least > rest + MARGIN:
                hit = np.flatnonzero(score >= least - rest - MARGIN)
                if len(hit) > k + 1:
                    least = max(least, float(np.partition(score[hit], -k - 1)[-k - 1]))
                    hit = hit[score[hit] >= least - rest - MARGIN]
            else:  # even rows without a posting so far may count
                here = np.zeros(blocks, bool)
                here[part] = True
                hit = np.flatnonzero(np.repeat(here, BLOCK)[: len(self.ids)] & ((score[: len(self.ids)] > 0) | (rest > 0)))
            first, last = self.ends[hit], self.ends[hit + 1]
            run = runs_of(first, last)
            exact = np.round(np.bincount(np.repeat(np.arange(len(hit)), last - first), self.whole[self.terms[run]] * self.weights[run], len(hit)), 12)
            best += [(-s, i, y) for s, i, y in zip(exact.tolist(), self.ids[hit].tolist(), self.labels[hit].tolist(), strict=True) if s > 0 and i != skip]
            best = sorted(best)[:k]
        return [(-s, i, y) for s, i, y in best]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps of a ridge-penalised logistic regression; the last coefficient is the constant."""
    wide = x.shape[1] + 1
    b, pen = np.zeros(wide), np.r_[np.full(wide - 1, ridge), 1e-6]
    for _ in range(50):
        curve, slope = np.diag(pen + 1e-9), -pen * b
        for i in range(0, len(x), 512):  # the rows may be many and in single precision
            part = np.c_[x[i : i + 512], np.ones(len(x[i : i + 512]))].astype(float)
            p, w = 1 / (1 + np.exp(-np.clip(part @ b, -30, 30))), weight[i : i + 512]
            curve += (part * (w * p * (1 - p))[:, None]).T @ part
            slope += part.T @ (w * (y[i : i + 512] - p))
        step = np.linalg.solve(curve, slope)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


class Model:
    """Everything a task needs to score a text; its size is bounded by the sample of examples."""

    def __init__(self, terms: list[tuple[str, float]], examples: Iterable[tuple[int, int, Pair]], prior: float, k: int):
        self.terms = [t for t, _ in terms]
        self.held = None
        self.weigh = np.array([w for _, w in terms])
        self.k, self.prior, self.floor, self.fit = k, prior, prior, None
        units = [(i, y, self.unit(v)[0]) for i, y, v in examples]
        units = [x for x in units if len(x[2][0])]
        self.index = BlockMaxIndex([i for i, _, _ in units], [y for _, y, _ in units], [u for _, _, u in units], len(terms))

    def calibrate(self, y: np.ndarray, x: np.ndarray, w: np.ndarray, rows: np.ndarray) -> None:
        """``x`` holds the examples' features without their own vote; not numbers where an example has no term.

        ``w`` weighs the examples, ``rows`` is how many labelled rows each stands for.
        """
        none = np.isnan(x).any(axis=1)
        if none.any():
            n = rows[none]
            self.floor = float((n @ y[none] + self.prior) / (n.sum() + 1))
        if not none.all():
            self.fit = logistic(x[~none], y[~none], w[~none])
            if not none.any():
                self.floor = self.calibrated(self.features(0.0, []))

    def send(self, spark: SparkSession) -> Callable[[], Model]:
        """The model in tasks: the examples and terms are broadcast once, what calibration found goes with each function."""
        if self.held is None:
            self.held = spark.sparkContext.broadcast((self.terms, self.weigh, self.index))
        held, rest = self.held, (self.k, self.prior, self.floor, self.fit)

        def get() -> Model:
            m = Model.__new__(Model)
            m.terms, m.weigh, m.index = held.value
            m.k, m.prior, m.floor, m.fit = rest
            return m

        return get

    def calibrated(self, x: list[float]) -> float:
        z = float(np.dot(self.fit[:-1], x) + self.fit[-1])
        return 1 / (1 + math.exp(-min(max(z, -30), 30)))

    def unit(self, counts: Pair) -> tuple[Pair, float]:
        terms, n = counts
        v = (1 + np.log(n)) * self.weigh[terms]
        terms, v = terms[v > 0], v[v > 0]
        norm = math.sqrt(float((v**2).sum()))
        return (terms, v / norm if norm else v), norm

    def features(self, norm: float, near: list[tuple[float, int, float]]) -> list[float]:
        mass = sum(s for s, _, _ in near)
        vote = (sum(s * y for s, _, y in near) + 0.5 * self.prior) / (mass + 0.5)
        vote = min(max(vote, 1e-3), 1 - 1e-3)
        return [math.log(vote / (1 - vote)), math.log1p(norm)]

    def score(self, counts: Pair) -> tuple[float, list[tuple[float, int, float]]]:
        unit, norm = self.unit(counts)
        if not len(unit[0]):
            return self.floor, []
        near = self.index.nearest(unit, self.k)
        if self.fit is None:
            return self.prior, near
        return self.calibrated(self.features(norm, near)), near


def labelled(docs: DataFrame, labels: DataFrame, train: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, y, text of at most ``per_class`` documents of each label, and how many each label has."""
    y = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("y"))
    y = y.where(F.expr(train))
    have = {int(r.y): int(r.n) for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64(F.col("doc_id").cast("long")), "doc_id"]
    chosen = None
    for label in (0, 1):
        part = y.where(F.col("y") == label).orderBy(*order).limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    # at most 2 * per_class rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), have


def varied(rows: DataFrame) -> DataFrame:
    """Of examples with equal label and text, the one with the smallest doc_id, and how many there are: copies would make their own words look telling."""
    return rows.groupBy("y", "text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "text", "y", "copies")


def train(docs: DataFrame, labels: DataFrame, where: str, per_class: int = PER_CLASS, k: int = K) -> Model:
    spark = docs.sparkSession
    found, have = labelled(docs, labels, where, per_class)
    sample = stored(varied(found).repartition(8), f"{shared_dir(spark)}/sample")

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: tuple[Counter, Counter] = (Counter(), Counter())
        for pdf in batches:
            for text, y in zip(pdf.text.tolist(), pdf.y.tolist(), strict=True):
                n[y].update(words_of(text).keys())
        for y in (0, 1):
            if n[y]:
                yield pd.DataFrame({"term": list(n[y]), "y": y, "n": list(n[y].values())})

    tallied = sample.groupBy("y").agg(F.count("*").alias("n"), F.sum("copies").alias("copies")).collect()
    size, share = {int(r.y): int(r.n) for r in tallied}, {int(r.y): have[int(r.y)] / int(r.copies) for r in tallied}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    weight = tuple(have.get(y, 0) / max(size.get(y, 0), 1) for y in (0, 1))
    total = have.get(0, 0) + have.get(1, 0)
    prior = (have.get(1, 0) + 0.5) / (total + 2)
    if not n0 or not n1:
        return Model([], [], prior if total else 0.25, k)
    c = sample.select("text", "y").mapInPandas(tally, "term string, y int, n long").groupBy("term").agg(F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("b"))
    a, b, n = F.col("a").cast("double"), F.col("b").cast("double"), float(n0 + n1)
    chi2 = n * F.pow(a * (n1 - b) - b * (n0 - a), 2) / ((a + b) * (n - a - b) * n0 * n1)
    rows = c.where(a + b >= MIN_DOCS).select("term", (a + b).alias("df"), chi2.alias("chi2")).toPandas().sort_values("term")
    phi = np.sqrt(np.nan_to_num(rows.chi2.to_numpy(float)) / n)  # a term of every example tells nothing
    terms = list(zip(rows.term, (np.log((1 + n) / (1 + rows.df.to_numpy(float))) + 1) * phi**POWER, strict=True))
    number = spark.sparkContext.broadcast({t: i for i, (t, _) in enumerate(terms)})

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = [vector(t, number.value) for t in pdf.text.tolist()]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "y": pdf.y, "copies": pdf.copies, "t": [t.astype(np.int32).tobytes() for t, _ in v], "c": [c.astype(np.int32).tobytes() for _, c in v]})

    # bounded by per_class; stored once: the index and the calibration read it
    held = stored(sample.select("doc_id", "y", "copies", "text").mapInPandas(vectors, "doc_id long, y int, copies long, t binary, c binary"), f"{shared_dir(spark)}/vectors")
    pair = lambda t, c: (np.frombuffer(t, np.int32), np.frombuffer(c, np.int32))
    # one partition at a time in the driver; the index orders them itself
    model = Model(terms, ((int(r.doc_id), int(r.y), pair(r.t, r.c)) for r in held.toLocalIterator()), prior, k)
    sent = model.send(spark)

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent()
        for pdf in batches:
            out = []
            for i, t, c in zip(pdf.doc_id.tolist(), pdf.t, pdf.c, strict=True):
                unit, norm = m.unit(pair(t, c))
                out.append(m.features(norm, m.index.nearest(unit, m.k, i)) if len(unit[0]) else [math.nan] * 2)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "y": pdf.y, "copies": pdf.copies, "v": [x[0] for x in out], "n": [x[1] for x in out]})

    fits = held.repartition(8).mapInPandas(own, "doc_id long, y int, copies long, v double, n double").toPandas().sort_values(["doc_id", "y", "v", "n"])
    y = fits.y.to_numpy(float)
    model.calibrate(y, fits[["v", "n"]].to_numpy(float), np.array([weight[int(i)] for i in y]), fits.copies.to_numpy(float) * np.array([share[int(i)] for i in y]))
    number.unpersist()
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, neighbours (doc_id, similarity, toxic), terms: the decision and its evidence."""
    sent = model.send(docs.sparkSession)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, number, seen = sent(), None, {}
        for pdf in batches:
            number, out = number or {t: i for i, t in enumerate(m.terms)}, []
            for text in pdf.text.tolist():
                key = digest(text)
                if key not in seen:
                    if len(seen) > CACHE_ENTRIES:
                        seen.clear()
                    terms, n = vector(text, number)
                    s, near = m.score((terms, n))
                    top = terms[np.argsort(-m.weigh[terms] * (1 + np.log(n)), kind="stable")[:5]].tolist()
                    seen[key] = (s, [(i, x, int(y)) for x, i, y in near[:5]], [m.terms[t] for t in top])
                out.append(seen[key])
            # ids go as strings: a null beside them would make them floats
            yield pd.DataFrame({"doc_id": pdf.doc_id, "score": [x[0] for x in out], "neighbours": [[{"doc_id": a, "similarity": b, "toxic": c} for a, b, c in x[1]] for x in out], "terms": [x[2] for x in out]})

    out = docs.select(F.col("doc_id").cast("long").cast("string"), "text").mapInPandas(score, "doc_id string, score double, neighbours array<struct<doc_id:long,similarity:double,toxic:int>>, terms array<string>")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def digest(text: str | None) -> bytes:
    return blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest()


def harmless(docs: DataFrame, model: Model, most: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``most``, with all their columns."""
    sent = model.send(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, seen = sent(), {}
        number = {t: i for i, t in enumerate(m.terms)}
        for part in texts:
            out = []
            for text in part.tolist():
                key = digest(text)
                if key not in seen:
                    if len(seen) > CACHE_ENTRIES:
                        seen.clear()
                    seen[key] = m.score(vector(text, number))[0]
                out.append(seen[key])
            yield pd.Series(out, dtype=float)

    return docs.where(score("text") < most)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, "crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    return scored(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "neighbours", "terms")
