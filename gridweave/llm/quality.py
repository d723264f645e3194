"""Quality classification by co-training a text-content view and a page-metadata view.

Text content: hashed words and hashed token shapes (case and attached punctuation) as shares of
the text's tokens, repetition and character classes.  Page metadata: the record's language, source,
declared length, size and line layout.  Both are computed once for every row and stored.  Each view
has its own logistic classifier, fitted on all labelled documents (equal records of one label once,
those of one hash part in four held out); means, slopes and curvatures are summed by the tasks, so
the driver holds matrices of the features only.  The pool is every distinct text of the unlabelled
documents.  Which rows these are is settled on ids and hashes; the features meet them in one merge
join, whatever their number.  Over ``rounds``, each classifier scores the whole pool and hands the
``most`` documents it is surest of to the other's training rows; every task sends on only its best.  Both views are then calibrated, and their
combination fitted, on the labelled rows that were held out.

Defined cases: a null text is an empty one, with no content and an empty layout; null language
and source are values of their own; documents without labels are scored like all others; with
labels of one kind only (or none), every score is the smoothed rate of good labels (0.5 without
any); several labels of a document count as good if any is; repeated rows are scored alike;
further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import discard, shared_dir, stored, table

ROUNDS, EACH, SHARE = 5, 200, 0.05
#: Up to LOCAL labelled rows in all are summed in the driver; else the sums of the tasks meet in GATHER ones.
LOCAL, GATHER = 4096, 4
#: Labelled rows that a task sums at least.
TASK = 8192
#: A Newton step below this is the last one of a fit; what is left is about its square.
STEP = 1e-4
#: No coefficient moves by more in a step, and a step gains at least this share of what the slope promises, or a part of it is taken.
LEAP, GAIN = 4.0, 1e-4
WORDS, SHAPES, FIGURES, TAGS = 512, 256, 13, 64
CACHE_ENTRIES = 100_000
PLACES = re.compile(r"[^\W_]+")


def token_codes(token: str) -> tuple[int, ...]:
    """Hashed places of a token's word and of its shape."""
    core = PLACES.sub(lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "0" if m[0].isdigit() else "x", token)
    word = zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) % WORDS
    return word, WORDS + zlib.crc32(core[:12].encode("utf-8", "surrogatepass")) % SHAPES


def content(text: str, cache: dict) -> np.ndarray:
    if len(cache) > CACHE_ENTRIES:
        cache.clear()
    tokens = text.split()
    codes = []
    for t in tokens:
        got = cache.get(t)
        if got is None:
            got = cache[t] = token_codes(t)
        codes.append(got)
    flat = np.fromiter(chain.from_iterable(codes), np.int64, 2 * len(codes))
    n, k, lines = max(len(text), 1), max(len(tokens), 1), text.split("\n")
    raw = text.encode("utf-8", "surrogatepass")
    spaces = raw.count(b" ")
    letters = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    marks = len(raw) - len(raw.translate(None, b"!#$%&*+<=>@[]^_{|}~\\"))
    same = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))
    figures = [np.log1p(k), len(text) / k / 10, spaces / n, letters / n, upper / n, digits / n, marks / n, marks > 0.02 * n, upper > 0.2 * n, same / k, same > 0.05 * k, len(set(tokens)) / k, len(set(lines)) / len(lines)]
    shares = np.sqrt(np.bincount(flat, minlength=WORDS + SHAPES) / k)
    # in half precision, as they are stored
    return np.minimum(np.concatenate([shares, np.array(figures, float)]), 60_000).astype(np.float16).astype(np.float32)


def metadata(text: str, lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
    """Figures of the record, none of its words."""
    n, lines = max(len(text), 1), text.count("\n") + 1
    declared = float(n_chars) if n_chars is not None and n_chars == n_chars else -1.0
    figures = [np.log1p(len(text)), np.log1p(lines), np.log1p(len(text) / lines), np.log1p(max(declared, 0)), abs(declared - len(text)) / n > 0.01, declared < 0]
    tags = np.zeros(TAGS, np.float32)
    tags[zlib.crc32(f"lang {lang}".encode()) % TAGS] += 1
    tags[zlib.crc32(f"source {source}".encode()) % TAGS] += 1
    return np.concatenate([np.array(figures, np.float32), tags])


def views(pdf: pd.DataFrame, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    texts = [t or "" for t in pdf.text.tolist()]
    a = np.array([content(t, cache) for t in texts], np.float32).reshape(len(texts), WORDS + SHAPES + FIGURES)
    b = [metadata(t, *m) for t, *m in zip(texts, pdf.lang.tolist(), pdf.source.tolist(), pdf.n_chars.tolist(), strict=True)]
    return a, np.array(b, np.float32).reshape(len(texts), -1)


def inputs(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang, source, n_chars; columns that ``docs`` lacks are null."""
    has = set(docs.columns)
    kinds = {"lang": "string", "source": "string", "n_chars": "double"}
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *((F.col(c) if c in has else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))


class View:
    """A logistic classifier over standardised features, with a calibration of its logit."""

    def __init__(self, n: float, total: np.ndarray, squares: np.ndarray, ridge: float):
        mean = total / n
        self.mean, self.scale, self.ridge = mean.astype(np.float32), (np.sqrt(np.maximum(squares / n - mean**2, 0)) + 1e-3).astype(np.float32), ridge
        self.b, self.calibration = np.zeros(len(mean) + 1), np.array([1.0, 0.0])

    def standard(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.standard(x) @ self.b[:-1] + self.b[-1], -15, 15)

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return self.logit(x) * self.calibration[0] + self.calibration[1]


#: Both views, labels, weights and which rows are held out, of some labelled rows.
Chunk = tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]
#: Features, labels and weights that a fit takes from a chunk.
Taken = Callable[[Chunk], tuple[np.ndarray, np.ndarray, np.ndarray]]
#: The chunks that batches of stored rows hold.
Chunks = Callable[[Iterable[pd.DataFrame]], Iterator]


class Labelled:
    """Stored rows and the chunks they make.  Sums over all of them, by the tasks or, where they are few, here."""

    def __init__(self, rows: DataFrame, chunks: Chunks, few: bool):
        self.rows, self.chunks = rows, chunks
        self.here = list(chunks([rows.toPandas()])) if few else None

    def total(self, of: Callable[..., list[np.ndarray]], shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
        if self.here is not None:
            return summed(map(of, self.here), shapes) or [np.zeros(x) for x in shapes]
        chunks = self.chunks

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            got = summed(map(of, chunks(batches)), shapes)
            yield pd.DataFrame({"s": [packed(got)] if got else []})

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            got = summed((unpacked(s, shapes) for pdf in batches for s in pdf.s), shapes)
            yield pd.DataFrame({"s": [packed(got)] if got else []})

        sums = self.rows.mapInPandas(part, "s binary").repartition(GATHER).mapInPandas(add, "s binary")
        return summed((unpacked(r.s, shapes) for r in sums.collect()), shapes) or [np.zeros(x) for x in shapes]

    def logits(self, of: Taken, path: str) -> Labelled:
        """The same over two figures, a label and a weight of each row that ``of`` takes, stored without the features."""
        out = Labelled(self.rows, plain, False)
        if self.here is not None:
            out.here = list(map(of, self.here))
            return out
        chunks = self.chunks

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for z, y, w in map(of, chunks(batches)):
                yield pd.DataFrame({"z0": z[:, 0], "z1": z[:, 1], "y": y, "w": w})

        out.rows = stored(self.rows.mapInPandas(part, "z0 double, z1 double, y double, w double"), path)
        return out


def plain(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for pdf in batches:
        yield pdf[["z0", "z1"]].to_numpy(float), pdf.y.to_numpy(float), pdf.w.to_numpy(float)


def weighted(weight: dict[int, float]) -> Chunks:
    def chunks(batches: Iterable[pd.DataFrame]) -> Iterator[Chunk]:
        for pdf in batches:
            for i in range(0, len(pdf), 1000):
                part = pdf.iloc[i : i + 1000]
                y = part.y.to_numpy(float)
                yield matrices(part), y, np.where(y == 1, weight[1], weight[0]), part.held.to_numpy(bool)

    return chunks


def summed(found: Iterable[list[np.ndarray]], shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    """The sums of arrays of these shapes; nothing of nothing."""
    out: list[np.ndarray] = []
    for each in found:
        out = out or [np.zeros(x) for x in shapes]
        for a, b in zip(out, each, strict=True):
            a += b
    return out


def packed(sums: list[np.ndarray]) -> bytes:
    """Of matrices, which are symmetric, the upper triangle in single precision."""
    return b"".join(x[np.triu_indices(len(x))].astype(np.float32).tobytes() if x.ndim == 2 else x.tobytes() for x in sums)


def unpacked(raw: bytes, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    out, at = [], 0
    for shape in shapes:
        if len(shape) == 2:
            upper = np.triu_indices(shape[0])
            x = np.zeros(shape)
            x[upper] = x.T[upper] = np.frombuffer(raw, np.float32, len(upper[0]), at)
            at += 4 * len(upper[0])
        else:
            x = np.frombuffer(raw, np.float64, shape[0], at)
            at += 8 * shape[0]
        out.append(x)
    return out


def bent(x: np.ndarray, y: np.ndarray, w: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Curvature and slope of the weighted log-likelihood; single precision of the first costs steps only."""
    x = np.c_[x, np.ones(len(x), x.dtype)]
    wide = x.astype(float)
    p = 1 / (1 + np.exp(-np.clip(wide @ b, -30, 30)))
    single = x.astype(np.float32) * np.sqrt(w * p * (1 - p)).astype(np.float32)[:, None]
    return [single.T @ single, wide.T @ (w * (y - p))]


def likelihood(x: np.ndarray, y: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The weighted log-likelihood, alone in an array."""
    z = x @ b[:-1] + b[-1]
    return np.array([-(w * np.logaddexp(0, np.where(y > 0.5, -z, z))).sum()])


class Climb:
    """Newton steps up a ridge-penalised log-likelihood from ``b``, the best point so far; ``at`` is where sums are wanted next.

    A whole step may lead down, and then further away with every step, where rows are judged with
    too much confidence and wrongly: as their curvature is nothing, steps become too long.
    """

    def __init__(self, start: np.ndarray, ridge: float):
        self.b, self.at, self.done = start.copy(), start.copy(), False
        self.pen = np.r_[np.full(len(start) - 1, ridge), 1e-6]
        self.value, self.step, self.promise = -np.inf, np.zeros(len(start)), 0.0

    def go(self, curve: np.ndarray, slope: np.ndarray, value: float) -> None:
        """The sums at ``at``: on from there, or back half of the way."""
        value -= float(self.pen @ self.at**2) / 2
        # sums of many rows are off by their last digits
        if value < self.value + GAIN * self.promise - 1e-10 * abs(self.value):
            self.step, self.promise = self.step / 2, self.promise / 2
            self.at = self.b + self.step
            return
        self.b, self.value, slope = self.at, value, slope - self.pen * self.at
        step = np.linalg.solve(curve + np.diag(self.pen + 1e-9), slope)
        longest = np.abs(step).max()
        self.step = step * min(1.0, LEAP / longest) if longest else step
        self.promise, self.at = float(slope @ self.step), self.b + self.step
        if longest < STEP:
            self.b, self.done = self.at, True


def fitted_by(rows: Labelled, taken: list[Taken], start: list[np.ndarray], ridge: list[float], extra: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None]) -> list[np.ndarray]:
    """Several ridge-penalised logistic regressions over all rows; the last coefficient is the constant."""
    climbs = [Climb(b, r) for b, r in zip(start, ridge, strict=True)]

    def sums_of(x: np.ndarray, y: np.ndarray, w: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        return [*bent(x, y, w, b), likelihood(x, y, w, b)]

    for _ in range(100):
        left = [k for k, c in enumerate(climbs) if not c.done]
        if not left:
            break
        now = [(taken[k], climbs[k].at) for k in left]
        shapes = [x for _, c in now for x in ((len(c), len(c)), (len(c),), (1,))]
        sums = rows.total(lambda chunk: list(chain.from_iterable(sums_of(*t(chunk), c) for t, c in now)), shapes)  # noqa: B023
        for i, k in enumerate(left):
            found = sums[3 * i : 3 * i + 3]
            if extra[k] is not None:
                found = [a + b for a, b in zip(found, sums_of(*extra[k], climbs[k].at), strict=True)]
            climbs[k].go(found[0], found[1], float(found[2][0]))
    return [c.b for c in climbs]


class CoTrained:
    def __init__(self, rate: float):
        self.rate, self.parts, self.blend = rate, None, None

    def fit(self, rows: Labelled, surest: Surest, rounds: int, calibrate_on_all: bool, at: str) -> None:
        """``surest`` names, for each view, the pool's rows that the other one hands over now."""
        widths = [WORDS + SHAPES + FIGURES, 6 + TAGS]

        def moments(chunk: Chunk) -> list[np.ndarray]:
            xs, fit = [x[~chunk[3]].astype(float) for x in chunk[0]], float((~chunk[3]).sum())
            return [np.array([fit]), *chain.from_iterable((x.sum(0), (x * x).sum(0)) for x in xs)]

        n, *m = rows.total(moments, [(1,), *((w,) for w in widths for _ in (0, 1))])
        parts = self.parts = [View(n[0], m[0], m[1], 30.0), View(n[0], m[2], m[3], 10.0)]

        def of(v: int) -> Taken:
            part = parts[v]

            def take(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                xs, y, w, held = chunk
                return part.standard(xs[v][~held]), y[~held], w[~held]

            return take

        taken: list[dict[int, tuple[np.ndarray, float]]] = [{}, {}]
        for step in range(rounds + 1):
            extra = []
            for v, part in enumerate(parts):
                got = [taken[v][i] for i in sorted(taken[v])]
                extra.append((part.standard(np.array([x for x, _ in got], np.float32)), np.array([label for _, label in got]), np.full(len(got), 0.5)) if got else None)
            # each round starts from the last one's coefficients
            for part, b in zip(parts, fitted_by(rows, [of(0), of(1)], [p.b for p in parts], [p.ridge for p in parts], extra), strict=True):
                part.b = b
            if step < rounds:
                for v, new in enumerate(surest(parts, [set(t) for t in taken], self.rate)):
                    taken[v] |= new

        def judged(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            xs, y, w, held = chunk
            here = held | calibrate_on_all
            return np.c_[parts[0].logit(xs[0][here]), parts[1].logit(xs[1][here])].astype(float), y[here], w[here]

        logits = rows.logits(judged, f"{at}/held")

        def one(v: int) -> Taken:
            return lambda chunk: (chunk[0][:, v : v + 1], chunk[1], chunk[2])

        for part, c in zip(parts, fitted_by(logits, [one(0), one(1)], [np.array([1.0, 0.0])] * 2, [0.01] * 2, [None] * 2), strict=True):
            part.calibration = c
        by, to = np.array([p.calibration for p in parts]).T
        self.blend = fitted_by(logits, [lambda chunk: (chunk[0] * by + to, chunk[1], chunk[2])], [np.array([0.5, 0.5, 0.0])], [0.1], [None])[0]
        discard(rows.rows.sparkSession, f"{at}/held")

    def score(self, xs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.parts is None:
            p = np.full(len(xs[0]), self.rate)
            return p, p, p
        z = [part.calibrated(x) for part, x in zip(self.parts, xs, strict=True)]
        sigmoid = lambda t: 1 / (1 + np.exp(-np.clip(t, -30, 30)))
        return sigmoid(np.c_[z[0], z[1]] @ self.blend[:-1] + self.blend[-1]), sigmoid(z[0]), sigmoid(z[1])


Surest = Callable[[list[View], list[set[int]], float], list[dict[int, tuple[np.ndarray, float]]]]


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, k (a number of the row), h (hash of the text), g (hash of the record) and both views (a in half precision, b) of every row."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for pdf in batches:
            for i in range(0, len(pdf), 1000):
                part = pdf.iloc[i : i + 1000]
                a, b = views(part, cache)
                yield pd.DataFrame({"doc_id": part.doc_id, "k": part.k, "h": part.h, "g": part.g, "a": [x.tobytes() for x in a.astype(np.float16)], "b": [x.tobytes() for x in b]})

    # ids go as strings: a null beside them would make them floats
    rows = inputs(docs).withColumns({"doc_id": F.col("doc_id").cast("string"), "h": F.xxhash64("text"), "g": F.xxhash64("text", "lang", "source", "n_chars"), "k": F.monotonically_increasing_id()})
    return rows.mapInPandas(build, "doc_id string, k long, h long, g long, a binary, b binary").withColumn("doc_id", F.col("doc_id").cast("long"))


def matrices(found: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(found[c]), t).astype(np.float32).reshape(len(found), -1) for c, t in (("a", np.float16), ("b", np.float32))]


def handing_over(pool: DataFrame, each: int, gather: int) -> Surest:
    """Scores of the whole pool by both views; at most ``gather * each`` documents a view and round reach the driver."""

    def surest(parts: list[View], taken: list[set[int]], rate: float) -> list[dict[int, tuple[np.ndarray, float]]]:
        good = max(1, round(each * rate))
        most = {1: good, 0: max(1, each - good)}

        def best(found: pd.DataFrame) -> pd.DataFrame:
            """The surest of each view and label."""
            found = found.sort_values(["to", "label", "sure", "h"], ascending=[True, True, False, True], kind="stable")
            return found[found.groupby(["to", "label"]).cumcount() < found.label.map(most)]

        def decided(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for i in range(0, len(pdf), 1000):
                    part = pdf.iloc[i : i + 1000]
                    xs = matrices(part)
                    for v in (0, 1):
                        z = parts[v].logit(xs[v])
                        # only decided cases are handed over, and a view is not asked again about what it has handed over
                        at = np.flatnonzero((np.abs(z) > 1.5) & ~part.h.isin(taken[1 - v]).to_numpy())
                        row = part.iloc[at]
                        yield pd.DataFrame({"h": row.h, "to": 1 - v, "label": (z[at] > 0).astype(int), "sure": np.abs(z[at]), "x": row["ba"[v]]})

        def chosen(found: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
            kept = None
            for more in found:
                if len(more):
                    kept = best(more if kept is None else pd.concat([kept, more]))
            return kept

        def sends(of: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
            def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                kept = chosen(of(batches))
                if kept is not None:
                    yield kept

            return send

        columns = "h long, to int, label int, sure double, x binary"
        found = pool.select("h", "a", "b").mapInPandas(sends(decided), columns).repartition(gather).mapInPandas(sends(lambda batches: batches), columns)
        kept = chosen(iter([found.toPandas()]))
        out: list[dict[int, tuple[np.ndarray, float]]] = [{}, {}]
        for r in [] if kept is None else kept.itertuples():
            out[r.to][int(r.h)] = (np.frombuffer(r.x, (np.float16, np.float32)[r.to]).astype(np.float32), float(r.label))
        return out

    return surest


def train(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, most: int = EACH, share: float = SHARE) -> CoTrained:
    spark, at = docs.sparkSession, shared_dir(docs.sparkSession)
    model = fitted(stored(featured(docs), f"{at}/features"), labels, rounds, most, share)
    discard(spark, f"{at}/features")
    return model


def fitted(features: DataFrame, labels: DataFrame, rounds: int = ROUNDS, most: int = EACH, share: float = SHARE) -> CoTrained:
    """The model of all labelled rows and all unlabelled texts among ``features``, a stored table."""
    spark, at = features.sparkSession, shared_dir(features.sparkSession)
    y = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("y"))
    have = {int(r.y): int(r.n) for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(have.values())
    model = CoTrained((have.get(1, 0) + 1) / (total + 2))
    if len(have) < 2:
        return model
    # on ids and hashes: equal records of one label count once, as do equal texts of the pool
    known = features.where("doc_id is not null").select("doc_id", "k", "h", "g").join(y.hint("merge"), "doc_id", "left")
    once = known.groupBy("y", F.when(F.col("y").isNull(), F.col("h")).otherwise(F.col("g")).alias("same")).agg(F.min(F.struct("doc_id", "g", "k")).alias("r"))
    held = F.crc32(F.concat(F.lit("held "), F.col("r.doc_id").cast("string")).cast("binary")) % 4 == 0
    roles = stored(once.select("r.k", "y", held.alias("held")), f"{at}/roles")
    sizes = {(r.y if r.y is None else int(r.y), bool(r.held)): int(r.n) for r in roles.groupBy("y", "held").agg(F.count("*").alias("n")).collect()}
    n = {v: sizes.get((v, False), 0) + sizes.get((v, True), 0) for v in (0, 1, None)}
    if not n[0] or not n[1]:
        discard(spark, f"{at}/roles")
        return model
    # the plan does not change with the size
    used = stored(features.select("k", "h", "a", "b").join(roles.hint("merge"), "k").select("h", "y", "held", "a", "b", F.col("y").isNull().alias("free")), f"{at}/used", "free")
    discard(spark, f"{at}/roles")
    pool, rows = used.where("free").select("h", "a", "b"), used.where("not free").select("y", "held", "a", "b").coalesce(-(-(n[0] + n[1]) // TASK))
    if not sizes.get((0, False)) or not sizes.get((1, False)):
        rows, sizes = rows.withColumn("held", F.lit(False)), {}
    mean = total / (n[0] + n[1])
    labelled = Labelled(rows, weighted({v: have[v] / n[v] / mean for v in (0, 1)}), n[0] + n[1] <= LOCAL)
    surest = handing_over(pool, max(1, min(most, int(share * n[None]))), GATHER)
    model.fit(labelled, surest, rounds if n[None] else 0, not (sizes.get((0, True)) and sizes.get((1, True))), at)
    discard(spark, f"{at}/used")
    return model


def judged(features: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id, score (probability of good), content_score, metadata_score of stored features."""
    held = features.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 1000):
                part = pdf.iloc[i : i + 1000]
                both, a, b = held.value.score(matrices(part))
                yield pd.DataFrame({"doc_id": part.doc_id, "score": both, "content_score": a, "metadata_score": b})

    rows = features.select(F.col("doc_id").cast("string").alias("doc_id"), "a", "b")
    return rows.mapInPandas(score, "doc_id string, score double, content_score double, metadata_score double").withColumn("doc_id", F.col("doc_id").cast("long"))


def scored(docs: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id, score (probability of good), content_score, metadata_score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for pdf in batches:
            for i in range(0, len(pdf), 1000):
                part = pdf.iloc[i : i + 1000]
                both, a, b = held.value.score(views(part, cache))
                # ids go as strings: a null beside them would make them floats
                yield pd.DataFrame({"doc_id": part.doc_id, "score": both, "content_score": a, "metadata_score": b})

    out = inputs(docs).withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(score, "doc_id string, score double, content_score double, metadata_score double")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def good(docs: DataFrame, model: CoTrained, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        cache: dict = {}
        for columns in parts:
            pdf = pd.concat(columns, axis=1, keys=["text", "lang", "source", "n_chars"])
            each = [held.value.score(views(pdf.iloc[i : i + 1000], cache))[0] for i in range(0, len(pdf), 1000)]
            yield pd.Series(np.concatenate(each) if each else [], dtype=float)

    has = set(docs.columns)
    kinds = {"text": "string", "lang": "string", "source": "string", "n_chars": "double"}
    return docs.where(score(*((F.col(c) if c in has else F.lit(None)).cast(k) for c, k in kinds.items())) >= least)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = stored(featured(table(spark, sf_dir, "documents")), f"{shared_dir(spark)}/features")
    return judged(features, fitted(features, table(spark, sf_dir, "labels"))).withColumn("kept", F.col("score") >= 0.5)
