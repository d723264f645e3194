"""Exact top-k inner products over an impact-ordered, score-at-a-time index.

Vectors are dealt into shards of about ``shard_rows`` rows.  A shard's index keeps, for every
dimension, its rows in order of value, cut into segments of equal quantised value; it is stored
once, in the shared folder.  A query
processes the segments of all dimensions by falling quantised impact |weight * level| and adds
the quantised impact to its accumulators.  After each step, every score is known up to what the
unprocessed segments and the quantisation can still add; processing stops only when that proves
all but a few rows to be outside the best k, and the possible members are rescored exactly.  The
stated query set meets all rows in blocks: a task holds one shard's index and reads the blocks of
queries from the shared folder one after the other; no vector is shuffled for it.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter
vectors count as padded with zeros; an empty vector scores 0 everywhere; rows that share a
query's id are its own and are no candidates for it; null ids take no part; ties go to the
smaller id; repeated candidate rows each count, repeated query rows are one query; other columns are ignored; without queries or
candidates there are no rows.  Scores that may not fit into 64 bits raise an error.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import file_system, shared_dir, stored, table

SHARD_ROWS, QUERY_BLOCK, SHIFT, STEPS = 8192, 256, 3, 12


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, v: floor(256 * x) of each component, as longs."""
    good = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    usable = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256.0).cast("long")).alias("v"))


def matrix(rows: pd.Series) -> np.ndarray:
    wide = max((len(v) for v in rows), default=0)
    out = np.zeros((len(rows), wide), np.int64)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


STORED = ("ids", "rows", "order", "dims", "levels", "starts", "stops")


class Index:
    """One shard: rows by value for each dimension, and where each quantised level starts."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        n, self.wide = rows.shape
        # a segment's rows lie side by side
        self.order = np.ascontiguousarray(np.argsort(rows, axis=0, kind="stable").T, np.int32)
        dims, levels, starts, stops = [], [], [], []
        for d in range(self.wide):
            level = rows[self.order[d], d] >> SHIFT
            cut = np.flatnonzero(np.r_[True, level[1:] != level[:-1]])
            dims.append(np.full(len(cut), d))
            levels.append(level[cut])
            starts.append(cut)
            stops.append(np.r_[cut[1:], n])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        self.dims, self.levels, self.starts, self.stops = map(join, (dims, levels, starts, stops))

    def packed(self) -> dict:
        return {n: pickle.dumps(getattr(self, n), 5) for n in STORED}

    @classmethod
    def unpacked(cls, row) -> Index:
        index = cls.__new__(cls)
        for n in STORED:
            setattr(index, n, pickle.loads(getattr(row, n)))
        index.wide = index.rows.shape[1]
        return index

    def search(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of a superset of the k best rows (those not ``own``)."""
        n = len(self.ids)
        weight = np.zeros(self.wide, np.int64)
        weight[: min(len(q), self.wide)] = q[: self.wide]
        possible = self.ids != own
        # a row of a segment adds weight * (level * 2^SHIFT + rest), 0 <= rest < 2^SHIFT
        low = weight[self.dims] * (self.levels << SHIFT)
        slack = weight[self.dims] * ((1 << SHIFT) - 1)
        floor, ceil = low + np.minimum(slack, 0), low + np.maximum(slack, 0)
        impact = np.maximum(np.abs(floor), np.abs(ceil))
        turn = np.argsort(-impact, kind="stable")
        turn = turn[impact[turn] > 0]
        exact_error = int(np.abs(weight).sum()) * ((1 << SHIFT) - 1)
        acc = np.zeros(n)
        size = self.stops - self.starts
        ends, order = np.cumsum(size[turn]), self.order.ravel()
        first, last = self.dims * n + self.starts, self.dims * n + self.stops
        at = 0
        while at < len(turn):
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + max(1, ends[-1] // STEPS), "left")) + 1
            now = turn[at:stop]
            rows = np.concatenate([order[s:e] for s, e in zip(first[now].tolist(), last[now].tolist(), strict=True)])
            acc += np.bincount(rows, np.repeat(floor[now].astype(float), size[now]), n)
            at = min(stop, len(turn))
            rest = np.zeros(self.wide)
            np.maximum.at(rest, self.dims[turn[at:]], impact[turn[at:]].astype(float))
            left = float(rest.sum())
            if possible.sum() > k:
                best = np.partition(acc[possible], -k)[-k] - left
                possible &= acc + left + exact_error >= best
            # what is left to process costs more than the exact scores of all that are still possible
            if possible.sum() <= max(4 * k, n // 64, (ends[-1] - ends[at - 1]) // self.wide):
                break
        places = np.flatnonzero(possible)
        return places, self.rows[places] @ weight


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``vectors`` for each row of ``queries``."""
    spark = vectors.sparkSession
    at = shared_dir(spark)
    base, asked = stored(integers(vectors), f"{at}/vectors"), stored(integers(queries).distinct(), f"{at}/queries")
    shards = max(1, -(-base.count() // shard_rows))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    # nothing may wrap: the largest products of any two rows, counted over all of them
    largest = [base.agg(F.max(F.array_max(F.transform("v", F.abs))).alias("m"), F.max(F.size("v")).alias("n")).first(), asked.agg(F.max(F.array_max(F.transform("v", F.abs))).alias("m")).first()]
    if (largest[0].m or 0) * (largest[1].m or 0) * (largest[0].n or 0) >= 2**62:
        raise ValueError("scores do not fit into 64 bits")

    def dealt(df: DataFrame, key: str, n: int) -> DataFrame:
        return df.withColumn(key, F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n)).cast("int")).groupBy(key)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({k: [v] for k, v in Index(pdf.vec_id.to_numpy(np.int64), matrix(pdf.v)).packed().items()})

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        m = matrix(pdf.v)
        return pd.DataFrame({"ids": [pdf.vec_id.to_numpy(np.int64).tobytes()], "rows": [m.tobytes()], "wide": [m.shape[1]]})

    index = stored(dealt(base, "shard", shards).applyInPandas(build, ", ".join(f"{n} binary" for n in STORED)), f"{at}/index")
    parts = f"{at}/parts"
    stored(dealt(asked, "part", blocks).applyInPandas(block, "ids binary, rows binary, wide int"), parts)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as files, parquet

        fs, where = file_system(parts)
        names = sorted(f.path for f in fs.get_file_info(files.FileSelector(where)) if f.path.endswith(".parquet"))
        for pdf in batches:
            for shard in pdf.itertuples(index=False):
                index = Index.unpacked(shard)
                for name in names:
                    with fs.open_input_file(name) as f:
                        for batch in parquet.ParquetFile(f).iter_batches(1):
                            out = []
                            for r in batch.to_pylist():
                                own_ids = np.frombuffer(r["ids"], np.int64)
                                for own, q in zip(own_ids.tolist(), np.frombuffer(r["rows"], np.int64).reshape(len(own_ids), r["wide"]), strict=True):
                                    places, scores = index.search(q, own, k)
                                    first = np.lexsort((index.ids[places], -scores))[:k]
                                    out.append(pd.DataFrame({"query_id": own, "vec_id": index.ids[places[first]], "score": scores[first]}))
                            yield pd.concat(out)

    spread = index.repartition(min(shards, 4096))
    near = spread.mapInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT vec_id, unnest(range(1, len(v) + 1)) AS d, unnest(v) AS c FROM v),
s AS (SELECT q.vec_id AS query_id, b.vec_id, sum(q.c * b.c) AS score FROM x q JOIN x b USING (d) WHERE q.vec_id % 50 = 0 AND b.vec_id <> q.vec_id GROUP BY q.vec_id, b.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 5
"""
