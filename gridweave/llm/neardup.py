"""Near-duplicate classes with an LSH forest over MinHash signatures, confirmed on full shingle sets.

1. Each text becomes its set of word shingles (64-bit hashes) and a MinHash signature.  Equal sets
   collapse to one representative, however many copies there are.
2. The forest: every tree is one sorted order of the representatives by its own sequence of
   signature values.  Rows are range-partitioned by (leading values, deeper values, id), so no
   region of the order, however common, lands in one task.  A region is what shares a tree's
   ``lead`` first values.  In a region of at most ``region`` rows, all neighbours are candidates;
   a larger one is taken deeper: candidates are the neighbours with the longest common prefixes
   (the nearest ones in the order) and the region's first row in the partition, which bounds a
   row's candidates by a partition's rows.  What a partition border cuts is
   paired by the same step over the border rows.
3. Candidates are confirmed by exact set sizes, the likeliest of each document first; pairs whose
   ends are connected already need no confirmation.
4. Regions taken deeper may hold links that no neighbour pair shows.  Wherever such a region
   still holds more than one class, its members outside the largest class are confirmed against
   all members of that class and against each other, in blocks of sets.

Recall: a pair of similarity s meets in one of T trees with probability 1 - (1 - s^lead)^T, over
0.999 at s = 0.8 with the defaults and over 0.999999 at 0.85.

Defined cases: null and wordless texts have empty sets and are linked with nothing; a text of
fewer words than a shingle is one shingle; rows with equal doc_id are separate members; a row
without doc_id takes part but cannot name its class unless no other member has an id (then
component_id is null and the row is kept); ties go to the smallest doc_id; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import discard, shared_dir, stored, table, wrapped
from .components import components

HASHES, TREES, LEAD, DEEP, REGION, NEAR, SEED = 128, 32, 6, 4, 16, 2, 20240229
#: Sets that travel together when large regions are checked again.
BLOCK = 256
#: Tokens hashed at a time.
BATCH_TOKENS = 1_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text, in order."""
    for i in range(0, len(texts), 256):
        part = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts[i : i + 256]]
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        codes = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in part]
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
        for c in codes:
            w = hashes[c]
            if not len(w):
                yield w
                continue
            k = min(width, len(w))
            s = np.full(len(w) - k + 1, k, np.uint64)
            for j in range(k):
                s = (s * MIX) ^ w[j : len(w) - k + 1 + j]
                s = mixed(s)
            yield np.unique(s)


def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 2**64, HASHES, dtype=np.uint64) | np.uint64(1)
    return a, rng.integers(0, 2**64, HASHES, dtype=np.uint64)


def signature(s: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(s), 4096):
        low = np.minimum(low, (((s[i : i + 4096, None] ^ x) * a) >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return low


def signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, h (hash of the text), n, sid (name of the set, null if empty), sig (128 little-endian uint32)."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, x = permutations()
        for pdf in batches:
            n, sid, sig = [], [], []
            for s in shingle_sets(pdf.text.tolist(), width):
                n.append(len(s))
                sid.append(int(np.int64(xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63)) if len(s) else None)
                sig.append(signature(s, a, x).astype("<u4").tobytes() if len(s) else None)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "h": pdf.h, "n": n, "sid": pd.array(sid, "Int64"), "sig": sig})

    # ids go as strings: a null beside them would make them floats
    out = docs.select(F.col("doc_id").cast("long").cast("string"), F.xxhash64("text").alias("h"), "text").mapInPandas(sign, "doc_id string, h long, n long, sid long, sig binary")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def forest(reps: DataFrame) -> DataFrame:
    """key (tree and leading values), deep (further values, 16 bits of each), a (sid): one row per tree."""

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(SEED + 1)
        orders = [rng.permutation(HASHES)[: LEAD + DEEP] for _ in range(TREES)]
        for pdf in batches:
            if not len(pdf):
                continue
            sigs = np.frombuffer(b"".join(pdf.sig), "<u4").reshape(-1, HASHES).astype(np.uint64)
            for t, order in enumerate(orders):
                key = np.full(len(sigs), t + 1, np.uint64)
                for k in order[:LEAD]:
                    key = mixed(key * MIX ^ sigs[:, k])
                deep = np.zeros(len(sigs), np.uint64)
                for k in order[LEAD:]:
                    deep = deep << np.uint64(16) | sigs[:, k] >> np.uint64(16)
                yield pd.DataFrame({"key": key.view(np.int64), "deep": deep.view(np.int64), "a": pdf.sid})

    return reps.select("sid", "sig").mapInPandas(grow, "key long, deep long, a long")


def neighbours(entries: DataFrame, partitions: int) -> DataFrame:
    """kind 'pair' (a, b), 'edge' (a at a partition's border) and 'large' (a in a region taken deeper).

    ``big`` goes along with an edge whose region was taken deeper: what lies beyond the border is part of it.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        key, deep, a = (np.concatenate([p[c].to_numpy(np.int64) for p in parts]) for c in ("key", "deep", "a"))
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        size, first = np.repeat(sizes, sizes), np.repeat(starts, sizes)
        big = np.logical_or.reduceat(np.concatenate([p.big.to_numpy(bool) for p in parts]), starts) | (sizes > REGION)
        big = np.repeat(big, sizes)

        def rows(kind: str, i: np.ndarray, b: np.ndarray | None = None) -> pd.DataFrame:
            return pd.DataFrame({"kind": kind, "key": key[i], "deep": deep[i], "a": a[i], "big": big[i], "b": pd.array(b if b is not None else [None] * len(i), "Int64")})

        most = int(min(sizes.max(), REGION))
        for d in range(1, most):
            i = np.flatnonzero((key[:-d] == key[d:]) & ((size[:-d] <= REGION) | (d <= NEAR)))
            if len(i):
                yield rows("pair", i, a[i + d])
        i = np.flatnonzero((size > REGION) & (np.arange(len(key)) > first))
        if len(i):
            yield rows("pair", i, a[first[i]])
        large = np.flatnonzero(big)
        if len(large):
            yield rows("large", large)
        if partitions > 1:
            near = [np.arange(s, e) if e - s <= REGION else np.r_[s : s + NEAR, e - NEAR : e] for s, e in {(0, int(sizes[0])), (int(starts[-1]), len(key))}]
            yield rows("edge", np.concatenate(near))

    if partitions > 1:
        entries = entries.repartitionByRange(partitions, "key", "deep", "a")
    else:
        entries = entries.coalesce(1)
    return entries.sortWithinPartitions("key", "deep", "a").mapInPandas(scan, "kind string, key long, deep long, a long, big boolean, b long")


def candidates(reps: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(a, b, met): pairs and in how many trees they met; (key, a): members of regions taken deeper."""
    entries, partitions = forest(reps).withColumn("big", F.lit(False)), int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = []
    while True:
        found.append(stored(neighbours(entries, partitions), f"{at}/neighbours-{len(found)}"))
        if partitions == 1:
            break
        entries = found[-1].where("kind = 'edge'").select("key", "deep", "a", "big")
        partitions = 1 if partitions <= 64 else partitions // 16
    rows = found[0]
    for x in found[1:]:
        rows = rows.union(x)
    pairs = rows.where("kind = 'pair' and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("met")), rows.where("kind = 'large'").select("key", "a").distinct()


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """sid, s: the full shingle sets (sorted 64-bit hashes) of the wanted (doc_id, sid)."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sid, out = [], []
            for want, s in zip(pdf.sid.tolist(), shingle_sets(pdf.text.tolist(), width), strict=True):
                if len(s) and int(np.int64(xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63)) == want:
                    sid.append(want)
                    out.append(s.tobytes())
            yield pd.DataFrame({"sid": np.array(sid, np.int64), "s": out})

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = held.join(wanted.select(F.col("doc_id").alias("w"), "sid"), F.col("doc_id").eqNullSafe(F.col("w")))
    return joined.select("sid", "text").mapInPandas(build, "sid long, s binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |A and B| >= percent * |A or B|."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = np.zeros(len(pdf), bool)
            for i, (x, y) in enumerate(zip(pdf.sa, pdf.sb, strict=True)):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)):
                    both = len(p) + len(q) - len(np.union1d(p, q))
                    good[i] = 100 * both >= percent * (len(p) + len(q) - both)
            yield pdf.loc[good, ["a", "b"]]

    left = sets.select(F.col("sid").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("sid").alias("b"), F.col("s").alias("sb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInPandas(check, "a long, b long")


def rechecked(odd: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between roots: the odd members (main, a, root) of each main class against all its members and each other.

    Both sides travel in blocks of about ``BLOCK`` sets; a task intersects one block of odd members
    with one block of the class through the block's own inverted lists and returns roots only.
    """
    mains = odd.select(F.col("main").alias("root")).distinct()
    own = labels.join(mains, "root", "left_semi").select("root", "node").union(mains.select("root", F.col("root").alias("node")))
    against = own.select(F.col("root").alias("main"), F.col("node").alias("a"), "root").union(odd.select("main", "a", "root"))
    sizes = against.groupBy("main").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).select("main", "blocks")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = np.array([len(x) // 8 for x in pdf.s], np.int64)
        return pd.DataFrame({"main": [pdf.main.iloc[0]], "block": [pdf.block.iloc[0]], "roots": [pdf.root.to_numpy(np.int64).tobytes()], "lengths": [lengths.tobytes()], "s": [b"".join(pdf.s)]})

    def blocked(rows: DataFrame) -> DataFrame:
        held = rows.join(sizes, "main").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
        held = held.join(sets.select(F.col("sid").alias("a"), "s"), "a").select("main", "block", "root", "s")
        return held.groupBy("main", "block").applyInPandas(pack, "main long, block int, roots binary, lengths binary, s binary")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            links = set()
            for r in pdf.itertuples(index=False):
                roots, lengths = np.frombuffer(r.roots, np.int64), np.frombuffer(r.lengths, np.int64)
                flat = np.frombuffer(r.s, np.uint64)
                order = np.argsort(flat, kind="stable")
                flat, member = flat[order], np.repeat(np.arange(len(lengths)), lengths)[order]
                ends, at = np.cumsum(np.frombuffer(r.q_lengths, np.int64)), 0
                asked = np.frombuffer(r.q_s, np.uint64)
                for root, end in zip(np.frombuffer(r.q_roots, np.int64).tolist(), ends.tolist(), strict=True):
                    q, at = asked[at:end], end
                    first, last = np.searchsorted(flat, q, "left"), np.searchsorted(flat, q, "right")
                    n = last - first
                    hit = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                    both = np.bincount(member[hit], minlength=len(lengths))
                    good = (100 * both >= percent * (lengths + len(q) - both)) & (roots != root)
                    links.update((min(root, x), max(root, x)) for x in set(roots[good].tolist()))
            yield pd.DataFrame(sorted(links), columns=["a", "b"], dtype=np.int64)

    asked = blocked(odd).select("main", F.col("roots").alias("q_roots"), F.col("lengths").alias("q_lengths"), F.col("s").alias("q_s"))
    everywhere = asked.join(sizes, "main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return blocked(against).join(everywhere, ["main", "block"]).mapInPandas(meet, "a long, b long").distinct()


def relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) after adding links between nodes whose present roots ``links`` names as a, b."""
    new = components(links)
    if labels is None:
        return new
    old = labels.join(new.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return old.union(new.join(labels.select("node"), "node", "left_anti").select("node", "root"))


def rooted(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Adds ra, rb: the roots of both ends, and leaves out pairs that are connected already."""
    if labels is None:
        return pairs.withColumns({"ra": F.col("a"), "rb": F.col("b")})
    a = labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    b = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    joined = pairs.join(a, "a", "left").join(b, "b", "left")
    return joined.withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")}).where("ra <> rb")


def classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, component_id, kept for every row of ``docs``."""
    spark = docs.sparkSession
    at = shared_dir(spark)
    sigs = stored(signed(docs, width), f"{at}/signatures")
    reps = stored(sigs.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig")), f"{at}/representatives")
    pairs, large = candidates(reps, at)
    todo = stored(pairs, f"{at}/pairs-0")
    large = stored(large, f"{at}/large")
    ends = todo.select(F.col("a").alias("sid")).union(todo.select(F.col("b").alias("sid"))).union(large.select(F.col("a").alias("sid"))).distinct()
    sets = stored(sets_of(docs, reps.select("doc_id", "sid").join(ends, "sid", "left_semi"), width).dropDuplicates(["sid"]), f"{at}/sets")
    labels, step, each = None, 0, 1
    while todo.head(1):
        step += 1
        ranked = [F.row_number().over(Window.partitionBy(c).orderBy(F.desc("met"), o)) for c, o in (("a", "b"), ("b", "a"))]
        marked = stored(todo.withColumns({"x": ranked[0], "y": ranked[1]}), f"{at}/marked-{step}")
        links = confirmed(marked.where(f"x <= {each} or y <= {each}"), sets, percent)
        if labels is not None:
            links = rooted(links, labels).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        labels = stored(relabel(labels, links), f"{at}/labels-{step}")
        rest = marked.where(f"x > {each} and y > {each}").select("a", "b", "met")
        todo = stored(rooted(rest, labels).select("a", "b", "met"), f"{at}/pairs-{step}")
        discard(spark, f"{at}/marked-{step}", f"{at}/pairs-{step - 1}")
        each *= 4
    if labels is not None and large.head(1):
        known = labels.withColumnRenamed("node", "a")
        members = stored(large.join(known, "a", "left").select("key", "a", F.coalesce("root", "a").alias("root")), f"{at}/members")
        tally = members.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).alias("m"), F.count("*").alias("k")).where("k > 1")
        mains = tally.select("key", F.col("m.root").alias("main"))
        odd = stored(members.join(mains, "key").where("root <> main").select("main", "a", "root").distinct(), f"{at}/odd")
        if odd.head(1):
            links = rechecked(odd, labels, sets, percent)
            labels = stored(relabel(labels, links), f"{at}/labels-last")
    ids = reps.select("sid", "doc_id")
    if labels is not None:
        ids = ids.join(labels.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "doc_id", F.coalesce("root", "sid").alias("root"))
    else:
        ids = ids.withColumn("root", F.col("sid"))
    least = ids.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = stored(ids.join(least, "root").select("sid", "component_id"), f"{at}/classes")
    discard(spark, f"{at}/sets")
    component = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = sigs.select("doc_id", "h", F.col("n").alias("n_shingles"), "sid").join(named, "sid", "left").select("doc_id", "h", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each class, one of equal rows."""
    stay = classes(docs, width, percent).where("kept").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    named = wrapped(docs, _doc=F.col("doc_id").cast("long"), _text=F.xxhash64("text"))
    joined = named.join(stay, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_h")))
    one = F.row_number().over(Window.partitionBy("_doc", "_text").orderBy("_h"))
    return joined.withColumn("_one", one).where("_one = 1").select("row.*")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), 4, 80).drop("h")


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i + 1, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 0) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
