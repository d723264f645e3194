"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

1. The windows (phrases) of all benchmark items are listed, and the document frequency of every
   benchmark word is counted over the whole corpus.
2. The positional index holds the postings (word, document, position) of the words that any
   phrase is searched by: its ``lead`` rarest.  Postings of other words could not start a match.
3. Posting lists are intersected rarest first after subtracting each word's offset in its
   phrase; what is left are (document, start, phrase) candidates, nearly all of them true.
4. The remaining words of each candidate are compared with the document's own words.

Skew: the phrase side of every join is the small one and is broadcast only after its rows have
been counted; beyond ``BROADCAST_ROWS`` the joins are shuffled and adaptive execution splits hot
words.  Candidates are combined in the task that read the document, before any exchange.

Defined cases: null or wordless texts have no words and no hits; an item of fewer words than a
window is one window; items without words match nothing; repeated items each count; a null
item id is listed as an empty string; repeated document rows each get the same result; other
columns are ignored; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import ascii_lower, shared_dir, stored, table, wrapped

#: Broadcast the phrase side of a join up to so many rows (of about 100 bytes), shuffle beyond.
BROADCAST_ROWS = 100_000
BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(c: Column) -> Column:
    """ASCII-lower-cased runs of letters, digits and non-ASCII characters; none for null."""
    return F.filter(F.split(F.coalesce(ascii_lower(c), F.lit("")), BREAK), lambda w: w != "")


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def keyed(docs: DataFrame) -> DataFrame:
    """did, h name a document; rows equal in both are copies with equal results."""
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long"))
    return docs.select("doc_id", did.alias("did"), F.xxhash64("text").alias("h"), "text")


def phrases_of(items: DataFrame, size: int) -> DataFrame:
    """pid, terms, len, items: every distinct window with the items that hold it."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.greatest(F.size("w") - size, F.lit(0))
    windows = w.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), n), lambda i: F.slice("w", i + 1, size))).alias("terms"))
    return windows.groupBy("terms").agg(F.collect_set("item_id").alias("items")).select(F.xxhash64("terms").alias("pid"), "terms", F.size("terms").alias("len"), "items")


def postings(docs: DataFrame, terms: DataFrame, rows: int) -> DataFrame:
    """The positional index of ``terms`` (column term): term, did, h, pos, n."""
    w = keyed(docs).select("did", "h", words(F.col("text")).alias("w"))
    return w.select("did", "h", F.size("w").alias("n"), F.posexplode("w").alias("pos", "term")).join(small(terms, rows), "term")


def frequencies(docs: DataFrame, terms: DataFrame, rows: int) -> DataFrame:
    """term, df: in how many documents each of ``terms`` occurs; terms that never occur are missing."""
    w = keyed(docs).select(F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    return w.join(small(terms, rows), "term").groupBy("term").agg(F.count("*").alias("df"))


def leads(phrases: DataFrame, df: DataFrame, lead: int) -> DataFrame:
    """pid, len, need, term, offset: each phrase's ``lead`` rarest places; phrases with unseen words are left out."""
    places = phrases.select("pid", "len", F.posexplode("terms").alias("offset", "term")).join(df, "term", "left")
    ranked = places.groupBy("pid", "len").agg(F.sort_array(F.collect_list(F.struct("df", "offset", "term"))).alias("p"))
    known = ranked.where(F.col("p")[0]["df"].isNotNull()).select("pid", "len", F.slice("p", 1, lead).alias("p"))
    return known.select("pid", "len", F.size("p").alias("need"), F.explode("p").alias("x")).select("pid", "len", "need", "x.term", "x.offset")


def phrase_matches(docs: DataFrame, phrases: DataFrame, lead: int = 2) -> DataFrame:
    """did, h, start, len, pid: every occurrence of every phrase, once each."""
    spark = docs.sparkSession
    at = shared_dir(spark)
    phrases = stored(phrases, f"{at}/phrases")
    vocabulary = stored(phrases.select(F.explode("terms").alias("term")).distinct(), f"{at}/terms")
    n_terms, n_phrases = vocabulary.count(), phrases.count()
    seen = stored(frequencies(docs, vocabulary, n_terms), f"{at}/frequencies")
    anchors = stored(leads(phrases, seen, lead), f"{at}/leads")
    n_anchors = anchors.count()
    index = stored(postings(docs, anchors.select("term").distinct(), n_anchors), f"{at}/postings")
    start = F.col("pos") - F.col("offset")
    aligned = index.join(small(anchors, n_anchors), "term").select("did", "h", "pid", "len", "need", start.alias("start"), "offset", "n")
    inside = aligned.where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n")))
    # a set: copies of a document row repeat its postings
    found = inside.groupBy("did", "h", "start", "pid", "len", "need").agg(F.collect_set("offset").alias("o")).where(F.size("o") >= F.col("need"))
    by_doc = found.groupBy("did", "h").agg(F.collect_list(F.struct("start", "len", "pid")).alias("c"))
    texts = keyed(docs).select("did", "h", words(F.col("text")).alias("w")).join(by_doc, ["did", "h"])
    cut = texts.select("did", "h", F.explode(F.transform("c", lambda c: F.struct(c["start"].alias("start"), c["len"].alias("len"), c["pid"].alias("pid"), F.slice("w", c["start"] + 1, c["len"]).alias("terms")))).alias("c")).select("did", "h", "c.*")
    return cut.join(small(phrases.select("pid", "terms"), n_phrases), ["pid", "terms"]).select("did", "h", "start", "len", "pid").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``."""
    at = shared_dir(docs.sparkSession)
    phrases = stored(phrases_of(items, size), f"{at}/phrases")
    n = phrases.count()
    hits = phrase_matches(docs, phrases).join(small(phrases.select("pid", "items"), n), "pid")
    spans = F.sort_array(F.collect_set(F.struct("start", "len")))
    per_doc = hits.groupBy("did", "h").agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("ids"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["start"] + s["len"]).alias("end"),
            (a["total"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(a["end"], s["start"]))).alias("total"),
        ),
        lambda a: a["total"],
    )
    per_doc = stored(per_doc.select("did", "h", covered.alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256")), f"{at}/hits")
    every = keyed(docs).select("doc_id", "did", "h", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return every.join(per_doc, ["did", "h"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", nothing).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated")
    )


def clean(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no window of any item occurs, with all their columns."""
    phrases = stored(phrases_of(items, size), f"{shared_dir(docs.sparkSession)}/phrases")
    hit = phrase_matches(docs, phrases).select("did", "h").distinct()
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long"))
    return wrapped(docs, did=did, h=F.xxhash64("text")).join(hit, ["did", "h"], "left_anti").select("row.*")


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = 2) -> DataFrame:
    """doc_id, item_id, start, end: places where all of an item's words lie within their number plus ``slop`` words.

    In any order, by the postings of all the items' words: each occurrence of an item's rarest
    word is an anchor; the match is the first window around it that holds every distinct word.
    """
    spark = docs.sparkSession
    at = shared_dir(spark)
    distinct = items.select("item_id", F.array_distinct(words(F.col("text"))).alias("terms")).where(F.size("terms") > 0)
    wanted = stored(distinct.select("item_id", (F.size("terms") + slop).alias("span"), F.size("terms").alias("need"), F.explode("terms").alias("term")), f"{at}/wanted")
    n = wanted.count()
    seen = stored(frequencies(docs, wanted.select("term").distinct(), n), f"{at}/frequencies")
    index = stored(postings(docs, wanted.select("term").distinct(), n).distinct(), f"{at}/postings")
    rarest = wanted.join(seen, "term").groupBy("item_id", "span", "need").agg(F.min_by("term", F.struct("df", "term")).alias("term"), F.count("*").alias("k")).where("k = need").drop("k")
    anchors = index.join(small(rarest, n), "term").select("did", "h", "n", "item_id", "span", "need", F.col("pos").alias("p"))
    near = index.join(small(wanted.select("term", "item_id"), n), "term").select("did", "h", "item_id", "term", "pos")
    pairs = anchors.join(near, ["did", "h", "item_id"]).where(F.abs(F.col("pos") - F.col("p")) < F.col("span"))
    held = pairs.groupBy("did", "h", "n", "item_id", "span", "need", "p").agg(F.collect_list(F.struct("pos", "term")).alias("x"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("p") - F.col("span") + 1), F.col("p"))
    good = F.filter(starts, lambda s: F.size(F.array_distinct(F.transform(F.filter("x", lambda y: (y["pos"] >= s) & (y["pos"] < s + F.col("span"))), lambda y: y["term"]))) == F.col("need"))
    out = held.select("did", "item_id", F.get(good, F.lit(0)).alias("start"), F.least(F.get(good, F.lit(0)) + F.col("span"), F.col("n")).alias("end")).where("start is not null").distinct()
    return out.select(F.when(F.col("did") == -(2**63), None).otherwise(F.col("did")).alias("doc_id"), "item_id", "start", "end")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH bw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
win AS (SELECT item_id, list_slice(w, i + 1, i + 10) AS t FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM bw WHERE len(w) > 0)),
ph AS (SELECT t, len(t) AS n, list(DISTINCT item_id) AS items FROM win GROUP BY t),
dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
lens AS (SELECT DISTINCT n FROM ph),
dwin AS (SELECT doc_id, i, n, list_slice(w, i + 1, i + n) AS t FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT d.doc_id, d.i, d.n, p.items FROM dwin d JOIN ph p ON d.t = p.t),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, unnest(items) AS item_id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
