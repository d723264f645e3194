"""Chat formatting as prefix trees: shared initial turns are emitted once, depth first.

A node is a distinct sequence of initial turns.  Its name is a hash chained over the turns, its
parent is the sequence without the last turn.  Nodes without forks between them form a segment;
its path (the segments from the root down) and the depth sort nodes depth first, so the linear
order of all trees is one distributed sort.  A node's start is
the number of tokens before it (partition totals, then a running sum inside each partition),
its position ids continue its parent's, and it may attend to the spans of its ancestors and
itself: the ancestor intervals, joined where they touch.  Assistant turns are under the loss mask.

Template: ``<s>`` opens a conversation; a system turn is ``[SYS] text [/SYS]``, a user turn
``[INST] text [/INST]``, an assistant turn `` text </s>``, any other role ``[TURN role] text
[/TURN]``.  Inside texts and role names every ``\\`` becomes ``\\\\``, ``[`` becomes ``\\[`` and
``<`` becomes ``\\<``, so no control string can occur there, and the escape is undone exactly.

Defined cases: null texts and roles are empty; a conversation's rows are taken by turn, then
role, then text (nulls first), gaps and repeated rows included; null conv_ids are one
conversation; a conversation of any length is one path; an empty table has no nodes; columns of
other names are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import discard, shared_dir, stored, table

#: Fixed control strings of the template; no escaped text contains one.
OPEN, END = "<s>", "</s>"
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
TURN, TURN_END, UNDO = "[TURN ", " [/TURN]", re.compile(r"(?s)\\.")
#: Parts into which the rows of one common node are dealt.
SALTS = 8


def escaped(c: Column) -> Column:
    for x in ("\\", "[", "<"):
        c = F.replace(c, F.lit(x), F.lit("\\" + x))
    return c


def rendered(role: Column, text: Column) -> Column:
    """The formatted turn as a struct: head, body, tail."""
    parts = F.struct(F.concat(F.lit(TURN), escaped(role), F.lit("] ")).alias("head"), escaped(text).alias("body"), F.lit(TURN_END).alias("tail"))
    for name, (head, tail) in MARKS.items():
        parts = F.when(role == name, F.struct(F.lit(head).alias("head"), escaped(text).alias("body"), F.lit(tail).alias("tail"))).otherwise(parts)
    return parts


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, chain: per conversation its nodes from the root, as (node, role, text)."""
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    listed = ordered.select("conv_id", F.col("conv_id").cast("string").alias("name"), F.transform("t", lambda t: t["role"]).alias("roles"), F.transform("t", lambda t: t["text"]).alias("texts"))

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, roles, texts in zip(pdf.name, pdf.roles, pdf.texts, strict=True):
                last, nodes = "", []
                for role, text in zip(roles, texts, strict=True):
                    last = sha256(f"{last}{role}\n{len(text)}\n{text}".encode("utf-8", "surrogatepass")).hexdigest()[:32]
                    nodes.append(last)
                yield pd.DataFrame({"name": pd.Series([name], dtype=object), "nodes": [nodes], "roles": [list(roles)], "texts": [list(texts)]})

    # a conversation's id goes as a string, a null stays one
    kind = turns.schema["conv_id"].dataType.simpleString()
    made = listed.select("name", "roles", "texts").mapInPandas(chain, "name string, nodes array<string>, roles array<string>, texts array<string>")
    return made.select(F.col("name").cast(kind).alias("conv_id"), F.arrays_zip(F.col("nodes").alias("node"), F.col("roles").alias("role"), F.col("texts").alias("text")).alias("chain"))


def forked(chains: DataFrame) -> DataFrame:
    """conv_id, starts, heads: depths and names of the nodes of each conversation that start a segment.

    A segment is a run of nodes without forks: it starts at a root or below a node with several
    children.  Paths name segments, not turns, so a long conversation has no long path.  The first
    turn that many conversations share is one parent with many children: children are counted
    before they are dealt by parent, and the look-up is dealt by parent and a salt.
    """
    pair = F.transform("chain", lambda x, i: F.struct(i.alias("depth"), x["node"].alias("node"), F.get("chain", i - 1)["node"].alias("parent")))
    rows = chains.select("conv_id", F.explode(pair).alias("p")).select("conv_id", "p.*")
    forks = rows.where("parent is not null").select("parent", "node").distinct().groupBy("parent").agg(F.count("*").alias("n")).where("n > 1")
    forks = forks.select("parent", F.lit(True).alias("fork"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("conv_id", "node"), F.lit(SALTS)).cast("int"))
    heads = salted.join(forks, ["parent", "salt"], "left").where("fork or parent is null")
    listed = heads.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "node"))).alias("h"))
    return listed.select("conv_id", F.transform("h", lambda x: x["depth"]).alias("starts"), F.transform("h", lambda x: x["node"]).alias("heads"))


def nodes_of(chains: DataFrame) -> DataFrame:
    """Every distinct node once: path (the segments down to its own), node, parent, depth, role, text."""
    f = forked(chains).withColumnRenamed("conv_id", "_conv")
    both = chains.join(f, F.col("conv_id").eqNullSafe(F.col("_conv")))
    # each turn leaves with its own values only, however long its conversation is
    within = lambda i: F.size(F.filter("starts", lambda d: d <= i))
    each = F.transform("chain", lambda x, i: F.struct(x["node"].alias("node"), F.array_join(F.slice("heads", 1, within(i)), "").alias("path"), F.get("chain", i - 1)["node"].alias("parent"), i.alias("depth"), x["role"].alias("role"), x["text"].alias("text")))
    return both.select(F.explode(each).alias("x")).select("x.*").dropDuplicates(["node"])


def merged(spans: Column) -> Column:
    """Intervals in order, joined where one ends as the next starts."""
    kind = "array<struct<start:bigint,stop:bigint>>"
    last = lambda a: F.get(a, F.size(a) - 1)
    put = lambda a, x: F.when(last(a)["stop"] == x["start"], F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), x["stop"].alias("stop"))))).otherwise(F.concat(a, F.array(F.struct(x["start"].alias("start"), x["stop"].alias("stop")))))
    return F.aggregate(spans, F.array().cast(kind), lambda a, x: put(a, x).cast(kind))


NODE = "path string, node string, parent string, depth int, role string"


def tokenised(nodes: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Nodes with their tokens: head, text and tail of the turn one after the other."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .packing import encoder

        ids, marks = encoder(rank_file, pattern), {}

        def fixed(text: str) -> bytes:
            if len(marks) > 10_000:
                marks.clear()
            if text not in marks:
                marks[text] = ids.ids(text)
            return marks[text]

        for pdf in batches:
            parts = [(fixed(h), ids.plain(b), fixed(t)) for h, b, t in zip(pdf["head"], pdf.body, pdf["tail"], strict=True)]
            spoken = (pdf.role == "assistant").tolist()
            out = pdf[[k.split()[0] for k in NODE.split(", ")]].copy()
            out["ids"] = [np.frombuffer(b"".join(x), "<u4").astype(np.int32) for x in parts]
            out["text_from"] = [len(h) // 4 for h, _, _ in parts]
            out["text_to"] = [(len(h) + len(b)) // 4 for h, b, _ in parts]
            out["loss_from"] = pd.array([len(h) // 4 if y else None for (h, _, _), y in zip(parts, spoken, strict=True)], "Int32")
            out["loss_to"] = pd.array([(len(h) + len(b)) // 4 if y else None for (h, b, _), y in zip(parts, spoken, strict=True)], "Int32")
            yield out
        ids.cache.clear()  # the worker lives on

    return nodes.select(*(k.split()[0] for k in NODE.split(", ")), "head", "body", "tail").mapInPandas(encode, NODE + ", ids array<int>, text_from int, text_to int, loss_from int, loss_to int")


def counted(nodes: DataFrame) -> DataFrame:
    """Adds the partition and the tokens before each node in it; rows come sorted and hold no tokens."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, before = TaskContext.get().partitionId(), 0
        for pdf in batches:
            n = pdf.n.to_numpy(np.int64)
            pdf["part"], pdf["local"] = part, before + np.cumsum(n) - n
            before += int(n.sum())
            yield pdf

    return nodes.select("path", "node", "depth", "n").mapInPandas(add, "path string, node string, depth int, n long, part int, local long")


def tokenizer_files(rank_file: str | None, pattern: str | None) -> tuple[str, str]:
    if rank_file is None or pattern is None:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return rank_file, pattern


def format_chats(turns: DataFrame, rank_file: str | None = None, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(tree, members).

    tree: node, parent, depth, role, token_ids, text_from, text_to (the tokens of the turn's text
    among them), loss_from, loss_to (those under the loss mask), start (of the node in the depth-first sequence), position (of its first
    token), attend (intervals of the sequence that it may attend to).
    members: conv_id, depth, node.
    """
    rank_file, pattern = tokenizer_files(rank_file, pattern)
    spark = turns.sparkSession
    at = shared_dir(spark)
    chains = stored(paths(turns), f"{at}/chains")
    first = F.when(F.col("depth") == 0, F.concat(F.lit(OPEN), F.col("p.head"))).otherwise(F.col("p.head"))
    nodes = nodes_of(chains).withColumn("p", rendered(F.col("role"), F.col("text"))).withColumns({"head": first, "body": F.col("p.body"), "tail": F.col("p.tail")})
    held = stored(tokenised(nodes, rank_file, pattern), f"{at}/nodes")
    # the order is found without the tokens
    slim = held.select("path", "node", "depth", F.size("ids").cast("long").alias("n"))
    ranged = slim.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "depth").sortWithinPartitions("path", "depth")
    local = stored(counted(ranged), f"{at}/order")
    # one row for each partition
    totals = local.groupBy("part").agg(F.sum("n").alias("total"))
    before = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    started = local.join(F.broadcast(before), "part").select("path", "node", "n", (F.col("local") + F.col("before")).alias("start"))
    # segments look up the spans of the segments along their path
    spans = stored(started.groupBy("path").agg(F.min("start").alias("first"), F.max(F.col("start") + F.col("n")).alias("stop")), f"{at}/spans")
    up = F.col("path").substr(F.col("k") * 32 + 1, F.lit(32))
    wanted = spans.where("length(path) > 32").select("path", F.explode(F.sequence(F.lit(0), (F.length("path") / 32 - 2).cast("int"))).alias("k")).select("path", "k", up.alias("up"))
    # a segment that many others hang below is looked up under several salts
    wanted = wanted.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    ends = spans.select(F.substring("path", -32, 32).alias("up"), F.col("first").alias("start"), "stop", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    above = wanted.join(ends, ["up", "salt"]).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("k", "start", "stop"))).alias("a"))
    above = above.select("path", F.transform("a", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))).alias("a"))
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    segments = spans.join(above, "path", "left").select("path", "first", merged(F.coalesce("a", none)).alias("above"), F.aggregate(F.coalesce("a", none), F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"]).alias("base"))
    own = F.array(F.struct(F.col("first").alias("start"), (F.col("start") + F.col("n")).alias("stop")))
    seen = started.join(segments, "path").select("node", "start", (F.col("base") + F.col("start") - F.col("first")).alias("position"), merged(F.concat("above", own)).alias("attend"))
    tree = held.join(seen, "node").select("node", "parent", "depth", "role", F.col("ids").alias("token_ids"), "text_from", "text_to", "loss_from", "loss_to", "start", "position", "attend")
    tree = stored(tree, f"{at}/tree")
    discard(spark, f"{at}/nodes", f"{at}/order", f"{at}/spans")
    members = chains.select("conv_id", F.posexplode(F.transform("chain", lambda x: x["node"])).alias("depth", "node"))
    return tree, members


def plain(text: str) -> str:
    """Undo ``escaped``."""
    return UNDO.sub(lambda m: m[0][1], text)


def decoded(tree: DataFrame, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """node, start, role, text, chars (of the formatted turn), loss (the text under the mask): all from the tokens alone."""
    rank_file, pattern = tokenizer_files(rank_file, pattern)
    fixed = {head: name for name, (head, _) in MARKS.items()}

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .packing import encoder

        words = encoder(rank_file, pattern).model
        for pdf in batches:
            rows = []
            for node, start, ids, a, b, low, high in zip(pdf.node, pdf.start, pdf.token_ids, pdf.text_from, pdf.text_to, pdf.loss_from.tolist(), pdf.loss_to.tolist(), strict=True):
                said = lambda i, j, ids=ids.tolist(): words.decode_bytes(ids[i:j]).decode("utf-8", "surrogatepass")
                head, body, tail = said(0, a), said(a, b), said(b, None)
                turn = head.removeprefix(OPEN)
                role = fixed[turn] if turn in fixed else plain(turn[len(TURN) : -2])
                loss = None if low != low or low is None else plain(said(int(low), int(high)))
                rows.append((node, start, role, plain(body), len(head) + len(body) + len(tail), loss))
            yield pd.DataFrame(rows, columns=["node", "start", "role", "text", "chars", "loss"])

    return tree.select("node", "start", "token_ids", "text_from", "text_to", "loss_from", "loss_to").mapInPandas(decode, "node string, start long, role string, text string, chars long, loss string")


def read_back(tree: DataFrame, members: DataFrame) -> DataFrame:
    """conv_id and its turns as read from the tokens of its nodes in the order of the sequence: array of (start, role, text, chars, loss)."""
    nodes = decoded(tree).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    said = members.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")).join(nodes, ["node", "salt"])
    return said.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("start", "role", "text", "chars", "loss"))).alias("turns"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    back = read_back(*format_chats(turns))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"].isNotNull()), lambda t: t["loss"]), "")
    formatted = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["chars"])
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(all_turns.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), formatted.alias("formatted_chars")
    )


OP7_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '[', '')) + length(text) - length(replace(text, '<', '')) AS n,
  length(role) + length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, '[', '')) + length(role) - length(replace(role, '<', '')) AS r FROM c),
f AS (SELECT *, n + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 ELSE 16 + r END AS k FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(k) + 3 AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
