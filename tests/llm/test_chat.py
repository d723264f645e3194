import hashlib

from gridweave.llm.chat import format_chats, op7_chat_formatting, read_back

TURNS = [(1, 0, "system", "be brief"), (1, 1, "user", "hi [INST] <s> \\[ \\\\ x"), (1, 2, "assistant", "yes </s>"), (2, 0, "system", "be brief"), (2, 1, "user", "hi [INST] <s> \\[ \\\\ x"), (2, 2, "assistant", "no"), (2, 3, "tool]x", None), (3, 0, None, ""), (3, 0, None, ""), (4, 0, "system", "be brief"), (None, 5, "user", "é" * 3000), (5, 0, "assistant", "\\"), (5, 1, "assistant", "a\n")]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_round_trip_and_tree(spark):
    df = spark.createDataFrame(TURNS, SCHEMA).repartition(3)
    tree, members = format_chats(df)
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in read_back(tree, members).collect()}
    want = {}
    for c, _, role, text in TURNS:
        want.setdefault(c, []).append((role or "", text or ""))
    assert back == want
    nodes = {r.node: r for r in tree.collect()}
    assert len(nodes) == len({tuple(v[: i + 1]) for v in want.values() for i in range(len(v))})
    order = sorted(nodes.values(), key=lambda r: r.start)
    at, stack = 0, []
    for r in order:
        assert r.start == at
        at += len(r.token_ids)
        stack = stack[: r.depth]
        assert (stack[-1].node if stack else None) == r.parent
        stack.append(r)
        assert [i for a in r.attend for i in range(a.start, a.stop)] == [i for s in stack for i in range(s.start, s.start + len(s.token_ids))]
        assert all(a.stop < b.start for a, b in zip(r.attend, r.attend[1:], strict=False))
        assert r.position == sum(len(s.token_ids) for s in stack[:-1])
        assert (r.loss_from is not None) == (r.role == "assistant")


def test_query_columns(spark, tmp_path):
    spark.createDataFrame(TURNS, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    rows = {r.conv_id: r for r in op7_chat_formatting(spark, str(tmp_path)).collect()}
    said = "</s>[INST] ok [/INST]"
    assert rows[-7].n_turns == 2 and rows[-7].loss_chars == len(said) and rows[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert rows[-7].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert rows[5].loss_sha256 == hashlib.sha256(b"\\a\n").hexdigest()


def test_long_conversation_is_linear(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(20_000)] + [(2, 0, "user", "turn 0"), (2, 1, "assistant", "other")]
    tree, members = format_chats(spark.createDataFrame(rows, SCHEMA))
    back = {r.conv_id: r.turns for r in read_back(tree, members).collect()}
    assert [t.text for t in back[1]] == [r[3] for r in rows[:20_000]] and [t.loss for t in back[2]] == [None, "other"]
    assert tree.count() == 20_001


def test_common_first_turn_and_clashing_columns(spark):
    rows = [(i, t, "system" if t == 0 else "user", "the same" if t == 0 else f"{i}", "x", 1) for i in range(400) for t in (0, 1)]
    df = spark.createDataFrame(rows, SCHEMA + ", node string, start int")
    tree, members = format_chats(df)
    assert tree.count() == 401 and tree.where("depth = 0").count() == 1
    root = tree.where("depth = 0").first()
    assert all(a.attend[0].start == root.start and a.attend[-1].stop == a.start + len(a.token_ids) for a in tree.collect())
    back = {r.conv_id: [t.text for t in r.turns] for r in read_back(tree, members).collect()}
    assert back == {i: ["the same", f"{i}"] for i in range(400)}


def test_of_nothing(spark):
    tree, members = format_chats(spark.createDataFrame([], SCHEMA))
    assert tree.count() == 0 and read_back(tree, members).count() == 0
