"""Large ids beside a null in one batch come back unchanged, and a caller's columns keep their values."""

from gridweave.llm import decontaminate, katz, neardup, packing, quality, toxicity, warc

BIG = 2**60 + 1
DOCS = [(BIG, "one two three four five six", 7), (None, "seven eight nine ten eleven", 8), (BIG + 2, None, 9)]


def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, n_chars long").coalesce(1)


def test_katz(spark):
    seen = []
    rows = katz.katz_scores(docs(spark), lambda i: i == BIG).collect()
    assert {(r.doc_id, r.held_out) for r in rows} == {(BIG, True), (None, False), (BIG + 2, False)}, seen


def test_packing(spark):
    rows = packing.pack(docs(spark), capacity=4).collect()
    assert {r.doc_id for r in rows} == {BIG, None, BIG + 2}
    twice = packing.pack(docs(spark).union(docs(spark)), capacity=4).collect()
    assert len(twice) == 2 * len(rows) and len({(r.sequence_id, r.offset) for r in twice}) == len(twice)


def test_neardup(spark):
    rows = {r.doc_id: r for r in neardup.classes(docs(spark), 4, 80).collect()}
    assert set(rows) == {BIG, None, BIG + 2} and rows[BIG].component_id == BIG and rows[BIG + 2].component_id == BIG + 2


def test_classifiers(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in quality.scored(docs(spark), quality.train(docs(spark), none)).collect()} == {BIG, None, BIG + 2}
    assert {r.doc_id for r in toxicity.scored(docs(spark), toxicity.train(docs(spark), none, "true")).collect()} == {BIG, None, BIG + 2}


def test_warc(spark, tmp_path):
    page = "<p>" + "x" * 200
    pages = spark.createDataFrame([(BIG, "u", page), (None, None, page), (BIG + 2, "v", page), (BIG + 4, "w", None)], "page_id long, url string, html string").coalesce(1)
    rows = {r.page_id: r for r in warc.read(warc.write(pages, str(tmp_path / "a"))).collect()}
    assert set(rows) == {BIG, None, BIG + 2, BIG + 4}
    assert rows[BIG].type == "response" and rows[None].refers_to == BIG and rows[BIG + 2].refers_to == BIG


def test_foreign_records():
    head = b"WARC/1.1\r\nWARC-Type: response\r\nX-Name: \xff\xfe\r\nPage-ID: <a>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    fields, payload = warc.parse(head)
    assert payload == b"hi" and warc.whole(fields["Page-ID"]) is None and warc.whole("12") == 12 and warc.whole("9" * 30) is None


def test_columns_of_the_caller(spark):
    names = ["_h", "_did", "_one", "_doc", "_text", "_id", "row", "h", "did"]
    df = spark.createDataFrame([(i, t, *range(10 * i, 10 * i + len(names))) for i, t in enumerate(["a b c d e f g h", "a b c d e f g h", "p q r s t u v w x y z", None])], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    rows = {r.doc_id: r for r in df.collect()}
    items = spark.createDataFrame([(1, "p q r s t u v w x y")], "item_id long, text string")
    clean = decontaminate.clean(df, items)
    assert clean.columns == df.columns and {r.doc_id: r for r in clean.collect()} == {i: rows[i] for i in (0, 1, 3)}
    once = neardup.representatives(df)
    assert once.columns == df.columns and {r.doc_id: r for r in once.collect()} == {i: rows[i] for i in (0, 2, 3)}
