import gzip
import hashlib
import random

from gridweave.llm.warc import CHUNK, MAGIC, member, read, records_in, write


def test_every_split_finds_each_record_once():
    rng = random.Random(1)
    stored = b"".join(rng.randbytes(30) + MAGIC + b"\x00" * 7 + gzip.compress(b"WARX") for _ in range(20))
    blocks = [b"", b"a" * 5, stored, rng.randbytes(3 * CHUNK), gzip.compress(b"x" * 100), b"end\r\n\r\n"]
    data = b"".join(member([("Page-ID", str(i))], b) for i, b in enumerate(blocks))
    take = lambda a, n: data[a : a + n]
    for size in (97, 1000, 65536, len(data)):
        got = [(h["Page-ID"], b) for s in range(0, len(data), size) for _, h, b in records_in(take, s, min(s + size, len(data)), len(data))]
        assert got == [(str(i), b) for i, b in enumerate(blocks)]


def test_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 20000
    rows = [(5, "u", "x" * 100), (3, "v\r\nw", "x" * 100), (9, None, "x" * 100), (4, "s", "y" * 99), (2, "s", "y" * 99), (7, "n", None), (8, "", ""), (1, "b", big), (6, "b", big), (1, "b", big), (None, "z", big)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    manifest = write(df, str(tmp_path / "w"), file_bytes=300)
    got = sorted(((r.page_id, r.type, r.refers_to, r.payload_bytes, r.digest, bytes(r.payload)) for r in read(manifest, 50).collect()), key=str)
    want = []
    for i, _, html in rows:
        p = (html or "").encode()
        first = min((j for j, _, h in rows if (h or "").encode() == p and j is not None), default=None)
        again = len(p) >= 100 and i != first
        want.append((i, "revisit" if again else "response", first if again else None, len(p), hashlib.sha256(p).hexdigest(), b"" if again else p))
    assert got == sorted(want, key=str)


def test_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert read(write(df, str(tmp_path / "w"))).count() == 0
