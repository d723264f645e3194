import random

import numpy as np

from gridweave.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def make(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeiourst") for _ in range(rng.randint(2, 8)))
    docs, good = [], {}
    for i in range(n):
        w = [word() for _ in range(rng.randint(20, 80))]
        kind = rng.choice(["prose"] * 5 + ["shout", "repeat", "marks"])
        if kind == "shout":
            w = [x.upper() + "!!" for x in w]
        elif kind == "repeat":
            w = [x for x in w[:4] for _ in range(15)]
        elif kind == "marks":
            w = [x + rng.choice(["***", "%%%", "&&&"]) for x in w]
        text = " ".join(w)
        docs.append((i, text, rng.choice(["en", "de", None]), f"src{i % 7}", len(text), 0.0))
        good[i] = int(kind == "prose")
    return docs, good


def test_accuracy_on_unlabelled_rows_and_odd_rows(spark):
    docs, good = make(900, 3)
    labels = [(i, good[i], 0) for i in range(450)] + [(5, None, 0), (None, 1, 0), (10**9, 1, 0)]
    odd = [(2000, None, None, None, None, 0.0), (2001, "", "en", "", 0, 0.0), (2002, "x" * 200_000, "en", "s", 5, 0.0), (2003, "y y", "en", "s", 3, 0.0), (2003, "y y", "en", "s", 3, 0.0)]
    d = spark.createDataFrame(docs + odd, SCHEMA).repartition(3)
    model = quality.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = quality.scored(d, model).collect()
    assert len(rows) == len(docs) + len(odd) and all(0 <= r.score <= 1 and np.isfinite(r.score) for r in rows)
    seen = [(r.score >= 0.5) == good[r.doc_id] for r in rows if 450 <= r.doc_id < 900]
    assert len(seen) == 450 and sum(seen) / len(seen) > 0.97
    stay = quality.good(d, model)
    assert stay.columns == d.columns and {r.doc_id for r in stay.collect()} == {r.doc_id for r in rows if r.score >= 0.5}


def test_views_are_separate():
    docs, _ = make(5, 1)
    import pandas as pd

    pdf = pd.DataFrame(docs, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    a, b = quality.views(pdf, {})
    other = pdf.assign(lang="xx", source="yy", n_chars=1)
    a2, b2 = quality.views(other, {})
    assert (a == a2).all() and (b != b2).any()


def test_without_labels_or_rows(spark):
    d = spark.createDataFrame([(1, "a b", "en", "s", 3, 0.0)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.scored(d, quality.train(d, none)).collect()] == [0.5]
    assert quality.scored(d.limit(0), quality.train(d.limit(0), none)).count() == 0


def test_every_label_and_every_unlabelled_text_counts(spark, monkeypatch):
    import pandas as pd

    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["ab", "cd", "ef", "GH", "i!"]) for _ in range(rng.randint(2, 9))) + f" {i}", "en", f"s{i % 3}", 9, 0.0) for i in range(4200)]
    docs += [(5000 + i, docs[i][1], "en", "s", 9, 0.0) for i in range(4000, 4100)]  # the pool's copies
    labels = [(i, int(i % 20 > 0), 0) for i in range(4000)]  # 3800 good ones
    pools, plain = [], quality.handing_over
    monkeypatch.setattr(quality, "handing_over", lambda pool, each, at: pools.append(pool.count()) or plain(pool, each, at))
    d, y = spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(d, y, rounds=1)
    assert pools == [200]
    held = np.array([quality.zlib.crc32(f"held {i}".encode()) % 4 == 0 for i in range(4000)])
    for part, x in zip(model.parts, quality.views(pd.DataFrame(docs[:4000], columns=[c.split()[0] for c in SCHEMA.split(", ")]), {}), strict=True):
        assert np.allclose(part.mean, x[~held].mean(0, dtype=float), atol=1e-5)
    # summed by tasks: the same model
    monkeypatch.setattr(quality, "LOCAL", 0)
    monkeypatch.setattr(quality, "TASK", 1500)
    other = quality.train(d, y, rounds=1)
    for a, b in zip(model.parts, other.parts, strict=True):
        assert np.allclose(a.b, b.b, atol=1e-5) and np.allclose(a.calibration, b.calibration, atol=1e-4)
    assert np.allclose(model.blend, other.blend, atol=1e-4)


def test_sums_travel_as_upper_triangles():
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=(400, 30)), rng.integers(0, 2, 400).astype(float), rng.uniform(0.5, 2, 400)
    b = rng.normal(size=31) / 10
    found, shapes = quality.bent(x, y, w, b), [(31, 31), (31,)]
    wide = np.c_[x, np.ones(400)]
    p = 1 / (1 + np.exp(-wide @ b))
    raw = quality.packed(quality.summed([found], shapes))
    assert len(raw) == 31 * 32 // 2 * 4 + 31 * 8  # a good quarter of two full matrices of doubles
    curve, slope = quality.unpacked(raw, shapes)
    assert np.allclose(curve, (wide * (w * p * (1 - p))[:, None]).T @ wide, rtol=1e-5, atol=1e-4) and np.allclose(slope, wide.T @ (w * (y - p)))
    assert quality.summed([], shapes) == []  # a task without rows sends nothing


def test_jobs_of_a_fit_and_no_wide_join_by_broadcast(spark, monkeypatch):
    """The driver's memory grew with the jobs: two for every Newton step, three for every round."""
    docs, good = make(400, 8)
    docs += [(1000 + i, *docs[i][1:]) for i in range(50)]  # copies count once
    labels = [(i, good[i], 0) for i in range(200)] + [(1000, good[0], 0)]
    monkeypatch.setattr(quality, "LOCAL", 0)
    written, plain, passes, total = [], quality.stored, [], quality.Labelled.total
    monkeypatch.setattr(quality, "stored", lambda df, path, *by: written.append(path.rsplit("/", 1)[1]) or plain(df, path, *by))
    monkeypatch.setattr(quality.Labelled, "total", lambda self, *x: passes.append(self.rows.count()) or total(self, *x))
    quality.train(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert written == ["features", "roles", "used", "held"]
    assert passes[0] == 200 and 0 < passes[-1] < 80 and set(passes) == {passes[0], passes[-1]}  # calibration reads held-out logits only


def test_fits_end_at_the_best_point_from_where_whole_newton_steps_lead_away():
    """Some confident and wrong logits sent the calibration to coefficients of 1e10: all rows kept, or none."""
    rng = np.random.default_rng(7)
    y = (rng.random(4000) < 0.86).astype(float)
    z = np.clip(np.c_[rng.normal(9, 2, 4000), rng.normal(2, 1.5, 4000)] * np.where(y > 0, 1, -1)[:, None], -15, 15)
    y[:60] = 1 - y[:60]
    rows = quality.Labelled.__new__(quality.Labelled)
    rows.here = [(z[i : i + 1000], y[i : i + 1000], np.ones(1000)) for i in range(0, 4000, 1000)]
    one = lambda v: lambda c: (c[0][:, v : v + 1], c[1], c[2])
    found = quality.fitted_by(rows, [one(0), one(1), lambda c: c], [np.array([1.0, 0.0])] * 2 + [np.array([2.0, 2.0, 0.0])], [0.01, 0.01, 0.1], [None] * 3)
    for x, b, ridge in zip((z[:, :1], z[:, 1:], z), found, (0.01, 0.01, 0.1), strict=True):
        wide = np.c_[x, np.ones(len(x))]
        p = 1 / (1 + np.exp(-wide @ b))
        assert np.abs(b).max() < 20 and np.abs(wide.T @ (y - p) - np.r_[[ridge] * x.shape[1], 1e-6] * b).max() < 0.1
        assert ((p >= 0.5) == y).mean() > 0.9
