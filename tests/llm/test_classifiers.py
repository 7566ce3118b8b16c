import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tamiz.llm import langid, licenses, quality

SF_DIR = "/root/testdata/sf0.01"
SYLLABLES = {"x": "ba be bi bo bu da de".split(), "y": "zor zak zil mur mok mit".split(), "z": "éa éo ñu ñi öa öe".split()}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_interactions_by_the_identity():
    machine = quality.Machine()
    rng = np.random.default_rng(1)
    machine.weight, machine.bias = rng.normal(size=machine.weight.shape), 0.3
    buckets, at, statistics = np.array([5, 9, 5, 70, 9, 9]), np.array([0, 4, 6, 6]), rng.normal(size=(3, quality.STATISTICS))
    row, feature, value = machine._rows(buckets, at, statistics)
    logit, _ = machine._logit(row, feature, value, 3)
    for r in range(3):
        f, x = feature[row == r], value[row == r]
        pairs = sum(machine.factor[f[i]] @ machine.factor[f[j]] * x[i] * x[j] for i in range(len(f)) for j in range(i + 1, len(f)))
        assert logit[r] == pytest.approx(0.3 + machine.weight[f] @ x + pairs)


def test_statistics_of_long_texts_do_not_depend_on_slices(monkeypatch):
    texts = pa.array(["a bb bb CC! 12\nx| y" * 50, None, "", "é " * 300])
    whole = [f[1:] for f in quality.features(texts)]
    monkeypatch.setattr(quality, "SLICE", 64)
    parts = [f[1:] for f in quality.features(texts)]
    assert np.allclose(np.concatenate([w[2] for w in whole]), np.concatenate([p[2] for p in parts]))


def test_quality_learns_and_keeps_columns(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        good = i % 4 != 0
        t = sentence(rng, "x", rng.randint(5, 60))
        rows.append((i, t if good else "### ".join(t.upper().split(" ")) + "!!!", int(good), "keep"))
    rows += [(1000, None, None, "k"), (1001, "", None, "k"), (None, "be ba", None, None), (5, rows[5][1], 1, "copy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int, score string")
    labels = docs.where("y IS NOT NULL AND doc_id % 2 = 0").select("doc_id", F.col("y").alias("quality"))
    machine = quality.fit_quality(docs, labels)
    got = quality.score_quality(docs, machine).collect()
    assert len(got) == len(rows) and [f for f in got[0].asDict()] == ["doc_id", "text", "y", "score", "predicted"]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["y"] is not None and r["doc_id"] % 2]
    assert np.mean([r["predicted"] == r["y"] for r in held]) > 0.95


@pytest.fixture
def workers(monkeypatch):
    """What is sent to workers: (columns, function over batches) of each call."""
    from pyspark.sql.classic.dataframe import DataFrame

    calls, sent = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, *rest: calls.append((self.columns, f)) or sent(self, f, *rest))
    return calls


def test_workers_return_long_texts_in_small_batches(spark, workers):
    rng = random.Random(7)
    rows = [(i, sentence(rng, "x", 4000) if i % 5 else None) for i in range(300)] + [(300, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learned = spark.createDataFrame([(sentence(rng, lang, 20), lang) for lang in "xy" for _ in range(8)], "text string, lang string")
    languages = langid.fit_languages(learned)
    workers.clear()
    quality.score_quality(docs, quality.Machine())
    langid.identify(docs, languages)
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["doc_id", "text"])
    assert batch.nbytes > 4 << 20
    for _, work in workers:
        got = list(work(iter([batch])))
        assert [tuple(r.values()) for b in got for r in b.select(["doc_id", "text"]).to_pylist()] == rows
        most = max(sum(len(t or "") for t in b.column("text").to_pylist()) for b in got)
        assert most <= max(quality.SLICE, 64 * max(len(t or "") for _, t in rows)) < 4 << 20
        whole = [r for b in got for r in b.to_pylist()]
        alone = [r for i in range(0, len(rows), 50) for b in work(iter([batch.slice(i, 50)])) for r in b.to_pylist()]
        assert [r["score"] for r in whole] == pytest.approx([r["score"] for r in alone])


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    machine = quality.fit_quality(docs, none)
    assert quality.score_quality(docs.limit(0), machine).collect() == []
    assert quality.score_quality(docs, machine).count() == 1


def test_languages(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng, "xyz"[i % 3], rng.randint(4, 80)), "xyz"[i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages = langid.fit_languages(docs, where=F.col("doc_id") % 4 != 2)
    odd = [(1000, None, "x"), (1001, "", "x"), (1002, "12 ... !", "y"), (1003, "bebaBO DEBA", None), (1004, "七八九" * 40, "x")]
    asked = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    got = {r["doc_id"]: r for r in langid.identify(asked, languages).collect()}
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows if i % 4 == 2]) > 0.98
    assert not any(got[i]["rejected"] for i, *_ in rows)
    for i in (1000, 1001, 1002):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
    assert got[1003]["lang_pred"] == "x" and got[1004]["rejected"] and got[1004]["lang_pred"] in "xyz"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_junk_in_the_sample_leaves_rejection(spark):
    """Rows of digits and signs under a language's name teach nothing, whatever
    their number up to a few in a hundred, and long clean texts stay."""
    rng = random.Random(6)
    clean = [(i, sentence(rng, "xy"[i % 2], rng.randint(10, 80)), "xy"[i % 2]) for i in range(400)]
    digits = lambda: "p " + " ".join(str(rng.randint(0, 10**6)) for _ in range(60))
    junk = [(500 + i, digits(), "x") for i in range(4)] + [(600, "12 34 56", "y"), (601, "!!", "y")]
    asked = [(1000, digits(), None), (1001, "p q 77 88 $$ %% " * 30, None)]
    asked += [(2000, sentence(rng, "x", 60_000), None), (2001, sentence(rng, "y", 12), None)]
    schema = "doc_id long, text string, lang string"
    for rows in (clean, clean + junk):
        languages = langid.fit_languages(spark.createDataFrame(rows, schema).withColumn("m", F.create_map(F.lit("a"), F.lit(1))))
        got = {r["doc_id"]: r["rejected"] for r in langid.identify(spark.createDataFrame(clean + asked, schema), languages).collect()}
        assert got[1000] and got[1001]
        assert not any(v for d, v in got.items() if d not in (1000, 1001))


def test_nearest_centroid_by_brute_force(spark):
    """Predictions are those of a plain loop over sequences and centroids."""
    rng = random.Random(7)
    docs = spark.createDataFrame([(i, sentence(rng, "xyz"[i % 3], rng.randint(3, 30)), "xyz"[i % 3]) for i in range(60)], "doc_id long, text string, lang string")
    languages = langid.fit_languages(docs)
    for r in langid.identify(docs, languages).collect():
        # Signs that are no letters count as one.
        signs = [0 if b < 128 and not chr(b).isalpha() else b for b in r["text"].lower().encode()]
        counts: dict = {}
        for n in (2, 3, 4):
            for a in range(len(signs) - n + 1):
                key = 0
                for b in signs[a : a + n]:
                    key = (key * 257 + b) % 2**64
                key = (key * 0x9E3779B97F4A7C15 + n) % 2**64 * 0xBF58476D1CE4E5B9 % 2**64 >> (64 - langid.BITS)
                counts[key] = counts.get(key, 0) + 1
        weight = {k: np.log(1 + n) * languages.idf[k] for k, n in counts.items()}
        norm = sum(w * w for w in weight.values()) ** 0.5
        cosine = [sum(w * c[k] for k, w in weight.items()) / norm for c in languages.centroids]
        assert r["lang_pred"] == languages.names[int(np.argmax(cosine))]
        assert r["score"] == pytest.approx(max(cosine), abs=1e-4)


def test_languages_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    languages = langid.fit_languages(docs)
    assert langid.identify(docs, languages).collect() == []
    one = spark.createDataFrame([(1, "abc", None, 2.5)], "doc_id long, text string, lang string, score double")
    assert [r["lang_pred"] for r in langid.identify(one, languages).collect()] == ["und"]


def test_counts_do_not_depend_on_slices(monkeypatch):
    rng = random.Random(1)
    texts = pa.array([sentence(rng, "z", 200), "", "ab", None, sentence(rng, "x", 90)])
    idf = np.ones(langid.SIZE, np.float32)
    whole = np.concatenate([x for _, x, _ in langid.vectors(texts, idf)])
    monkeypatch.setattr(langid, "SLICE", 50)
    assert np.allclose(whole, np.concatenate([x for _, x, _ in langid.vectors(texts, idf)]))


def test_licences(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(sentence(rng, "x", 12) for _ in range(4))) for i in range(60)]
    planted = {
        0: ("Released under the MIT License.", "mit"),
        1: ("This file is licensed under the Apache License, Version 2.0.", "apache-2.0"),
        2: ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
        3: ("  Licensed under CC BY-NC 4.0.  ", "cc-by-nc"),
        4: ("REDISTRIBUTION AND USE IN SOURCE AND BINARY FORMS, WITH OR WITHOUT MODIFICATION, ARE PERMITTED", "bsd"),
    }
    near = ["She had a license to drive, released by the state.", "the public work of the general", "version 3 of the text is free"]
    rows = [(i, t + "\n" + planted[i][0] if i in planted else t + "\n\n" + near[i % 3]) for i, t in rows]
    rows += [(100, None), (101, ""), (None, "Released under the MIT License."), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("w", F.lit(1)).withColumn("family", F.lit("x"))
    model = licenses.fit_licences(docs)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["paragraph"], r["family"]) for r in licenses.scan_licences(docs, model).where("confirmed").collect())
    want = [(False, i, 4, f) for i, (_, f) in planted.items()] + [(False, 0, 4, "mit"), (True, 0, 0, "mit")]
    assert got == sorted(want)
    assert licenses.scan_licences(docs.limit(0), model).collect() == []
