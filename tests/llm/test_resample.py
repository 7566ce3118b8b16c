import hashlib
import math
import re
import zlib

import pytest

from tamiz.llm import resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def features_of(text, longest):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, longest=1, buckets=10_000, percent=10, min_words=20, seed=2024):
    def counts(texts):
        c = [0] * buckets
        for t in texts:
            for f in features_of(t, longest):
                c[zlib.crc32(f.encode()) % buckets] += 1
        return c

    s, t = counts(x for _, x in rows), counts(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for d, x in rows:
        f = features_of(x, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(g.encode()) % buckets] for g in f)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(x))])
    fit = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0], r[1], r[2]))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


def run(spark, rows, target, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    return sorted((tuple(r) for r in resample.resample(docs, goal, **options).collect()), key=repr)


TEXTS = [
    None, "", " .,;-", "one", "ÀÉ à-é ÀÉ", "a  b\tc\nd.e,,f", "x1 2Y [z] {w} ~ `", "\x00 \x7f \x80 é", "the end " * 30,
    "Of many words, the words of many. " * 9, "long " * 30_000, "ab" * 40_000, "İstanbul ſ K ẞ " * 8,
]


@pytest.mark.parametrize("longest, buckets, percent", [(1, 10_000, 40), (3, 97, 100), (2, 5, 0)])
def test_as_by_brute_force(spark, longest, buckets, percent):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(None, "n " * 25), (None, None), (4, "again " * 21), (4, "again " * 21)]
    target = ["The words of the end", None, "", "ÀÉ many"]
    options = dict(longest=longest, buckets=buckets, percent=percent)
    assert run(spark, rows, target, **options) == brute(rows, target, **options)


def test_ties_go_to_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(resample, "gumbel", lambda document, seed: resample.F.lit(5).cast("long"))
    rows = [(i * 7 % 50, "same words " * 15) for i in range(50)] + [(None, "same words " * 15)]
    got = run(spark, rows, ["same"], percent=20)
    assert sorted((r[4], r[0]) for r in got if r[4]) == [(i + 1, i) for i in range(10)]


def test_empty_tables(spark):
    rows = [(1, "w " * 20), (2, "v " * 40)]
    assert run(spark, [], ["a"]) == []
    assert run(spark, rows, [], percent=100) == brute(rows, [], percent=100)


def test_clashing_columns_and_drawn_rows(spark):
    schema = "doc_id string, text string, score int, rank int, n_words string, bucket int, at int, part int"
    docs = spark.createDataFrame([(f"k{i}", "some words " * 12, 1, 2, "x", 3, 4, 5) for i in range(20)], schema)
    goal = docs.limit(1)
    got = resample.resample(docs, goal, percent=50)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and got.where("rank > 0").count() == 10
    drawn = resample.draw_documents(docs, goal, percent=50)
    assert drawn.columns == docs.columns and drawn.where("score = 1 AND part = 5").count() == 10


def test_spans_of_overlapping_ngrams():
    got = list(resample.spans(b"One two,  THREE four", resample.ngram_pattern(3)))
    assert got == [b"one two three", b"two three four"]
    assert list(resample.spans(b" a ", resample.ngram_pattern(2))) == []
