import hashlib
import random
import re

import pytest

from tamiz.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, length=10):
    out = []
    for d, text in docs:
        w = WORD.findall((text or "").translate(FOLD))
        hit, found = set(), set()
        for i, t in items:
            v = WORD.findall((t or "").translate(FOLD))
            for s in range(max(len(v) - length, 0) + 1 if v else 0):
                win = v[s : s + length]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        found.add(i)
        ids = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in D.decontaminate(d, i, **options).collect()), key=repr)


def cases():
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "B", "cc", "É", "é", "x1", "the"])
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(word() for _ in range(n))
    items = [(k, text(rng.randint(0, 14))) for k in range(12)] + [(20, None), (21, ""), (22, "One"), (23, "two Words"), (24, items_text := text(30)), (25, items_text)]
    docs = [(k, text(rng.randint(0, 60))) for k in range(25)]
    docs += [(100 + k, f"{text(5)} {items[rng.randrange(len(items))][1] or ''} {text(3)}") for k in range(25)]
    docs += [(200, None), (201, ""), (202, "... !"), (None, items_text), (203, items_text), (203, items_text), (204, "x TWO words. one")]
    return docs, items


def test_against_brute_force(spark):
    docs, items = cases()
    assert run(spark, docs, items) == brute(docs, items)


def test_blocks_of_windows_give_the_same(spark):
    docs, items = cases()
    assert run(spark, docs, items, broadcast_bytes=2500) == brute(docs, items)


@pytest.mark.parametrize("docs, items", [([], [(1, "a b")]), ([(1, "a b")], [])])
def test_empty_tables(spark, docs, items):
    assert run(spark, docs, items) == brute(docs, items)


def test_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b c", 5, "h", "w")], "doc_id long, text string, n int, h string, w string")
    i = spark.createDataFrame([(7, "b c", 1)], "item_id long, text string, window int")
    assert [tuple(r)[1:4] for r in D.decontaminate(d, i).collect()] == [(3, 2, 1)]
