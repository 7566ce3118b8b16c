import random
import re

import pytest

from tamiz.llm import components, neardup
from tamiz.llm.components import connected_components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, percent):
    sets = {d: shingles(t) for d, t in rows}
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared, whole = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if whole and shared and 100 * shared >= percent * whole:
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in ids)


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in neardup.link_documents(docs, **options).collect()), key=repr)


def corpus():
    """Groups of copies with more and more words changed, many around one
    text, so that regions are crowded and links lie at the threshold."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows, at = [], 0
    for size, n in ((120, 150), (60, 40), (300, 25), (9, 30)):
        base = [word() for _ in range(size)]
        for k in range(n):
            own = list(base)
            for _ in range(rng.randint(0, max(1, size // 40))):
                own[rng.randrange(size)] = word()
            rows.append((at, " ".join(own) if k % 7 else "\t\n ".join(own).upper()))
            at += 1
    rows += [(1000 + i, " ".join(word() for _ in range(rng.randint(1, 80)))) for i in range(100)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "ONE  two"), (2005, "two one"), (-5, rows[3][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_against_brute_force(spark, percent):
    rows = corpus()
    assert run(spark, rows, percent=percent) == sorted(brute(rows, percent), key=repr)


def test_star_of_edited_copies(spark):
    """A text in the middle of thousands of copies edited independently: each
    is linked with it, hardly any with another."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 9001):
        own = list(base)
        for slot in rng.sample(range(19), 4):
            own[5 + 10 * slot + rng.randrange(5)] = f"e{i}-{slot}"
        rows.append((i, " ".join(own)))
    assert {c for _, _, c, _ in run(spark, rows, percent=80)} == {0}


def test_all_pairs_of_crowded_groups(spark, monkeypatch):
    """Groups compared in full, in small blocks, sets sent in several parts."""
    for name, size in (("SENT_BYTES", 20_000), ("BLOCK_ROWS", 16), ("BLOCK_COLUMNS", 64)):
        monkeypatch.setattr(neardup, name, size)
    rows = [r for r in corpus() if r[0] < 250]
    crowded = spark.createDataFrame([(d, (d + 5) // 120, d) for d, _ in rows], "node long, region long, component long")
    docs = spark.createDataFrame(rows, "d long, t string")
    got = {r["node"]: r["component"] for r in neardup._compared(crowded, None, docs, 5, 80).collect()}
    for region in {(d + 5) // 120 for d, _ in rows}:
        for d, _, component, _ in brute([r for r in rows if (r[0] + 5) // 120 == region], 80):
            assert got.get(d, d) == component


def test_mixed_regions_are_joined_once(spark):
    """What compares crowded regions reads them several times, from files."""
    found = spark.createDataFrame([(1, None, 7), (2, None, 7), (1, None, 8)], "a long, b long, m long")
    mixed = neardup._mixed(found, None)
    assert sorted(r["node"] for r in mixed.where("region = 7").collect()) == [1, 2] and mixed.count() == 2
    assert "Join" not in mixed._jdf.queryExecution().executedPlan().toString()


def test_null_and_repeated_ids_and_no_rows(spark):
    t = "a b c d e f g"
    got = run(spark, [(None, t), (None, t), (4, t), (4, t), (9, t)])
    assert got == sorted([(None, 3, None, True)] * 2 + [(4, 3, 4, True)] * 2 + [(9, 3, 4, False)], key=repr)
    assert run(spark, []) == []


def test_clashing_columns(spark):
    odd = spark.createDataFrame([(1, "a b", 1, 2, b"x")], "doc_id long, text string, n int, component long, digest binary")
    assert [tuple(r) for r in neardup.link_documents(odd).collect()] == [(1, 1, 1, True)]


def test_bounds():
    assert (1 - 0.85 ** neardup.least_depth(0.85)) ** neardup.ORDERS <= neardup.MISS
    assert neardup.least_matches(0.85) < 0.85 * neardup.VALUES


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200), (130, 129), (50, 49), (49, 50)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 131), 100), 49: 49, 50: 49}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_components_of_stars_need_no_round(spark, monkeypatch):
    """Each round is many jobs, whose plans and threads the driver holds."""
    written = []
    monkeypatch.setattr(components, "materialize", lambda df, label, own=components.materialize: written.append(label) or own(df, label))
    stars = spark.createDataFrame([(k, k % 3) for k in range(3, 30)], "u long, v long").repartition(3)
    assert {(r["node"], r["component"]) for r in connected_components(stars).collect()} == {(k, k % 3) for k in range(30)}
    chain = spark.createDataFrame([(str(k), str(k + 1)) for k in range(100, 140)], "u string, v string").coalesce(1)
    assert {r["component"] for r in connected_components(chain).collect()} == {"100"}
    assert written == ["edges"] * 3


def test_components_of_many_small_stars(spark, monkeypatch):
    monkeypatch.setattr(components, "STAR_EDGES", 2)
    test_components(spark)


def test_crowded_regions_are_met_by_the_nearest(spark, monkeypatch):
    """In later orders too: a region they crowd is compared in full if not whole."""
    widths = []

    def scan(placed, depth, matches, percent, width, crowded_width, own=neardup._neighbours, **options):
        widths.append((width, crowded_width))
        return own(placed, depth, matches, percent, width, crowded_width, **options)

    monkeypatch.setattr(neardup, "_neighbours", scan)
    # Nothing is confirmed, so all stay apart and all orders are scanned.
    monkeypatch.setattr(neardup, "_linked", lambda found, components, *rest: components)
    monkeypatch.setattr(neardup, "_compared", lambda crowded, components, *rest: components)
    base = [f"w{k}" for k in range(120)]
    run(spark, [(i, " ".join([*base[:i], f"e{i}", *base[i + 1 :]])) for i in range(100)], percent=80)
    assert widths == [(neardup.WIDTH, neardup.CROWDED_FIRST), (neardup.CROWDED_WIDTH, neardup.CROWDED_FIRST)]


def test_ranges_meet_where_a_prefix_goes_on(spark, monkeypatch):
    scanned = []
    monkeypatch.setattr(neardup, "materialize", lambda df, label, own=neardup.materialize: scanned.append(own(df, label)) or scanned[-1])
    rows = [(0, bytes([k // 250, k % 250]) * 4, None, k, 9, k) for k in range(2000)]
    placed = spark.createDataFrame(rows, "o int, key binary, sketch binary, node long, n long, component long")
    assert neardup._neighbours(placed, 2, 1, 80, 8, 2).count() == 0
    edges = scanned[0].where("edge IS NOT NULL").groupBy("edge").count().collect()
    assert edges and all(r["count"] <= 2 for r in edges)
