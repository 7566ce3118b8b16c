import glob
import hashlib
import io
import random

import pytest
import zstandard
from pyspark.errors import PythonException

from tamiz.llm import warc

LONG = "<p>Long é</p>" * 100
OTHER = "<p>Other</p>" * 200
SEPARATOR = warc.SKIPPED.decode()


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def read(spark, rows, **options):
    found = warc.round_trip(pages(spark, rows), **options).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r) for r in found.collect()), key=repr)


def brute(rows, least=1000):
    seen, out = {}, []
    for i, (page, _, html) in enumerate(rows):
        seen.setdefault(html or "", []).append((page is not None, page, i))
    for same in seen.values():
        raw, top = same and (rows[same[0][2]][2] or "").encode(), max(same, key=lambda s: (s[0], s[1] or 0))
        for s in same:
            again = len(raw) >= least and s[2] != top[2]
            out.append((s[1], len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top[1] if again else None))
    return sorted(out, key=repr)


ROWS = [
    (5, "http://a/5", LONG), (9, "http://a/9", LONG), (7, None, LONG), (1, "http://b/\r\nX: y ", "short"), (2, "", "short"),
    (3, "ü" * 20_000, None), (4, " ", ""), (10, "http://c", OTHER), (10, "http://d", OTHER), (10, "http://c", OTHER), (8, "u", OTHER),
    (None, "n", OTHER), (None, None, "x" * 999), (None, None, "x" * 1000), (None, "m", "x" * 1000), (11, "big", "word " * 400_000),
    (12, "s", SEPARATOR * 500), (13, "t", "a" + SEPARATOR + "b"), (14, "z", "\x00" * 5000), (-3, "neg", "\r\n\r\nWARC/1.1\r\n"),
]


@pytest.mark.parametrize("broadcast", [50_000, 0, 2])
def test_as_by_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", broadcast or 1)
    rows = ROWS * (1 if broadcast else 3)
    assert read(spark, rows) == brute(rows)


def test_many_copies_of_one_payload(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", 1)
    rows = [(i, "u", LONG if i % 3 else OTHER * (i % 40)) for i in range(2000)]
    assert read(spark, rows, least=1) == brute(rows, least=1)


def test_files_are_plain_frames_and_split_anywhere(spark, folder):
    rnd = random.Random(1)
    rows = [(i, f"http://h/{i}", "".join(rnd.choice(["<p>", "word ", "</p>", "é"]) for _ in range(rnd.randint(0, 900)))) for i in range(600)]
    rows += [(900 + i, "s", SEPARATOR * i) for i in range(50)]
    warc.write_archives(pages(spark, rows).coalesce(2), f"{folder}/w")
    whole = 0
    for name in glob.glob(f"{folder}/w/part-*"):
        raw = open(name, "rb").read()
        assert raw[:4] == warc.DICTIONARY
        first = raw.index(warc.SKIPPED)
        words = zstandard.ZstdCompressionDict(warc.dictionary_of(raw[:first]))
        with zstandard.ZstdDecompressor(dict_data=words).stream_reader(io.BytesIO(raw), read_across_frames=True) as stream:
            text = stream.read()
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        whole += text.count(b"WARC-Type: response")
    assert whole == len(rows)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "777b")
    try:
        back = warc.read_pages(spark, f"{folder}/w")
        assert back.rdd.getNumPartitions() > 20
        assert sorted(tuple(r) for r in back.collect()) == sorted(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_pages_come_back(spark, folder):
    rows = [(i, f"http://h/{i}", LONG if i % 2 else f"own {i}") for i in range(40)]
    warc.write_archives(pages(spark, rows), f"{folder}/w")
    assert sorted(tuple(r) for r in warc.read_pages(spark, f"{folder}/w").collect()) == rows
    records = warc.read_archives(spark, f"{folder}/w")
    ids = [r["record_id"] for r in records.collect()]
    named = {r["refers_record"] for r in records.where("record_type = 'revisit'").collect()}
    assert len(set(ids)) == 40 and len(named) == 1 and named < set(ids)


def test_nothing_and_clashing_columns(spark):
    assert read(spark, []) == []
    odd = spark.createDataFrame([("a b%\n", "u", LONG, "k", 1, 2), ("c", "u", LONG, "k", 1, 2)], "page_id string, url string, html string, key string, n int, role int")
    got = {r["page_id"]: r for r in warc.round_trip(odd).collect()}
    assert got["a b%\n"]["refers_to"] == "c" and got["c"]["record_type"] == "response" and len(got) == 2


def test_damage_is_noticed(spark, folder):
    rows = [(i, "u", f"{i} " * 300) for i in range(50)]
    warc.write_archives(pages(spark, rows).coalesce(1), f"{folder}/w")
    raw = open(glob.glob(f"{folder}/w/part-*")[0], "rb").read()
    at = raw.index(warc.SKIPPED, len(raw) // 2)
    with open(f"{folder}/broken", "wb") as f:
        f.write(raw[: at - 20] + bytes([raw[at - 20] ^ 4]) + raw[at - 19 :])
    with pytest.raises(PythonException, match="damaged"):
        warc.read_archives(spark, f"{folder}/broken").collect()


def test_records():
    with pytest.raises(ValueError, match="length"):
        warc.parse_record(warc.make_record("response", [], b"abc")[:-5] + b"\r\n\r\n")
    fields, block = warc.parse_record(warc.make_record("response", [("A", "b: c")], b"\r\n\r\n"))
    assert fields["a"] == "b: c" and block == b"\r\n\r\n"
    assert warc.train_dictionary([b"x"]) == b"" and warc.Writer(b"").head() is None
