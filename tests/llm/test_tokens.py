import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tamiz.llm import packing, rangecoder, tokenfile, tokens

TEXTS = [
    "", None, "  ", "a\tb c  d\x1c e", "don't I'M 's x", "<|endoftext|> x<|startoftext|>y", "x" * 500 + " y", "ΑΣ Σ. é́ ̈a ﬁ İ",
    "\r\n a.b!c?   z", "A.. b.. É. é, k2. ... I. ª. ²", "a.'s b'.s c.…d …. '. 't.'t", "a\x00b _x_ y~z", "One. Two! Three? " * 400,
]


@pytest.fixture(scope="module")
def encode():
    return tokens.encoder(tokens.default_path())


def ids_of(encode, text):
    return encode.tokenizer.encode(text or "", add_special_tokens=False).ids


class Watched:
    """A tokenizer that notes the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.texts += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def made_words(letters, n):
    rng = random.Random(n)
    return ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(n)]


@pytest.mark.parametrize(
    "letters, most",
    [("abcdefGHIJßéÈÖÿ", 0), ("abcéÖ,'1-\u0301\u00a0İΣσ…", 20), ("\u0301\u0307\u212b\u037e\x00é", 20)],
)
def test_new_pieces_go_to_the_tokenizer_together(letters, most):
    encode = tokens.TextEncoder(tokens.default_path())
    watched = encode.tokenizer = Watched(encode.tokenizer)
    text = " ".join(made_words(letters, 3000))
    _, ids, _ = next(encode.encode(pa.array([text])))
    # Words need none of the file's normal form and pre-tokenizer; others go many in a text.
    assert len(watched.texts) <= most
    assert ids.tolist() == watched.tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_found_after_growth():
    rng = np.random.default_rng(1)
    pieces, want = tokens.Pieces(np.uint16, 2), {}
    for size in (1, 2, 5, 300, 0, 4000):
        # Crowded: hashes that differ in their low bits alone share a slot.
        new = np.setdiff1d(rng.integers(1, 4000, size).astype(np.uint64) << np.uint64(50), np.array([*want, 0], np.uint64))
        new = np.concatenate([new, new + np.uint64(1)])
        n = rng.integers(0, 4, len(new))
        ids = rng.integers(0, 1 << 16, int(n.sum()))
        at = np.cumsum(n) - n
        pieces.add(new, at, n, ids)
        want |= {h: ids[a : a + k].tolist() for h, a, k in zip(new.tolist(), at.tolist(), n.tolist())}
        asked = np.concatenate([rng.permutation(np.array([*want], np.uint64)), np.array([2, 3], np.uint64)])
        slot, known = pieces.find(asked)
        assert known.tolist() == [h in want for h in asked.tolist()]
        got = zip(*pieces.get(slot[known]))
        assert [pieces.pool[a : a + k].tolist() for a, k in got] == [want[h] for h in asked[known].tolist()]


@pytest.mark.parametrize("size", [100, 1 << 21])
def test_ids_are_the_librarys(encode, monkeypatch, size):
    monkeypatch.setattr(tokens, "SLICE", size)
    got = {}
    for lo, ids, at in encode.encode(pa.array(TEXTS)):
        for i in range(len(at) - 1):
            got[lo + i] = ids[at[i] : at[i + 1]].tolist()
    assert [got[i] for i in range(len(TEXTS))] == [ids_of(encode, t) for t in TEXTS]


def test_cheapest_cuts():
    rng = random.Random(3)
    for _ in range(200):
        window, n = rng.choice([4, 8, 16, 64]), rng.randint(1, 30)
        places = np.cumsum([0] + [rng.randint(1, window) for _ in range(n)])
        fee = np.array([0.0] + [rng.choice([0, 3, 8.0]) for _ in range(n)])
        best = [0.0] + [float("inf")] * n
        for j in range(1, n + 1):
            for i in range(j):
                size = int(places[j] - places[i])
                if size <= window:
                    best[j] = min(best[j], best[i] + packing.padding(size, window) + fee[j] + packing.SEQUENCE)
        cuts = packing.choose_cuts(places, fee, window)
        cost = sum(packing.padding(int(places[b] - places[a]), window) + fee[b] + packing.SEQUENCE for a, b in zip(cuts, cuts[1:]))
        assert cost == pytest.approx(best[-1])


def documents(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id. twice"), (None, "null id. twice"), (3, "again"), (3, "again")]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


@pytest.mark.parametrize("window, stretch", [(16, 64), (64, 300), (4096, 1 << 20)])
def test_each_id_is_in_one_piece(spark, encode, window, stretch):
    docs, rows = documents(spark)
    pieces = [r.asDict() for r in packing.pack(docs, window=window, stretch=stretch).collect()]
    whole, sequences = {}, {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        raw = np.frombuffer(p["ids"], "<u4")
        assert len(raw) == p["length"] > 0
        assert p["offset"] == sequences.get(p["sequence_id"], 0)
        sequences[p["sequence_id"]] = p["offset"] + p["length"]
        whole.setdefault(p["doc_id"], []).append(p)
    assert max(sequences.values()) <= window
    for key, parts in whole.items():
        want = [ids_of(encode, t) + [2] for d, t in rows if d == key]
        ids = []
        for p in parts:
            if p["start"] == 0:
                ids.append([])
            assert p["start"] == len(ids[-1])
            ids[-1] += np.frombuffer(p["ids"], "<u4").tolist()
        assert sorted(ids) == sorted(want)


def test_pack_nothing_and_clashing_columns(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    odd = spark.createDataFrame([("k", "a b", 1, 2)], "doc_id string, text string, ids int, row int")
    assert {r["doc_id"] for r in packing.pack(odd).collect()} == {"k"}


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 255, 3000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 65535, n), np.minimum(rng.zipf(1.3, n), 60000), np.full(n, 65534), np.arange(n) % 7):
        words, per_lane = rangecoder.encode(ids.astype(np.uint32))
        assert (rangecoder.decode(words, per_lane, n) == ids).all()


def test_repeated_ids_take_little_room():
    ids = (np.arange(20000) % 50 + 1000).astype(np.uint32)
    assert len(rangecoder.encode(ids)[0]) * 16 < 3 * len(ids)


def test_damage_is_noticed():
    block = tokenfile.write_block(5, [1, None], 0, False, [2, 1], np.array([7, 8, 9], np.uint32))
    first, keys, before, goes_on, counts, ids = tokenfile.read_block(block)
    assert (first, keys, before, goes_on, counts.tolist(), ids.tolist()) == (5, [1, None], 0, False, [2, 1], [7, 8, 9])
    with pytest.raises(ValueError):
        tokenfile.read_block(block[:-1] + bytes([block[-1] ^ 1]))
    with pytest.raises(ValueError):
        tokenfile.read_block(b"none" + block)


@pytest.mark.parametrize("block_ids", [50, 1 << 20])
def test_files_round_trip(spark, encode, block_ids):
    docs, rows = documents(spark)
    got = tokenfile.round_trip(docs, block_ids=block_ids).collect()
    at, want = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(encode, t) + [2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    found = sorted(((r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in got), key=lambda r: r[1])
    # Texts of one id follow each other in the order they were read.
    assert [r[1:3] for r in found] == [r[1:3] for r in want] or sorted(found, key=repr) == sorted(want, key=repr)
    assert sorted((r[0] is None, r[0] or 0, r[2], r[3]) for r in found) == sorted((r[0] is None, r[0] or 0, r[2], r[3]) for r in want)
    assert sum(r[2] for r in found) == at


def test_files_of_nothing(spark):
    assert tokenfile.round_trip(spark.createDataFrame([], "doc_id long, text string")).collect() == []
