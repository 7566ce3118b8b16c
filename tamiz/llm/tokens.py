"""Token ids of whole texts by a public tokenizer file.

The file's pre-tokenizer never joins text across white space, nor a letter
with a mark beside it, and folds case; so the ids of a text are those of its
pieces in order. Pieces are found and looked up by their 64-bit hash with
array operations, and only those not met before go to the tokenizer (tested
against the library on whole texts)."""

from __future__ import annotations

import codecs
import json
import os
import re
import sys
import types
from itertools import chain

import numpy as np
import pyarrow as pa

from tamiz.llm import hashing as H

#: Bytes of pieces that a worker keeps; beyond it starts anew.
KEPT_BYTES = 64 << 20
#: Bytes of text looked up at a time.
SLICE = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x0A]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
# ASCII marks but the apostrophe, which can belong to the letters after it.
_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
# The characters that stand for the bytes in the vocabulary of a byte-level
# model; the space between words stays one.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_HIDDEN = sorted(set(range(256)) - set(_SHOWN))
_CHARACTERS = "".join(chr(b if b in _SHOWN or b == 0x20 else 256 + _HIDDEN.index(b)) for b in range(256))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Pieces:
    """Known pieces: a table of their 64-bit hashes with linear probing, for
    each where its ids are in a pool and how many. Both grow by doubling or
    half, so that what is added is not copied with all before it each time."""

    def __init__(self, kind=np.uint32, bits: int = 16):
        self.hash, self.value = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.shift, self.known = np.uint64(64 - bits), 0
        self.room, self.size = np.zeros(0, kind), 0

    @property
    def pool(self) -> np.ndarray:
        return self.room[: self.size]

    def nbytes(self) -> int:
        return self.hash.nbytes + self.value.nbytes + self.room.nbytes

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of pieces, and which of them are known. No hash is 0."""
        slot = (hashes >> self.shift).view(np.int64)
        found = self.hash[slot]
        known = found == hashes
        left = np.flatnonzero(~known & (found != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.hash) - 1)
            found = self.hash[slot[left]]
            known[left] = found == hashes[left]
            left = left[~known[left] & (found != 0)]
        return slot, known

    def get(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of the ids of known pieces."""
        value = self.value[slot]
        return (value >> np.uint64(32)).view(np.int64), (value & np.uint64(0xFFFFFFFF)).view(np.int64)

    def _put(self, hashes: np.ndarray, value: np.ndarray) -> None:
        slot = (hashes >> self.shift).view(np.int64)
        while len(hashes):
            free = np.flatnonzero(self.hash[slot] == 0)
            self.hash[slot[free]] = hashes[free]
            # Of several pieces for one slot the last one has it.
            mine = self.hash[slot] == hashes
            self.value[slot[mine]] = value[mine]
            hashes, value, slot = hashes[~mine], value[~mine], (slot[~mine] + 1) & (len(self.hash) - 1)

    def add(self, hashes: np.ndarray, at: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        """Add different pieces that are not known."""
        self.known += len(hashes)
        if 4 * self.known > 3 * len(self.hash):
            old, value = self.hash, self.value
            bits = (2 * self.known).bit_length()
            self.hash, self.value = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
            self.shift = np.uint64(64 - bits)
            filled = old != 0
            self._put(old[filled], value[filled])
        self._put(hashes, ((at + self.size).astype(np.uint64) << np.uint64(32)) | n.astype(np.uint64))
        end = self.size + len(ids)
        if end > len(self.room):
            grown = np.empty(max(end, len(self.room) * 3 // 2), self.room.dtype)
            grown[: self.size] = self.pool
            self.room = grown
        self.room[self.size : end] = ids
        self.size = end


class TextEncoder:
    """Ids of texts. Strings of special tokens inside a text are ordinary text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
        self.ends_sentence = np.zeros(max(vocabulary.values()) + 4, bool)
        self.ends_sentence[[i for t, i in vocabulary.items() if t.endswith((".</w>", "!</w>", "?</w>"))]] = True
        self.stop = self.tokenizer.encode(".", add_special_tokens=False).ids[0]
        self.kind = np.uint16 if len(self.ends_sentence) <= 1 << 16 else np.uint32
        self.known = Pieces(self.kind)
        # The same model without what lower-case words do not need: they are in
        # their normal form, and words of their own. Its id of a word's end tells
        # where the next word begins.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.ends_word = np.zeros(len(self.ends_sentence), bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.is_word = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
        sample = [t.removesuffix("</w>") for t in vocabulary][:: max(1, len(vocabulary) // 500)]
        sample = ["straße", "ÀÖØÿ", *(t for t in sample if t.isascii() and t.isalpha())]
        got = self._word_ids(sample)
        same = got is not None and [got[2][a : a + n].tolist() for a, n in zip(*got[:2])] == [
            e.ids for e in self.tokenizer.encode_batch_fast(sample, add_special_tokens=False)
        ]
        if not same:  # another kind of file
            self.is_word = lambda piece: None

    def _word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Start, number and list of ids of words, some hundred at a time."""
        lists = []
        for lo in range(0, len(words), 512):
            joined = codecs.charmap_decode(" ".join(words[lo : lo + 512]).lower().encode(), "strict", _CHARACTERS)[0]
            lists.append(np.array(self.words.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32))
        ids = np.concatenate(lists) if lists else np.zeros(0, np.uint32)
        end = np.flatnonzero(self.ends_word[ids]) + 1
        if len(end) != len(words):
            return None
        start = np.concatenate([np.zeros(1, np.int64), end])[:-1]
        return start, end - start, ids

    def _joined_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """The same of any pieces without a stop, by stops between them."""
        start, n, lists, total = [], [], [], 0
        for lo in range(0, len(pieces), 512):
            some = pieces[lo : lo + 512]
            got = np.array(self.tokenizer.encode_batch_fast([" . ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(got == self.stop)
            if len(cut) != len(some) - 1:
                return None
            first = np.concatenate([[0], cut + 1])
            start.append(first + total)
            n.append(np.concatenate([cut, [len(got)]]) - first)
            lists.append(got)
            total += len(got)
        return np.concatenate(start), np.concatenate(n), np.concatenate(lists)

    def _each_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of any pieces, one by one."""
        n, lists = [], []
        for lo in range(0, len(pieces), 4096):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(pieces[lo : lo + 4096], add_special_tokens=False)]
            n += map(len, got)
            lists.append(np.fromiter(chain.from_iterable(got), np.uint32))
        n = np.array(n, np.int64)
        return np.cumsum(n) - n, n, np.concatenate(lists)

    def _ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, number and list of ids of pieces. Words go to the tokenizer
        many at a time, others without a stop do with stops between, and the
        rest go one by one."""
        texts = [p.decode("utf-8") for p in pieces]
        sort = np.fromiter((0 if self.is_word(t) else 2 if "." in t else 1 for t in texts), np.uint8, len(texts))
        at, n, lists = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), []
        total = 0
        for k, way in enumerate((self._word_ids, self._joined_ids, self._each_ids)):
            some = np.flatnonzero(sort == k)
            if not len(some):
                continue
            chosen = list(map(texts.__getitem__, some.tolist()))
            got = way(chosen) or self._each_ids(chosen)
            at[some], n[some] = got[0] + total, got[1]
            lists.append(got[2])
            total += len(got[2])
        return at, n, np.concatenate(lists) if lists else np.zeros(0, np.uint32)

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes, start, end = H.byte_runs(data, offsets, _SPACE, (_LETTER, _MARK))
        hashes[hashes == 0] = 1
        if self.known.nbytes() > KEPT_BYTES:
            self.known = Pieces(self.kind)
        slot, is_known = self.known.find(hashes)
        lacking = np.flatnonzero(~is_known)
        if len(lacking):
            some, first = np.unique(hashes[lacking], return_index=True)
            base, buffer = int(offsets[0]), data[offsets[0] : offsets[-1]].tobytes()
            place = lacking[first]
            cut = map(slice, (start[place] - base).tolist(), (end[place] - base).tolist())
            before = len(self.known.hash)
            self.known.add(some, *self._ids(list(map(buffer.__getitem__, cut))))
            if len(self.known.hash) == before:
                slot[lacking] = self.known.find(hashes[lacking])[0]
            else:
                slot = self.known.find(hashes)[0]
        at, n = self.known.get(slot)
        done = np.concatenate([[0], np.cumsum(n)])
        source = np.repeat(at - done[:-1], n)
        source += np.arange(done[-1])
        return self.known.pool[source].astype(np.uint32), done[np.searchsorted(start, offsets)]

    def encode(self, texts: pa.Array):
        """Yields (first row, ids, offsets of rows in ids) for ranges of rows
        of a text column, in order; null counts as empty."""
        data, offsets = H.text_bytes(texts)
        for lo, hi in H.row_groups(offsets, SLICE):
            parts, ends = [], []
            at = offsets[lo : hi + 1]
            if at[-1] - at[0] <= 2 * SLICE:
                ids, ends = self._slice(data, at)
                yield lo, ids, ends
                continue
            # One text far longer than a slice: between words, piece by piece.
            for a, b in H._pieces(data, int(at[0]), int(at[-1]), _SPACE):
                parts.append(self._slice(data, np.array([a, b]))[0])
            ids = np.concatenate(parts)
            yield lo, ids, np.array([0, len(ids)])


def encoder(path: str) -> TextEncoder:
    """One encoder per worker process: functions travel by value, so the
    encoder is kept in a module of the process, not of this file."""
    kept = sys.modules.setdefault("_kept_text_encoders", types.ModuleType("_kept_text_encoders"))
    if path not in kept.__dict__:
        kept.__dict__[path] = TextEncoder(path)
    return kept.__dict__[path]
