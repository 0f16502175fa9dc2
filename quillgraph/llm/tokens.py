"""Tokenizing whole texts with a public tokenizer, one distinct word at a time.

The word tokenizer's normaliser and splitter never look across ASCII white space, so a text's
ids are those of its words, one after the other. Each distinct word of a worker is encoded by
the tokenizers library once and found by its 64-bit hash afterwards; tests hold this against
whole texts.
"""

from __future__ import annotations

import json

import numpy as np
from tokenizers import Tokenizer

from . import kernels as K

TOKENIZER = "word_bpe_49k.json"
SLOTS = 1 << 22
CACHE_WORDS = 1_500_000
AT_ONCE = 2048


def default_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The splitter's characters for bytes: printable Latin-1 stands for itself, the others follow from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in _SHOWN)}
BYTE_CODES = np.array([ord(BYTE_CHARS[b]) for b in range(256)], "<u4")

#: Bytes after 0xC3 that make a lower-case letter of Latin-1 with it, and those that make a letter.
_LOWER_C3, _LETTER_C3 = np.zeros(256, bool), np.zeros(256, bool)
_LOWER_C3[0x9F:0xC0] = _LETTER_C3[0x80:0xC0] = True
_LOWER_C3[0xB7] = _LETTER_C3[0xB7] = _LETTER_C3[0x97] = False
_SMALL = np.zeros(256, bool)
_SMALL[0x61:0x7B] = True
#: Marks that may be split off a word's end; special tokens begin with ``<|`` and end with ``|>``.
MARKS = np.zeros(256, bool)
MARKS[[x for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in "<|>"]] = True
MOST_MARKS = 8


def plain_bytes(buf: np.ndarray) -> np.ndarray:
    """Which bytes belong to a-z or a lower-case letter of Latin-1, which are pieces as they stand."""
    out = _SMALL[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    lead = lead[_LOWER_C3[buf[lead + 1]]]
    out[lead] = out[lead + 1] = True
    return out


def _piece(word: bytes) -> str | None:
    """What the model gets for a word that is one piece and that only lower-casing normalises: Latin letters."""
    try:
        text = word.decode()
    except UnicodeDecodeError:
        return None
    if text.isalpha() and (max(text) < "\u0100" or (max(text) < "\u0250" and text == text.lower())):
        return text.lower().encode().decode("latin-1").translate(BYTE_CHARS)
    return None


class WordTable:
    """64-bit hashes to numbers 0, 1, ... by open addressing, for whole arrays."""

    def __init__(self):
        self.keys = np.zeros(SLOTS, np.uint64)
        self.values = np.zeros(SLOTS, np.int32)
        self.used = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the hashes; -1 for those that aren't there."""
        out = np.full(len(hashes), -1, np.int64)
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        left = None
        while True:
            have = self.keys[slot]
            want = hashes if left is None else hashes[left]
            hit = have == want
            if left is None:
                out[hit] = self.values[slot[hit]]
                left = np.flatnonzero(~hit & (have != 0))
                slot = slot[left]
            else:
                out[left[hit]] = self.values[slot[hit]]
                on = ~hit & (have != 0)
                left, slot = left[on], slot[on]
            if not len(left):
                return out
            slot = (slot + 1) & (SLOTS - 1)

    def add(self, hashes: np.ndarray) -> None:
        """New, distinct hashes get the next numbers in order."""
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[left[free]]
            own = self.keys[slot] == hashes[left]
            self.values[slot[own]] = self.used + left[own]
            left, slot = left[~own], (slot[~own] + 1) & (SLOTS - 1)
        self.used += len(hashes)


class WordEncoder:
    """Ids of texts. Tokenizers whose words depend on their neighbours get whole texts instead."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        state = lambda part: json.loads(part.__getstate__()) if part is not None else None
        normalizer, splitter = state(self.tokenizer.normalizer) or {}, json.dumps(state(self.tokenizer.pre_tokenizer))
        steps = normalizer.get("normalizers") or []
        kinds = [s.get("type") for s in steps]
        squeezed = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} for s in steps)
        self.by_word = squeezed and "\\s" in splitter and self.tokenizer.post_processor is None
        self.lower = "Lowercase" in kinds
        # words of Latin letters are one piece each, which nothing normalises further
        self.letters = self.by_word and self.lower and "\\p{L}]+" in splitter.replace("\\\\", "\\") and "ByteLevel" in splitter
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.letters = self.letters and bool(suffix)
        if self.letters:
            self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends_word[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        # each word is encoded once, so the model's own cache would only take memory
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._clear()

    def _clear(self) -> None:
        self.table = WordTable()
        self.flat, self.used = np.zeros(1 << 16, self.kind), 0
        self.begin, self.length = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)

    def _keep(self, ids: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + len(ids)] = ids
        k = self.table.used
        if k + len(sizes) > len(self.begin):
            more = np.zeros(len(self.begin) + len(sizes), np.int32)
            self.begin, self.length = (np.concatenate((x, more)) for x in (self.begin, self.length))
        self.length[k : k + len(sizes)] = sizes
        self.begin[k : k + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.table.add(hashes)

    def _learn(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Encodes new words: plain ones by the model, others many as one text, where ids go to words by their offsets."""
        # the words' own bytes, one after the other: most of a group is known
        sizes = ends - starts
        until = np.cumsum(sizes)
        buf = buf[np.arange(int(until[-1]) if len(until) else 0) + np.repeat(starts - (until - sizes), sizes)]
        starts, ends, raw = until - sizes, until, buf.tobytes()
        plain = np.zeros(len(hashes), bool)
        if self.letters:
            other = np.concatenate(([0], np.cumsum(~plain_bytes(buf), dtype=np.int32)))
            # a text that is no UTF-8 may cut a letter in two, whose halves then stand in two words
            plain = (other[starts] == other[ends]) & (buf[starts] & 0xC0 != 0x80) & (buf[ends - 1] != 0xC3)
            shown = BYTE_CODES[buf].tobytes().decode("utf-32-le")
            pieces = [shown[a:b] for a, b in zip(starts[plain].tolist(), ends[plain].tolist())]
            left = np.flatnonzero(~plain)
            more = [_piece(raw[a:b]) for a, b in zip(starts[left].tolist(), ends[left].tolist())]
            found = left[[p is not None for p in more]] if len(left) else left
            pieces += [p for p in more if p is not None]
            order = np.concatenate((np.flatnonzero(plain), found))
            tokenize = self.tokenizer.model.tokenize
            # one flat list: a word's last id is one that ends words
            ids = np.array([t.id for p in pieces for t in tokenize(p)], np.uint32)
            self._keep(ids, np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1), hashes[order])
            plain[found] = True
        rest = np.flatnonzero(~plain)
        for at in range(0, len(rest), AT_ONCE):
            own = rest[at : at + AT_ONCE]
            part = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[own].tolist(), ends[own].tolist())]
            whole = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            cuts = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            owner = np.searchsorted(cuts, np.fromiter((o[0] for o in whole.offsets), np.int64, len(whole.ids)), "right")
            self._keep(np.array(whole.ids, np.uint32), np.bincount(owner, minlength=len(part)), hashes[own])

    def _gathered(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known words, one after the other, and where each word's end."""
        lengths = self.length[at].astype(np.int64)
        until = np.cumsum(lengths)
        source = np.arange(int(until[-1]) if len(until) else 0) + np.repeat(self.begin[at] - (until - lengths), lengths)
        return self.flat[source].astype(np.uint32), until

    def _stems(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where each word's marks at its end begin, if a Latin letter stands before them, with which no piece goes on; else its end."""
        stem = ends.copy()
        if not self.letters:
            return stem
        on = np.arange(len(ends))
        for _ in range(MOST_MARKS):
            on = on[(stem[on] - starts[on] > 1) & MARKS[buf[stem[on] - 1]]]
            if not len(on):
                break
            stem[on] -= 1
        cut = np.flatnonzero(stem < ends)
        last, before = buf[stem[cut] - 1], buf[np.maximum(stem[cut] - 2, 0)]
        letter = _SMALL[last] | ((stem[cut] - starts[cut] > 1) & (before == 0xC3) & _LETTER_C3[last])
        stem[cut[~letter]] = ends[cut[~letter]]
        return stem

    def _add(self, buf: np.ndarray, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Learns distinct words. One that ends in marks after a Latin letter is put together of two."""
        stem = self._stems(buf, starts, ends)
        two = stem < ends
        begin = np.concatenate((starts[~two], starts[two], stem[two]))
        end = np.concatenate((ends[~two], stem[two], ends[two]))
        halves = np.maximum(K.hash_spans(buf, begin[len(hashes) - two.sum() :], end[len(hashes) - two.sum() :], 0, sums), np.uint64(1))
        every = np.concatenate((hashes[~two], halves))
        distinct, first = np.unique(every, return_index=True)
        new = self.table.find(distinct) < 0
        first = first[new]
        self._learn(buf, begin[first], end[first], distinct[new])
        if len(halves):
            ids, until = self._gathered(self.table.find(halves).reshape(2, -1).T.ravel())
            self._keep(ids, np.diff(until[1::2], prepend=0), hashes[two])

    def _group(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.lower and b"<|" not in buf.tobytes():  # special tokens are found before the normaliser lower-cases
            # a mark from U+0300 on may compose with a small letter only, as in J and a caron: those are left to the normaliser
            marked = np.flatnonzero(buf[1:] >= 0xCC)
            low = K.LOWER[buf]
            low[marked] = buf[marked]
            buf = low
        starts, ends = K.spans(buf, offsets, K.SPACED)
        sums = K.running_sums(buf, 0)
        hashes = np.maximum(K.hash_spans(buf, starts, ends, 0, sums), np.uint64(1))
        at = self.table.find(hashes)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            fresh, first = np.unique(hashes[missing], return_index=True)
            if self.table.used + 3 * len(fresh) > CACHE_WORDS:  # with their stems and marks
                self._clear()
                missing = np.arange(len(hashes))
                fresh, first = np.unique(hashes, return_index=True)
            first = missing[first]
            self._add(buf, sums, starts[first], ends[first], fresh)
            at[missing] = self.table.find(hashes[missing])
        ids, until = self._gathered(at)
        cuts = np.concatenate(([0], until))[np.searchsorted(starts, offsets)]
        return ids, np.diff(cuts)

    def encode_group(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a group of texts (see ``kernels.groups``), and the number of ids of each."""
        if not self.by_word:
            raw = buf.tobytes()
            coded = self.tokenizer.encode_batch_fast([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])], add_special_tokens=False)
            return np.concatenate([np.zeros(0, np.uint32), *(np.array(x.ids, np.uint32) for x in coded)]), np.array([len(x.ids) for x in coded], np.int64)
        if len(offsets) == 2 and len(buf) > 2 * K.GROUP:
            parts = [self._group(p, np.array([0, len(p)]))[0] for p in K.pieces(buf, K.SPACED)]
            return np.concatenate(parts), np.array([sum(map(len, parts))])
        return self._group(buf, offsets)


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file, kept between tasks."""
    found = K.kept("tokens")
    if path not in found:
        found[path] = WordEncoder(path)
    return found[path]
