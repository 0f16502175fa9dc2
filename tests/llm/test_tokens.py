"""Ids of words that are learned one by one against the tokenizer's on whole texts."""

import random

import numpy as np
from tokenizers import Tokenizer

from quillgraph.llm import kernels as K
from quillgraph.llm import tokens


def group(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)


def coded(encoder, texts):
    ids, sizes = encoder.encode_group(*group(texts))
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


class Recorder:
    """A tokenizer that notes what it is given beyond its model."""

    def __init__(self, tokenizer):
        self.own, self.model, self.texts = tokenizer, tokenizer.model, []

    def encode(self, text, **options):
        self.texts.append(text)
        return self.own.encode(text, **options)


def test_words_of_latin_letters_go_to_the_model_with_or_without_marks():
    """Only the marks themselves need the normaliser and the splitter, whatever the number of words that end in them."""
    encoder, whole = tokens.WordEncoder(tokens.default_path()), Tokenizer.from_file(tokens.default_path())
    encoder.tokenizer = recorder = Recorder(encoder.tokenizer)
    stems = ["onrest", "Éoiréle", "naïveß", "überé", "WORLD"]
    texts = [" ".join(s + m for s in stems for m in ("", ",", "&&&", ".%%%", "!!", "$$$"))]
    assert coded(encoder, texts) == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert sorted(" ".join(recorder.texts).split()) == sorted([",", "&&&", ".%%%", "!!", "$$$"])


def test_odd_words_are_coded_as_in_whole_texts():
    r = random.Random(5)
    bits = ["the", "ing", "É", "ß", "ÿ", "×", "÷", "µ", "ª", "İ", "ı", "ſ", "Ā", "Σ", "ς", "Ж", "中", "ﬁ", "…", "’", "'", "'s", "'re", ",", ".", "!!", "&&&", "<", "|", ">", "<|endoftext|>", "<|ENDOFTEXT|>", "(", "_", "12", "½", "J", "Hello", " ", " ", "\n", " ", " ", "\x00", "🙂", "^", "`", "ʰ"]
    encoder, whole = tokens.WordEncoder(tokens.default_path()), Tokenizer.from_file(tokens.default_path())
    for _ in range(300):
        texts = ["".join(r.choices(bits, k=r.randint(0, 14))) for _ in range(5)]
        assert coded(encoder, texts) == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_halves_of_a_letter_are_no_letter():
    """Bytes that are no UTF-8: a text's last byte and the next one's first don't join to a letter."""
    encoder, whole = tokens.WordEncoder(tokens.default_path()), Tokenizer.from_file(tokens.default_path())
    raw = [b"word\xc3", b"\xa9word", b"caf\xc3\xa9"]
    ids, sizes = encoder.encode_group(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [whole.encode(x.decode("utf-8", "replace"), add_special_tokens=False).ids for x in raw]


def test_capitals_with_marks_are_composed_before_they_are_lowered():
    """J and a caron stay two characters, a small j and a caron become one: the normaliser composes first."""
    encoder, whole = tokens.WordEncoder(tokens.default_path()), Tokenizer.from_file(tokens.default_path())
    texts = ["J̌", "aJ̌b, H̱ T̈! W̊ Y̊", "ǰ J̣̌ İ É.", "J", "̌x"]
    assert coded(encoder, texts) == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_hashes_do_not_depend_on_strips(monkeypatch):
    """Hashes are kept in indexes of earlier sessions: where sums are cut changes none."""
    buf = np.random.default_rng(4).integers(0, 256, 5000).astype(np.uint8)
    starts, ends = K.spans(buf, np.array([0, 5000]), K.SPACED)
    want = [K.hash_spans(buf, starts, ends, lane) for lane in (0, 1)]
    for strip in (1, 7, 4999, 5000):
        monkeypatch.setattr(K, "STRIP", strip)
        assert all(np.array_equal(w, K.hash_spans(buf, starts, ends, lane)) for lane, w in enumerate(want))
    power = np.array([pow(K._BASES[0], k, 1 << 64) for k in range(50)], object)
    sums = [sum((int(b) + 1) * p for b, p in zip(buf[:n], power)) % (1 << 64) for n in range(51)]
    assert K.running_sums(buf[:50], 0).tolist() == sums
