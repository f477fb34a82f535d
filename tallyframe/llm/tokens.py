"""Exact token ids of whole texts with the tokenizers library, at a fraction of its cost per text.

The tokenizer of ``word_bpe_49k.json`` never joins anything across white space: its normaliser works inside a word, and
its pre-tokeniser drops white space. A text is therefore the concatenation of its space-separated words. Texts are split
many at a time in Arrow and each different word is looked up once; since words repeat, each worker keeps their ids.
Words keep any rarer white space and go through the library unchanged, so that the ids are those of the whole text.
Lower-case Latin-1 letters and the marks after them are pre-tokens of their own, so stems and marks are kept apart, and
new stems go to the library's model many at a time.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from functools import cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTERS = "abcdefghijklmnopqrstuvwxyzªµº" + "".join([chr(c) for c in range(0xDF, 0x100) if c != 0xF7])
MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"  # not those that begin a contraction or a special token
STEM = f"^[{LETTERS}]+$"
STEM_AND_MARKS = f"^[{LETTERS}]+[{re.escape(MARKS)}]*$"
KEPT_WORDS = 300_000  # a worker keeps the words of the last so many new ones, and those met again since then
NEW_STEMS = 500  # go to the library at once
TEXT_BYTES = 1 << 22  # of texts that are split at once, about, or one longer text


@cache
def vocabulary_path(name: str) -> str:
    """Where a public vocabulary lies on this machine; a path given as such is taken as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def tokenizer(name: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(name))


class WordEncoder:
    """Ids of texts as unsigned 32-bit arrays, for a tokenizer that works word by word."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = tokenizer(name)
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.stems = Tokenizer(self.tokenizer.model)
        self.stems.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}

    def _library(self, words: list[str]) -> list[bytes]:
        """Ids of words of any kind, by the whole tokenizer."""
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.width).tobytes() for e in found]

    def _model(self, stems: list[str]) -> list[bytes]:
        """Ids of words of lower-case Latin-1 letters, by the tokenizer's model: they are one pre-token as they stand."""
        out, size = [], np.dtype(self.width).itemsize
        for start in range(0, len(stems), NEW_STEMS):
            some = stems[start : start + NEW_STEMS]
            found = self.stems.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(found.ids, dtype=self.width).tobytes()
            ends = (size * np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(some)), "right")).tolist()
            out += [ids[a:e] for a, e in zip([0, *ends], ends, strict=False)]
        return out

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of different words that are not kept, looked up among the earlier ones first."""
        found = list(map(self.before.get, words))
        out = {w: f for w, f in zip(words, found, strict=True) if f is not None}
        new = [w for w, f in zip(words, found, strict=True) if f is None]
        plain = pc.match_substring_regex(pa.array(new, pa.large_string()), STEM).to_numpy(zero_copy_only=False)
        for ids_of, some in ((self._model, list(compress(new, plain))), (self._library, list(compress(new, ~plain)))):
            out.update(zip(some, ids_of(some), strict=True))
        return out

    def _kept(self, words: pa.Array) -> pa.Array:
        """Ids of each word, as bytes."""
        once = words.dictionary_encode()
        different = once.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, different))
        if None in found:
            learnt = self._learn([w for w, f in zip(different, found, strict=True) if f is None])
            found = [learnt[w] if f is None else f for w, f in zip(different, found, strict=True)]
            self.known.update(learnt)
            if len(self.known) > KEPT_WORDS:
                self.before, self.known = self.known, {"": b""}
        return pa.array(found, pa.large_binary()).take(once.indices)

    def _ids(self, words: pa.Array) -> pa.Array:
        """Ids of each word, as bytes: those of its stem, then those of the marks after it."""
        split = pc.match_substring_regex(words, STEM_AND_MARKS)
        stems = pc.if_else(split, pc.utf8_rtrim(words, characters=MARKS), words)
        marks = pc.if_else(split, pc.utf8_ltrim(words, characters=LETTERS), pa.scalar("", pa.large_string()))
        return pc.binary_join_element_wise(self._kept(stems), self._kept(marks), pa.scalar(b"", pa.large_binary()))

    def encode_flat(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, as wide as the vocabulary needs, and the end of each text among them."""
        # Lower case would make special tokens of what only looks like them.
        whole = [(text.lower() if "<|" not in text and is_latin(text) else text).replace("\n", " ") for text in (t or "" for t in texts)]
        words = pc.split_pattern(pa.array(whole, pa.large_string()), " ")
        once = words.flatten().dictionary_encode()
        ids = self._ids(once.dictionary).take(once.indices)
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, np.int64, len(ids) + 1) // np.dtype(self.width).itemsize
        flat = np.frombuffer(data, self.width, int(ends[-1])) if ends[-1] else np.empty(0, self.width)
        return flat, ends[words.offsets.to_numpy()[1:]]

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        if not len(texts):
            return []
        flat, ends = self.encode_flat(texts)
        flat, ends = flat.astype(np.uint32), ends.tolist()
        return [flat[a:e] for a, e in zip([0, *ends], ends, strict=False)]


def is_latin(text: str) -> bool:
    """All characters below U+0100: lower case and composition then work character by character."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@cache
def word_encoder(name: str) -> WordEncoder:
    """One encoder per worker process; its words serve all tasks that the worker runs."""
    return WordEncoder(name)
