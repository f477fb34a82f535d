"""Language identification with a string kernel, Nyström landmarks and one-versus-rest kernel ridge regression.

The kernel is the blended-spectrum presence kernel: the number of n-grams (n = 1, 2, 3) that two texts share, over the
n-grams that occur in some landmark, divided by the root of the product of their own numbers. Landmarks are a few
training texts of each language. A text's kernel values against all landmarks are one product of its presence row
with the landmarks' presence matrix; ridge regression on the Nyström features gives one output for each language, and
since that is linear in the kernel values, scoring a batch is two matrix products.

A null text, or one without letters, has language ``und`` and score 0. Ties go to the first language in name order.
Without any training text every row is ``und``. Repeated rows stay; other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import beside_results, code_points, hashed_share, pieces, with_results

UNDETERMINED = "und"
PER_LANGUAGE = 240  # training texts of a language, at most (about)
LANDMARKS = 24  # of each language
LANGUAGES = 500  # more than these make the fit refuse instead of growing without bound
BATCH_CHARACTERS = 100_000
SEGMENT = 600
ALPHABET = 64  # codes: 0 none, 1 edge of a word, the rest by rank of the letter among the landmarks; every other letter has its code point beyond these
SPACE = ALPHABET**3
POINT = (1 << 21) - 1
OTHER = 1 << 60  # n-grams with a letter of no rank start here, three codes of 18 bits


@cache
def _lowered() -> tuple[np.ndarray, np.ndarray]:
    """For each code point below the limit: its lower-case letter, or 0; true for letters."""
    lower = np.zeros(0x3000, dtype=np.uint32)
    for point in range(len(lower)):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            lower[point] = ord(low) if len(low) == 1 else point
    return lower, lower > 0


def letters(flat: np.ndarray) -> np.ndarray:
    """Lower-case letters; 0 for whatever is no letter. Letters beyond the table stay as they are."""
    table, _ = _lowered()
    low = table[np.minimum(flat, 0x2FFF)]
    beyond = flat >= 0x3000
    if beyond.any():
        points, place = np.unique(flat[beyond], return_inverse=True)
        low[beyond] = np.array([p if chr(p).isalpha() else 0 for p in points.tolist()], dtype=np.uint32)[place]
    return low


def combined(one, two, three: np.ndarray) -> np.ndarray:
    """n-grams of three codes, the first of which may be 0: a place in a dense table, or all of the codes from OTHER on."""
    high = (three | two | one) >= ALPHABET
    if not high.any():
        return (one * ALPHABET + two) * ALPHABET + three
    one, two, three = (np.asarray(code, dtype=np.int64) for code in (one, two, three))
    return np.where(high, OTHER + (one << 36 | two << 18 | three), (one * ALPHABET + two) * ALPHABET + three)


@dataclass
class LanguageModel:
    languages: list[str]
    alphabet: np.ndarray  # letters with a code of their own, ascending
    codes: np.ndarray  # their codes
    column: np.ndarray  # n-gram of letters with a rank -> column of the presence matrix, -1 for those of no landmark
    presence: np.ndarray  # n-grams x landmarks, each column divided by its root
    weights: np.ndarray  # landmarks x languages, after the Nyström map
    table_of_codes: np.ndarray | None = None
    others: np.ndarray | None = None  # the landmarks' n-grams from OTHER on, ascending; they have the last columns

    def coded(self, flat: np.ndarray) -> np.ndarray:
        if self.table_of_codes is None:
            low = letters(np.arange(0x3000, dtype=np.uint32))
            codes = np.where(low > 0, ALPHABET + low, 1).astype(np.int32)
            for letter, code in zip(self.alphabet.tolist(), self.codes.tolist(), strict=True):
                codes[low == letter] = code
            self.table_of_codes = codes
        code = self.table_of_codes[np.minimum(flat, 0x2FFF)]
        beyond = flat >= 0x3000
        if beyond.any():
            low = letters(flat[beyond])
            code[beyond] = np.where(low > 0, ALPHABET + low, 1)
        return code

    def grams(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Owner and n-gram of every position and n."""
        flat, ends = code_points([f" {t or ''} " for t in texts])
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(np.concatenate([[0], ends])))
        code = self.coded(flat)
        # Runs of non-letters count as one edge.
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != 1) | (code[:-1] != 1) | (owner[1:] != owner[:-1])
        code, owner = code[keep], owner[keep]
        two = combined(0, code[:-1], code[1:])
        same = owner[1:] == owner[:-1]
        three = combined(code[:-2], code[1:-1], code[2:])
        alike = owner[2:] == owner[:-2]
        # A trigram always has a non-zero first code; shorter ones leave it zero, so that the three kinds stay apart.
        return np.concatenate([owner, owner[1:][same], owner[2:][alike]]), np.concatenate([combined(0, 0, code), two[same], three[alike]])

    def grams_of_sets(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Owner and n-gram, in the codes of the model, of the members of each ``gram_set``."""
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(g) for g in sets])
        flat = np.concatenate(sets)
        one, two, three = (np.where(points > 0, self.coded(points.astype(np.uint32)), 0) for points in (flat >> 42, flat >> 21 & POINT, flat & POINT))
        return owner, combined(one, two, three)

    def kernel(self, texts: list[str | None]) -> np.ndarray:
        """Normalised kernel values against all landmarks."""
        return self.kernel_of(*self.grams(texts), len(texts))

    def columns(self, gram: np.ndarray) -> np.ndarray:
        other = gram >= OTHER if gram.dtype == np.int64 else None
        if other is None or not other.any():
            return self.column[gram]
        column = self.column[np.where(other, 0, gram)]
        column[other] = -1
        if self.others is not None and len(self.others):
            place = np.flatnonzero(other)
            at = np.minimum(np.searchsorted(self.others, gram[place]), len(self.others) - 1)
            column[place] = np.where(self.others[at] == gram[place], len(self.presence) - len(self.others) + at, -1)
        return column

    def kernel_of(self, owner: np.ndarray, gram: np.ndarray, many: int) -> np.ndarray:
        column = self.columns(gram)
        known = column >= 0
        bits = np.zeros((many, len(self.presence)), dtype=np.float32)
        bits[owner[known], column[known]] = 1
        own = np.sqrt(np.maximum(bits.sum(axis=1, keepdims=True), 1))
        return (bits @ self.presence) / own

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages or not texts:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        parts, owner = segments(texts)
        values = self.kernel(parts)
        size = np.array([len(p) for p in parts], dtype=float)
        out = (values @ self.weights).astype(float) * size[:, None]
        out = np.stack([np.bincount(owner, out[:, k], minlength=len(texts)) for k in range(out.shape[1])], axis=1)
        out /= np.maximum(np.bincount(owner, size, minlength=len(texts)), 1)[:, None]
        lettered = np.array([any(map(str.isalpha, t or "")) for t in texts])
        best = out.argmax(axis=1)
        names = [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
        score = np.clip(out[np.arange(len(texts)), best], 0, 1)
        return names, np.where(lettered, score, 0.0).astype(float)


def segments(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Whole texts in pieces of equal size, about ``SEGMENT`` characters, and the text that each piece is from.

    Presence says nothing about how much of a long text is in which language; the pieces' outputs are averaged.
    """
    parts, owner = [], []
    for i, text in enumerate(texts):
        text = text or ""
        step = -(-max(len(text), 1) // max(1, round(len(text) / SEGMENT)))
        for a in range(0, max(len(text), 1), step):
            parts.append(text[a : a + step])
            owner.append(i)
    return parts, np.array(owner, dtype=np.int64)


def gram_set(text: str) -> np.ndarray:
    """The different n-grams of a whole text, as code points of lower-case letters, 21 bits each; 1 is an edge of a word."""
    text, found, tail = f" {text} ", [], np.empty(0, np.int64)
    for a in range(0, len(text), BATCH_CHARACTERS):
        flat, _ = code_points([text[a : a + BATCH_CHARACTERS]])
        code = np.concatenate([tail, np.maximum(letters(flat), 1).astype(np.int64)])
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != 1) | (code[:-1] != 1)
        code = code[keep]
        two = code[:-1] << 21 | code[1:]
        found.append(np.unique(np.concatenate([code, two, two[:-1] << 21 | code[2:]])))
        tail = code[-2:]
    return np.unique(np.concatenate(found))


def training_grams(texts: list[str]) -> list[list[bytes] | None]:
    """The n-grams of each whole training text and of its snippets, as bytes; None for a text without letters."""
    return [[gram_set(part).tobytes() for part in snippets(t)] if any(map(str.isalpha, t)) else None for t in texts]


def snippets(text: str) -> list[str]:
    """A training text and, so that short texts are met in training, one short run of its words."""
    words = text.split()
    return [text, " ".join(words[len(words) // 2 : len(words) // 2 + 6])] if len(words) > 12 else [text]


def fit_language(docs: DataFrame, keep: Column, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = 1e-2) -> LanguageModel:
    """Learn from text and language of about ``per_language`` documents of each language that ``keep`` admits."""
    usable = docs.where(keep & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = usable.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return LanguageModel([], np.empty(0, np.uint32), np.empty(0, np.int32), np.full(SPACE, -1, np.int32), np.empty((0, 0), np.float32), np.empty((0, 0), np.float32))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_language / r["count"]))])
    picked = usable.where(hashed_share(F.col("doc_id"), "language", F.element_at(share, F.col("lang"))))
    picked = picked.select("lang", "text", F.xxhash64("doc_id", F.lit("order")).alias("o"))
    grams = with_results(picked, lambda: lambda texts: [pa.array(training_grams(texts), pa.list_(pa.binary()))], "grams array<binary>").drop("text")
    rows = grams.where(F.col("grams").isNotNull()).collect()  # bounded by languages * per_language; the n-grams are those of whole texts
    rows = sorted(set((r["lang"], r["o"], tuple(map(bytes, r["grams"]))) for r in rows))
    sets, names = [], []
    chosen = []
    taken: dict[str, int] = {}
    for lang, _, parts in rows:
        if taken.get(lang, 0) < landmarks:
            taken[lang] = taken.get(lang, 0) + 1
            chosen.append(np.frombuffer(parts[0], np.int64))
        for part in parts:
            sets.append(np.frombuffer(part, np.int64))
            names.append(lang)
    languages = sorted(set(names))
    return _fit_sets(languages, sets, names, chosen, ridge)


def _fit(languages: list[str], texts: list[str], names: list[str], chosen: list[str], ridge: float) -> LanguageModel:
    return _fit_sets(languages, [gram_set(t) for t in texts], names, [gram_set(t) for t in chosen], ridge)


def _fit_sets(languages: list[str], sets: list[np.ndarray], names: list[str], chosen: list[np.ndarray], ridge: float) -> LanguageModel:
    """Fit on the ``gram_set`` of each training text and of each landmark."""
    every = np.concatenate([*chosen, np.empty(0, np.int64)])
    found, many = np.unique((every & POINT).astype(np.uint32), return_counts=True)  # letters by the n-grams that end in them
    many, found = many[found > 1], found[found > 1]
    frequent = np.sort(found[np.argsort(-many, kind="stable")][: ALPHABET - 3])
    model = LanguageModel(languages, frequent, np.arange(2, 2 + len(frequent), dtype=np.int32), np.full(SPACE, -1, np.int32), np.empty((0, 0), np.float32), np.empty((0, 0), np.float32))
    if not languages:
        return model
    owner, gram = model.grams_of_sets(chosen)
    kinds, place = np.unique(gram, return_inverse=True)
    ranked = np.searchsorted(kinds, OTHER)
    model.column[kinds[:ranked]] = np.arange(ranked, dtype=np.int32)
    model.others = kinds[ranked:].astype(np.int64)
    bits = np.zeros((len(kinds), len(chosen)), dtype=np.float32)
    bits[place, owner] = 1
    model.presence = bits / np.sqrt(np.maximum(bits.sum(axis=0), 1))
    values = np.concatenate([model.kernel_of(*model.grams_of_sets(sets[a : a + 256]), len(sets[a : a + 256])) for a in range(0, len(sets), 256)]).astype(float)
    among = (model.presence.T @ model.presence).astype(float)
    size, axes = np.linalg.eigh(among)
    root = axes[:, size > 1e-6] / np.sqrt(size[size > 1e-6])  # Nyström features are values @ root
    features = values @ root
    wanted = np.array([[float(n == lang) for lang in languages] for n in names])
    gram_matrix = features.T @ features + ridge * len(sets) * np.eye(features.shape[1]) / 10
    model.weights = (root @ np.linalg.solve(gram_matrix, features.T @ wanted)).astype(np.float32)
    return model


def _identifier(spark, model: LanguageModel):
    shared = spark.sparkContext.broadcast(model)  # sized by languages, landmarks and alphabet

    def make():
        fitted = shared.value

        def work(texts):
            names, scores = [], []
            for i, j in pieces(texts, BATCH_CHARACTERS):
                for a in range(i, j, 256):
                    some, score = fitted.predict(texts[a : min(a + 256, j)])
                    names += some
                    scores.append(score)
            return [pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.empty(0), pa.float64())]

        return work

    return make


def identify_language(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row, from its whole text alone."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return with_results(rows, _identifier(docs.sparkSession, model), "lang_pred string, score double").drop("text")


def accepted(docs: DataFrame, model: LanguageModel, least: float = 0.25) -> DataFrame:
    """The rows in a known language, by a score of at least ``least``, with all their columns."""
    found = beside_results(docs, _identifier(docs.sparkSession, model), "lang_pred string, score double")
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select("doc.*")
