"""Toxicity with a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel compares words by the letter subsequences of length four that they share; each occurrence may skip letters
inside a span of six and is damped by a factor for each letter skipped, so an insult with a letter put in keeps most
of its features. White space between single letters and any sign inside a word is dropped first, so spelled-out and
dotted insults become words again. A word's value is divided by the root of its own number of damped subsequences.

The instances of the machine are words, not sentences: a document is as toxic as its worst word, so an insult made of
everyday words alone is not found. Positive are words whose share of toxic documents is many times their share of clean
ones and that, or whose beginning, several unrelated toxic documents hold, as far as the machine itself upholds them in
a few rounds; all others are negative. Landmarks are words too. The machine is linear in the kernel values against the
landmarks, and the kernel is a product of finite feature rows, so the fitted expansion is folded once into one weight
for each subsequence (``expanded`` gives the unfolded value); scoring a text is then a sum of table look-ups.

Null and empty texts, and texts without words of two letters, have a score near 0. Repeated rows stay
and other columns are not read. Without labels of both kinds, the score is 0.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import code_points, labelled_sample, pieces, with_results
from tallyframe.llm.language import letters

SAMPLE = (4_000, 1_500)  # clean and toxic labelled documents, at most (about)
LANDMARKS = 192  # at first; each round adds the words that were judged wrong
NEGATIVES = 8_000  # clean words that the machine is fitted on, at most
BATCH_CHARACTERS = 100_000
LIMIT = 0x3000
DAMPING = 0.5
ALPHABET = 40  # codes: 0 none, 1 edge of a word, the rest letters by rank; every other letter has its code point beyond these
ORDER, SPAN = 4, 6
OTHER = 1 << 62  # features with a letter of no rank start here: 62 bits of a hash of the four codes
FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
POSITIVE_SHARE = 0.3
TOXIC_RATIO = 20.0  # an insult's share of toxic documents over its share of clean ones, with one clean document added, at least
NEAR_COPY = 0.8  # least Jaccard similarity of the word sets of near copies
MARKED_VARIANTS = 300
MARKED_PLACES = 3
# Places of the four letters of a subsequence after its first, and how many letters each skips.
PATTERNS = [(a, b, c) for a in range(1, SPAN) for b in range(a + 1, SPAN) for c in range(b + 1, SPAN)]


@dataclass
class ToxicityModel:
    alphabet: np.ndarray
    codes: np.ndarray
    table: np.ndarray | None  # weight of each subsequence of letters with a rank
    bias: float
    slope: float
    offset: float
    table_of_codes: np.ndarray | None = None
    others: np.ndarray | None = None  # features of the fit from OTHER on, ascending
    other_weights: np.ndarray | None = None

    def lookup(self) -> np.ndarray:
        """Code of each code point below the limit of ``letters``."""
        if self.table_of_codes is None:
            low = letters(np.arange(LIMIT, dtype=np.uint32))
            codes = np.where(low > 0, ALPHABET + low, 0).astype(np.int32)
            for letter, code in zip(self.alphabet.tolist(), self.codes.tolist(), strict=True):
                codes[low == letter] = code
            codes[[32, 10, 9, 13, 160]] = 1
            self.table_of_codes = codes
        return self.table_of_codes

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Letters and one edge (1) after each word; text of each word; places of the edges; source places of all."""
        flat, ends = code_points([f"{t or ''} " for t in texts])
        code = self.lookup()[np.minimum(flat, LIMIT - 1)]
        beyond = flat >= LIMIT
        if beyond.any():
            low = letters(flat[beyond])
            code[beyond] = np.where(low > 0, ALPHABET + low, 0)
        last = np.zeros(len(flat), bool)
        last[ends - 1] = True
        code[ends - 1] = 1
        source = np.flatnonzero(code)
        code, last = code[source], last[source]
        # One edge for a run of blanks.
        keep = np.ones(len(code), bool)
        keep[:-1] = (code[:-1] != 1) | (code[1:] != 1) | last[:-1]
        code, last, source = code[keep], last[keep], source[keep]
        # An edge between two words of one letter each goes: the letters are one word, spelled out.
        edges = np.flatnonzero(code == 1)
        size = np.diff(np.concatenate([[-1], edges])) - 1
        joins = (size[:-1] == 1) & (size[1:] == 1) & ~last[edges[:-1]]
        if joins.any():
            keep = np.ones(len(code), bool)
            keep[edges[:-1][joins]] = False
            code, last, source = code[keep], last[keep], source[keep]
            edges = np.flatnonzero(code == 1)
        closing = last[edges]
        return code, np.cumsum(closing) - closing, edges, source

    def subsequences(self, code: np.ndarray, edges: np.ndarray):
        """For each pattern and place: the word, whether the pattern fits into it, the feature, and the damping."""
        n = len(code)
        padded = np.concatenate([[1], code]).astype(np.int32)  # the first word has an edge before it too
        edge = padded == 1
        # The edge that ends a word has the word's number; as a first letter an edge opens the next word.
        home = np.cumsum(edge, dtype=np.int32) - 1
        wid = home - edge
        other = padded >= ALPHABET
        ranked = np.where(other, 0, padded) if other.any() else padded
        third, second, first = ranked * ALPHABET**3, ranked * ALPHABET**2, ranked * ALPHABET
        if ranked is not padded:
            p3, p2, p1, p0 = (padded.astype(np.uint64) * factor for factor in FACTORS)
        for a, b, c in PATTERNS:
            many = n + 1 - c
            if many > 0:
                # The last place may be the closing edge of the same word, whose own number is that word's.
                fits = wid[c:] == home[:many]
                feature = third[:many] + second[a : a + many] + first[b : b + many] + ranked[c:]
                if ranked is not padded:
                    hashed = (p3[:many] + p2[a : a + many] + p1[b : b + many] + p0[c:] >> np.uint64(2)).astype(np.int64)
                    feature = np.where(other[:many] | other[a : a + many] | other[b : b + many] | other[c:], OTHER + hashed, feature)
                yield home, fits, feature, DAMPING ** (c - ORDER + 1)

    def fold(self, kinds: np.ndarray, weights: np.ndarray) -> None:
        """Take over the weights of the ascending features ``kinds``; all others have none."""
        ranked = np.searchsorted(kinds, OTHER)
        self.table = np.zeros(ALPHABET**ORDER, dtype=np.float32)
        self.table[kinds[:ranked]] = weights[:ranked]
        self.others, self.other_weights = kinds[ranked:], weights[ranked:].astype(np.float32)

    def weights(self, feature: np.ndarray) -> np.ndarray:
        if feature.dtype != np.int64:
            return self.table[feature]
        other = feature >= OTHER
        found = self.table[np.where(other, 0, feature)]  # no feature is 0, so its weight is
        if self.others is not None and len(self.others):
            place = np.flatnonzero(other)
            at = np.minimum(np.searchsorted(self.others, feature[place]), len(self.others) - 1)
            found[place] = np.where(self.others[at] == feature[place], self.other_weights[at], 0)
        return found

    def word_values(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Value of each word, and the text that it is from."""
        code, text, edges, _ = self.words(texts)
        here, norms, home = np.zeros(len(code) + 1, np.float32), np.zeros(len(code) + 1, np.float32), None
        for home, fits, feature, damping in self.subsequences(code, edges):
            found = self.weights(feature)
            found *= fits
            here[: len(fits)] += found * np.float32(damping)
            norms[: len(fits)] += fits * np.float32(damping**2)
        if home is None:
            return np.full(len(edges), -1e3), text
        total, norm = (np.bincount(home, v, minlength=len(edges) + 1) for v in (here, norms))
        # A word too short for any subsequence says nothing.
        values = np.where(norm[:-1] > 0, total[:-1] / np.sqrt(np.maximum(norm[:-1], 1e-9)) + self.bias, -1e3)
        return values, text

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.table is None or not texts:
            return np.zeros(len(texts))
        values, owner = self.word_values(texts)
        worst = worst_values(values, owner)
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.offset, -30, 30)))


def worst_values(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Largest value of each text; every text has a word, if only an empty one."""
    return np.maximum.reduceat(values, np.flatnonzero(np.append(True, owner[1:] != owner[:-1])))


def feature_rows(model: ToxicityModel, words: list[str]):
    """Sparse normalised feature row of each word: (word, feature, value) with equal features added up."""
    code, _, edges, _ = model.words(words)
    at, feature, value, norm = [], [], [], np.zeros(len(edges) + 1)
    for home, fits, f, damping in model.subsequences(code, edges):
        place = np.flatnonzero(fits)
        word = home[place]
        at.append(word)
        feature.append(f[place])
        value.append(np.full(len(place), damping))
        norm += np.bincount(word, minlength=len(norm)) * damping**2
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    at, feature, value = np.concatenate(at), np.concatenate(feature).astype(np.int64), np.concatenate(value)
    return at, feature, value / np.sqrt(norm[at])


def expanded(model: ToxicityModel, landmarks: list[str], alpha: np.ndarray, words: list[str]) -> np.ndarray:
    """The machine's value of each word as a sum over landmarks, without the folded table."""
    kinds, rows = _columns(model, landmarks)
    return _kernel(model, words, kinds, rows) @ alpha + model.bias


def _columns(model: ToxicityModel, landmarks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    at, feature, value = feature_rows(model, landmarks)
    kinds, place = np.unique(feature, return_inverse=True)
    rows = np.zeros((len(kinds), len(landmarks)))
    np.add.at(rows, (place, at), value)
    return kinds, rows


def _kernel(model: ToxicityModel, words: list[str], kinds: np.ndarray, rows: np.ndarray, block: int = 128, root: np.ndarray | None = None) -> np.ndarray:
    """Kernel values of words against landmarks; with ``root``, their coordinates and a column of ones."""
    out = np.empty((len(words), rows.shape[1])) if root is None else np.ones((len(words), root.shape[1] + 1))
    for a in range(0, len(words), block):
        some = words[a : a + block]
        at, feature, value = feature_rows(model, some)
        place = np.minimum(np.searchsorted(kinds, feature), len(kinds) - 1)
        known = kinds[place] == feature
        dense = np.bincount(at[known] * len(kinds) + place[known], value[known], minlength=len(some) * len(kinds))
        values = dense.reshape(len(some), len(kinds)) @ rows
        if root is None:
            out[a : a + block] = values
        else:
            out[a : a + block, :-1] = values @ root
    return out


def _machine(x1: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 3e-4, steps: int = 30, block: int = 2_000) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps on the rows inside the margin.

    ``x1`` ends in a column of ones. Its rows are added up in blocks, so that no second copy of them is held.
    """
    ridge = np.append(np.full(x1.shape[1] - 1, penalty * weight.sum() / 100), 1e-9)
    w, inside = np.zeros(x1.shape[1]), None
    for _ in range(steps):
        now = y * (x1 @ w) < 1
        if inside is not None and (now == inside).all():
            break
        inside = now
        normal, right, places = np.diag(ridge), np.zeros(len(w)), np.flatnonzero(inside)
        for a in range(0, len(places), block):
            at = places[a : a + block]
            some = x1[at]
            rows = some * weight[at, None]
            normal = normal + rows.T @ some
            right += rows.T @ y[at]
        w = np.linalg.solve(normal, right)
    return w[:-1], float(w[-1])


def split_words(texts: list[str | None], model: ToxicityModel) -> list[list[str]]:
    """The words that the kernel sees, as strings of lower-case letters, for each text."""
    out: list[list[str]] = [[] for _ in texts]
    for a, b in pieces(texts, BATCH_CHARACTERS):
        some = [f"{t or ''} " for t in texts[a:b]]
        flat, _ = code_points(some)
        low = letters(flat)
        code, owner, edges, source = model.words(texts[a:b])
        chars = "".join(map(chr, np.where(code == 1, 32, low[source]).tolist()))
        start = 0
        for edge, text in zip(edges.tolist(), owner.tolist(), strict=True):
            if edge > start:
                out[a + text].append(chars[start:edge])
            start = edge + 1
    return out


def apart(words: list[list[str]], share: float = NEAR_COPY) -> list[int]:
    """Places of the word sets that are no near copy of one placed before: those with less than ``share`` of both's words in common.

    Exact: sets that agree by ``share`` have one of the first words in common, by rarity, of which a set can lack no more.
    """
    rarity = Counter(w for ws in words for w in ws)
    kept: dict[int, set[str]] = {}
    holders: dict[str, list[int]] = {}
    for i, ws in enumerate(words):
        own = set(ws)
        first = sorted(own, key=lambda w: (rarity[w], w))[: int(len(own) * (1 - share) + 1e-9) + 1]
        others = {k for w in first for k in holders.get(w, ())}
        if not own or any(len(own & kept[k]) >= share * len(own | kept[k]) - 1e-9 for k in others):
            continue
        kept[i] = own
        for w in first:
            holders.setdefault(w, []).append(i)
    return list(kept)


def fit_toxicity(docs: DataFrame, labels: DataFrame, keep: Column, limit: tuple[int, int] = SAMPLE) -> ToxicityModel:
    """Fit on at most about ``limit`` clean and toxic labelled documents among those that ``keep`` admits."""
    sample = labelled_sample(docs, labels, "toxic", keep, limit, "toxicity").select("label", "text")
    rows = with_results(sample, lambda: lambda texts: [pa.array(distinct_words(texts), pa.string())], "words string").drop("text").collect()  # bounded by limit; the words are those of whole texts
    return fit_words(sorted({(r["words"], int(r["label"])) for r in rows}))


def distinct_words(texts: list[str | None]) -> list[str]:
    """The different words of each whole text, in order, with a blank between; without words of one letter, which have no value."""
    blank = ToxicityModel(np.empty(0, np.uint32), np.empty(0, np.int32), None, 0.0, 1.0, 0.0)
    return [" ".join(sorted({w for w in ws if len(w) > 1})) for ws in split_words(texts, blank)]


def fit_texts(rows: list[tuple[str, int]], rounds: int = 3, landmarks: int = LANDMARKS) -> ToxicityModel:
    return fit_words(list(zip(distinct_words([t for t, _ in rows]), [v for _, v in rows], strict=True)), rounds, landmarks)


def fit_words(rows: list[tuple[str, int]], rounds: int = 3, landmarks: int = LANDMARKS) -> ToxicityModel:
    """Fit on the ``distinct_words`` and the label of each document."""
    texts, y = [t for t, _ in rows], np.array([v for _, v in rows])
    flat, _ = code_points(texts)
    found, many = np.unique(letters(flat), return_counts=True)
    many, found = many[found > 0], found[found > 0]
    frequent = np.sort(found[np.argsort(-many, kind="stable")][: ALPHABET - 3])
    model = ToxicityModel(frequent, np.arange(2, 2 + len(frequent), dtype=np.int32), None, 0.0, 1.0, 0.0)
    if not (y == 1).any() or not (y == 0).any():
        return model
    same: dict[str, str] = {}  # one string for each word
    words = [[same.setdefault(w, w) for w in t.split()] for t in texts]
    # A word counts once for all near copies of a document; the same holds for the beginnings of words.
    counts, starts, groups = [Counter(), Counter()], [Counter(), Counter()], [0, 0]
    for label in (0, 1):
        mine = [ws for ws, v in zip(words, y.tolist(), strict=True) if v == label]
        kept = apart(mine)
        groups[label] = len(kept)
        for i in kept:
            counts[label].update(mine[i])
            starts[label].update({w[:5] for w in mine[i]})
    clean, several = counts
    del words

    def telling(of: list[Counter], key: str, added: int = 1) -> bool:
        return of[1][key] * groups[0] >= TOXIC_RATIO * (of[0][key] + added) * groups[1]

    # A word tells by itself, or by its beginning if it is not itself a clean word.
    free = sorted(w for w in several if telling(counts, w) or (telling(counts, w, 0) and telling(starts, w[:5])))
    if not free:
        return model
    # Landmarks: words and beginnings that set toxic documents apart, words of toxic documents, and clean words.
    strength = {w: several[w] - 1 + starts[1][w[:5]] * telling(starts, w[:5]) for w in free}
    marked = sorted(free, key=lambda w: (-strength[w], w))
    everyday = sorted(set(clean).difference(marked))
    order = np.random.default_rng(5).permutation(len(everyday))
    negatives = [everyday[i] for i in order[:NEGATIVES]]
    rest = sorted(set(several).difference(clean, marked))
    unknown = marked[:NEGATIVES] + [rest[i] for i in np.random.default_rng(6).permutation(len(rest))[: NEGATIVES // 2]]
    # Marked words with one letter put in stand for insults written to escape notice.
    letters_seen = [chr(c) for c in frequent.tolist()]
    random = np.random.default_rng(7)
    bent = []
    for word in marked[:MARKED_VARIANTS]:
        for at in random.permutation(np.arange(1, len(word)))[:MARKED_PLACES].tolist():
            bent.append(word[:at] + letters_seen[int(random.integers(len(letters_seen)))] + word[at:])
    seen = np.array([several[w] + 1 for w in unknown])
    sign = np.where(np.arange(len(unknown)) < len(marked), 1.0, -1.0)
    chosen = marked[: landmarks // 2] + rest[:: max(1, len(rest) * 8 // landmarks)] + negatives[: landmarks // 4]
    for _ in range(rounds):
        chosen = list(dict.fromkeys(chosen))
        kinds, rows_of = _columns(model, chosen)
        among = _kernel(model, chosen, kinds, rows_of)
        size, axes = np.linalg.eigh((among + among.T) / 2)
        root = axes[:, size > 1e-6] / np.sqrt(size[size > 1e-6])
        x1 = _kernel(model, unknown + negatives + bent, kinds, rows_of, root=root)
        labels = np.concatenate([sign, -np.ones(len(negatives)), np.ones(len(bent))])
        weight = np.where(labels > 0, POSITIVE_SHARE * len(labels) / max((labels > 0).sum(), 1), 1.0)
        weight[: len(unknown)] *= np.where(sign > 0, np.sqrt(seen), 0.1)
        w, model.bias = _machine(x1, labels, weight)
        model.fold(kinds, rows_of @ (root @ w))
        values = x1[:, :-1] @ w + model.bias
        value, value_bent = values[: len(unknown)], values[len(values) - len(bent) :]
        del x1, rows_of
        sign = np.where((value > 0) & (sign > 0) & (np.arange(len(unknown)) < len(marked)), 1.0, -1.0)
        # Clean words that the machine takes for insults join the fit and the landmarks, as do insults that it misses, plain or with a letter put in.
        found = np.concatenate([np.empty(0), *(model.word_values([" ".join(everyday[a : a + 20_000])])[0] for a in range(0, len(everyday), 20_000))])
        hard = [everyday[i] for i in np.argsort(-found)[: NEGATIVES // 6]]
        negatives = list(dict.fromkeys(negatives + hard))  # a bounded sample and, by now, the hardest
        missed = [unknown[i] for i in np.flatnonzero(sign > 0)[np.argsort(value[sign > 0])][: landmarks // 4]]
        low = np.argsort(value_bent, kind="stable")[: landmarks // 2]
        chosen += hard[: landmarks // 3] + missed + [bent[i] for i in low.tolist()]
    # One logistic step turns the worst value of a document into a chance.
    worst = np.concatenate([worst_values(*model.word_values(texts[a:b])) for a, b in pieces(texts, BATCH_CHARACTERS)])
    model.slope, model.offset = _calibrated(worst[y == 0], worst[y == 1])
    return model


def _calibrated(clean: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve over a document's worst value.

    Even chances lie a third of the way from the highest clean documents to the lowest toxic ones, because insults in
    disguise have lower values than the plain ones that most labelled documents hold.
    """
    high, low = float(np.quantile(clean, 0.998)), float(np.quantile(toxic, 0.02))
    if low > high:
        middle = high + (low - high) / 3
    else:  # the kinds overlap: where the fewest are on the wrong side
        cuts = np.unique(np.concatenate([clean, toxic]))
        wrong = [(clean >= c).sum() + (toxic < c).sum() for c in cuts]
        middle = float(cuts[int(np.argmin(wrong))])
    slope = 4 / max(abs(low - high) / 3, 0.2)
    return slope, -slope * middle


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score) for every row, from its whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one weight for each subsequence

    def make():
        fitted = shared.value

        def work(texts):
            found = [fitted.score(texts[a:b]) for a, b in pieces(texts, BATCH_CHARACTERS)]
            return [pa.array(np.concatenate(found) if found else np.empty(0), pa.float64())]

        return work

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return with_results(rows, make, "score double").drop("text")
