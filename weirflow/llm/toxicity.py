"""Toxicity: a support vector machine on a gapped subsequence string kernel, with Nyström landmarks.

The kernel of two words counts the letter triples they have in common as subsequences,
each weighted by ``DECAY`` to the power of the stretch it spans in either word, and is
normalised to 1 for equal words; its ``POWER``, a kernel again, is used. Letters put in between
("idxiot", "stuxpid") widen the stretch and only lower the value. It is worked out for every word and every
landmark, by the triples that landmarks have, in any script.

A text is a bag of words. Words that tell the classes apart in the labelled texts are toxic as far as
those texts are; words that do not are clean. Landmarks are parts of the texts: telling words, the clean words nearest to them, and clean words
at large. The kernel values of a word with them, multiplied by the inverse square root of the
landmarks' own kernel matrix (Nyström), are the features of a linear machine with squared hinge loss.
It learns telling words with letters put in between as well. A text's probability comes from the greatest
margin of its words, the sum of the positive ones and the number of words, by a logistic fit over labelled texts,
their sentences, and copies of these with letters put into telling words.

A word is read by its letters ("m-o-ron" and "i_di_ot" are words; so are their runs of letters); words longer than ``WINDOW`` letters are
read by overlapping windows, words with endings by their heads of ``HEADS`` letters as well
(with landmarks no longer than the head, so a stem counts in full under any ending), and single letters in a row ("i d i o t") as
one word as well, so whole texts are scored.

The machine is fitted in one task on at most ``SAMPLE`` labelled rows and ``SAMPLE_BYTES`` bytes of text (the rows with the
lowest hash of their id, documented bounds; longer texts are passed over there). The fitted model has a fixed size, whatever the
input's, and is sent with the task. Scores depend on the text alone.

Defined cases: a null text is empty, and an empty text gets the score of no evidence;
null labels and labels of missing documents are left out of the fit; without labels of both classes, or without
words that tell them apart, every score is the share of toxic labels (0.0 without labels); repeated rows
score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import random
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.common import take_over, trim, uncollected, whole
from weirflow.plans.runtime import ship

#: Labelled rows and bytes of their texts in the fit, at most.
SAMPLE, SAMPLE_BYTES = 5000, 8 << 20
#: Telling landmarks, at most, and how many words that may stand out by chance are taken where almost none is sure.
LANDMARKS, FEW_LANDMARKS = 64, 12
#: Landmarks among clean words: those nearest to the telling ones, and others.
NEAR_CLEAN, OTHER_CLEAN = 32, 16
#: Weight of a letter's stretch in the kernel, the letters of a subsequence, and the kernel's power.
DECAY, LETTERS, POWER = 0.9, 3, 4
#: Letters of a word compared at once.
WINDOW = 16
#: Lengths of the heads of words that are compared as well, and may be landmarks.
HEADS = (4, 5, 6, 7, 8)
#: Least share of toxic texts among a telling word's texts.
LEAST_SHARE = 0.4
#: Words this near to a landmark already chosen are passed over.
NEAR_REPEAT = 0.8
#: Clean words in the fit, copies of each telling word with a letter put in, and texts of a class in the logistic fit.
CLEAN_WORDS, COPIES, CALIBRATE = 30_000, 12, 500
#: Words whose margins are remembered in a worker, by generation.
REMEMBERED = 200_000
#: Pairs of words in one vectorised step, and cells of a table of triples.
PAIRS, CELLS = 40_000, 4 << 20


def codes(words: Sequence[str], width: int = WINDOW) -> np.ndarray:
    """Code points of words of at most ``width`` letters, padded with 0."""
    joined = np.zeros((len(words), width), np.int32)
    for i, w in enumerate(words):
        joined[i, : len(w)] = np.frombuffer(w.encode("utf-32-le"), np.int32)
    return joined


def raw_kernel(a: np.ndarray, b: np.ndarray, decay: float = DECAY, n: int = LETTERS) -> np.ndarray:
    """The subsequence kernel of each row pair of two padded code matrices."""
    pairs, la = a.shape
    lb = b.shape[1]
    # reach[i, j]: weight of going from column i to j; a matrix product runs the recursion along b.
    gap = np.arange(lb)
    reach = np.where(gap[None, :] > gap[:, None], decay ** np.maximum(gap[None, :] - gap[:, None] - 1, 0), 0).astype(np.float32)
    # inner[m]: sum over pairs of m-letter prefixes that end before this column of b, aged to here and to the letter of a.
    inner = [np.ones((pairs, lb), np.float32)] + [np.zeros((pairs, lb), np.float32) for _ in range(n - 1)]
    total = np.zeros(pairs, np.float32)
    square = np.float32(decay * decay)
    for i in range(la):
        letter = a[:, i]
        same = (b == letter[:, None]) & (letter != 0)[:, None]
        if not same.any():
            for m in range(1, n):
                inner[m] *= decay
            continue
        total += (square * inner[n - 1] * same).sum(1)
        for m in range(n - 1, 0, -1):
            inner[m] = decay * inner[m] + (square * inner[m - 1] * same) @ reach
    return total


def own_kernel(a: np.ndarray) -> np.ndarray:
    return np.concatenate([raw_kernel(a[i : i + PAIRS], a[i : i + PAIRS]) for i in range(0, len(a), PAIRS)] or [np.zeros(0, np.float32)])


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised kernel of row pairs; 0 where a word is too short to have a subsequence."""
    own = np.sqrt(own_kernel(a) * own_kernel(b))
    return np.divide(raw_kernel(a, b), own, out=np.zeros(len(a), np.float32), where=own > 0)


_STRIP = " .,;:!?\"'()[]{}<>|*_~`´“”‘’«»¡¿…-–—/\\#&%$@+="
_SPELLED = re.compile(r"(?<!\S)(?:[^\W\d_][\s.\-_*]+){2,}[^\W\d_](?![^\s.,;:!?])")
_RUNS = re.compile(r"[^\W\d_]+")


def spread_words(text: str) -> list[str]:
    """Words spelled out letter by letter, put together."""
    return ["".join(c for c in m if c.isalpha()) for m in _SPELLED.findall(text)]


def tokens(text: str) -> set[str]:
    """The different tokens of a text, without marks at their edges."""
    low = text.lower()
    found = {t if t.isalpha() else t.strip(_STRIP) for t in set(low.split())}
    if len(low) > 4 and _SPELLED.search(low):
        found.update(spread_words(low))
    return found


def windows(word: str) -> list[str]:
    """The word, or overlapping parts of at most ``WINDOW`` letters that cover it."""
    if len(word) <= WINDOW:
        return [word]
    return [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def parts(token: str) -> list[tuple[str, bool]]:
    """What is compared of a token: (letters, whether they are the head of a longer word)."""
    if token.isalpha():
        n = len(token)
        if n <= WINDOW:
            return [(token, False), *((token[:k], True) for k in HEADS if k < n)] if n >= LETTERS else []
        words = [token]
    else:
        words = _RUNS.findall(token)
        if len(words) > 1:
            words.append("".join(words))
    out = [(p, False) for w in words for p in windows(w) if len(p) >= LETTERS]
    return out + [(w[:n], True) for w in words for n in HEADS if len(w) > n]


@dataclass
class Landmarks:
    """Landmark words and the triples they have, with their normalised weights."""

    words: list[str]
    alphabet: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.alphabet = np.array(sorted({ord(c) for w in self.words for c in w}), np.int64)  # a letter is its place here, from 1
        base = len(self.alphabet) + 1
        table: dict[int, np.ndarray] = {}
        own = own_kernel(codes(self.words))
        for z, w in enumerate(self.words):
            at = [int(np.searchsorted(self.alphabet, ord(c))) + 1 for c in w]
            for i, j, k in combinations(range(len(w)), 3):
                row = table.setdefault((at[i] * base + at[j]) * base + at[k], np.zeros(len(self.words)))
                row[z] += DECAY ** (k - i + 1) / np.sqrt(own[z])
        self.triples = np.array(sorted(table), np.int64)
        weights = np.array([table[t] for t in self.triples.tolist()]).reshape(len(table), len(self.words))
        has, self.landmark = np.nonzero(weights)  # the landmarks of each triple, end to end
        self.weights = weights[has, self.landmark]
        self.starts = np.searchsorted(has, np.arange(len(table) + 1))
        self.direct = None
        if 0 < base**3 <= CELLS:  # a table of all triples, unless letters are too many
            self.direct = np.full(base**3, -1, np.int32)
            self.direct[self.triples] = np.arange(len(self.triples))

    def near(self, found: Sequence[tuple[str, bool]]) -> np.ndarray:
        """Kernel values of parts with all landmarks; those of heads with longer landmarks are 0."""
        out = np.zeros((len(found), len(self.words)), np.float32)
        length = np.array([len(p) for p, _ in found])
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            i, j, k = np.array(list(combinations(range(n), 3))).T
            weight = (DECAY ** (k - i + 1)).astype(np.float32)
            step = max(1, CELLS // 4 // len(i))
            for s in range(0, len(at), step):
                some = at[s : s + step]
                rows, values = self._dots([found[x][0] for x in some.tolist()], (i, j, k), weight)
                out[some[rows]] = values
        head = np.array([h for _, h in found])
        out[head[:, None] & (self.size[None, :] > length[:, None])] = 0
        np.square(out, out=out)
        return np.square(out, out=out) if POWER == 4 else out ** (POWER / 2)

    def _dots(self, words: list[str], triple: tuple, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that share a triple with a landmark, and their kernel values."""
        n, base = len(words[0]), len(self.alphabet) + 1
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, n).astype(np.int64)
        letters = np.minimum(np.searchsorted(self.alphabet, code), len(self.alphabet) - 1)
        letters = np.where(self.alphabet[letters] == code, letters + 1, 0)
        i, j, k = triple
        wanted = (letters[:, i] * base + letters[:, j]) * base + letters[:, k]
        if self.direct is not None:
            place = self.direct[wanted]
            row, col = np.nonzero(place >= 0)
        else:
            place = np.minimum(np.searchsorted(self.triples, wanted), len(self.triples) - 1)
            row, col = np.nonzero(self.triples[place] == wanted)
        if not len(row):
            return row, np.zeros((0, len(self.words)), np.float32)
        hit = place[row, col]
        rows, at = np.unique(row, return_inverse=True)
        many = self.starts[hit + 1] - self.starts[hit]
        entry = np.arange(many.sum()) + np.repeat(self.starts[hit] - (np.cumsum(many) - many), many)
        cell = np.repeat(at * len(self.words), many) + self.landmark[entry]
        dots = np.bincount(cell, weights=np.repeat(weight[col], many) * self.weights[entry], minlength=len(rows) * len(self.words)).reshape(len(rows), -1)
        own = own_kernel(code[rows].astype(np.int32))
        return rows, (dots / np.sqrt(own)[:, None]).astype(np.float32)


@dataclass
class Model:
    """``weight`` holds each landmark's share in a word's margin, ``bias`` the margin of no evidence, ``bag`` what the features of a text count for."""

    landmarks: list[str]
    weight: np.ndarray
    bias: float
    bag: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        return _sigmoid(np.column_stack([features, np.ones(len(features))]) @ self.bag)

    @classmethod
    def constant(cls, share: float) -> Model:
        share = float(np.clip(share, 1e-6, 1 - 1e-6))
        return cls([], np.zeros(0), 0.0, np.array([0.0, 0.0, 0.0, np.log(share / (1 - share))]))


class Margins:
    """Margins of texts, with those of words and their parts remembered."""

    def __init__(self, landmarks: Landmarks, weight: np.ndarray, bias: float, remembered: int = REMEMBERED) -> None:
        self.landmarks, self.weight, self.bias, self.remembered = landmarks, weight, bias, remembered
        self.new: dict[str, float] = {}
        self.old: dict[str, float] = {}
        self.parts: dict[tuple[str, bool], float] = {}

    @classmethod
    def of(cls, model: Model) -> Margins:
        return cls(Landmarks(model.landmarks), model.weight, model.bias)

    def of_parts(self, found: Sequence[tuple[str, bool]]) -> np.ndarray:
        if not found or not self.landmarks.words:
            return np.full(len(found), self.bias)
        return np.concatenate([self.landmarks.near(found[s : s + 20_000]) @ self.weight + self.bias for s in range(0, len(found), 20_000)])

    def of_tokens(self, wanted: set[str]) -> dict[str, float]:
        """A table with the margins of these tokens, the greatest of their parts'; it holds until the next call."""
        new, old = self.new, self.old
        if len(new) > self.remembered:
            self.old, self.new = new, {}
            new, old = self.new, self.old
        if len(self.parts) > self.remembered:
            self.parts = {}
        for t in self.transient:
            old.pop(t, None)
            new.pop(t, None)
        bare = []
        for t in wanted:
            if t not in new:
                v = old.get(t)
                if v is None:
                    bare.append(t)
                else:
                    new[t] = v
        index: dict[tuple[str, bool], int] = {}
        place: list[int] = []
        starts: list[int] = []
        words: list[str] = []
        for w in bare:
            own = parts(w)
            if not own:
                new[w] = self.bias
                continue
            words.append(w)
            starts.append(len(place))
            for p in own:
                place.append(index.setdefault(p, len(index)))
        if words:
            every = list(index)
            values = np.array([self.parts.get(p, np.nan) for p in every])
            fresh = np.flatnonzero(np.isnan(values))
            values[fresh] = self.of_parts([every[i] for i in fresh.tolist()])
            self.parts.update((every[i], values[i]) for i in fresh.tolist() if len(every[i][0]) < WINDOW)
            new.update(zip(words, np.maximum.reduceat(values[place], starts).tolist(), strict=True))
        self.transient = [t for t in words if len(t) > 3 * WINDOW]
        return new

    transient: Sequence[str] = ()

    def of_bags(self, bags: Sequence[set[str]]) -> np.ndarray:
        """For each bag of tokens: the greatest margin, the sum of the positive ones and, if there are any, the number of tokens, on a log scale."""
        known = self.of_tokens(set().union(*bags))
        out = np.zeros((len(bags), 3))
        for k, bag in enumerate(bags):
            own = [known[t] for t in bag]
            worst = max(own, default=self.bias)
            out[k] = (worst, np.log1p(sum(v for v in own if v > 0)), np.log1p(len(own))) if worst > 0 else (worst, 0.0, 0.0)
        return out

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        return self.of_bags([tokens(t) for t in texts])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _contexts(texts: Sequence[str], wanted: set[str]) -> Counter:
    """Between how many different neighbours parts stand."""
    found: dict[str, set] = {w: set() for w in wanted}
    for text in texts:
        row = text.lower().split()
        for k, t in enumerate(row):
            for p, _ in parts(t):
                if p in found:
                    found[p].add((*row[max(0, k - 1) : k], None, *row[k + 1 : k + 2]))
    return Counter({w: len(c) for w, c in found.items()})


def telling_parts(texts: Sequence[str], toxic: np.ndarray, rng: random.Random) -> tuple[dict[str, tuple[int, int]], list[str]]:
    """Parts that tell the classes apart, most telling first, with how many toxic and clean texts have them; and some parts that are no more toxic than any.

    Copies of a text are no further evidence: a part counts for no more texts than it has different neighbours.
    """
    number: dict[str, int] = {}  # of each part
    known: dict[str, np.ndarray] = {}  # the parts of each token
    seen, bad = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
    for t, y in zip(texts, toxic, strict=True):
        lists = []
        for w in tokens(t):
            own = known.get(w)
            if own is None:
                own = known[w] = np.array([number.setdefault(p, len(number)) for p, _ in parts(w)], np.int32)
            lists.append(own)
        while len(number) > len(seen):
            seen, bad = np.append(seen, np.zeros_like(seen)), np.append(bad, np.zeros_like(bad))
        own = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int32)
        seen[own] += 1
        if y:
            bad[own] += 1
    del known
    seen, bad = seen[: len(number)].astype(float), bad[: len(number)].astype(float)
    share = float(np.clip(toxic.mean(), 1e-9, 1 - 1e-9))
    # How unlikely so large a share of toxic texts is for a part of no account, in nats.
    p = bad / np.maximum(seen, 1)
    value = seen * (p * np.log(np.maximum(p, 1e-12) / share) + (1 - p) * np.log(np.maximum(1 - p, 1e-12) / (1 - share)))
    sure = 1.2 * np.log(max(1, len(number)))  # as many parts are tried, some stand out by chance
    names = list(number)
    likely = np.flatnonzero((bad >= 2) & (bad > seen * max(LEAST_SHARE, share)))
    ranked = sorted(((value[i], names[i], i) for i in likely.tolist()), key=lambda x: (-x[0], -len(x[1]), x[1]))
    ranked = [x for x in ranked if x[0] >= sure] or ranked[:FEW_LANDMARKS]
    places = _contexts([t for t, y in zip(texts, toxic, strict=True) if y], {w for _, w, _ in ranked})
    chosen = [(w, i) for v, w, i in ranked if v * min(1.0, (places[w] or bad[i]) / bad[i]) >= sure]
    if len(chosen) < 3:  # too few labels to be sure of any
        chosen = [(w, i) for _, w, i in ranked[:FEW_LANDMARKS]]
    found = {w: (int(bad[i]), int(seen[i] - bad[i])) for w, i in chosen}
    # Of a word and its head, the head stays if it is found in more toxic texts (a stem), else the word.
    for w in sorted(found, key=len, reverse=True):
        for n in HEADS:
            if n < len(w) and w in found and w[:n] in found:
                del found[w if found[w[:n]][0] > 1.05 * found[w][0] else w[:n]]
    clean = np.flatnonzero(bad <= seen * share).tolist()
    some = (names[i] for i in rng.sample(clean, min(2 * CLEAN_WORDS, len(clean))))
    return found, [w for w in some if not any(w == x[: len(w)] for x in found)][:CLEAN_WORDS]


def _apart(telling: Sequence[str], most: int) -> list[str]:
    """Telling words without those nearly equal to one before."""
    chosen: list[str] = []
    for w in telling[: 20 * most]:
        if chosen and kernel(codes([w] * len(chosen)), codes(chosen)).max() > NEAR_REPEAT:
            continue
        chosen.append(w)
        if len(chosen) == most:
            break
    return chosen


def with_letter(word: str, rng: random.Random, letters: str) -> str:
    """The word with one letter put in between."""
    at = rng.randrange(1, len(word))
    return word[:at] + rng.choice(letters) + word[at:]


def _machine(x: np.ndarray, sign: np.ndarray, cost: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Newton steps on the squared hinge."""
    xa = np.column_stack([x, np.ones(len(x))])
    ridge = penalty * np.append(np.ones(x.shape[1]), 1e-3)
    w = np.zeros(xa.shape[1])
    for _ in range(50):
        f = xa @ w
        c = cost * (sign * f < 1)
        step = np.linalg.solve((xa * c[:, None]).T @ xa + np.diag(ridge), xa.T @ (c * (f - sign)) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights of the features, and of 1, in the log odds; margins never count against a text."""
    xa = np.column_stack([x, np.ones(len(x))])
    for _ in range(3):
        w = _newton(xa, y, cost)
        against = np.flatnonzero(w[:2] < 0)
        if not len(against):
            break
        xa[:, against] = 0
    return w


def _newton(xa: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    goal = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    w = np.zeros(xa.shape[1])
    for _ in range(200):
        p = _sigmoid(xa @ w)
        step = np.linalg.solve((xa * (cost * (p * (1 - p) + 1e-9))[:, None]).T @ xa + 1e-3 * np.eye(len(w)), xa.T @ (cost * (p - goal)) + 1e-3 * w)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sentences(text: str) -> list[set[str]]:
    return [tokens(t) for t in re.split(r"[.!?\n]+", text) if t.strip()]


def fit(texts: Sequence[str], toxic: Sequence[int], most: int = LANDMARKS, penalty: float = 1e-4) -> Model:
    """The machine for labelled texts."""
    y = np.asarray(toxic, bool)
    rng = random.Random(5)
    telling, clean = telling_parts(texts, y, rng) if len(y) and y.any() and not y.all() else ({}, [])
    if not telling or not clean:
        return Model.constant(y.mean() if len(y) else 0.0)
    stems = _apart(list(telling), most)
    nearest = np.concatenate([Landmarks(stems).near([(w, False) for w in clean[s : s + 5000]]).max(1) for s in range(0, len(clean), 5000)])
    hard = [clean[i] for i in np.argsort(-nearest, kind="stable")]
    landmarks = Landmarks(stems + hard[:NEAR_CLEAN] + [w for w in clean[:OTHER_CLEAN] if w not in hard[:NEAR_CLEAN]])
    gram = landmarks.near([(w, False) for w in landmarks.words]).astype(float)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > 1e-3
    project = vectors[:, keep] / np.sqrt(values[keep]) @ vectors[:, keep].T
    letters = "".join(sorted({c for w in clean[:2000] for c in w}))
    known = list(telling)[: 20 * most]
    spoiled = [w for w in stems for _ in range(COPIES)]
    good = list(dict.fromkeys(hard[:4000] + clean[:4000]))
    # A telling word is toxic and clean as its texts are; with a letter put in, as the word is.
    sure = np.array([(telling[w][0], telling[w][1]) for w in known + spoiled], float)
    sure /= sure.sum(1, keepdims=True)
    near = landmarks.near([(w, False) for w in known + [with_letter(w, rng, letters) for w in spoiled] + good]) @ project
    x = np.concatenate([near, near[: len(sure)]])
    sign = np.repeat([1.0, -1.0, -1.0], [len(sure), len(good), len(sure)])
    cost = np.concatenate([sure[:, 0] / len(sure), np.full(len(good), 1 / len(good)), sure[:, 1] / len(sure)]) / 2
    w, bias = _machine(x, sign, cost, penalty)
    margins = Margins(landmarks, (project @ w).astype(np.float32), bias)
    bags, marks, weight = [], [], []
    for c in (True, False):
        of = np.flatnonzero(y == c)[:CALIBRATE].tolist()
        for i in of:
            bag = tokens(texts[i])
            own = [bag]
            parts_of = _sentences(texts[i])
            if not c:
                own += rng.sample(parts_of, min(2, len(parts_of)))
            else:
                known = margins.of_tokens(bag)
                value = {t: known[t] for t in bag}
                worst = max(value, key=lambda t: (value[t], t), default="")
                if value and value[worst] > 0:
                    own += [next((s for s in parts_of if worst in s), {worst})]
                    own += [{with_letter(t, rng, letters) if value.get(t, 0) > 0 and len(t) > 2 else t for t in b} for b in own]
            bags += own
            marks += [c] * len(own)
            weight += [(y.mean() if c else 1 - y.mean()) / len(of) / len(own)] * len(own)
    features = np.concatenate([margins.of_bags(bags[s : s + 256]) for s in range(0, len(bags), 256)])
    return Model(landmarks.words, margins.weight, bias, _logistic(features, np.array(marks), np.array(weight) * len(bags) / sum(weight)))


def fold(doc_id: Column) -> Column:
    """Remainder of the checksum of the id's text; 0 marks held-out rows."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = LANDMARKS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits on labelled documents outside the held-out fold."""
    used = labels.where((fold(F.col("doc_id")) != 0) & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = used.orderBy(F.xxhash64("doc_id", "toxic"), "doc_id", "toxic").limit(sample)
    few = docs.select("doc_id", whole(F.col("text")).alias("text")).join(F.broadcast(chosen), "doc_id")
    held = few.select("doc_id", "toxic", F.xxhash64("doc_id", "text").alias("h"), F.octet_length("text").alias("n")).orderBy("h", "doc_id", "toxic").limit(sample)
    size = Window.orderBy("h", "doc_id", "toxic")  # over the sample's rows at most
    fits = held.where(F.col("n") <= sample_bytes // 16).withColumn("held", F.sum("n").over(size)).where(F.col("held") <= sample_bytes).select("doc_id", "toxic", "h").distinct()
    rows = few.withColumn("h", F.xxhash64("doc_id", "text")).join(F.broadcast(fits), ["doc_id", "toxic", "h"]).dropDuplicates(["doc_id", "toxic", "h"]).select("text", "toxic", "h", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["h"], r["doc_id"], r["toxic"]))
        model = fit([r["text"] for r in found], [r["toxic"] for r in found], most)
        del found
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    ship(docs.sparkSession)
    got = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else Model.constant(0.0)


_MARGINS: dict[tuple, Margins] = {}


def margins_for(model: Model) -> Margins:
    """Landmark tables and remembered words, kept between tasks of a worker."""
    key = (*model.landmarks, model.bias, model.weight.tobytes())
    if key not in _MARGINS:
        _MARGINS.clear()
        _MARGINS[key] = Margins.of(model)
    return _MARGINS[key]


def with_scores(docs: DataFrame, model: Model, to: str = "score") -> DataFrame:
    """Adds the score of column ``text``, replacing a column of that name."""
    ship(docs.sparkSession)
    kept = docs.drop(to)
    schema = kept.select("*", F.lit(0.0).alias(to)).schema
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("toxicity", _MARGINS.clear)
        margins = margins_for(model)
        for batch in batches:
            texts = batch.column(at)
            scores = np.zeros(batch.num_rows)
            for s in range(0, batch.num_rows, 512):
                part = [t or "" for t in texts.slice(s, 512).to_pylist()]
                with uncollected():
                    scores[s : s + len(part)] = model.scores(margins(part))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, to])

    return kept.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = with_scores(docs.select("doc_id", "text"), train(docs, labels, sample))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
