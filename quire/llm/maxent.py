"""A hashed maximum-entropy language model with a class-factored softmax.

The CLASSES * PER_CLASS - 1 most frequent words and the end of a text form classes of equal size; all other
words fall into RARE classes by their last two bytes, in which a word has its smoothed count's share, so that
the model gives every word, seen or not, a probability. The class, and the word within a frequent class, are
softmaxes over hashed features: of the class the word before, the two words before together, and the word before
the last (a skip); of the word within its class the word before and, again, the word before the last. Each softmax has
a bias, of each class in the second, that starts at the logarithms of the counts and is trained like all other weights.

Training goes in ROUNDS. A round has its own share of the documents; its gradients are summed over all of them at the
same weights, and then one step is taken, a weight's gradient over the curvature that its feature has gathered
so far. So the weights depend on the documents alone, however they are dealt over tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np

CLASSES, PER_CLASS, RARE = 64, 64, 16
ALL = CLASSES + RARE
#: Hash rows of the class features and of the word features.
ROWS = 1 << 14
#: Contexts whose gradients are summed together, and tokens that are scored together, so few that a core's cache holds them.
BATCH, SCORED = 1 << 15, 1 << 12
#: Shares of the documents, in sixteenths, by round: steps are cheap while the weights are far off.
ROUNDS = (1, 1, 2, 4, 8)
#: Of a step: its length, what is added to the curvature, and the most that a weight moves.
RATE, CALM, MOST = 0.7, 2.0, 1.5
END = b"\n"
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def round_of(number: int) -> int:
    """The round of a document, by the crc32 of its id as text."""
    return int(np.searchsorted(np.cumsum(ROUNDS), (number >> 8) % sum(ROUNDS), side="right"))


def rare_class(word: bytes) -> int:
    return CLASSES + zlib.crc32(word[-2:]) % RARE


@cache
def _by_ending() -> np.ndarray:
    """rare_class of words by their last two bytes; a word of one byte counts from 65,536 on."""
    return np.array([rare_class(bytes([k >> 8, k & 255])) for k in range(65536)] + [rare_class(bytes([k])) for k in range(256)])


def rare_classes(words: list[bytes]) -> np.ndarray:
    """rare_class of each of many words, none empty."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    last = np.cumsum(sizes) - 1
    return _by_ending()[np.where(sizes > 1, data[last - (sizes > 1)] << 8 | data[last], 65536 + data[last])]


class Vocabulary:
    """words: the frequent ones with END among them, most frequent first; counts of them, and of the rare classes in all.

    rare_tokens and rare_types count what is not in words. total and types (N and V) give the base distribution.
    """

    def __init__(self, words: list[bytes], counts: list[int], rare_tokens: np.ndarray, rare_types: np.ndarray, total: int, types: int):
        self.place = {w: k for k, w in enumerate(words)}
        self.counts = np.array(counts, np.float64)
        self.total, self.types = total, types
        self.rare_tokens, self.rare_types = rare_tokens, rare_types

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.total + 0.5 * (self.types + 1)))

    def slots(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Class of each word, and its place in a frequent class or -1."""
        place = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        cls = np.where(place >= 0, place % CLASSES, rare_classes(words)) if words else place
        return cls, np.where(place >= 0, place // CLASSES, -1)


class Weights:
    """Two tables: features of the class (the last row is the bias), and of the word (the last CLASSES rows are biases)."""

    PARTS = ("classes", "words")

    def __init__(self, vocabulary: Vocabulary):
        n = len(vocabulary.counts)
        k = np.arange(n)
        within = np.full((CLASSES, PER_CLASS), -30.0)
        within[k % CLASSES, k // CLASSES] = np.log(vocabulary.counts + 0.5)
        within -= np.log(np.exp(within).sum(axis=1, keepdims=True))
        cls = np.full(ALL, 0.5)
        np.add.at(cls, k % CLASSES, vocabulary.counts)
        cls[CLASSES:] += vocabulary.rare_tokens
        cls /= cls.sum()
        self.classes = np.zeros((ROWS + 1, ALL), np.float32)
        self.words = np.zeros((ROWS + CLASSES, PER_CLASS), np.float32)
        self.classes[ROWS], self.words[ROWS:] = np.log(cls), within
        share = np.exp(within).mean(axis=0)
        #: variance of each outcome at the start, and how often each row was used
        self.spread = {"classes": cls * (1 - cls), "words": share * (1 - share)}
        self.used = {name: np.zeros(len(getattr(self, name))) for name in self.PARTS}

    def step(self, name: str, rows: np.ndarray, gradient: np.ndarray, used: np.ndarray) -> None:
        """One step of the given rows along their summed gradients (observed less expected)."""
        self.used[name][rows] += used
        curve = CALM + self.used[name][rows][:, None] * self.spread[name]
        getattr(self, name)[rows] += np.clip(RATE * gradient / curve, -MOST, MOST)


def contexts(hashes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word before and of the one before that; start marks the first token of each text."""
    before = np.concatenate([[np.uint64(1)], hashes[:-1]]) if len(hashes) else hashes
    before = np.where(start, np.uint64(1), before)
    earlier = np.concatenate([[np.uint64(2)], before[:-1]]) if len(hashes) else hashes
    return before, np.where(start, np.uint64(2), earlier)


def _row(x: np.ndarray) -> np.ndarray:
    return (x * _M[0] >> np.uint64(50)).astype(np.uint16)


def class_features(before: np.ndarray, earlier: np.ndarray) -> list[np.ndarray]:
    return [_row(before), _row(before * _M[1] ^ earlier * _M[2]), _row(earlier ^ _M[2])]


def word_features(cls: np.ndarray, before: np.ndarray, earlier: np.ndarray) -> list[np.ndarray]:
    salt = (cls + 3).astype(np.uint64) * _M[1]
    return [_row(before ^ salt), _row(earlier * _M[2] ^ salt)]


def _logits(table: np.ndarray, bias: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    """A start at logarithms of shares and at most MOST a round for each of a few features: far from where exp leaves single precision."""
    z = table[features[0]]
    z += bias
    for f in features[1:]:
        z += table[f]
    return z


def _totals(z: np.ndarray) -> np.ndarray:
    """The sum of each row."""
    return np.einsum("ij->i", z)


def _ranked(key: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct ones."""
    order = np.argsort(key)
    new = np.concatenate([[False], key[order[1:]] != key[order[:-1]]]) if len(key) else order
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _grouped(rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of the tokens of BATCH distinct keys at a time: one token of each key, all tokens, the number of each one's key here, and how many a key has."""
    sizes = np.bincount(rank)
    order, ends = np.argsort(rank), np.concatenate([[0], np.cumsum(sizes)])
    for at in range(0, len(sizes), BATCH):
        size = sizes[at : at + BATCH]
        members = order[ends[at] : ends[at + len(size)]]
        yield order[ends[at : at + len(size)]], members, np.repeat(np.arange(len(size)), size), size


def _by_context(before: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """The rank of the two words before each token; their hashes have 32 bits. A softmax is the same for all tokens of a rank."""
    return _ranked(before << np.uint64(32) | earlier)


def log_probability(w: Weights, v: Vocabulary, cls: np.ndarray, place: np.ndarray, count: np.ndarray, before: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """log10 of each token's probability."""
    out = np.empty(len(cls))
    for at in range(0, len(cls), SCORED):
        s = slice(at, at + SCORED)
        z = _logits(w.classes, w.classes[ROWS], class_features(before[s], earlier[s]))
        own = z[np.arange(len(z)), cls[s]]
        out[s] = own - np.log(_totals(np.exp(z, out=z)))
        often = at + np.flatnonzero(place[s] >= 0)
        if len(often):
            c = cls[often]
            z = _logits(w.words, w.words[ROWS + c], word_features(c, before[often], earlier[often]))
            own = z[np.arange(len(z)), place[often]]
            out[often] += own - np.log(_totals(np.exp(z, out=z)))
    rare = place < 0
    r = cls[rare] - CLASSES
    out[rare] += np.log((count[rare] + 0.5) / (v.rare_tokens[r] + 0.5 * (v.rare_types[r] + 1)))
    return out / np.log(10)


class Sums:
    """Gradients (observed less expected) at fixed weights, summed by row, and how many tokens used each row."""

    def __init__(self, w: Weights):
        self.w = w
        self.gradient = {name: np.zeros_like(getattr(w, name)) for name in w.PARTS}
        self.used = {name: np.zeros(len(getattr(w, name))) for name in w.PARTS}
        self.tokens = 0

    def _scatter(self, name: str, features: list[np.ndarray], g: np.ndarray, size: np.ndarray) -> None:
        """Adds g to the rows of each of the features, a column at a time, which is far faster than row by row; size is how many tokens each row of g stands for."""
        many = len(self.used[name])
        used = sum(np.bincount(f, size, many) for f in features)
        rows = np.flatnonzero(used)
        place = np.empty(many, np.int64)
        place[rows] = np.arange(len(rows))
        at = [place[f] for f in features]
        out = np.empty((g.shape[1], len(rows)))
        for k, column in enumerate(np.ascontiguousarray(g.T, np.float64)):
            out[k] = np.bincount(at[0], column, len(rows))
            for x in at[1:]:
                out[k] += np.bincount(x, column, len(rows))
        self.gradient[name][rows] += out.T
        self.used[name][rows] += used[rows]

    def add(self, cls: np.ndarray, place: np.ndarray, before: np.ndarray, earlier: np.ndarray) -> None:
        w = self.w
        rank = _by_context(before, earlier)
        for first, members, of, size in _grouped(rank):
            features = class_features(before[first], earlier[first])
            g = self._residual(_logits(w.classes, w.classes[ROWS], features), of, size, cls[members])
            self._scatter("classes", features, g, size)
            self.gradient["classes"][ROWS] += g.sum(axis=0)
            self.used["classes"][ROWS] += len(members)
        often = np.flatnonzero(place >= 0)
        for one, all_, of, size in _grouped(_ranked(rank[often] * CLASSES + cls[often])):
            first = often[one]
            c = cls[first]
            features = word_features(c, before[first], earlier[first])
            g = self._residual(_logits(w.words, w.words[ROWS + c], features), of, size, place[often[all_]])
            self._scatter("words", [*features, ROWS + c], g, size)
        self.tokens += len(cls)

    @staticmethod
    def _residual(z: np.ndarray, of: np.ndarray, size: np.ndarray, outcome: np.ndarray) -> np.ndarray:
        """Of each distinct context the outcomes observed less those expected of as many tokens."""
        np.exp(z, out=z)
        z *= (-size / _totals(z))[:, None].astype(z.dtype)
        np.add.at(z.reshape(-1), of * z.shape[1] + outcome, z.dtype.type(1))
        return z


def rows_of(sums: Sums, chunk: int = 1024) -> Iterator[tuple[str, int, bytes, bytes]]:
    """(table, chunk, means, uses): of the rows in each chunk the gradient for each use, in half precision, and the uses."""
    for name, g in sums.gradient.items():
        for at in range(0, len(g), chunk):
            used = sums.used[name][at : at + chunk]
            if used.any():
                yield name, at, (g[at : at + chunk] / np.maximum(used, 1)[:, None]).astype("<f2").tobytes(), used.astype("<f4").tobytes()


def joined(parts: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Summed gradients and uses of the same chunk from several tasks."""
    used = [np.frombuffer(u, "<f4").astype(np.float64) for _, u in parts]
    total = sum(np.frombuffer(x, "<f2").reshape(len(u), -1) * u[:, None] for (x, _), u in zip(parts, used, strict=True))
    return total, sum(used)
