"""Hashed subword embeddings averaged into a linear softmax, trained by stochastic gradient descent in numpy.

A text's features are the character n-grams of its lower-cased words with their edges, hashed into a fixed number of
buckets. Its vector is the mean of the buckets' embeddings; a linear softmax on it gives the classes. Since both steps are
linear, embeddings and softmax weights are multiplied once after training: scoring adds up one row of class scores per n-gram.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _letters() -> np.ndarray:
    found = getattr(_letters, "table", None)
    if found is None:
        found = _letters.table = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return found


@dataclass
class Block:
    """Texts laid end to end as code points, a separator before each and one at the end. ``starts``: of each separator."""

    codes: np.ndarray
    letter: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Block:
        low = [t.lower() for t in texts]
        starts = np.zeros(len(low), np.int64)
        np.cumsum([len(t) + 1 for t in low[:-1]], out=starts[1:])
        flat = "\n" + "\n".join(low) + "\n"
        codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[codes]
        return cls(np.where(letter, codes, 0).astype(np.uint32), letter, starts)

    def grams(self, orders: tuple[int, ...], bits: int):
        """For each order, the bucket of the n-gram that begins at each position; 2 ** bits where none begins.

        An n-gram lies within a word, or holds the edge before or after it too."""
        out = np.empty(len(self.codes), np.int32)
        for n in orders:
            m = len(self.codes) - n + 1
            out[:] = 1 << bits
            if m > 0:
                h = self.codes[:m] * np.uint32(2654435761) + np.uint32(n)
                ok = self.letter[:m] | self.letter[1 : m + 1] if n == 2 else self.letter[1 : m + 1].copy()
                for k in range(1, n):
                    h = (h ^ h >> np.uint32(15)) * np.uint32(2246822519) + self.codes[k : k + m]
                    if 1 < k < n - 1:
                        ok &= self.letter[k : k + m]
                h = (h ^ h >> np.uint32(13)) * np.uint32(3266489917)
                out[:m] = np.where(ok, h >> np.uint32(32 - bits), 1 << bits)
            yield out

    def words(self) -> np.ndarray:
        """The position before the first letter of each word, in order."""
        return np.flatnonzero(self.letter[1:] & ~self.letter[:-1])


#: Positions whose class scores are held at a time.
STRETCH = 1 << 16
#: Length of what one training step adds to an embedding, at most.
FARTHEST = 3.0


@dataclass
class SubwordModel:
    """``table``: class scores of each bucket, the last row zero. ``seen``: buckets that training met."""

    classes: list
    table: np.ndarray
    bias: np.ndarray
    seen: np.ndarray
    orders: tuple[int, ...]
    bits: int

    def score_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class scores of each text, its number of n-grams, the share of them that training met). Summed up a stretch of
        positions at a time, so that memory doesn't grow with characters times classes."""
        block = Block.of(texts)
        total = np.zeros((len(texts), len(self.classes)))
        count, met = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for bucket in block.grams(self.orders, self.bits):
            for k in range(0, len(bucket), STRETCH):
                part = bucket[k : k + STRETCH]
                first, last = np.searchsorted(block.starts, [k, k + len(part) - 1], "right") - 1
                of, begin = np.arange(first, last + 1), np.maximum(block.starts[first : last + 1] - k, 0)
                total[of] += np.add.reduceat(self.table[part], begin, axis=0, dtype=np.float64)
                count[of] += np.add.reduceat(part < 1 << self.bits, begin, dtype=np.int64)
                met[of] += np.add.reduceat(self.seen[part], begin, dtype=np.int64)
        return total / np.maximum(count, 1)[:, None] + self.bias, count, met / np.maximum(count, 1)

    def best_window(self, texts: list[str], words: int) -> np.ndarray:
        """The largest lead of class 1 over class 0 of any ``words`` successive words of each text (-inf without words)."""
        block = Block.of(texts)
        ahead = self.table[:, 1] - self.table[:, 0]
        lead, n = np.zeros(len(block.codes), np.float32), np.zeros(len(block.codes), np.int8)
        for bucket in block.grams(self.orders, self.bits):
            lead += ahead[bucket]
            n += bucket < 1 << self.bits
        at = block.words()
        out = np.full(len(texts), -np.inf)
        if not len(at):
            return out
        sums = np.concatenate([[0.0], np.cumsum(np.add.reduceat(lead, at, dtype=np.float64))])
        counts = np.concatenate([[0], np.cumsum(np.add.reduceat(n, at, dtype=np.int64))])
        first = np.searchsorted(at, block.starts)  # the first word of each text
        of = np.searchsorted(block.starts, at, "right") - 1
        begin = np.maximum(first[of], np.arange(len(at)) - words + 1)
        # whole windows count, and shorter ones only where the text has fewer words
        last = np.append(first[1:], len(at)) - first
        whole = np.arange(len(at)) - first[of] + 1 >= np.minimum(words, last[of])
        end = np.arange(1, len(at) + 1)
        lead = np.where(whole, (sums[end] - sums[begin]) / np.maximum(counts[end] - counts[begin], 1), -np.inf)
        held = last > 0
        out[held] = np.maximum.reduceat(lead, first[held]) + self.bias[1] - self.bias[0]
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(
    texts: list[str], labels: list, orders: tuple[int, ...], bits: int = 17, dim: int = 12, epochs: int = 4, rate: float = 0.3, batch: int = 32, seed: int = 7,
    weights: np.ndarray | None = None,
) -> SubwordModel:
    """Embeddings and softmax trained jointly by minibatch SGD with a linearly falling rate. Texts without n-grams are left out.

    What a step adds to a bucket's embedding has a length of ``FARTHEST`` at most: a bucket that a batch holds very often would
    overshoot and diverge otherwise. A model that isn't finite is an error."""
    classes = sorted(set(labels))
    y = np.array([classes.index(x) for x in labels])
    at, n = [], np.zeros(len(texts), np.int64)
    for first in range(0, len(texts), 1024):  # a block at a time: only the bucket numbers stay in memory
        block = Block.of(texts[first : first + 1024])
        of = np.repeat(np.arange(len(block.starts), dtype=np.int32), np.diff(np.append(block.starts, len(block.codes))))
        found = [(bucket[ok].astype(np.int32), of[ok]) for bucket in block.grams(orders, bits) for ok in (bucket < 1 << bits,)]
        text = np.concatenate([t for _, t in found])
        at.append(np.concatenate([b for b, _ in found])[np.argsort(text, kind="stable")])
        n[first : first + 1024] = np.bincount(text, minlength=len(block.starts))
    at = np.concatenate(at) if at else np.zeros(0, np.int32)
    ends = np.cumsum(n)
    seen = np.zeros((1 << bits) + 1, bool)
    seen[at] = True
    rng = np.random.default_rng(seed)
    # only buckets that training met have embeddings
    met = np.flatnonzero(seen)
    at = np.searchsorted(met, at).astype(np.int32)
    e = rng.uniform(-1 / dim, 1 / dim, (len(met), dim)).astype(np.float32)
    w, b = np.zeros((dim, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    usable = np.flatnonzero(n)
    weight = np.ones(len(texts), np.float32) if weights is None else weights.astype(np.float32)
    steps, step = epochs * -(-len(usable) // batch), 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(usable), max(1, -(-len(usable) // batch))):
            lr = np.float32(rate * (1 - step / max(steps, 1)))
            step += 1
            idx = np.concatenate([at[ends[i] - n[i] : ends[i]] for i in part]) if len(part) else np.zeros(0, np.int32)
            if not len(idx):
                continue
            size = n[part]
            first = np.cumsum(size) - size
            h = np.add.reduceat(e[idx], first, axis=0) / size[:, None]
            error = softmax(h @ w + b)
            error[np.arange(len(part)), y[part]] -= 1
            error *= weight[part][:, None]
            back = (error @ w.T / size[:, None]).astype(np.float32)
            w -= lr * (h.T @ error).astype(np.float32)
            b -= lr * error.sum(axis=0).astype(np.float32)
            uniq, inverse = np.unique(idx, return_inverse=True)
            grad = np.zeros((len(uniq), dim), np.float32)
            np.add.at(grad, inverse, np.repeat(back, size, axis=0))
            move = lr * dim * grad
            move *= np.minimum(1, FARTHEST / np.maximum(np.sqrt((move * move).sum(axis=1)), 1e-12))[:, None].astype(np.float32)
            e[uniq] -= move
    if not (np.isfinite(e).all() and np.isfinite(w).all() and np.isfinite(b).all()):
        raise ArithmeticError("training diverged")
    table = np.zeros(((1 << bits) + 1, len(classes)), np.float32)
    table[met] = e @ w
    return SubwordModel(classes, table, b.astype(np.float64), seen, orders, bits)
