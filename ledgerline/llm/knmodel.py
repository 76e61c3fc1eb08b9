"""Texts as code points, hashed words and character grams, and what a document's evidence is:
the per-batch helper of op2. The counts and probabilities come from Spark (see op2_toxicity).

A text is lower-cased; letters, digits and marks stay, and each run of anything else is one
space. A text is worked through in pieces of PIECE characters that end at a space where there
is one, so memory does not grow with its length.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np

#: Characters of a gram, of which the last is predicted from the others.
ORDER = 5
PIECE = 1 << 20
GRAM_BITS, WORD_BITS = 22, 23
#: Slots of the arrays of a Pair, and the bytes that are inflated at once.
SLOTS, CHUNK = (1 << GRAM_BITS, 1 << GRAM_BITS, 1 << WORD_BITS), 1 << 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.uint64(32)


@lru_cache
def in_words() -> np.ndarray:
    """Whether each code point belongs to words: letters, digits and marks."""
    return np.fromiter((unicodedata.category(chr(i))[0] in "LNM" for i in range(0x110000)), bool, 0x110000)


@lru_cache
def powers() -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(4095, 0xD1342543DE82EF95, np.uint64)))


def pieces(text: str | None) -> Iterator[str]:
    text, at = text or "", 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            found = text.find(" ", end, end + PIECE)
            end = found if found >= 0 else end
        yield text[at:end]
        at = end


def spelled(piece: str) -> np.ndarray:
    """Code points of the words, ORDER - 1 spaces ahead and one after each; empty without words."""
    x = np.frombuffer(piece.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = in_words()[x]
    keep = inside | np.append(False, inside[:-1])
    out = np.where(inside, x, 32)[keep].astype(np.uint64)
    if not len(out):
        return out
    return np.concatenate([np.full(ORDER - 1, SPACE), out, [] if out[-1] == SPACE else [SPACE]]).astype(np.uint64)


def grams(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the grams of a spelled piece and of their contexts."""
    n = max(0, len(x) - ORDER + 1)
    context = h = np.zeros(n, np.uint64)
    for i in range(ORDER):
        context = h
        h = (h + x[i : i + n] + np.uint64(1)) * FACTOR
        h ^= h >> np.uint64(29)
    return h * FACTOR, context * FACTOR


def words(x: np.ndarray) -> np.ndarray:
    """Codes of the words of a spelled piece."""
    x = x[ORDER - 1 :]
    if not len(x):
        return x
    start = np.append(0, np.flatnonzero(x == SPACE)[:-1] + 1)
    place = np.arange(len(x)) - np.repeat(start, np.diff(np.append(start, len(x))))
    h = np.add.reduceat((x + np.uint64(1)) * powers()[np.minimum(place, 4095)], start)
    h ^= h >> np.uint64(32)
    return h * FACTOR


class Pair(NamedTuple):
    """Log-likelihood ratios, toxic against ordinary, by the leading bits of the codes: of grams (NaN:
    not seen), of contexts whose gram was not seen, and of words; `unseen` that of other words."""

    gram: np.ndarray
    context: np.ndarray
    word: np.ndarray
    unseen: float


def packed(pair: Pair) -> tuple[bytes, float]:
    """The models compressed, as they are broadcast: most slots are empty."""
    deflate = zlib.compressobj(1)
    return b"".join([*(deflate.compress(x) for x in pair[:3]), deflate.flush()]), pair.unseen


def unpacked(held: tuple[bytes, float]) -> Pair:
    """The models of a task. Their arrays are inflated in place, so that loading takes little more than
    what stays, and share one block, which is too large for the allocator to keep once it is let go."""
    block, (rest, unseen) = np.empty(sum(SLOTS), np.float16), held
    to, inflate, at = block.view(np.uint8), zlib.decompressobj(), 0
    while at < len(to):
        part = np.frombuffer(inflate.decompress(rest, CHUNK), np.uint8)
        if not len(part):
            raise ValueError("the models end early")
        to[at : at + len(part)] = part
        at, rest = at + len(part), inflate.unconsumed_tail
    return Pair(*np.split(block, np.cumsum(SLOTS)[:-1]), unseen)


NAMES = ("spelling, whole text", "most toxic spelling of a word", "toxic spellings", "words, whole text", "toxic words over 1", "toxic words over 2", "words")


def features(text: str | None, pair: Pair) -> list[float]:
    """The length-normalised log-likelihood ratios of the whole text, by spelling and by words, and
    how far single words go beyond what chance gives. All 0 for a text without words."""
    letters = tokens = spelling = word = most = over = over1 = over2 = 0.0
    for piece in pieces(text):
        x = spelled(piece)
        if not len(x):
            continue
        code, context = grams(x)
        r = pair.gram[code >> np.uint64(64 - GRAM_BITS)].astype(np.float32)
        r = np.where(np.isnan(r), pair.context[context >> np.uint64(64 - GRAM_BITS)], r)
        last = x[ORDER - 1 :] == SPACE
        one = np.bincount(np.cumsum(np.append(0, last[:-1])), r)
        w = pair.word[words(x) >> np.uint64(64 - WORD_BITS)].astype(np.float32)
        w = np.where(np.isnan(w), pair.unseen, w)
        letters, tokens = letters + len(r), tokens + len(w)
        spelling, word = spelling + float(r.sum()), word + float(w.sum())
        most, over = max(most, float(one.max())), over + float(np.maximum(one - 3, 0).sum())
        over1, over2 = over1 + float(np.maximum(w - 1, 0).sum()), over2 + float(np.maximum(w - 2, 0).sum())
    return [spelling / max(1.0, letters), most, float(np.log1p(over)), word / max(1.0, tokens), float(np.log1p(over1)), float(np.log1p(over2)), float(np.log1p(tokens))]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps; returns mean, scale and coefficients (bias last)."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    b = np.zeros(z.shape[1])
    r = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (weight * (p - y)) + r @ b
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + r
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, b
