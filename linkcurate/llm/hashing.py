"""Hashes of words and of words in a row, for many texts at once with numpy."""

from __future__ import annotations

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def word_edges(data: np.ndarray, inside_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes for which the table `inside_word` holds."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = inside_word[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial in the bytes of each word, modulo 2**64, mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    held = np.zeros(len(starts), np.uint64)
    # One pass per position in a word; the passes get shorter as fewer words reach so far. Long words are few and go one by one.
    order = np.argsort(-lengths, kind="stable")
    order = order[np.count_nonzero(lengths > 64) :]
    counts = np.searchsorted(-lengths[order], -np.arange(int(lengths[order[0]]) if len(order) else 0), "left")
    for i, n in enumerate(counts):
        some = order[:n]
        held[some] = held[some] * _BASE + (data[starts[some] + i].astype(np.uint64) + np.uint64(1))
    for k in np.flatnonzero(lengths > 64):
        word = data[starts[k] : ends[k]].astype(np.uint64) + np.uint64(1)
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(word) - 1, _BASE, np.uint64)]), dtype=np.uint64)
        held[k] = (word * powers[::-1]).sum(dtype=np.uint64)
    return (held ^ (held >> np.uint64(29))) * _BASE


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Of every `n` words in a row."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    held = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        held *= _STEP
        held += words[i : i + len(held)]
    return held ^ (held >> np.uint64(31))


def hashed_words(texts: list[bytes], inside_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts (a line feed between), starts, ends and hashes of words, and each text's first word.

    A line feed must not belong to a word. The last array has one entry more than there are texts.
    """
    data = LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    starts, ends = word_edges(data, inside_word)
    first = np.searchsorted(starts, np.cumsum([0] + [len(x) + 1 for x in texts]))
    return data, starts, ends, word_hashes(data, starts, ends), first


#: Words between ASCII white space.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Per text its distinct shingles of `n` words as ascending hashes; fewer words are one shingle, no words none."""
    out: list[np.ndarray] = []
    part: list[bytes] = []
    size = 0
    for text in [*texts, None]:
        if len(out) + len(part) < len(texts):
            part.append((text or "").encode("utf-8", "surrogatepass"))
            size += len(part[-1])
        if part and (size > 1 << 20 or len(out) + len(part) == len(texts)):
            _, _, _, words, first = hashed_words(part, NOT_BLANK)
            windows = window_hashes(words, n)
            for a, b in zip(first[:-1], first[1:]):
                if b - a >= n:
                    out.append(np.unique(windows[a : b - n + 1]))
                else:
                    out.append(window_hashes(words[a:b], int(b - a)) + np.uint64(b - a) if b > a else windows[:0])
            part, size = [], 0
    return out
