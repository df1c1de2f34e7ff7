"""Words and word n-grams of whole texts as 64-bit hashes, computed over numpy arrays.

A word is a maximal run of letters and digits of the lower-cased text; every character of a script that is written
without spaces is a word of its own. Signs of other languages part words as ASCII signs do: Latin-1 signs, general
and CJK punctuation, spaces, currency signs, arrows, symbols, full-width signs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

_PIECE = 1 << 18
_SIGNS = re.compile("[\u0080-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u00d7\u00f7\u2000-\u206f\u20a0-\u20cf\u2190-\u2bff\u2e00-\u2e7f\u3000-\u3004\u3008-\u303f\u30fb\ufe30-\ufe6f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
_UNSPACED = re.compile("([\u0e00-\u0e7f\u1780-\u17ff\u3005-\u3007\u3040-\u30fa\u30fc-\u31ff\u3400-\u9fff\uac00-\ud7a3\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003ffff])")
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            row = np.full(max(n, 1 << 16), base, dtype=np.uint64)
            row[0] = 1
            _POWERS[key] = np.multiply.accumulate(row)
    return _POWERS["up"], _POWERS["down"]


def hash_words(data: bytes, is_word: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, start offset of each word) of UTF-8 bytes; is_word says which of the 256 bytes words hold."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = is_word[raw]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def _plain(text: str) -> bytes:
    """Lower-cased UTF-8 with a space for every sign and around every character of an unspaced script."""
    low = text.lower()
    if not low.isascii():
        low = _UNSPACED.sub(r" \1 ", _SIGNS.sub(" ", low))
    return low.encode("utf-8", "replace")


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of bounded length, cut where a separator stands (a longer word is cut at the bound)."""
    at = 0
    while len(text) - at > _PIECE:
        to = at + _PIECE
        space = max(text.rfind(" ", at + 1, to), text.rfind("\n", at + 1, to))
        to = space if space > at else to
        yield text[at:to]
        at = to
    yield text[at:] if at else text


def word_hashes(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks (first, last + 1, hashes, counts) of a list of texts: the words of texts[first:last + 1] in a row.

    Null texts count as empty. Memory is bounded by the longest text; texts are joined up to about a quarter of a megabyte.
    """
    first, held, size = 0, [], 0

    def flush(last: int):
        marks = np.cumsum([0, *(len(x) + 1 for x in held)])
        hashes, start = hash_words(b"\n".join(held))
        return first, last, hashes, np.diff(np.searchsorted(start, marks))

    for k, text in enumerate(texts):
        text = text or ""
        if len(text) > _PIECE:
            if held:
                yield flush(k)
            parts = [hash_words(_plain(x))[0] for x in _pieces(text)]
            hashes = np.concatenate(parts)
            yield k, k + 1, hashes, np.array([len(hashes)])
            first, held, size = k + 1, [], 0
            continue
        data = _plain(text)
        held.append(data)
        size += len(data)
        if size > _PIECE:
            yield flush(k + 1)
            first, held, size = k + 1, [], 0
    if held:
        yield flush(len(texts))


def ngrams(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram hashes, text index of each, word position in its text); a text of fewer than n words has none."""
    owner = np.repeat(np.arange(len(counts)), counts)
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = len(hashes) - n + 1
    total = np.zeros(m, dtype=np.uint64)
    for j in range(n):
        total = total * _BASE + hashes[j : j + m]
    whole = owner[:m] == owner[n - 1 :]
    first = np.cumsum(counts) - counts
    at = np.flatnonzero(whole)
    return mix(total[at]), owner[at], at - first[owner[at]]
