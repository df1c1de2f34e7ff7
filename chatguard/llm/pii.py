"""Personal data by a character-level bidirectional LSTM with a CRF on top, beside exact base patterns.

The network is trained in numpy from labelled spans: base matches in a bounded sample of documents, and planted
values in several spellings set into stretches of the same documents. At scan time texts are cut into overlapping
windows; their scores are blended, weighted towards window centres, and one Viterbi pass over each stretch settles
all its spans. Model spans must still hold a value of their kind (digits, checksum, number ranges) and never replace
a base span. Every value holds a digit or a spelling of @, so no window is run that lies farther than a whole window
from the next of these: a span could reach it only across WINDOW characters of prose, which is no value.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # 0 outside, 1 + 2k begins kind k, 2 + 2k continues it

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LABEL_CHARS = _LOCAL_CHARS - frozenset("._%+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_OPEN, _SHUT = r"[\[({<] ?", r" ?[\])}>]"
_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]+", r"[A-Za-z0-9-]+"
_AT = rf" ?(?:@|{_OPEN}(?i:at){_SHUT}) ?"
_DOT = rf"(?: ?(?:\.|{_OPEN}(?:(?i:dot)|\.){_SHUT}) ?| (?i:dot) )"
_SAID = rf"(?: ?{_OPEN}(?i:dot){_SHUT} ?| (?i:dot) )"
# A bare "at" is an @ only where a dot is spelled out as well.
_ADDRESS = re.compile(rf"{_LOCAL}(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})+| (?i:at) {_LABEL}(?:{_DOT}{_LABEL})*{_SAID}{_LABEL}(?:{_DOT}{_LABEL})*)")
_POSSIBLE = re.compile(r"[\d@\uff20\ufe6b]|[\[({<] ?(?i:at) ?[\])}>]|\s(?i:at)(?=\s)")
_BARE_DOT = re.compile(r"\s(?i:dot)\s|[\[({<] ?(?i:dot) ?[\])}>]")

_MARKS = " \n!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Inputs: 0 padding, 1 a digit, 2 another letter, 3 all else, 4 to 29 the letters a to z, then the marks; one more row says upper case.
_DIGIT, _LETTER, _OTHER, _A = 1, 2, 3, 4
_CLASSES = _A + 26 + len(_MARKS)
_CASE, _UPPER = _CLASSES, 128  # the case row, and the bit of a code that asks for it
_TABLE = np.full(256, _OTHER, dtype=np.int16)
_TABLE[48:58], _TABLE[97:123], _TABLE[65:91] = _DIGIT, np.arange(_A, _A + 26), np.arange(_A, _A + 26) + _UPPER
_TABLE[[ord(c) for c in _MARKS]] = np.arange(_A + 26, _CLASSES)
_TABLE[192:] = _LETTER
_TABLE[0xA0] = _TABLE[32]
_DASHES, _SPACES = [*range(0x2010, 0x2016), 0x2212], [*range(0x2000, 0x200B), 0x202F, 0x3000]
_DECIMALS = np.array([c for c in range(0x660, 0x20000) if chr(c).isdecimal()], dtype=np.uint32)
# Signs that stand for ASCII ones of the same meaning.
_LIKE = {0xFF20: "@", 0xFE6B: "@", 0xFF0E: ".", 0xFF0B: "+", 0xFF0D: "-", 0xFF08: "(", 0xFF09: ")"}

WINDOW, STRIDE, MARGIN = 96, 64, 24


def luhn(digits: str) -> bool:
    """Mod-10 checksum over ASCII digits."""
    total = sum(int(d) for d in digits[-1::-2]) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: each @ looks back over its local part, no further than the last match."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base patterns, leftmost and non-overlapping within a kind, in order."""
    out = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def holds_value(kind: int, value: str) -> bool:
    """Whether a span found by the network holds a value of its kind, whatever stands between its parts."""
    value = ascii_form(value)
    digits = "".join(_DIGITS.findall(value))
    if kind == 0:
        return _ADDRESS.fullmatch(value) is not None
    if kind == 1:
        parts = _DIGITS.findall(value)
        # A dot or its name stands between the parts: numbers in a list are no address.
        gaps = _DIGITS.split(value)[1:-1]
        return len(parts) == 4 and all("." in g or "dot" in g.lower() for g in gaps) and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and (value[0] == "+" or value.startswith(("00", "(+")))


def settled(text: str, span: tuple[int, int, int], taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The parts of a network span that hold values: free of base spans, trimmed, and cut at spaces where the whole does not."""
    low, high, kind = span
    edges = [low, *(x for a, b in taken if a < high and low < b for x in (max(a, low), min(b, high))), high]
    out = []
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        words = [(a + m.start(), a + m.end()) for m in re.finditer(r"\S+", text[a:b])]
        first = 0
        while first < len(words):
            for last in range(len(words) - 1, first - 1, -1):
                start, end = words[first][0], words[last][1]
                if kind:
                    m = re.search(r"[\d+](?:.*\d)?", text[start:end], re.S)
                    start, end = (start + m.start(), start + m.end()) if m else (start, start)
                # What the digits are is settled by their value: 00 49 ... tagged as a card is a telephone number.
                real = next((k for k in (kind, *((3, 2, 1) if kind else ())) if start < end and holds_value(k, text[start:end])), None)
                if real is not None:
                    out.append((start, end, real))
                    first = last
                    break
            first += 1
    return out


def grown(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans with addresses widened to whole tokens and on to the end of an address, no further than their neighbours."""
    out: list[tuple[int, int, int]] = []
    for k, (low, high, kind) in enumerate(spans):
        if kind == 0:
            least, most = out[-1][1] if out else 0, spans[k + 1][0] if k + 1 < len(spans) else len(text)
            while low > least and text[low] in _LOCAL_CHARS and text[low - 1] in _LOCAL_CHARS:
                low -= 1
            while high < most and text[high - 1] in _LABEL_CHARS and text[high] in _LABEL_CHARS:
                high += 1
            for m in re.finditer(r"\S+", text[low:high]):
                if whole := _ADDRESS.match(text, low + m.start(), most):
                    high = max(high, whole.end())
        out.append((low, high, kind))
    return out


def encode(text: str) -> np.ndarray:
    """Input codes of the characters: every ASCII letter, digits of any script, every ASCII mark with what is like it,
    other letters and all else; a bit for upper case."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    ids = _TABLE[np.minimum(codes, 255)]
    if (wide := codes > 0x65F).any():
        own = codes[wide]
        new = np.full(len(own), _LETTER, dtype=np.int16)
        new[np.isin(own, _DECIMALS)] = _DIGIT
        new[np.isin(own, _SPACES)] = _TABLE[32]
        new[np.isin(own, _DASHES)] = _TABLE[45]
        for code, sign in _LIKE.items():
            new[own == code] = _TABLE[ord(sign)]
        ids[wide] = new
    return ids


def ascii_form(value: str) -> str:
    """The value with digits of any script and signs like ASCII ones as ASCII, of the same length."""
    if value.isascii():
        return value
    return "".join(_LIKE.get(ord(c)) or (str(unicodedata.decimal(c)) if c.isdecimal() else c) for c in value)


class Network:
    """Weights and the numpy passes; both directions run as one batch."""

    def __init__(self, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {
            "x": f(2, _CLASSES + 1, 4 * hidden, scale=0.3), "h": f(2, hidden, 4 * hidden, scale=hidden**-0.5),
            "u": f(2, hidden, TAGS, scale=0.2), "b": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32),
        }
        self.p["x"][:, :, hidden : 2 * hidden] += 0.5
        self.hidden = hidden

    def save(self, path: str) -> None:
        """Keep the weights, so that a later job need not train; the driver's own file, which load reads back."""
        np.savez(path, **self.p)

    @classmethod
    def load(cls, path: str) -> Network:
        with np.load(path) as kept:
            out = cls(hidden=kept["h"].shape[1])
            out.p = {name: kept[name] for name in kept.files}
        return out

    def run(self, ids: np.ndarray, keep: bool = False):
        """Tag scores (batch, time, tags) of class ids (batch, time); with keep also what the backward pass needs."""
        p, h, (n, steps) = self.p, self.hidden, ids.shape
        both = np.stack([ids, ids[:, ::-1]])
        inputs = np.stack([p["x"][k][both[k] % _UPPER] + (both[k] >= _UPPER)[..., None] * p["x"][k][_CASE] for k in range(2)])
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        out = np.empty((2, n, steps, h), np.float32)
        saved = []
        for t in range(steps):
            z = inputs[:, :, t] + state @ p["h"]
            gates = 0.5 * np.tanh(0.5 * z[..., : 3 * h]) + 0.5
            g = np.tanh(z[..., 3 * h :])
            before, old = cell, state
            cell = gates[..., h : 2 * h] * cell + gates[..., :h] * g
            squashed = np.tanh(cell)
            state = gates[..., 2 * h :] * squashed
            out[:, :, t] = state
            if keep:
                saved.append((gates, g, before, squashed, old))
        scores = out[0] @ p["u"][0] + out[1][:, ::-1] @ p["u"][1] + p["b"]
        return (scores, out, both, saved) if keep else scores

    def gradient(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the gold tags and its gradient."""
        p, h = self.p, self.hidden
        scores, out, both, saved = self.run(ids, keep=True)
        n, steps, _ = scores.shape
        loss, d_scores, d_t = crf_gradient(scores.astype(np.float64), p["t"].astype(np.float64), gold)
        d = (d_scores / n).astype(np.float32)
        grad = {"t": (d_t / n).astype(np.float32), "b": d.sum((0, 1)), "x": np.zeros_like(p["x"]), "h": np.zeros_like(p["h"])}
        d_both = np.stack([d, d[:, ::-1]])
        grad["u"] = np.stack([np.einsum("nth,ntk->hk", out[k], d_both[k]) for k in range(2)])
        d_out = d_both @ np.swapaxes(p["u"], 1, 2)[:, None]
        d_state, d_cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        d_inputs = np.empty((2, n, steps, 4 * h), np.float32)
        for t in range(steps - 1, -1, -1):
            gates, g, before, squashed, old = saved[t]
            i, f, o = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :]
            d_state = d_state + d_out[:, :, t]
            d_cell = d_cell + d_state * o * (1 - squashed**2)
            dz = np.concatenate([d_cell * g * i * (1 - i), d_cell * before * f * (1 - f), d_state * squashed * o * (1 - o), d_cell * i * (1 - g**2)], axis=2)
            d_inputs[:, :, t] = dz
            grad["h"] += np.swapaxes(old, 1, 2) @ dz
            d_state, d_cell = dz @ np.swapaxes(p["h"], 1, 2), d_cell * f
        for k in range(2):
            one = np.zeros((n * steps, _CLASSES + 1), np.float32)
            one[np.arange(n * steps), both[k].ravel() % _UPPER] = 1
            one[:, _CASE] = both[k].ravel() >= _UPPER
            grad["x"][k] = one.T @ d_inputs[k].reshape(-1, 4 * h)
        return loss / n, grad


def crf_gradient(scores: np.ndarray, trans: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(summed negative log-likelihood, its gradient by scores, by transitions) of a linear-chain CRF.

    Forward and backward passes run on probabilities that are scaled to sum to 1 at every step.
    """
    n, steps, k = scores.shape
    top = scores.max(axis=2, keepdims=True)
    seen, step = np.exp(scores - top), np.exp(trans)
    forward, backward, scale = np.empty_like(scores), np.ones_like(scores), np.empty((n, steps, 1))
    now = seen[:, 0]
    for t in range(steps):
        now = (forward[:, t - 1] @ step) * seen[:, t] if t else now
        scale[:, t] = now.sum(axis=1, keepdims=True)
        forward[:, t] = now / scale[:, t]
    for t in range(steps - 2, -1, -1):
        backward[:, t] = ((seen[:, t + 1] * backward[:, t + 1]) @ step.T) / scale[:, t + 1]
    d_scores = forward * backward
    after = seen[:, 1:] * backward[:, 1:] / scale[:, 1:]
    d_trans = step * (forward[:, :-1].reshape(-1, k).T @ after.reshape(-1, k))
    rows, cols = np.arange(n)[:, None], np.arange(steps)[None]
    d_scores[rows, cols, gold] -= 1
    np.add.at(d_trans, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), -1)
    right = scores[rows, cols, gold].sum() + trans[gold[:, :-1], gold[:, 1:]].sum()
    return float((np.log(scale) + top).sum() - right), d_scores, d_trans


def viterbi(scores: list[np.ndarray], trans: np.ndarray) -> list[np.ndarray]:
    """Best tags for each score matrix (time, tags); kind k can only be continued after its own tags."""
    rule = trans.astype(np.float32).copy()
    for kind in range(len(KINDS)):
        others = [t for t in range(TAGS) if t not in (1 + 2 * kind, 2 + 2 * kind)]
        rule[others, 2 + 2 * kind] = -1e9
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(scores)
    order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
    at = 0
    while at < len(order):
        longest = len(scores[order[at]])
        some = order[at : at + max(1, min(1024, (1 << 20) // longest))]
        at += len(some)
        pad = np.zeros((len(some), longest, TAGS), np.float32)
        for row, k in enumerate(some):
            pad[row, : len(scores[k])] = scores[k]
            pad[row, len(scores[k]) :, 1:] = -1e9
        best = pad[:, 0].copy()
        best[:, 2::2] = -1e9
        back = np.empty((longest, len(some), TAGS), np.int8)
        for t in range(1, longest):
            step = best[:, :, None] + rule
            back[t] = step.argmax(1)
            best = step.max(1) + pad[:, t]
        tags = np.empty((len(some), longest), np.int8)
        tags[:, -1] = best.argmax(1)
        for t in range(longest - 1, 0, -1):
            tags[:, t - 1] = back[t][np.arange(len(some)), tags[:, t]]
        for row, k in enumerate(some):
            out[k] = tags[row, : len(scores[k])]
    return out


def stretches(text: str, margin: int) -> list[tuple[int, int]]:
    """Parts of a text within margin characters of a digit, an @ or a spelling of it, out to whole words.

    A bare at counts only if a bare or bracketed dot follows it: no address can come of it otherwise.
    """
    out: list[tuple[int, int]] = []
    said = -1 if _BARE_DOT.search(text) is None else 0
    for m in _POSSIBLE.finditer(text):
        if m[0][0].isspace() and said >= 0 and said <= m.start():
            dot = _BARE_DOT.search(text, m.end() - 1)
            said = dot.start() if dot else -1
        if m[0][0].isspace() and said < 0:
            continue
        low, high = max(0, m.start() - margin), min(len(text), m.end() + margin)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    whole: list[tuple[int, int]] = []
    for low, high in out:
        while low and not text[low - 1].isspace() and (not whole or low > whole[-1][1]):
            low -= 1
        while high < len(text) and not text[high].isspace():
            high += 1
        if whole and low <= whole[-1][1]:
            whole[-1] = (whole[-1][0], max(high, whole[-1][1]))
        else:
            whole.append((low, high))
    return whole


def model_spans(texts: list[str], network: Network) -> list[list[tuple[int, int, int]]]:
    """Spans of the network for each text: window scores blended over a stretch, which is decoded as a whole."""
    where = sorted(((k, low, high) for k, text in enumerate(texts) if _POSSIBLE.search(text) for low, high in stretches(text, WINDOW)), key=lambda x: x[2] - x[1])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    bell = 1 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]).astype(np.float32)
    at = 0
    while at < len(where):
        some, cells, size = [], [], 0
        while at < len(where) and (not some or size + where[at][2] - where[at][1] <= 1 << 17):
            k, low, high = where[at]
            some.append((k, low, high - low))
            # Windows lie on one grid of the text, so that a character is scored alike however much is left out.
            first, last = max(0, (low - WINDOW) // STRIDE + 1) * STRIDE, max(0, -(-(len(texts[k]) - WINDOW) // STRIDE)) * STRIDE
            starts = range(first, min(last, (high - 1) // STRIDE * STRIDE) + 1, STRIDE)
            ids = encode(texts[k][first : high + WINDOW])
            cells += [(len(some) - 1, s - low, ids[s - first : s - first + WINDOW]) for s in starts]
            size += high - low
            at += 1
        total = [np.zeros((n, TAGS), np.float32) for _, _, n in some]
        weight = [np.zeros((n, 1), np.float32) for _, _, n in some]
        for first in range(0, len(cells), 512):
            part = cells[first : first + 512]
            wide = np.zeros((len(part), WINDOW), np.int16)
            for row, (_, _, ids) in enumerate(part):
                wide[row, : len(ids)] = ids
            scores = network.run(wide)
            for row, (owner, s, ids) in enumerate(part):
                a, b = max(0, -s), min(len(ids), some[owner][2] - s)  # what of the window lies in the stretch
                total[owner][s + a : s + b] += scores[row, a:b] * bell[a:b, None]
                weight[owner][s + a : s + b] += bell[a:b, None]
        tags = viterbi([a / b for a, b in zip(total, weight, strict=True)], network.p["t"])
        for (k, low, _), row in zip(some, tags, strict=True):
            begin = np.flatnonzero((row % 2 == 1) & (row > 0))
            for b in begin.tolist():
                end = b + 1
                while end < len(row) and row[end] == row[b] + 1:
                    end += 1
                found[k].append((low + b, low + end, int(row[b] - 1) // 2))
    return found


def all_spans(texts: list[str], network: Network | None) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, all spans) of each text; model spans enter where they overlap no base span and hold a value."""
    extra = model_spans(texts, network) if network is not None else [[] for _ in texts]
    out = []
    for text, more in zip(texts, extra, strict=True):
        base = base_spans(text)
        taken: list[tuple[int, int]] = []
        for a, b, _ in base:
            if taken and a < taken[-1][1]:
                taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
            else:
                taken.append((a, b))
        new = [part for span in grown(text, more) for part in settled(text, span, taken)]
        out.append((base, sorted(base + new, key=lambda s: (s[0], s[2], s[1]))))
    return out


def _luhn_number(rng: np.random.Generator, n: int) -> str:
    body = "".join(str(d) for d in rng.integers(0, 10, n - 1))
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def planted(rng: np.random.Generator, kind: int, said: bool = False) -> str:
    """A made-up value of a kind in one of several spellings; with said an address whose at and dot are bare words."""
    pick = lambda *x: x[rng.integers(len(x))]
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    num = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    if kind == 0:
        local = pick(word(), word(), word(), f"{word()}.{word()}", f"{word()}{num(2)}", f"{word()}_{num(1)}", f"{word()}+{word()}")
        if not rng.integers(3):
            local = pick(f"{word()}.{word()}_{word()}{num(2)}", f"{word()}.{word()}.{word()}", f"{pick('a', 'j', 'r')}.{word()}", f"{word()}.{word()}.{word()}_{word()}-{word()}")
        host, end = word() + pick("", num(1), "-" + word()), pick("com", "net", "org", "de", "io", "co", "info", "example.com")
        if said or not rng.integers(5):
            return local + pick(" at ", " at ", " AT ") + host + pick(" dot ", " dot ", " dot ", " DOT ", "[dot]", "(dot)") + end
        at = pick("@", "@", " @ ", " @ ", " @ ", " [at] ", "(at)", " (AT) ", "[AT]", "{at}", "{at}", " {at} ", "<at>", "<at>", " <AT> ", " (at) ")
        return local + at + host + pick(".", ".", ".", " . ", "[.]", "(dot)", " [DOT] ", "{dot}", "<dot>") + end
    if kind == 1:
        return pick(".", ".", ".", "[.]", " . ", "(.)", "[dot]", "(dot)", " dot ", "{dot}", "{.}").join(str(rng.integers(0, 256)) for _ in range(4))
    if kind == 2:
        digits, gap = _luhn_number(rng, int(pick(13, 15, 16, 16, 16, 19))), pick("", "", " ", "-", ".", "/", "  ", "_", "\u2013", " - ", "\u00a0", ",")
        sizes = pick((4, 4, 4, 4, 4), (4, 6, 5, 4), (4, 4, 4, 4, 4), (8, 8, 8))
        cut = np.cumsum([0, *sizes])
        return gap.join(x for a, b in zip(cut, cut[1:], strict=False) if (x := digits[a:b]))
    # A country prefix, then two to five groups with one kind of gap; the first group may stand in brackets.
    head = pick("+", "+", "+", "00", "00 ", "+ ", "(+", "(00") + num(int(pick(1, 2, 2, 3)))
    head += ")" if head[0] == "(" else ""
    gap = pick(" ", " ", "-", ".", "/", " - ", " / ", "\u2013", "\u00a0", "  ", "_", "", "")
    groups = [num(int(n)) for n in pick((3, 3, 4), (2, 3, 4), (2, 4, 4), (3, 7), (2, 8), (1, 2, 2, 2, 2), (3, 4, 3), (2, 3, 2, 2), (4, 6))]
    if not rng.integers(3):
        groups[0] = pick(f"({groups[0]})", f"(0){groups[0]}", f"(0{groups[0]})")
    return head + (pick(gap, gap, " ") if gap else pick("", " ")) + gap.join(groups)


def _sampled(frames: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """Pieces of `width` characters around stretches with base spans or digits, with their spans."""
    for frame in frames:
        rows = []
        for text in frame.iloc[:, 0]:
            text = text or ""
            spans = base_spans(text)
            for low, high in stretches(text, MARGIN) or [(0, min(len(text), width))]:
                mid = max(0, (low + high - width) // 2)
                piece = text[mid : mid + width]
                inside = [(a - mid, b - mid, k) for a, b, k in spans if a >= mid and b <= mid + width]
                if piece and all(a >= mid and b <= mid + width or b <= mid or a >= mid + width for a, b, _ in spans):
                    rows.append((piece, [a for a, _, _ in inside], [b for _, b, _ in inside], [k for _, _, k in inside]))
        yield pd.DataFrame(rows, columns=["piece", "starts", "ends", "kinds"])


def tagged(spans: list[tuple[int, int, int]], length: int) -> np.ndarray:
    tags = np.zeros(length, dtype=np.int64)
    for a, b, kind in spans:
        tags[a] = 1 + 2 * kind
        tags[a + 1 : b] = 2 + 2 * kind
    return tags


def train_on(pieces: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 8, batch: int = 64, width: int = WINDOW // 2 + 16, seed: int = 7, planted_each: int = 400) -> Network:
    """A network from labelled pieces plus planted values set into them; deterministic for the same pieces.

    A training row is `width` characters long: what a piece holds beyond them serves as no label and no context.
    """
    rng = np.random.default_rng(seed)
    contexts = [p for p, spans in pieces if not spans] or ["the order of and in"]
    rows = list(pieces)
    for kind, said in [*((k, False) for k in range(len(KINDS))), *[(0, True)] * 4, *[(0, False)] * 4, *[(3, False)] * 3, (2, False), (1, False)]:
        for _ in range(planted_each):
            value, around = planted(rng, kind, said), contexts[rng.integers(len(contexts))]
            cut = int(rng.integers(0, max(1, min(len(around), width - len(value) - 2))))
            left, right = around[:cut], around[cut:]
            text = left + (" " if left else "") + value + (" " if right else "") + right
            start = len(left) + bool(left)
            rows.append((text, [(start, start + len(value), kind)]))
    for _ in range(planted_each):
        around = contexts[rng.integers(len(contexts))]
        cut = int(rng.integers(0, len(around) + 1))
        noise = "".join(str(d) for d in rng.integers(0, 10, rng.integers(1, 12))) + ["", "%", ".5", "/2024", " 000", ":30"][rng.integers(6)]
        rows.append((f"{around[:cut]} {noise} {around[cut:]}", []))
    ids, gold = np.zeros((len(rows), width), np.int16), np.zeros((len(rows), width), np.int64)
    for k, (text, spans) in enumerate(rows):
        code = encode(text[:width])
        ids[k, : len(code)] = code
        gold[k, : len(code)] = tagged([s for s in spans if s[1] <= width], len(code))
    network = Network(seed=seed)
    first, second = ({k: np.zeros_like(v) for k, v in network.p.items()} for _ in range(2))
    step = 0
    for epoch in range(rounds):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            _, grad = network.gradient(ids[some], gold[some])
            step += 1
            norm = max(1.0, float(np.sqrt(sum((g**2).sum() for g in grad.values()))) / 5)
            rate = 0.02 * (1 - step / (1 + rounds * -(-len(order) // batch)))
            for name, g in grad.items():
                g = g / norm
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                network.p[name] -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return network


def train(docs: DataFrame, text: str = "text", max_docs: int = 4000, max_pieces: int = 1500, **options) -> Network:
    """Fit on a bounded sample: about max_docs documents by a hash of their text, at most max_pieces pieces of them."""
    n = docs.count()
    share = min(1 << 40, (max_docs << 40) // max(1, n))
    some = docs.select(F.col(text).alias("text")).filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < share))
    width = WINDOW // 2 + 16
    pieces = some.mapInPandas(lambda x: _sampled(x, width), "piece string, starts array<int>, ends array<int>, kinds array<int>")
    ranked = pieces.dropDuplicates(["piece"]).orderBy(F.size("kinds") == 0, F.xxhash64("piece"), "piece").limit(max_pieces).collect()
    return train_on([(r["piece"], list(zip(r["starts"], r["ends"], r["kinds"], strict=True))) for r in ranked], **options)


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_model long"


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find_personal_data(docs: DataFrame, network: Network | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, counts by kind and digest of base spans, all spans, n_model of them the network's.

    Null texts count as empty. Spans are code-point offsets, end exclusive, listed by start, kind and end.
    Without a network only base spans are found. Texts are read whole; repeated rows come out alike. Counts and digest
    follow from the text alone, whatever the network finds; a kind's count over all spans is how often it is in `spans`.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t or "" for t in frame.iloc[:, 1]]
            rows = []
            for key, (base, spans) in zip(frame.iloc[:, 0], all_spans(texts, network), strict=True):
                counts = [sum(k == kind for _, _, k in base) for kind in range(len(KINDS))]
                rows.append((key, *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(spans) - len(base)))
            out = pd.DataFrame(rows, columns=["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))])
            yield out.astype({"doc_id": frame.iloc[:, 0].dtype})

    kind = dict(docs.dtypes)[doc_id]
    # A long goes as text: beside a null id pandas would make it a float, which rounds ids above 2^53.
    sent = "string" if kind == "bigint" else kind
    found = docs.select(F.col(doc_id).cast(sent).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, f"doc_id {sent}, {SCHEMA}")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))
