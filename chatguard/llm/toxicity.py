"""Toxicity scores from a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, maps look-alike letters of other scripts, styled letters, accents and digit substitutions
to one plain letter (l, i and 1 to i) and drops invisible characters. Terms are whole words, which also match with
a common English ending, and stems (written with a star), which match any word they begin: a stem is learned only
where many different words with it were seen. Weights are smoothed log odds from labelled training rows; hits
inside exception phrases do not count. The sum of weights, alone and for the length of the text, goes through a
logistic function fitted on the same rows.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatguard.llm.store import free_name, keep, released

# Letters of other scripts by the Latin letter they look like.
_LOOKALIKES = {
    "a": "аαɑ", "b": "вβ", "c": "сϲ", "d": "ԁ", "e": "еєε", "g": "ɡ", "h": "һн", "i": "іιїı", "j": "ј", "k": "кκ", "m": "м",
    "n": "пη", "o": "оοσ", "p": "рρ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υ", "v": "ν", "w": "ѡω", "x": "хχ", "y": "уγ",
}
# Digits and signs written for letters.
_SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "$": "s", "@": "a", "|": "i", "l": "i"}

# Harmless phrases that hold a lexicon word.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash day", "clown fish", "clownfish", "stupid question", "sore loser", "worthless without", "class clown", "pond scum")

LEAST, SHORT, LONG = 3, 4, 8  # letters of a word, of the shortest and of the longest stem
VARIETY = 5  # different words that a stem must have begun
# Endings that a term may carry in a text.
ENDINGS = ("s", "es", "y", "ed", "er", "ers", "ic", "ish", "ly", "ally", "ity", "ness")


def _folding() -> dict[int, str | None]:
    table: dict[int, str | None] = {c: None for c in (0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF, *range(0x300, 0x370))}
    for low, high in ((0xC0, 0x250), (0x1E00, 0x1F00), (0x2460, 0x2500), (0xFF01, 0xFF5F), (0x1D400, 0x1D800)):
        for c in range(low, high):
            plain = "".join(x for x in unicodedata.normalize("NFKD", chr(c).lower()) if not unicodedata.combining(x)).lower()
            if plain != chr(c) and len(plain) == 1:
                table[c] = plain
    for letter, others in _LOOKALIKES.items():
        table |= {ord(x): letter for x in others}
    for c, plain in list(table.items()):
        if plain in _SUBSTITUTES:
            table[c] = _SUBSTITUTES[plain]
    return table | {ord(c): plain for c, plain in _SUBSTITUTES.items()}


_FOLD = _folding()


def fold(text: str | None) -> str:
    """Lower-cased text in the folded alphabet; null is empty."""
    return (text or "").lower().translate(_FOLD)


class _Letters(dict):
    """translate() table that drops what folding drops and writes a for letters, space for all else."""

    def __missing__(self, code: int) -> str:
        self[code] = "a" if chr(code).isalpha() else " "
        return self[code]


_LETTERS = _Letters({c: None for c, plain in _FOLD.items() if plain is None})


def _words(text: str) -> list[str]:
    """Words of a folded text: maximal runs of letters."""
    return "".join(c if c.isalpha() else " " for c in text).split()


def _stems(words: set[str]) -> set[str]:
    return {f"{w[:k]}*" for w in words for k in range(SHORT, min(len(w), LONG) + 1)}


def _counted(frames: Iterator[pd.DataFrame], most: int = 50_000) -> Iterator[pd.DataFrame]:
    """(term, beside, toxic, clean): document counts of words and stems; beside is null for the plain count, else the
    word before a word or the word that a stem began, for toxic rows only. A task holds about `most` counts at once."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def done() -> pd.DataFrame:
        keys = list(counts[0].keys() | counts[1].keys())
        out = pd.DataFrame({"term": [k[0] for k in keys], "beside": [k[1] for k in keys], "toxic": [counts[1][k] for k in keys], "clean": [counts[0][k] for k in keys]})
        counts[0].clear()
        counts[1].clear()
        return out

    for frame in frames:
        for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
            words = _words(fold(text))
            own = {w for w in words if len(w) >= LEAST}
            counts[int(toxic)].update((t, None) for t in own | _stems(own))
            if toxic:
                counts[1].update({(w, v) for v, w in zip(["", *words], words, strict=False) if w in own})
                counts[1].update((t, w) for w in own for t in _stems({w}))
            if len(counts[0]) + len(counts[1]) > most:
                yield done()
    if counts[0] or counts[1]:
        yield done()


def _apart(terms: dict[str, float]) -> set[str]:
    """The terms of the highest ratios, longer ones first among equals, of which no stem begins another."""
    kept: set[str] = set()
    for term in sorted(terms, key=lambda t: (-terms[t], -len(t), t)):
        word = term.rstrip("*")
        shorter = any(f"{word[:k]}*" in kept for k in range(SHORT, len(word) + 1))
        if not shorter and not (term[-1] == "*" and any(t.startswith(word) for t in kept)):
            kept.add(term)
    return kept


class Lexicon:
    """Terms with weights and exception phrases in one automaton; built once in each worker."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term, weight in weights.items():
            # The automaton keeps one value a string: a word and a stem of the same letters count as the heavier one.
            letters, stem = term.rstrip("*"), term.endswith("*")
            _, old, wide = self.automaton.get(letters, (0, 0.0, False))
            self.automaton.add_word(letters, (len(letters), max(weight, old), stem or wide))
        for phrase in exceptions:
            self.automaton.add_word(fold(phrase), (len(fold(phrase)), None, False))
        self.endings = frozenset(("", *map(fold, ENDINGS)))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def measure(self, text: str | None) -> tuple[float, int]:
        """(sum of weights, number of hits); a word counts once, with its heaviest term.

        Bounds of words are looked up in the text before folding, so a digit or sign beside a word is no letter.
        """
        folded = fold(text)
        letters, best, free = "", {}, []
        for end, (length, weight, stem) in () if self.empty else self.automaton.iter(folded):
            letters = letters or (text or "").lower().translate(_LETTERS)
            start, stop = end + 1 - length, end + 1
            if start and letters[start - 1] == "a":
                continue
            rest = stop
            while rest < len(letters) and letters[rest] == "a" and rest - stop < 6:
                rest += 1
            if not stem and folded[stop:rest] not in self.endings:
                continue
            if weight is None:
                free.append((start, stop))
            else:
                best[start] = max(weight, best.get(start, 0.0))
        if free:
            # Few phrases a text: each drops the words inside it.
            best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in free)}
        return sum(best.values()), len(best)


def features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    """1, log of the sum of weights, log of the sum per square root of words."""
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(total / np.sqrt(np.maximum(words, 1)))], axis=1)


def word_total(text: str | None) -> int:
    """Words between white space of any kind."""
    return len((text or "").split())


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Coefficients by Newton steps with a small ridge, so that separable rows end too."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (y - p) - ridge * b
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), slope)
        b = b + step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return b


class Model:
    def __init__(self, weights: dict[str, float], coefficients: list[float]):
        self.weights, self.coefficients = weights, coefficients


def _measured(frames: Iterator[pd.DataFrame], weights: dict[str, float]) -> Iterator[pd.DataFrame]:
    lexicon = Lexicon(weights)
    for frame in frames:
        got = [lexicon.measure(t) for t in frame["text"]]
        yield pd.DataFrame({"toxic": frame["toxic"], "total": [g[0] for g in got], "words": [word_total(t) for t in frame["text"]]})


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000) -> Model:
    """Learn terms, weights and the logistic curve from a bounded sample of labelled rows.

    docs: doc_id, text. labels: doc_id, toxic (null labels take no part; repeated ids count as toxic if any row
    says so). Both are joined on doc_id, which serves for nothing else. At most about max_rows labelled rows,
    drawn by a hash of their id, are used: fitting is the one step that does not read every row. A word or stem
    becomes a term if the likelihood ratio of its counts would not arise by chance among all of them, and a word
    only if it follows many different words, so that copies of one document do not make terms of its words; a stem
    only if it began VARIETY words at least, none of them in half the rows that hold it.
    Without rows of both labels the model has no terms and scores the share of toxic rows.
    """
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = marks.count()
    if n > max_rows:
        marks = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < max(1, (max_rows << 40) // n))
    sample = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    sample = keep(sample, "toxic-sample")
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        share = min(0.99, max(0.01, bad / max(1, bad + good))) if bad + good else 0.01
        return Model({}, [math.log(share / (1 - share)), 0.0, 0.0])
    pairs = sample.mapInPandas(released(_counted), "term string, beside string, toxic long, clean long").groupBy("term", "beside").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    whole, beside = F.col("beside").isNull(), F.col("beside").isNotNull()
    counts = pairs.groupBy("term").agg(F.sum(F.when(whole, F.col("toxic"))).alias("toxic"), F.sum(F.when(whole, F.col("clean"))).alias("clean"), F.sum(beside.cast("long")).alias("kinds"), F.max(F.when(beside, F.col("toxic"))).alias("most"))
    varied = F.when(F.endswith("term", F.lit("*")), (F.col("kinds") >= VARIETY) & (2 * F.col("most") <= F.col("toxic"))).otherwise(2 * F.col("kinds") >= F.col("toxic"))
    counts = keep(counts.filter((F.col("toxic") >= 4) & varied), "toxic-counts")
    base, terms = bad / (bad + good), max(2, counts.count())
    both = F.col("toxic") + F.col("clean")
    ratio = 2 * (F.col("toxic") * F.log(F.col("toxic") / (both * base)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (both * (1 - base)))).otherwise(0.0))
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (good + 1))
    picked = counts.select("term", ratio.alias("ratio"), odds.alias("odds")).filter((F.col("ratio") >= 2 * math.log(terms) + 8) & (F.col("odds") >= 2)).orderBy("term").collect()  # words of max_rows texts
    kept = _apart({r["term"]: r["ratio"] for r in picked})
    weights = {r["term"]: r["odds"] for r in picked if r["term"] in kept}
    rows = sample.mapInPandas(released(lambda x: _measured(x, weights)), "toxic int, total double, words long").toPandas()  # max_rows rows of numbers
    rows = rows.sort_values(["toxic", "total", "words"])
    b = fit_logistic(features(rows["total"].to_numpy(), rows["words"].to_numpy()), rows["toxic"].to_numpy(float))
    return Model(weights, b.tolist())


def score_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with toxic_score double (0 to 1) and toxic_hits int for every row, from the whole text.

    Null and empty texts have no hits and the score of a text without any. Columns of these names are replaced;
    all other columns pass through. Rows are scored one by one, so repeated rows score alike.
    """
    weights, b = model.weights, np.array(model.coefficients)

    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(weights)
        for texts in parts:
            got = [lexicon.measure(t) for t in texts]
            words = np.array([word_total(t) for t in texts], dtype=float)
            x = features(np.array([g[0] for g in got], dtype=float).reshape(-1), words.reshape(-1))
            yield pd.DataFrame({"toxic_score": 1 / (1 + np.exp(-np.clip(x @ b, -30, 30))), "toxic_hits": np.array([g[1] for g in got], dtype=np.int32)})

    @F.pandas_udf("toxic_score double, toxic_hits int")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from released(scores)(parts)

    said, own = free_name("__said", docs.columns), [c for c in docs.columns if c.lower() not in ("toxic_score", "toxic_hits")]
    scored = docs.withColumn(said, judge(F.col(text)))
    return scored.select(*[F.col(f"`{c}`") for c in own], f"{said}.toxic_score", f"{said}.toxic_hits")
