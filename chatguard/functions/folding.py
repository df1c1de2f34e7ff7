"""Folding of disguised digits into ASCII digits, for detection only."""

from __future__ import annotations

import re
import unicodedata

# Shortcodes, number words, look-alike letters.
SHORTCODES = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "keycap_ten": "10", "100": "100", "1234": "1234"}
UNITS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "zéro": 0, "un": 1, "une": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
TEENS = {
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "dix": 10, "onze": 11, "douze": 12, "diez": 10, "once": 11, "doce": 12,
}
TENS = {"twenty": 2, "thirty": 3, "forty": 4, "fourty": 4, "fifty": 5, "sixty": 6, "seventy": 7, "eighty": 8, "ninety": 9}
REPEATS = {"double": 2, "triple": 3}
LOOKALIKES = {"O": "0", "o": "0", "I": "1", "l": "1", "|": "1", "Z": "2", "S": "5", "B": "8"}

_SHORTCODE = re.compile(rf":({'|'.join(SHORTCODES)})(?:::skin-tone-\d)?:")
_unit = "|".join(sorted(UNITS, key=len, reverse=True))
_NUMBER = re.compile(rf"\b(?:(?P<tens>{'|'.join(TENS)})(?:[\s-]+(?P<ones>{_unit}))?|(?P<teen>{'|'.join(TEENS)})|(?P<unit>{_unit}))\b", re.I)
_REPEAT = re.compile(rf"\b({'|'.join(REPEATS)})[\s-]+(\d)", re.I)
_NAMES = frozenset({*UNITS, *TEENS, *TENS, *REPEATS})
_TOKEN = re.compile(r"\w+")
_RUN = re.compile(r"(?<!\S)[\dOoIl|ZSB]+(?:\s+[\dOoIl|ZSB]+)*(?!\S)")
_SWAP = str.maketrans(LOOKALIKES)
_BETWEEN = re.compile(r"(?<=\d)[\W_]{1,3}(?=\d)")


class _CharTable(dict):
    """translate() table filled as characters turn up."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        if code < 128:
            out = c
        elif unicodedata.category(c) in ("Cf", "Mn", "Me"):
            out = None
        else:
            number = unicodedata.digit(c, None)
            if number is None:
                number = unicodedata.numeric(c, None)
                number = int(number) if number is not None and 0 <= number <= 20 and number == int(number) else None
            out = c if number is None else str(number)
        self[code] = out
        return out


_CHARS = _CharTable()


def _number(m: re.Match) -> str:
    if m["tens"]:
        return str(TENS[m["tens"].lower()] * 10 + (UNITS[m["ones"].lower()] if m["ones"] else 0))
    return str(TEENS[m["teen"].lower()] if m["teen"] else UNITS[m["unit"].lower()])


def fold_chars(text: str) -> str:
    """Digits of any script and small whole numerals as ASCII, invisible characters dropped, ASCII untouched."""
    return text if text.isascii() else text.translate(_CHARS)


def fold_number_words(text: str) -> str:
    if _NAMES.isdisjoint(_TOKEN.findall(text.lower())):
        return text
    return _REPEAT.sub(lambda m: m[2] * REPEATS[m[1].lower()], _NUMBER.sub(_number, text))


def fold_lookalikes(text: str) -> str:
    """Look-alike letters as digits, within runs of tokens made of nothing else that hold a digit."""
    return _RUN.sub(lambda m: m[0].translate(_SWAP) if any(c.isdigit() for c in m[0]) else m[0], text)


def fold_text(text: str) -> str:
    """All layers: shortcodes, compatibility form, characters, number words, look-alikes, separators."""
    if ":" in text:
        text = _SHORTCODE.sub(lambda m: SHORTCODES[m[1]], text)
    if not text.isascii():
        text = fold_chars(unicodedata.normalize("NFKC", text))
    return _BETWEEN.sub("", fold_lookalikes(fold_number_words(text)))


def disguised_digits(text: str, folded: str) -> int:
    """How many digits only appear by folding; a folded text holds no digits but ASCII ones."""
    return sum(map(folded.count, "0123456789")) - sum(map(text.count, "0123456789"))
