"""A slow, independent statement of folding, detection and splits for tests: nothing of the library is used.

Everything is enumerated by definition: all candidate stretches are listed and the first that qualifies is taken.
"""

import itertools
import re
import unicodedata

EN = "zero one two three four five six seven eight nine".split()
WORDS = dict(zip(EN, range(10))) | dict(zip("zéro un deux trois quatre cinq - sept huit neuf".split(), range(10))) | dict(zip("cero uno dos tres cuatro cinco seis siete ocho nueve".split(), range(10))) | {"une": 1}
WORDS.pop("-")
TEENS = dict(zip("ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), range(10, 20))) | {"dix": 10, "onze": 11, "douze": 12, "diez": 10, "once": 11, "doce": 12}
TENS = dict(zip("twenty thirty forty fifty sixty seventy eighty ninety".split(), range(2, 10))) | {"fourty": 4}
ALIKE = {"O": "0", "o": "0", "I": "1", "l": "1", "|": "1", "Z": "2", "S": "5", "B": "8"}
CARD_WORDS = r"(?i)\b(card|cc|visa|master ?card|amex|credit|debit|digits|number|num|exp|cvv|cvc|payment)\b"
SIN_WORDS = r"(?i)\b(sin|social insurance|t4|payroll|digits|number)\b"


def _tokens(text):
    return re.findall(r"\w+|\W", text)


def fold(text):
    for name, digit in [*zip(EN, "0123456789"), ("keycap_ten", "10"), ("100", "100"), ("1234", "1234")]:
        text = re.sub(rf":{name}(::skin-tone-\d)?:", digit, text)
    out = ""
    for c in unicodedata.normalize("NFKC", text) if not text.isascii() else text:
        if ord(c) < 128:
            out += c
        elif unicodedata.category(c) not in ("Cf", "Mn", "Me"):
            value = unicodedata.numeric(c, -1)
            digit = unicodedata.digit(c, None)
            out += str(digit) if digit is not None else str(int(value)) if value in range(21) else c
    # Number words: walk over tokens; a tens word takes the unit after white space or dashes.
    tokens, folded, k = _tokens(out), [], 0
    while k < len(tokens):
        low = tokens[k].lower()
        if low in TENS:
            j = k + 1
            while j < len(tokens) and re.fullmatch(r"[\s-]", tokens[j]):
                j += 1
            if j > k + 1 and j < len(tokens) and tokens[j].lower() in WORDS:
                folded.append(str(10 * TENS[low] + WORDS[tokens[j].lower()]))
                k = j + 1
                continue
            folded.append(str(10 * TENS[low]))
        else:
            folded.append(str(TEENS[low]) if low in TEENS else str(WORDS[low]) if low in WORDS else tokens[k])
        k += 1
    out = "".join(folded)
    for word, n in (("double", 2), ("triple", 3)):
        out = re.sub(rf"(?i)\b{word}[\s-]+(\d)", lambda m, n=n: m[1] * n, out)
    # Look-alikes: runs of neighbouring tokens, split by white space, that hold nothing else and one digit at least.
    pieces = re.split(r"(\s+)", out)
    fits = [bool(p) and set(p) <= {*ALIKE, *"0123456789"} for p in pieces]
    for low in range(0, len(pieces), 2):
        if fits[low] and (low == 0 or not fits[low - 2]):
            high = low
            while high + 2 < len(pieces) and fits[high + 2]:
                high += 2
            if any(c.isdigit() for c in "".join(pieces[low : high + 1])):
                for k in range(low, high + 1, 2):
                    pieces[k] = "".join(ALIKE.get(c, c) for c in pieces[k])
    out = "".join(pieces)
    drop = set()
    for m in re.finditer(r"(?<=\d)[\W_]+(?=\d)", out):
        if len(m[0]) <= 3:
            drop |= set(range(*m.span()))
    return "".join(c for k, c in enumerate(out) if k not in drop)


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def is_card(d):
    return 13 <= len(d) <= 19 and d[0] in "3456" and luhn(d)


def is_sin(d):
    return len(d) == 9 and d[0] not in "08" and luhn(d)


def groups(text):
    return [(m.start(), m.end()) for m in re.finditer(r"\d+", text)]


def _near(gap):
    return 0 < len(gap) <= 8 and "\n" not in gap and len(gap.split()) <= 1


def grouped(text):
    """(entity, start, end) of the first stretch of near groups that is a card or looks like one."""
    spans = groups(text)
    for i, j in itertools.combinations(range(len(spans)), 2):
        inner = spans[i : j + 1]
        gaps = [text[a[1] : b[0]] for a, b in zip(inner, inner[1:])]
        digits = "".join(text[a:b] for a, b in inner)
        if len(digits) > 19 or not all(map(_near, gaps)):
            continue
        if is_card(digits):
            return "CREDIT_CARD", inner[0][0], inner[-1][1]
        if [b - a for a, b in inner] in ([4, 4, 4, 4], [4, 6, 5]):
            rest = text[: inner[0][0]] + text[inner[-1][1] :]
            if re.search(CARD_WORDS, text) or any(c.isalpha() for g in gaps for c in g) or not rest.strip() and all(re.fullmatch(r"[\s-]+", g) for g in gaps):
                return "CARD_LIKE", inner[0][0], inner[-1][1]
    return None


def run_kind(run, context):
    if len(run) > 19:
        return "CREDIT_CARD" if context and any(is_card(x) for k in range(13, 20) for x in (run[:k], run[-k:])) else None
    return "CREDIT_CARD" if is_card(run) else "CA_SIN" if is_sin(run) else None


def find(text):
    """Entities with spans, by the cascade."""
    found = []
    rules = [
        ("CREDIT_CARD", r"\b(?:\d[ -]?){13,19}\b", lambda t: is_card(re.sub(r"\D", "", t))), ("CA_SIN", r"\b\d{3}[ -]\d{3}[ -]\d{3}\b|\b\d{9}\b", lambda t: is_sin(re.sub(r"\D", "", t))),
        ("US_SSN", r"\b\d{3}-\d{2}-\d{4}\b", lambda t: t[:3] not in ("000", "666") and t[0] != "9"), ("API_KEY", r"\bAKIA[A-Z0-9]{16}\b", lambda t: True), ("IBAN", r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}\b", lambda t: True),
    ]
    for entity, pattern, good in rules:
        for m in re.finditer(pattern, text):
            if good(m[0]) and not any(a < m.end() and m.start() < b for _, a, b in found):
                found.append((entity, m.start(), m.end()))
    if found:
        return found
    if hit := grouped(text):
        return [hit]
    folded = fold(text)
    if folded == text:
        return []
    kinds = [run_kind(folded[a:b], re.search(CARD_WORDS, folded)) for a, b in groups(folded) if b - a >= 9]
    if any(kinds):
        return [(k, 0, len(text)) for k in dict.fromkeys(filter(None, kinds))]
    hit = grouped(folded)
    return [(hit[0], 0, len(text))] if hit else []


def hidden(text):
    count = lambda t: sum(c in "0123456789" for c in t)
    return count(fold(text)) - count(text)


def split(texts):
    """(entity, indexes) of a value over several messages: all stretches of groups are tried in order."""
    folded = [fold(t) for t in texts]
    flat = [(k, f[a:b]) for k, f in enumerate(folded) for a, b in groups(f)]
    if len(texts) < 2 or len(flat) < 2:
        return None
    talks = flat[-1][0] != len(texts) - 1
    said = folded[-1] if talks else " ".join(folded)
    for i, j in itertools.combinations(range(len(flat) + 1), 2):
        used = sorted({k for k, _ in flat[i:j]})
        value = "".join(g for _, g in flat[i:j])
        if j - i > 8 or len(value) > 19 or len(used) < 2 or flat[-1][0] not in used:
            continue
        bare = all(hidden(texts[k]) or not any(c.isalpha() for c in folded[k]) for k in used)
        if is_card(value) and (re.search(CARD_WORDS, said) or not talks and bare):
            return "CREDIT_CARD", used
        if is_sin(value) and (re.search(SIN_WORDS, said) or not talks and all(hidden(texts[k]) for k in used)):
            return "CA_SIN", used
    return None


def coded(text):
    tokens = [t.lower() for t in re.findall(r":[a-zA-Z0-9_+\-]+:|[^\W\d_]+", text)]
    many = any(len(set(tokens[k : k + 13])) <= 10 for k in range(len(tokens) - 12))
    return len(re.findall(r":[a-z0-9_+\-]+:", text)) >= 8 or hidden(text) >= 8 or many
