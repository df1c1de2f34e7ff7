"""Column expressions over digit strings and texts; all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatguard.functions.folding import SHORTCODES

# Context words and key prefixes.
CARD_CONTEXT = r"(?i)\b(card|cc|visa|master ?card|amex|credit|debit|digits|number|num|exp|cvv|cvc|payment)\b"
SIN_CONTEXT = r"(?i)\b(sin|social insurance|t4|payroll|digits|number)\b"
KEY_PREFIXES = ["AKIA", "ghp_", "xoxb-", "xoxp-", "xoxa-", "AIza"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digits_only(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"[^0-9]", "")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def luhn_total(digits: Column | str, shift: int = 0) -> Column:
    """Sum of digits from the right with every second one doubled; shift 1 doubles the last digit too."""

    def value(c: Column, i: Column) -> Column:
        n = c.try_cast("int")
        twice = n * 2 - F.when(n > 4, 9).otherwise(0)
        return F.when((i + shift) % 2 == 1, twice).otherwise(n)

    return F.aggregate(F.transform(_chars(F.reverse(_col(digits))), value), F.lit(0), lambda a, x: a + x)


def luhn_ok(digits: Column | str) -> Column:
    """Whether a digit string passes the mod-10 check; false for null or other characters."""
    return F.coalesce(luhn_total(digits) % 10 == 0, F.lit(False))


def luhn_complete(body: Column | str) -> Column:
    """The body with its check digit appended."""
    return F.concat(_col(body), ((10 - luhn_total(body, 1) % 10) % 10).cast("string"))


def break_luhn(digits: Column | str) -> Column:
    """The digits with the last one raised by one (9 becomes 0), which fails the check."""
    d = _col(digits)
    last = (F.right(d, F.lit(1)).try_cast("int") + 1) % 10
    return F.concat(F.left(d, F.length(d) - 1), last.cast("string"))


def group_digits(digits: Column | str, sizes: list[int], gap: str = " ") -> Column:
    """The digits in groups of the given sizes, what is left over last."""
    d, at, parts = _col(digits), 1, []
    for n in sizes:
        parts.append(F.substr(d, F.lit(at), F.lit(n)))
        at += n
    parts.append(F.substr(d, F.lit(at)))
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), gap)


def is_card(value: Column | str) -> Column:
    d = digits_only(value)
    return F.length(d).between(13, 19) & F.left(d, F.lit(1)).isin("3", "4", "5", "6") & luhn_ok(d)


def is_sin(value: Column | str) -> Column:
    d = digits_only(value)
    return (F.length(d) == 9) & ~F.left(d, F.lit(1)).isin("0", "8") & luhn_ok(d)


def is_ssn(value: Column | str) -> Column:
    d = digits_only(value)
    return (F.length(d) == 9) & ~F.left(d, F.lit(3)).isin("000", "666") & (F.left(d, F.lit(1)) != "9")


def entropy(text: Column | str) -> Column:
    """Shannon entropy in bits for each character; 0 for an empty text."""
    chars = _chars(_col(text))
    n = F.size(chars)

    def share(c: Column) -> Column:
        p = F.size(F.filter(chars, lambda x: x == c)) / n
        return p * F.log2(p)

    return F.abs(F.aggregate(F.transform(F.array_distinct(chars), share), F.lit(0.0), lambda a, x: a + x))


def is_secret(text: Column | str) -> Column:
    t = _col(text)
    strict = F.exists(F.array(*[F.lit(p) for p in KEY_PREFIXES]), lambda p: F.startswith(t, p))
    return strict | ((F.length(t) >= 20) & (entropy(t) > 3.5))


def has_card_context(text: Column | str) -> Column:
    return _col(text).rlike(CARD_CONTEXT)


def has_sin_context(text: Column | str) -> Column:
    return _col(text).rlike(SIN_CONTEXT)


def card_runs(text: Column | str) -> Column:
    """Card-shaped runs of a text with ASCII digits: the count form of the span detector."""
    return F.regexp_extract_all(_col(text), F.lit(r"\b((?:[0-9][ -]?){13,19})\b"))


def mask_text(text: Column | str, findings: Column | str, mark: str = "█") -> Column:
    """Every character of every span replaced by the mark; length stays, overlaps and ends past the text do no harm."""

    def cover(t: Column, f: Column) -> Column:
        end = F.least(f["end"], F.length(t))
        start = F.least(f["start"], end)
        return F.concat(F.left(t, start), F.repeat(F.lit(mark), end - start), F.substr(t, end + 1, F.greatest(F.length(t) - end, F.lit(0))))

    return F.aggregate(F.coalesce(_col(findings), F.array()), _col(text), cover)


def fingerprint(text: Column | str, key: str) -> Column:
    """First 16 hex digits of HMAC-SHA256 of the UTF-8 text; null text counts as empty."""
    raw = key.encode()
    if len(raw) > 64:
        import hashlib

        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    body = F.coalesce(_col(text), F.lit("")).cast("binary")
    return F.left(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body), 256))), 256), F.lit(16))


def fold_shortcodes(text: Column | str) -> Column:
    """Emoji shortcodes of digits as digits."""
    out = _col(text)
    for name, digit in SHORTCODES.items():
        out = F.regexp_replace(out, rf":{name}(?:::skin-tone-[0-9])?:", digit)
    return out


def join_digit_separators(text: Column | str) -> Column:
    """One to three characters that are no letters or digits, between two digits, removed."""
    return F.regexp_replace(_col(text), r"(?U)(?<=\d)[\W_]{1,3}(?=\d)", "")


def digit_groups(folded: Column | str) -> Column:
    return F.regexp_extract_all(_col(folded), F.lit(r"(?U)(\d+)"))
