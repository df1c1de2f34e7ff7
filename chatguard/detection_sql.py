"""Detection and decisions over the message views in SQL: an independent statement of the rules for comparison.

The SQL covers texts of ASCII letters, digits and signs, as the views hold: shortcodes and English unit words fold,
other number words, look-alikes and scripts do not occur there.
"""

from __future__ import annotations

from chatguard.functions.folding import TEENS, TENS, UNITS
from chatguard.plans import views as V

_UNITS = "zero one two three four five six seven eight nine".split()
_CARD_WORD = r"(?i)\b(card|cc|visa|master ?card|amex|credit|debit|digits|number|num|exp|cvv|cvc|payment)\b"
_SIN_WORD = r"(?i)\b(sin|social insurance|t4|payroll|digits|number)\b"


def luhn(x: str) -> str:
    """SQL for whether the digit string x passes the mod-10 check."""
    doubled = "CASE WHEN i % 2 = 0 THEN CAST(c AS INT) * 2 - (CASE WHEN CAST(c AS INT) > 4 THEN 9 ELSE 0 END) ELSE CAST(c AS INT) END"
    return f"(list_sum(list_transform(string_split(reverse({x}), ''), lambda c, i: {doubled})) % 10 = 0)"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def _is_card(x: str) -> str:
    return f"(length({x}) BETWEEN 13 AND 19 AND left({x}, 1) IN ('3', '4', '5', '6') AND {luhn(x)})"


def _is_sin(x: str) -> str:
    return f"(length({x}) = 9 AND left({x}, 1) NOT IN ('0', '8') AND {luhn(x)})"


def folded(text: str) -> str:
    """SQL for the folded form of an ASCII text."""
    out = text
    for n, name in enumerate(_UNITS):
        out = f"replace({out}, ':{name}:', '{n}')"
    for n, name in enumerate(_UNITS):
        out = f"regexp_replace({out}, '(?i)\\b{name}\\b', '{n}', 'g')"
    for _ in range(3):
        out = f"regexp_replace({out}, '([0-9])[^0-9A-Za-z]{{1,3}}([0-9])', '\\1\\2', 'g')"
    return out


def folded_words(text: str) -> str:
    """SQL for the folded form of a text of any language: number words by a table, then signs between digits.

    Words part at all but letters, digits and the underscore. Tens with units, doubles, look-alike letters and digits
    of other scripts do not occur in the documents and are not stated.
    """
    names = {**UNITS, **TEENS, **{w: 10 * n for w, n in TENS.items()}}
    table = "MAP {" + ", ".join(f"'{w}': '{n}'" for w, n in names.items()) + "}"
    word, sign = "[\\p{L}\\p{N}_]+", "[^\\p{L}\\p{N}_]+"
    # Words and the signs before them, a word taken from the table where it stands there.
    pieces = f"list_transform(regexp_extract_all({text}, '{sign}|{word}'), lambda w: coalesce(({table})[lower(w)], w))"
    out = f"array_to_string({pieces}, '')"
    for _ in range(3):
        out = f"regexp_replace({out}, '([0-9])[^\\p{{L}}\\p{{N}}]{{1,3}}([0-9])', '\\1\\2', 'g')"
    return out


def _run_kind(t: str, body: str) -> str:
    """What a run of nine or more digits is."""
    ends = f"len(list_filter(range(13, 20), lambda n: {_is_card(f'left({t}, n)')} OR {_is_card(f'right({t}, n)')})) > 0"
    return f"CASE WHEN {_is_card(t)} THEN 'CREDIT_CARD' WHEN {_is_sin(t)} THEN 'CA_SIN' WHEN length({t}) > 19 AND regexp_matches({body}, '{_CARD_WORD}') AND {ends} THEN 'CREDIT_CARD' END"


def grouped(rows: str, name: str, column: str = "text") -> str:
    """CTEs <name>_groups, _windows and <name>: the first grouped finding (id, entity, confidence, low, high) of each row of `rows`."""
    links = f"strpos(gap, chr(10)) = 0 AND length(gap) <= 8 AND len(list_filter(string_split_regex(gap, '\\s+'), lambda w: w <> '')) < 2"
    return f"""
    {name}_parts AS (SELECT id, {column} AS body, regexp_extract_all({column}, '[0-9]+') AS ms, string_split_regex({column}, '[0-9]+') AS ss FROM {rows} WHERE len(regexp_extract_all({column}, '[0-9]+')) > 1),
    {name}_each AS (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM {name}_parts),
    {name}_groups AS (SELECT id, body, k, ms[k] AS g, ss[k] AS gap, CAST(sum(length(ss[k])) OVER w + sum(length(ms[k])) OVER w - length(ms[k]) AS BIGINT) AS low FROM {name}_each WINDOW w AS (PARTITION BY id ORDER BY k)),
    {name}_chains AS (SELECT *, CAST(sum(CASE WHEN k > 1 AND {links} THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY k) AS BIGINT) AS chain FROM {name}_groups),
    {name}_windows AS (
        SELECT a.id, a.body, a.k AS first, b.k AS last, a.low, b.low + length(b.g) AS high, c.v, c.sizes, c.gaps
        FROM {name}_chains a JOIN {name}_chains b ON a.id = b.id AND a.chain = b.chain AND b.k > a.k AND b.k - a.k < 19,
        LATERAL (SELECT string_agg(x.g, '' ORDER BY x.k) AS v, list(length(x.g) ORDER BY x.k) AS sizes, list(x.gap ORDER BY x.k) FILTER (WHERE x.k > a.k) AS gaps FROM {name}_chains x WHERE x.id = a.id AND x.k BETWEEN a.k AND b.k) c
        WHERE length(c.v) <= 19),
    {name}_kinds AS (
        SELECT *, CASE WHEN {_is_card("v")} THEN 'CREDIT_CARD'
            WHEN (sizes = [4, 4, 4, 4] OR sizes = [4, 6, 5]) AND (regexp_matches(body, '{_CARD_WORD}') OR len(list_filter(gaps, lambda x: regexp_matches(x, '\\p{{L}}'))) > 0
                OR (trim(left(body, CAST(low AS INT))) = '' AND trim(substr(body, CAST(high AS INT) + 1)) = '' AND len(list_filter(gaps, lambda x: NOT regexp_full_match(x, '[\\s-]+'))) = 0)) THEN 'CARD_LIKE' END AS entity FROM {name}_windows),
    {name} AS (SELECT id, entity, CASE entity WHEN 'CREDIT_CARD' THEN 0.9 ELSE 0.75 END AS confidence, low, high FROM {name}_kinds WHERE entity IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY first, last) = 1)"""


# Exact findings, then grouped, then folded ones; splits of the messages that nothing of this removes.
ARCHIVE = f"""
    m AS ({V.MSGS_EVENTS}),
    f AS (SELECT *, {folded("text")} AS folded FROM m),
    x AS (SELECT *, regexp_extract_all(folded, '[0-9]+') AS gr, length({_digits("folded")}) - length({_digits("text")}) AS disguised,
        list_filter([
            CASE WHEN len(list_filter(list_transform(regexp_extract_all(text, '\\b((?:[0-9][ -]?){{13,19}})\\b', 1), lambda t: {_digits("t")}), lambda t: {_is_card("t")})) > 0 THEN 'CREDIT_CARD' END,
            CASE WHEN len(list_filter(list_transform(regexp_extract_all(text, '\\b[0-9]{{3}}[ -][0-9]{{3}}[ -][0-9]{{3}}\\b|\\b[0-9]{{9}}\\b'), lambda t: {_digits("t")}), lambda t: {_is_sin("t")})) > 0 THEN 'CA_SIN' END,
            CASE WHEN len(list_filter(regexp_extract_all(text, '\\b[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}\\b'), lambda t: left(t, 3) NOT IN ('000', '666') AND left(t, 1) <> '9')) > 0 THEN 'US_SSN' END,
            CASE WHEN regexp_matches(text, '\\bAKIA[A-Z0-9]{{16}}\\b') THEN 'API_KEY' END,
            CASE WHEN regexp_matches(text, '\\b[A-Z]{{2}}[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{3,7}}\\b') THEN 'IBAN' END], lambda e: e IS NOT NULL) AS exact,
        list_filter(list_transform(regexp_extract_all(folded, '[0-9]{{9,}}'), lambda t: CASE WHEN {_is_card("t")} THEN 'CREDIT_CARD' WHEN {_is_sin("t")} THEN 'CA_SIN' END), lambda e: e IS NOT NULL) AS runs FROM f),
    {grouped("m", "gt")}, {grouped("f", "gf", "folded")},
    e AS (SELECT x.*, CASE WHEN len(exact) > 0 THEN exact WHEN gt.entity IS NOT NULL THEN [gt.entity] WHEN folded = text THEN [] WHEN len(runs) > 0 THEN runs WHEN gf.entity IS NOT NULL THEN [gf.entity] ELSE [] END AS found
        FROM x LEFT JOIN gt USING (id) LEFT JOIN gf USING (id)),
    w AS (SELECT *, list({{'i': id, 'a': sent_at, 'f': folded, 'g': gr, 'd': disguised}}) OVER (PARTITION BY channel, author ORDER BY sent_at, id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS c FROM e),
    p AS (SELECT *, list_filter(c, lambda y: sent_at - y.a <= 180) AS parts FROM w),
    q AS (SELECT *, flatten(list_transform(parts, lambda y, n: list_transform(y.g, lambda t: {{'g': t, 'n': n}}))) AS fl FROM p),
    k AS (SELECT *, unnest(range(1, len(fl))) AS first FROM q WHERE len(parts) > 1),
    l AS (SELECT *, unnest(range(2, 9)) AS n FROM k),
    s AS (SELECT *, fl[first:first + n - 1] AS sub, len(gr) = 0 AS talks FROM l WHERE first + n - 1 <= len(fl)),
    v AS (SELECT *, array_to_string(list_transform(sub, lambda y: y.g), '') AS value, list_sort(list_distinct(list_transform(sub, lambda y: y.n))) AS used,
        CASE WHEN talks THEN folded ELSE array_to_string(list_transform(parts, lambda y: y.f), ' ') END AS said FROM s),
    h AS (SELECT *, CASE
        WHEN {_is_card("value")} AND (regexp_matches(said, '{_CARD_WORD}') OR (NOT talks AND len(list_filter(used, lambda y: parts[y].d = 0 AND regexp_matches(parts[y].f, '[A-Za-z]'))) = 0)) THEN 'CREDIT_CARD'
        WHEN {_is_sin("value")} AND (regexp_matches(said, '{_SIN_WORD}') OR (NOT talks AND len(list_filter(used, lambda y: parts[y].d = 0)) = 0)) THEN 'CA_SIN' END AS split
        FROM v WHERE length(value) <= 19 AND len(used) > 1 AND list_contains(used, fl[len(fl)].n)),
    hit AS (SELECT id, split, array_to_string(list_transform(used, lambda y: parts[y].i), ',') AS related FROM h WHERE split IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY first, n) = 1),
    done AS (SELECT q.*, CASE WHEN len(found) = 0 THEN hit.split END AS split, CASE WHEN len(found) = 0 THEN hit.related END AS related,
        CASE WHEN len(found) > 0 THEN coalesce(list_filter(found, lambda y: y IN ('CA_SIN', 'US_SSN', 'API_KEY'))[1], found[1]) ELSE hit.split END AS top FROM q LEFT JOIN hit USING (id)),
    decided AS (SELECT *, CASE WHEN top IS NULL THEN 'allow' WHEN top IN ('CA_SIN', 'US_SSN', 'API_KEY') THEN 'block' ELSE 'mask' END AS action,
        CASE top WHEN 'CREDIT_CARD' THEN 'card' WHEN 'CARD_LIKE' THEN 'card.shape' WHEN 'CA_SIN' THEN 'sin' WHEN 'US_SSN' THEN 'ssn' WHEN 'API_KEY' THEN 'key' WHEN 'IBAN' THEN 'iban' ELSE '' END AS rule_id FROM done),
    asked AS (SELECT *, action = 'allow' AND trim(text) <> '' AS single,
        action = 'allow' AND len(gr) > 0 AND len(list_filter(parts[1:len(parts) - 1], lambda y: len(y.g) > 0)) > 0 AND list_sum(list_transform(parts, lambda y: length(array_to_string(y.g, '')))) >= 9 AS window_check,
        action = 'allow' AND (len(regexp_extract_all(text, ':[a-z0-9_+-]+:')) >= 8 OR disguised >= 8) AS encoded_check FROM decided)"""

def _lane() -> str:
    """The ordered lane as a recursion: one message of every author a step, the kept messages as its state."""
    fixed = ARCHIVE.split("    w AS (SELECT *, list(")[0].rstrip().rstrip(",")
    kind = f"""CASE WHEN {_is_card("c.v")} AND (regexp_matches(said, '{_CARD_WORD}') OR (NOT talks AND len(list_filter(c.u, lambda y: parts[y].d = 0 AND regexp_matches(parts[y].f, '[A-Za-z]'))) = 0)) THEN 'CREDIT_CARD'
                    WHEN {_is_sin("c.v")} AND (regexp_matches(said, '{_SIN_WORD}') OR (NOT talks AND len(list_filter(c.u, lambda y: parts[y].d = 0)) = 0)) THEN 'CA_SIN' END"""
    return f"""
    WITH RECURSIVE {fixed},
    r AS MATERIALIZED (SELECT id, channel, author, sent_at, len(found) > 0 AS removes, {{'i': id, 'a': sent_at, 'f': folded, 'g': gr, 'd': disguised}} AS own, row_number() OVER (PARTITION BY channel, author ORDER BY sent_at, id) AS n FROM e),
    lane AS (
        SELECT DISTINCT channel, author, CAST(0 AS BIGINT) AS n, [own][1:0] AS held, NULL::VARCHAR AS id, false AS removes, NULL::VARCHAR AS split, []::VARCHAR[] AS ids FROM r WHERE n = 1
        UNION ALL
        SELECT channel, author, n, CASE WHEN removes THEN mine WHEN hit IS NOT NULL THEN list_filter(mine, lambda y: NOT list_contains(ids, y.i)) ELSE (mine || [own])[-6:] END, id, removes, hit.e, ids
        FROM (
            SELECT *, CASE WHEN hit IS NULL THEN [] ELSE list_transform(hit.u, lambda y: parts[y].i) END AS ids
            FROM (
                SELECT *, CASE WHEN removes THEN NULL ELSE list_filter(list_transform(fits, lambda c: {{'e': {kind}, 'u': c.u}}), lambda c: c.e IS NOT NULL)[1] END AS hit
                FROM (
                    SELECT *, list_filter(list_transform(flatten(list_transform(range(1, len(fl)), lambda k: list_transform(range(2, 9), lambda m: {{'k': k, 'm': m}}))),
                            lambda p: {{'v': array_to_string(list_transform(fl[p.k:p.k + p.m - 1], lambda y: y.g), ''), 'u': list_sort(list_distinct(list_transform(fl[p.k:p.k + p.m - 1], lambda y: y.n))), 'in': p.k + p.m - 1 <= len(fl)}}),
                            lambda c: c.in AND length(c.v) <= 19 AND len(c.u) > 1 AND list_contains(c.u, fl[len(fl)].n)) AS fits
                    FROM (
                        SELECT *, flatten(list_transform(parts, lambda y, n: list_transform(y.g, lambda t: {{'g': t, 'n': n}}))) AS fl, len(own.g) = 0 AS talks,
                               CASE WHEN len(own.g) = 0 THEN own.f ELSE array_to_string(list_transform(parts, lambda y: y.f), ' ') END AS said
                        FROM (
                            SELECT *, mine || [own] AS parts
                            FROM (SELECT r.*, list_filter(held, lambda y: r.sent_at - y.a <= 180) AS mine FROM lane JOIN r ON r.channel = lane.channel AND r.author = lane.author AND r.n = lane.n + 1)))))))
    SELECT id, removes OR split IS NOT NULL AS removed, split AS split_entity, array_to_string(ids, ',') AS related FROM lane WHERE id IS NOT NULL"""


SQL: dict[str, str] = {
    "rules_lane": _lane(),
    "archive_scan": f"WITH {ARCHIVE} SELECT id, action, rule_id, coalesce(related, '') AS related FROM decided",
    "folded_texts": f"WITH m AS ({V.MSGS_EVENTS}) SELECT id, {folded('text')} AS folded FROM m",
    "disguises": f"WITH m AS ({V.MSGS_EVENTS}), f AS (SELECT *, {folded('text')} AS folded FROM m) SELECT id, array_to_string(regexp_extract_all(folded, '[0-9]+'), ',') AS groups, CAST(length({_digits('folded')}) - length({_digits('text')}) AS INT) AS disguised, len(regexp_extract_all(text, ':[a-z0-9_+-]+:')) >= 8 AS encoded FROM f",
    "splits": f"WITH {ARCHIVE} SELECT id, split AS entity, related FROM hit",
    "model_checks": f"WITH {ARCHIVE} SELECT id, single AND channel <> 'view' AS ask_single, window_check AND channel <> 'view' AS ask_window, encoded_check AND channel <> 'view' AS ask_encoded FROM asked",
    "model_decisions": f"""
        WITH {ARCHIVE}
        SELECT id, CASE WHEN single AND event_id % 3 = 0 THEN 'mask' ELSE action END AS action, CASE WHEN single AND event_id % 3 = 0 THEN 'email' ELSE rule_id END AS rule_id,
               CAST(single AND event_id % 3 <> 0 AS INT) + CAST(window_check AS INT) + CAST(encoded_check AS INT) AS model_errors FROM asked""",
    "document_scan": f"""
        WITH m AS ({V.MSGS_DOCS}),
        c AS (SELECT id, text, regexp_extract_all(text, '\\b((?:[0-9][ -]?){{13,19}})\\b', 1) AS ms, string_split_regex(text, '\\b(?:[0-9][ -]?){{13,19}}\\b') AS ss FROM m),
        o AS (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM c),
        placed AS (SELECT id, text, k, ms[k] AS t, CAST(sum(length(ss[k])) OVER w + sum(length(ms[k])) OVER w - length(ms[k]) AS INT) AS low FROM o WINDOW w AS (PARTITION BY id ORDER BY k)),
        d AS (SELECT *, {_digits("t")} AS v FROM placed), cards AS (SELECT * FROM d WHERE {_is_card("v")}),
        bare AS (SELECT * FROM m WHERE id NOT IN (SELECT id FROM cards)), {grouped("bare", "g")},
        fd AS (SELECT id, text, folded FROM (SELECT id, text, {folded_words("text")} AS folded FROM bare WHERE id NOT IN (SELECT id FROM g)) WHERE folded <> text),
        runs AS (SELECT id, text, folded, unnest(regexp_extract_all(folded, '[0-9]{{9,}}')) AS t, generate_subscripts(regexp_extract_all(folded, '[0-9]{{9,}}'), 1) AS k FROM fd),
        kinds AS (SELECT id, text, entity, min(k) AS k FROM (SELECT *, {_run_kind("t", "folded")} AS entity FROM runs) WHERE entity IS NOT NULL GROUP BY id, text, entity),
        again AS (SELECT id, folded AS text FROM fd WHERE id NOT IN (SELECT id FROM kinds)), {grouped("again", "h")}
        SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS INT) AS place, 'CREDIT_CARD' AS entity, low AS start,
               -- A word bound before a letter outside ASCII, where the pattern takes the separator as well.
               low + CAST(length(t) AS INT) + CASE WHEN regexp_matches(substr(text, low + CAST(length(t) AS INT) + 1, 2), '^[ -][^\\x00-\\x7F]') AND regexp_matches(substr(text, low + CAST(length(t) AS INT) + 2, 1), '\\p{{L}}') THEN 1 ELSE 0 END AS "end", 0.97::DOUBLE AS confidence, '' AS note FROM cards
        UNION ALL SELECT id, 0, entity, CAST(low AS INT), CAST(high AS INT), confidence::DOUBLE, 'grouped' FROM g
        UNION ALL SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS INT), entity, 0, CAST(length(text) AS INT), 0.9::DOUBLE, 'obfuscated' FROM kinds
        UNION ALL SELECT h.id, 0, entity, 0, CAST(length(fd.text) AS INT), confidence::DOUBLE, 'obfuscated' FROM h JOIN fd USING (id)""",
    "digit_chains": f"""
        WITH m AS ({V.MSGS_DOCS}), {grouped("m", "g")}, n AS (SELECT id, chain, count(*) AS groups, min(low) AS low, max(low + length(g)) AS high FROM g_chains GROUP BY id, chain HAVING count(*) > 1)
        SELECT id, CAST(low AS INT) AS start, CAST(high AS INT) AS "end", CAST(groups AS INT) AS groups FROM n""",
}
