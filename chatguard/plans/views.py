"""Message views over the generated tables, in SQL that more than one engine reads."""

from __future__ import annotations

BASE = 1725000000
# Numbering leaves a small table in one partition; Spark deals it anew before the costly columns, other engines read a comment.
DEAL = "/*+ REPARTITION(event_id) */"


def _check_digit(body: str, n: int) -> str:
    """SQL for the digit that completes an n-digit body; the column <body>2 holds its digits doubled and cast out."""
    terms = [f"CAST(substr({body}{'2' if (n - k) % 2 == 0 else ''}, {k}, 1) AS INT)" for k in range(1, n + 1)]
    return f"CAST((10 - ({' + '.join(terms)}) % 10) % 10 AS STRING)"


def _doubled(body: str) -> str:
    return f"translate({body}, '0123456789', '0246813579') AS {body}2"


def _words(digits: str) -> str:
    """SQL that spells the digits of a string as emoji shortcodes."""
    out = digits
    for d, name in enumerate("zero one two three four five six seven eight nine".split()):
        out = f"replace({out}, '{d}', ':{name}:')"
    return out


MSGS_DOCS = f"SELECT concat('d.', CAST(doc_id AS STRING)) AS id, source AS channel, lang AS author, CAST({BASE} + doc_id AS DOUBLE) AS sent_at, text FROM documents"
MSGS_CONV = f"SELECT concat(CAST(conv_id AS STRING), '.', CAST(turn AS STRING)) AS id, CAST(conv_id AS STRING) AS channel, role AS author, CAST({BASE} + turn * 30 AS DOUBLE) AS sent_at, text FROM conversations"

# A number after every turn: a valid card, a card with its last digit off and no other sign of one, or one that is called a card.
_number = "(conv_id * 64 + turn)"
MSGS_CONV_CARDS = f"""
SELECT id, channel, author, sent_at, n, concat(text, CASE n % 3 WHEN 0 THEN concat(' ', body, {_check_digit('body', 15)}) WHEN 1 THEN concat(' ', spoilt) ELSE concat(' card ', substr(spoilt, 1, 4), '-', substr(spoilt, 5, 4), '-', substr(spoilt, 9, 4), '-', substr(spoilt, 13)) END) AS text
FROM (SELECT *, concat(body, CAST((CAST({_check_digit('body', 15)} AS INT) + 1) % 10 AS STRING)) AS spoilt
      FROM (SELECT *, {_doubled('body')} FROM (
            SELECT concat(CAST(conv_id AS STRING), '.', CAST(turn AS STRING)) AS id, CAST(conv_id AS STRING) AS channel, role AS author, CAST({BASE} + turn * 30 AS DOUBLE) AS sent_at, text,
                   {_number} AS n, concat('4', lpad(CAST(({_number} * 7919) % 100000000000 AS STRING), 11, '0'), '731') AS body FROM conversations) c0) c1) c2"""

_card = "concat(substr(card, 1, 4), {0}, substr(card, 5, 4), {0}, substr(card, 9, 4), {0}, substr(card, 13, 4))"
_spoilt = "concat(substr(card, 1, 4), '-', substr(card, 5, 4), '-', substr(card, 9, 4), '-', substr(card, 13, 3), CAST((CAST(substr(card, 16, 1) AS INT) + 1) % 10 AS STRING))"

MSGS_EVENTS = f"""
SELECT id, event_id, channel, author, sent_at, rn, card, sin, CASE rn % 16
    WHEN 0 THEN concat('pay with ', {_card.format("' '")}, ' today')
    WHEN 1 THEN concat('parcel ', {_spoilt}, ' is late')
    WHEN 2 THEN concat('my card number ', {_spoilt})
    WHEN 3 THEN {_card.format("' xx '")}
    WHEN 4 THEN concat('sin ', substr(sin, 1, 3), ' ', substr(sin, 4, 3), ' ', substr(sin, 7, 3), ' for payroll')
    WHEN 5 THEN concat('code ', substr(sin, 1, 3), ' ', substr(sin, 4, 3), ' ', substr(sin, 7, 2), CAST((CAST(substr(sin, 9, 1) AS INT) + 1) % 10 AS STRING))
    WHEN 6 THEN concat('ssn 123-45-', substr(card, 9, 4))
    WHEN 7 THEN concat('key AKIA', substr(card, 1, 16), ' rotate it')
    WHEN 8 THEN concat('iban GB82WEST', substr(card, 1, 12), ' ok')
    WHEN 9 THEN {_words("card")}
    WHEN 10 THEN concat(substr(card, 1, 4), ' ', substr(card, 5, 4))
    WHEN 11 THEN concat(substr(card, 9, 4), ' ', substr(card, 13, 4))
    WHEN 12 THEN 'that card is the one above'
    WHEN 13 THEN 'see you all at lunch then'
    WHEN 14 THEN concat('order ', CAST(event_id AS STRING), ' of 2024')
    ELSE concat('call 555-0', substr(card, 3, 3)) END AS text
FROM (SELECT *, concat(body, {_check_digit('body', 15)}) AS card, concat(sinbody, {_check_digit('sinbody', 8)}) AS sin
      FROM (SELECT *, {_doubled('body')}, {_doubled('sinbody')} FROM (
            SELECT {DEAL} concat('e.', CAST(event_id AS STRING)) AS id, event_id, event_type AS channel, author, CAST({BASE} + event_id * 3 AS DOUBLE) AS sent_at, rn,
                   concat('4', lpad(CAST((CAST(floor(rn / 16) AS BIGINT) * 7919 + uid * 104729 + length(event_type) * 31) % 100000000000 AS STRING), 11, '0'), '731') AS body,
                   concat('4', lpad(CAST((event_id * 7919) % 10000000 AS STRING), 7, '0')) AS sinbody
            FROM (SELECT event_id, event_type, user_id % 5 AS uid, concat('u', CAST(user_id % 5 AS STRING)) AS author,
                         row_number() OVER (PARTITION BY event_type, user_id % 5 ORDER BY event_id) - 1 AS rn
                  FROM events) e0) e1) e1b) e2"""

JOBS_EVENTS = f"""
SELECT event_id AS id, concat('k', CAST(event_id AS STRING)) AS dedupe, CASE WHEN event_id % 3 = 0 THEN 'deep' ELSE 'triage' END AS topic, user_id % 4 AS lane,
       CASE WHEN event_id % 97 = 0 THEN 'dead' WHEN event_id % 7 = 0 THEN 'queued' ELSE 'done' END AS status, CAST(event_id % 7 AS INT) AS attempts,
       CAST({BASE} + event_id % 400 AS DOUBLE) AS available_at, CAST({BASE} + event_id AS DOUBLE) AS finished_at, concat('error ', event_type) AS error FROM events"""

AUDIT_EVENTS = f"""
SELECT CAST({BASE} + event_id AS DOUBLE) AS t, concat('e.', CAST(event_id AS STRING)) AS id, event_type AS channel, concat('u', CAST(user_id % 5 AS STRING)) AS author,
       CASE WHEN event_id % 11 = 0 THEN 'mask' WHEN event_id % 13 = 0 THEN 'block' WHEN event_id % 17 = 0 THEN 'warn' ELSE 'allow' END AS action,
       CASE WHEN event_id % 4 = 0 THEN concat('m', CAST(event_id % 3 AS STRING)) END AS model,
       CASE WHEN event_id % 11 = 0 THEN 'CREDIT_CARD' WHEN event_id % 13 = 0 THEN 'CA_SIN' END AS entity,
       CASE WHEN event_id % 8 = 0 THEN CAST(event_id % 900 AS INT) END AS total_tokens, CAST(event_id % 50 AS DOUBLE) AS ms FROM events"""
