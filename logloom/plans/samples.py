"""Expressions and fields of the catalog's queries, valid in Spark and in standard SQL alike.

The tables hold no `key=value` texts and hardly any control characters, so both
are derived from their columns.
"""

from __future__ import annotations

RUN_FIELDS = ["app=capture", "run=42", 'note="quoted"\ttext', "rate=12.22E+12", "gone=null"]
TYPED_FIELDS = ["env=prod", "run=42", "rate=12.5", "live=true", "release-tag=1.2.3"]

# Letters of the documents, and what stands in for them: controls of every
# escape class, DEL, quotes and backslashes. NUL is apart, because `translate`
# takes it as an order to delete the letter.
CONTROL_FROM = "aeiourstnmé"
CONTROL_TO = '\t\b\x7f\x0b\\"\x01\r\x1f\f🧪'
NUL_FROM = "l"

# Frequent letters, and the characters of an escape-heavy log in their place.
ESCAPED_FROM = "rdlumcp"
ESCAPED_TO = '"\\\n\r\t\b\f'

# One text per event: every rule of field parsing, with the event's own values.
PARSE_KV = """CASE event_id % 18
    WHEN 0 THEN concat('user=', user_id)
    WHEN 1 THEN concat('kind=', event_type)
    WHEN 2 THEN concat('props=', props)
    WHEN 3 THEN props
    WHEN 4 THEN concat('=', event_type)
    WHEN 5 THEN concat(event_type, ' =', user_id)
    WHEN 6 THEN concat(repeat(event_type, 8), '=', user_id)
    WHEN 7 THEN concat('pad=', repeat('x', CAST(user_id * 4 AS INT)))
    WHEN 8 THEN concat('expr=', event_type, '=', user_id)
    WHEN 9 THEN concat('msg=', event_type)
    WHEN 10 THEN concat('flag=', CASE WHEN user_id % 3 = 0 THEN 'TRUE'
                                      WHEN user_id % 3 = 1 THEN 'true' ELSE 'false' END)
    WHEN 11 THEN concat('rate=-0.', user_id, 'E', event_id)
    WHEN 12 THEN concat('këy=', user_id)
    WHEN 13 THEN concat('num=', user_id, '.', event_id)
    WHEN 14 THEN concat('num=', user_id, '.')
    WHEN 15 THEN concat('wide=', repeat('é', CAST(user_id * 3 AS INT)))
    WHEN 16 THEN CASE WHEN user_id % 2 = 0 THEN 'gone=null' ELSE concat('gone=0', user_id) END
    ELSE concat(' ', event_type, '= ', user_id, ' ') END"""

# One set per user: repeated keys, sets beyond the cap, and sets with a bad text.
FOLD_KV = """CASE
    WHEN user_id % 5 = 0 AND event_id % 61 = 0 THEN props
    WHEN user_id % 7 = 0 AND event_id % 83 = 0 THEN concat('k', event_id, '=')
    WHEN event_id % 3 = 0 THEN concat('k', (event_id * 7) % (10 + user_id % 40), '=', props)
    ELSE concat('k', (event_id * 7) % (10 + user_id % 40), '=', event_id) END"""

# One set per event type: few keys, and as many texts as events.
SOURCE_KV = """CASE event_id % 4
    WHEN 0 THEN concat('last_user=', user_id)
    WHEN 1 THEN concat('last-props=', props)
    WHEN 2 THEN concat('user-', user_id % 20, '=', event_id)
    ELSE concat('even=', CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END) END"""
