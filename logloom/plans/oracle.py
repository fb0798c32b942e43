"""The catalog's queries as SQL over the same tables, to check the results by value."""

from __future__ import annotations

from .samples import (
    CONTROL_FROM,
    CONTROL_TO,
    ESCAPED_FROM,
    ESCAPED_TO,
    FOLD_KV,
    NUL_FROM,
    PARSE_KV,
    SOURCE_KV,
)

# Escapes with a letter. All other controls and DEL become \u00xx.
_LETTERS = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}


def escape(text: str) -> str:
    sql = "replace(replace(" + text + r""", '\', '\\'), '"', '\"')"""
    for code in [*range(32), 127]:
        short = f"\\{_LETTERS[code]}" if code in _LETTERS else f"\\u{code:04x}"
        sql = f"replace({sql}, chr({code}), '{short}')"
    return sql


def text_literal(text: str) -> str:
    """SQL text with controls spelled as chr(n)."""
    return " || ".join(f"chr({ord(char)})" for char in text)


NUMBER = r"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?"


def kind(value: str) -> str:
    return f"""CASE WHEN {value} IN ('true', 'false') THEN 'boolean'
        WHEN {value} = 'null' THEN 'null'
        WHEN regexp_full_match({value}, '{NUMBER}') THEN 'number' ELSE 'string' END"""


def rendered(value: str) -> str:
    return f"""CASE WHEN ({kind(value)}) = 'string'
        THEN '"' || {escape(value)} || '"' ELSE {value} END"""


FRONT = (
    """'{"app":"capture","run":42,"note":"\\"quoted\\"\\ttext","""
    """"rate":12.22E+12,"gone":null,"msg":"'"""
)
CONTROLS = (
    f"replace(translate(text, '{CONTROL_FROM}', {text_literal(CONTROL_TO)}), '{NUL_FROM}', chr(0))"
)


ESCAPED = f"translate(text, '{ESCAPED_FROM}', {text_literal(ESCAPED_TO)})"


def lines(text: str = "text") -> str:
    return f"""lines AS (
    SELECT doc_id, source, unnest(generate_series(0, len(parts) - 1)) AS line_no,
        unnest(parts) AS line
    FROM (SELECT doc_id, source, string_split(CASE WHEN right(t, 1) = chr(10)
            THEN left(t, length(t) - 1) ELSE t END, chr(10)) AS parts
        FROM (SELECT doc_id, source, {text} AS t FROM documents) WHERE t <> ''))"""


def pieces(size: int) -> str:
    return f"""pieces AS (
    SELECT doc_id, source, line_no, piece_no,
        substr(line, piece_no * {size} + 1, {size}) AS line
    FROM (SELECT *, unnest(generate_series(0,
            greatest((length(line) + {size - 1}) // {size} - 1, 0))) AS piece_no FROM lines))"""


def _aligned(position: str) -> str:
    def start(back: int) -> str:
        return f"substr(h, 2 * ({position} - {back}) + 1, 1) NOT IN ('8', '9', 'A', 'B')"

    return f"""CASE WHEN {position} >= n THEN n WHEN {start(0)} THEN {position}
        WHEN {start(1)} THEN {position} - 1 WHEN {start(2)} THEN {position} - 2
        ELSE {position} - 3 END"""


def byte_pieces(size: int) -> str:
    return f"""pieces AS (
    SELECT doc_id, line_no, piece_no,
        CASE WHEN n = 0 THEN '' ELSE decode(unhex(substr(h, 2 * a + 1, 2 * (b - a)))) END AS line
    FROM (SELECT *, {_aligned(f"(piece_no * {size})")} AS a,
            {_aligned(f"((piece_no + 1) * {size})")} AS b
        FROM (SELECT *, hex(encode(line)) AS h, strlen(line) AS n,
                unnest(generate_series(0,
                    greatest((strlen(line) + {size - 1}) // {size} - 1, 0))) AS piece_no
            FROM lines)))"""


def parsed(kv_sql: str) -> str:
    return f"""parsed AS (
    SELECT *, CASE WHEN error IS NULL THEN k END AS key, CASE WHEN error IS NULL THEN v END AS val
    FROM (SELECT *, CASE WHEN kv IS NULL OR eq <= 1 THEN 'EINV_FIELD_KEY'
            WHEN strlen(k) > 32 THEN 'EINV_FIELD_KEY'
            WHEN strlen(v) NOT BETWEEN 1 AND 512 THEN 'EINV_FIELD_VAL'
            WHEN NOT regexp_full_match(k, '[A-Za-z0-9_-]+') OR k = 'msg' THEN 'EINV_FIELD_KEY'
            END AS error
        FROM (SELECT *, strpos(kv, '=') AS eq, left(kv, greatest(strpos(kv, '=') - 1, 0)) AS k,
                substr(kv, strpos(kv, '=') + 1) AS v
            FROM (SELECT *, {kv_sql} AS kv FROM events))))"""


def folded(kv_sql: str, set_id: str) -> str:
    """Field sets by the rule itself: walk each set in order, with the distinct keys so far."""
    return f"""{parsed(kv_sql)},
firsts AS (
    SELECT *, CASE WHEN error IS NULL AND row_number() OVER (
        PARTITION BY {set_id}, key, error IS NULL ORDER BY event_id) = 1 THEN 1 ELSE 0
        END AS is_first FROM parsed),
seen AS (
    SELECT *, coalesce(sum(is_first) OVER (PARTITION BY {set_id} ORDER BY event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_seen FROM firsts),
walked AS (
    SELECT *, CASE WHEN n_seen >= 32 THEN 'ETOO_MANY_FIELD' ELSE error END AS failed FROM seen),
sets AS (
    SELECT {set_id}, min(event_id) FILTER (failed IS NOT NULL) AS error_pos,
        arg_min(failed, event_id) FILTER (failed IS NOT NULL) AS error
    FROM walked GROUP BY {set_id}),
accepted AS (
    SELECT w.{set_id}, key, min(event_id) AS pos, arg_max(val, event_id) AS val
    FROM walked w JOIN sets s ON w.{set_id} = s.{set_id}
    WHERE w.error IS NULL AND (s.error_pos IS NULL OR w.event_id < s.error_pos)
    GROUP BY w.{set_id}, key),
fronts AS (
    SELECT {set_id}, count(*) AS n_fields, '{{' || string_agg(
        '"' || key || '":' || {rendered("val")} || ',', '' ORDER BY pos) || '"msg":"' AS front
    FROM accepted GROUP BY {set_id})"""


# All on the hex digits of the texts: blocks of 37 bytes, lines in them, pieces of 10 bytes,
# whose cuts move back over up to three bytes that continue a character.
_H_START = "substr(h, 2 * ({0}) + 1, 1) NOT IN ('8', '9', 'A', 'B')"


def _hex_aligned(position: str) -> str:
    start = [_H_START.format(f"{position} - {back}") for back in range(3)]
    return f"""CASE WHEN {position} >= n THEN n WHEN {position} = 0 OR {start[0]} THEN {position}
        WHEN {start[1]} THEN {position} - 1 WHEN {start[2]} THEN {position} - 2
        ELSE {position} - 3 END"""


CUT_BYTES = f"""WITH blocks AS (
    SELECT doc_id, seq, substr(h, seq * 74 + 1, 74) AS h FROM (
        SELECT doc_id, hex(encode(text)) AS h,
            unnest(generate_series(0, (strlen(text) + 36) // 37 - 1)) AS seq FROM documents)),
parts AS (SELECT doc_id, seq, string_split(
        rtrim(regexp_replace(regexp_replace(h, '(..)', '\\1 ', 'g'), ' 0A $', ' ')), '0A') AS p
    FROM (SELECT doc_id, seq, CASE WHEN h = '0A' THEN '' ELSE h END AS h, h AS whole FROM blocks)),
hexed AS (SELECT doc_id, seq, unnest(generate_series(0, len(p) - 1)) AS line_no,
        replace(unnest(p), ' ', '') AS h FROM parts),
cuts AS (SELECT *, len(h) // 2 AS n,
        unnest(generate_series(0, greatest((len(h) // 2 + 9) // 10 - 1, 0))) AS piece_no FROM hexed)
SELECT doc_id, seq, line_no, piece_no, substr(h, 2 * a + 1, 2 * (b - a)) AS line_hex
FROM (SELECT *, {_hex_aligned("(piece_no * 10)")} AS a, {_hex_aligned("((piece_no + 1) * 10)")} AS b
    FROM cuts)"""


HOUR = "strftime(ts, '%Y-%m-%d %H')"
SHED_REPORT = f"""SELECT {HOUR} AS hour, count(*) AS arrived, least(count(*), 8) AS kept,
    greatest(count(*) - 8, 0) AS dropped FROM events GROUP BY 1"""
SHED = f"""SELECT hour, event_id, event_type FROM (
    SELECT {HOUR} AS hour, event_id, event_type, row_number() OVER (
        PARTITION BY {HOUR} ORDER BY ts, event_id) AS rank FROM events) WHERE rank <= 8"""
# Deliveries out of order: rows older than all earlier deliveries less ten minutes are late.
DELIVERED = f"""delivered AS (
    SELECT *, {HOUR} AS hour, CASE WHEN day(ts) > 20 THEN 3
        WHEN day(ts) > 10 OR event_id % 4 = 0 THEN 2 ELSE 1 END AS turn FROM events),
marks AS (SELECT t.turn, max(d.ts) - INTERVAL 10 MINUTE AS mark
    FROM (SELECT DISTINCT turn FROM delivered) t LEFT JOIN delivered d ON d.turn < t.turn
    GROUP BY 1),
judged AS (SELECT d.*, coalesce(d.ts < mark, false) AS late FROM delivered d JOIN marks USING (turn)),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY turn, ts, event_id)
    AS rank FROM judged WHERE NOT late) WHERE rank <= 8)"""
CAPTURED = f"WITH {lines()}, {pieces(1024)} SELECT {FRONT} || {escape('line')} || '\"}}' AS json"

# One stream in five goes on in a run of its own, one comes too late after its first third.
TIMED = """WITH chunks AS (
    SELECT doc_id % 97 AS stream_id, doc_id, coalesce(text, '') AS text,
        doc_id > (SELECT max(doc_id) // 3 FROM documents) AS rest FROM documents),
runs AS (SELECT stream_id, CASE WHEN rest AND stream_id % 5 = 0 THEN 2 ELSE 0 END AS hour,
        string_agg(text, '' ORDER BY doc_id) AS t
    FROM chunks WHERE NOT rest OR stream_id % 5 <> 1 GROUP BY 1, 2),
-- What follows the first third is a run of its own start, but for streams that had none.
begun AS (SELECT r.* REPLACE (CASE WHEN hour = 0 AND stream_id % 5 > 1 AND stream_id NOT IN
        (SELECT stream_id FROM chunks WHERE NOT rest) THEN 1 ELSE hour END AS hour) FROM runs r),
parts AS (SELECT stream_id, hour, right(t, 1) <> chr(10) AS open, string_split(
        CASE WHEN right(t, 1) = chr(10) THEN left(t, length(t) - 1) ELSE t END, chr(10)) AS p
    FROM begun WHERE t <> ''),
lines AS (SELECT stream_id, hour, open, len(p) AS n,
        unnest(generate_series(0, len(p) - 1)) AS line_no, unnest(p) AS line FROM parts),
pieces AS (SELECT *, unnest(generate_series(0, greatest((length(line) + 999) // 1000 - 1, 0)))
        AS piece_no FROM lines)
SELECT stream_id, CAST(hour AS BIGINT) AS hour, line_no, piece_no,
    substr(line, piece_no * 1000 + 1, 1000) AS line, CASE WHEN length(substr(line, piece_no * 1000 + 1, 1000)) = 1000 THEN 'size'
        WHEN open AND line_no = n - 1 THEN 'timeout' ELSE 'feed' END AS ended_by,
    CAST(NULL AS BIGINT) AS late_seq FROM pieces
UNION ALL SELECT stream_id, 0, NULL, NULL, text, 'late', doc_id
FROM chunks WHERE rest AND stream_id % 5 = 1"""

# A run of whole items at the start of an escaped text.
WHOLE_ITEMS = r"'^(?:[^\\]|\\u[0-9a-f]{4}|\\[^u])*'"


def profile(rows: str, text: str) -> str:
    return f"""SELECT source, size_class, escape_class, count(*) AS n_rows,
    CAST(sum(raw) AS BIGINT) AS bytes_raw, CAST(sum(enc) AS BIGINT) AS bytes_encoded,
    CASE WHEN sum(raw) > 0 THEN CAST(sum(enc) AS BIGINT) / CAST(sum(raw) AS BIGINT) END AS growth
FROM (SELECT source, CASE WHEN length(t) <= 128 THEN 'short' WHEN length(t) <= 512 THEN 'medium'
        ELSE 'long' END AS size_class,
        CASE WHEN esc = 0 THEN 'plain' WHEN esc * 1000 <= length(t) * 175 THEN 'escaped'
        ELSE 'highly_escaped' END AS escape_class, strlen(t) AS raw, strlen({escape("t")}) AS enc
    FROM (SELECT source, {text} AS t, length({text}) - length(regexp_replace({text},
            '[\\x00-\\x1f"\\\\\\x7f]', '', 'g')) AS esc FROM {rows}))
GROUP BY 1, 2, 3"""


def oracle_sql() -> dict[str, str]:
    split = f"WITH {lines()} SELECT doc_id, line_no, line FROM lines"
    return {
        "split_lines": split,
        "cap_lines": f"""WITH {lines()}, {pieces(1024)}
            SELECT doc_id, line_no, piece_no, line FROM pieces""",
        "cap_lines_bytes": f"""WITH {lines()}, {byte_pieces(100)}
            SELECT doc_id, line_no, piece_no, line FROM pieces""",
        "chunk_text": """SELECT doc_id, seq, substr(text, seq * 1024 + 1, 1024) AS data FROM (
            SELECT doc_id, text, unnest(generate_series(0, (length(text) + 1023) // 1024 - 1))
                AS seq FROM documents)""",
        "chunk_text_bytes": """SELECT doc_id, seq, substr(h, seq * 2048 + 1, 2048) AS data_hex
            FROM (SELECT doc_id, hex(encode(text)) AS h,
                unnest(generate_series(0, (strlen(text) + 1023) // 1024 - 1)) AS seq
            FROM documents)""",
        "reassemble_lines": split,
        "reassemble_lines_bytes": split,
        "reassemble_pieces": f"""WITH {lines()}, {pieces(200)}
            SELECT doc_id, line_no, piece_no, line FROM pieces""",
        "reassemble_without_ids": f"""WITH {lines()}, {pieces(1000)}
            SELECT CASE WHEN lang <> 'en' THEN lang END AS lang, doc_id, line_no, piece_no, line
            FROM pieces JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)""",
        "reassemble_offsets": f"""WITH whole AS (SELECT lang AS source, 0 AS doc_id,
                string_agg(text, '' ORDER BY doc_id) AS text FROM documents GROUP BY lang),
            {lines().replace("FROM documents", "FROM whole")}, {pieces(200)}
            SELECT source AS lang, line_no, piece_no, line FROM pieces""",
        "cut_bytes": CUT_BYTES,
        "reassemble_stream": f"""WITH {lines()}, {pieces(200)}
            SELECT doc_id, line_no, piece_no, line FROM pieces""",
        "reassemble_timed": TIMED,
        "parse_fields": f"WITH {parsed(PARSE_KV)} SELECT event_id, key, val, error FROM parsed",
        "type_profile": f"""WITH {parsed(PARSE_KV)},
            kinds AS (SELECT event_type, key,
                CASE WHEN val IS NOT NULL THEN {kind("val")} END AS t FROM parsed)
            SELECT event_type, key, count(t) AS n_values,
                count(*) FILTER (t = 'number') AS n_number,
                count(*) FILTER (t = 'boolean') AS n_boolean,
                count(*) FILTER (t = 'null') AS n_null,
                count(*) FILTER (t = 'string') AS n_string,
                CASE WHEN count(t) = 0 THEN NULL
                     WHEN count(DISTINCT t) FILTER (t <> 'null') = 0 THEN 'null'
                     WHEN count(DISTINCT t) FILTER (t <> 'null') = 1
                     THEN min(t) FILTER (t <> 'null') ELSE 'string' END AS common_type
            FROM kinds GROUP BY 1, 2""",
        "fold_fields": f"""WITH {folded(FOLD_KV, "user_id")}
            SELECT s.user_id, CASE WHEN s.error IS NULL THEN front END AS prefix,
                s.error, s.error_pos
            FROM sets s LEFT JOIN fronts f ON s.user_id = f.user_id""",
        "validate_field_sets": f"""WITH {folded(FOLD_KV, "user_id")}
            SELECT s.user_id, s.error IS NULL AS ok, s.error, s.error_pos,
                coalesce(n_fields, 0) AS n_fields
            FROM sets s LEFT JOIN fronts f ON s.user_id = f.user_id""",
        "inject_fields": """SELECT event_id, event_type, 'prod' AS env, CAST(42 AS BIGINT) AS run,
            CAST(12.5 AS DOUBLE) AS rate, true AS live, '1.2.3' AS "release-tag" FROM events""",
        "join_field_sets": f"""WITH {folded(SOURCE_KV, "event_type")}
            SELECT e.event_id, front || {escape("e.props")} || '"}}' AS json
            FROM events e LEFT JOIN fronts f ON e.event_type = f.event_type""",
        "join_field_sets_missing": f"""WITH {folded(SOURCE_KV, "event_type")}
            SELECT e.event_id, CASE WHEN e.event_type IN ('click', 'view') THEN '{{"msg":"'
                ELSE front END || {escape("e.props")} || '"}}' AS json,
                CASE WHEN e.event_type = 'view' THEN 'EINV_FIELD_KEY' END AS error
            FROM events e LEFT JOIN fronts f ON e.event_type = f.event_type""",
        "encode_ndjson_line_key": f"""SELECT conv_id, turn,
            '{{"msg":1,"app":"chat","line":"' || {escape("text")} || '"}}' AS json
            FROM conversations""",
        "encode_ndjson_documents": f"""WITH {lines()}
            SELECT doc_id, line_no, {FRONT} || {escape("line")} || '"}}' AS json FROM lines""",
        "encode_ndjson_pages": f"""SELECT page_id,
            {FRONT} || {escape("html")} || '"}}' AS json FROM pages""",
        "encode_ndjson_controls": f"""SELECT doc_id,
            '{{"msg":"' || {escape(CONTROLS)} || '"}}' AS json FROM documents""",
        "encode_ndjson_escaped": f"""SELECT doc_id,
            '{{"msg":"' || {escape(ESCAPED)} || '"}}' AS json FROM documents""",
        "encode_with": """SELECT conv_id, turn,
            '"chat","7","' || replace(text, '"', '""') || '"' AS record FROM conversations""",
        "truncate_encoded": f"""SELECT page_id, regexp_extract(substr({escape("html")}, 1, 256),
            {WHOLE_ITEMS}) AS encoded FROM pages""",
        "truncate_encoded_controls": f"""SELECT doc_id,
            regexp_extract(substr({escape(CONTROLS)}, 1, 99), {WHOLE_ITEMS}) AS encoded
            FROM documents""",
        "shed": SHED,
        "shed_large_capacity": """SELECT event_type, event_id FROM (
            SELECT event_type, event_id, row_number() OVER (
                PARTITION BY event_type ORDER BY ts, event_id) AS rank FROM events)
            WHERE rank <= 1500""",
        "shed_ties": """SELECT source, size, count(*) AS kept, count(DISTINCT doc_id) AS ids
            FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size) AS rank
                FROM (SELECT source, doc_id, coalesce(length(text), 0) // 500 AS size FROM documents))
            WHERE rank <= 30 GROUP BY 1, 2""",
        "shed_report": SHED_REPORT,
        "shed_stream": SHED,
        "shed_stream_report": SHED_REPORT,
        "shed_stream_late": f"WITH {DELIVERED} SELECT hour, event_id, event_type FROM kept",
        "shed_stream_late_report": f"""WITH {DELIVERED}
            SELECT d.hour, count(*) AS arrived, count(k.event_id) AS kept,
                count(*) - count(k.event_id) AS dropped, count(*) FILTER (d.late) AS late
            FROM judged d LEFT JOIN kept k ON d.event_id = k.event_id GROUP BY 1""",
        "read_lines": f"WITH {lines()} SELECT line AS value FROM lines",
        "read_records": "SELECT text AS value FROM documents",
        "stream_lines": f"WITH {lines()} SELECT line AS value FROM lines",
        "write_ndjson": f"{CAPTURED} FROM pieces",
        "write_ndjson_bytes": f"""WITH {lines()}, {pieces(1024)} SELECT count(*) AS records,
            CAST(sum(strlen('{{"doc_id":' || doc_id || ',"line_no":' || line_no || ',"piece_no":'
                || piece_no || ',"msg":"' || {escape("line")} || '"}}') + 1) AS BIGINT) AS bytes,
            CAST(0 AS BIGINT) AS files_over, CAST(0 AS BIGINT) AS unordered FROM pieces""",
        "read_places": """SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1
            AS line_no, coalesce(text, '') AS text FROM documents""",
        "capture": f"{CAPTURED} FROM pieces",
        "capture_frame": f"{CAPTURED}, doc_id, line_no, piece_no FROM pieces",
        "capture_audit": f"""WITH {lines(ESCAPED)}, {pieces(1024)},
            ins AS (SELECT source, count(*) AS n, CAST(sum(strlen(line)) AS BIGINT) AS b
                FROM lines GROUP BY 1),
            outs AS (SELECT source, count(*) AS n,
                CAST(sum(strlen({FRONT}) + strlen({escape("line")}) + 3) AS BIGINT) AS b
                FROM pieces GROUP BY 1)
            SELECT i.source, i.n AS lines, o.n AS pieces, i.b AS bytes_in, o.b AS bytes_out,
                o.b / i.b AS growth, true AS balanced
            FROM ins i JOIN outs o ON i.source = o.source""",
        "capture_ledger": f"""WITH {lines()}, {pieces(1024)}
            SELECT 'lines' AS name, count(*) AS rows, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM lines
            UNION ALL SELECT 'pieces', count(*), CAST(sum(strlen(line)) AS BIGINT) FROM pieces
            UNION ALL SELECT 'records', count(*), CAST(sum(strlen({FRONT} || {escape("line")}) + 2)
                AS BIGINT) FROM pieces""",
        "capture_sources": f"""WITH {lines()}, {pieces(1024)}
            SELECT CASE WHEN coalesce(source, '') = '' OR (doc_id % 2 = 1 AND source LIKE '%4')
                    THEN '{{"msg":"'
                ELSE '{{"origin":"' || source || '","run":' || CASE WHEN doc_id % 2 = 1 AND
                    source LIKE '%3' THEN 2 ELSE 1 END || ',"msg":"' END
                || {escape("line")} || '"}}' AS json FROM pieces""",
        "capture_digest": f"""WITH {lines()}, {pieces(1024)},
            ins AS (SELECT source, count(*) AS n, CAST(sum(strlen(line)) AS BIGINT) AS b
                FROM lines GROUP BY 1),
            outs AS (SELECT source, count(*) AS n FROM pieces GROUP BY 1),
            swapped AS (SELECT count(*) AS n FROM (SELECT 1 FROM lines
                WHERE source = 'src3' AND length(line) > 0 GROUP BY strlen(line)
                HAVING arg_min(line, (doc_id, line_no)) <> arg_max(line, (doc_id, line_no))))
            SELECT i.source, i.n AS lines, o.n AS pieces, i.b AS bytes_in,
                i.source <> 'src3' OR swapped.n = 0 AS balanced
            FROM ins i JOIN outs o ON i.source = o.source, swapped""",
        "capture_drop": f"""WITH {lines()} SELECT count(*) AS arrived,
            greatest(count(*) - 1000, 0) AS dropped, least(count(*), 1000) AS lines,
            CAST(0 AS BIGINT) AS unwritten FROM lines""",
        "written_audit": f"""WITH {lines()}, {pieces(1024)},
            front AS (SELECT *, '{{"source":"' || source || '","piece":' || piece_no || ',"msg":"' AS f,
                source = 'src3' AND doc_id % 3 = 0 AND line_no = 0 AS lost FROM pieces),
            ins AS (SELECT source, count(*) AS n, CAST(sum(strlen(line)) AS BIGINT) AS b
                FROM lines GROUP BY 1),
            outs AS (SELECT source, count(*) AS n, count(*) FILTER (piece_no = 0) AS firsts,
                CAST(sum(strlen(line)) AS BIGINT) AS m,
                CAST(sum(strlen(f) + strlen({escape("line")}) + 3) AS BIGINT) AS b
                FROM front WHERE NOT lost GROUP BY 1)
            SELECT i.source, i.n AS lines, o.n AS pieces, i.b AS bytes_in, o.b AS bytes_out,
                i.n = o.firsts AND i.b = o.m AS balanced
            FROM ins i JOIN outs o ON i.source = o.source""",
        "escape_profile": f"WITH {lines()} {profile('lines', 'line')}",
        "escape_profile_controls": profile("documents", CONTROLS),
    }
