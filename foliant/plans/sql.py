"""Fragments of the checking SQL (DuckDB)."""

from __future__ import annotations

from collections.abc import Iterable

from foliant.config import DEFAULT_SEPARATORS
from foliant.plans import inputs as I

_WS = r"[ \t\n\x0B\f\r]"
_BLANKS = "concat(' ', chr(9), chr(10), chr(13))"


def literal(text: str) -> str:
    """A string literal without raw control characters."""
    names = {"\n": "chr(10)", "\r": "chr(13)", "\t": "chr(9)"}
    parts = [names.get(c) or "'" + c.replace("'", "''") + "'" for c in text]
    return parts[0] if len(parts) == 1 else "concat(" + ", ".join(parts) + ")"


def with_ctes(ctes: Iterable[str], body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


def file_type(path: str) -> str:
    return (
        f"CASE WHEN instr({path}, '.') = 0 THEN 'unknown' "
        f"ELSE CASE lower(regexp_extract({path}, '([^.]*)\\z', 1)) "
        "WHEN 'txt' THEN 'txt' WHEN 'text' THEN 'txt' WHEN 'pdf' THEN 'pdf' "
        "WHEN 'md' THEN 'md' WHEN 'markdown' THEN 'md' WHEN 'csv' THEN 'csv' "
        "WHEN 'json' THEN 'json' WHEN 'xml' THEN 'xml' WHEN 'html' THEN 'html' "
        "WHEN 'htm' THEN 'html' ELSE 'unknown' END END"
    )


def clean_text(c: str) -> str:
    c = f"regexp_replace({c}, '  +', ' ', 'g')"
    c = f"regexp_replace({c}, '\\n\\n\\n+', concat(chr(10), chr(10)), 'g')"
    return f"trim(replace({c}, chr(13), ''), concat(' ', chr(9), chr(10)))"


def clean_pdf(c: str) -> str:
    c = f"regexp_replace({c}, '-{_WS}*\\n{_WS}*', '', 'g')"
    c = f"regexp_replace({c}, '  +', ' ', 'g')"
    c = f"regexp_replace({c}, '\\n{_WS}*[0-9]+{_WS}*\\n', concat(chr(10), chr(10)), 'g')"
    c = f"regexp_replace({c}, '([.!?]){_WS}*\\n{_WS}*([a-z])', '\\1 \\2', 'g')"
    c = f"regexp_replace({c}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')"
    c = f"regexp_replace({c}, '\\n\\n\\n+', concat(chr(10), chr(10)), 'g')"
    return f"trim({c}, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))"


def documents(text: str = "text") -> str:
    return (
        f"SELECT doc_id, source AS session, {I.SOURCE_FILE} AS source_file, {text} AS text "
        "FROM documents"
    )


def paged_documents() -> str:
    return documents(
        "array_to_string(list_transform(range(0, (length(text) - 1) // 500 + 1), "
        f"lambda i: {I.PAGE_PART}), '')"
    )


PLAIN = documents(clean_text("text"))


def routed(text: str = "text") -> str:
    """Documents cleaned by their type; ``text`` is an expression over the given text."""
    return (
        "SELECT doc_id, session, source_file, cleaned AS text, file_type FROM ("
        "SELECT *, CASE WHEN file_type = 'pdf' THEN " + clean_pdf("text") + " ELSE "
        + clean_text("text") + " END AS cleaned FROM (SELECT *, " + file_type("source_file")
        + " AS file_type FROM (" + documents(text) + ")) WHERE length(text) > 0) "
        "WHERE file_type <> 'pdf' OR strlen(cleaned) >= 50"
    )


ROUTED = routed()


def _break(s: str, size: int, separators: tuple[str, ...]) -> str:
    def last_in(window: str, sep: str) -> str:
        return (
            f"CASE WHEN instr({window}, {sep}) > 0 THEN {s} + 1 + length({window}) "
            f"- (instr(reverse({window}), reverse({sep})) - 1) END"
        )

    tries = [
        last_in(f"substr(text, {s} + 2, {size} + {len(sep)} - 1)", literal(sep))
        for sep in separators
    ]
    first = f"coalesce({', '.join(tries)}, {s} + {size})"
    space = last_in(f"substr(text, {s} + 2, {size})", "' '")
    return (
        f"CASE WHEN {s} + {size} >= n THEN n WHEN {first} = {s} + {size} "
        f"THEN coalesce({space}, {s} + {size}) ELSE {first} END"
    )


def spans(
    separators: tuple[str, ...] = DEFAULT_SEPARATORS, size: int = 1000, overlap: int = 200
) -> list[str]:
    """CTE ``w(doc_id, text, n, s, e)``: spans of the long texts of ``docs``."""
    step1 = f"SELECT *, e - least({overlap}, e - s - 1) AS ts0 FROM w WHERE e < n"
    step2 = (
        "SELECT *, ts0 - length(regexp_extract(reverse(substr(text, s + 2, ts0 - s)), "
        f"'^[^ \\n.!?\\t]*')) AS ts1 FROM ({step1})"
    )
    step3 = (
        "SELECT *, CASE WHEN substr(text, ts1 + 1, 1) IN (' ', chr(10), chr(9)) THEN ts1 + 1 "
        f"ELSE ts1 END AS ts2 FROM ({step2})"
    )
    step4 = (
        "SELECT *, greatest(s, ts2 - 100) AS lo, substr(text, greatest(s, ts2 - 100) + 2, "
        f"ts2 + 1 - greatest(s, ts2 - 100)) AS look FROM ({step3})"
    )
    step5 = (
        "SELECT *, CASE WHEN ts2 > s + 50 AND ts2 >= 100 AND regexp_matches(look, '[.!?][ \\n]') "
        "THEN lo + length(look) - length(regexp_extract(reverse(look), '(?s)^(.*?)[ \\n][.!?]', 1)) "
        f"+ 1 ELSE ts2 END AS ts3 FROM ({step4})"
    )
    step6 = (
        "SELECT doc_id, text, n, CASE WHEN ts3 <= s OR ts3 >= e THEN e ELSE ts3 END AS s "
        f"FROM ({step5})"
    )
    return [
        f"w AS (SELECT doc_id, text, n, 0::BIGINT AS s, {_break('0', size, separators)} AS e "
        f"FROM (SELECT doc_id, text, length(text) AS n FROM docs WHERE length(text) > {size}) "
        f"UNION ALL SELECT doc_id, text, n, s, {_break('s', size, separators)} AS e "
        f"FROM ({step6}))"
    ]


def pieces(size: int = 1000) -> str:
    return (
        f"pieces AS (SELECT doc_id, 0::BIGINT AS s, length(text) AS e, text AS c, true AS whole "
        f"FROM docs WHERE length(text) <= {size} UNION ALL "
        "SELECT doc_id, s, e, substr(text, s + 1, e - s), false FROM w)"
    )


def cleaned_pieces() -> str:
    a = f"SELECT *, trim(c, {_BLANKS}) AS a FROM pieces"
    b = f"SELECT *, regexp_replace(a, '\\A[.,;:)\\]][ \\t]*', '') AS b FROM ({a})"
    o = f"SELECT *, regexp_replace(b, '[ \\t]*[(\\[{{]\\z', '') AS o FROM ({b})"
    f = f"SELECT *, regexp_extract(o, '\\A([a-z][^ ]{{0,2}}) ', 1) AS f FROM ({o})"
    r = (
        "SELECT *, CASE WHEN strlen(o) > 3 AND f <> '' AND strlen(f) <= 3 "
        f"THEN regexp_replace(o, '\\A[^ ]+ ', '') ELSE o END AS r FROM ({f})"
    )
    return (
        "cleaned AS (SELECT doc_id, s, whole, CASE WHEN whole THEN c ELSE r END AS content, "
        f"CASE WHEN whole THEN 0 ELSE s + length(c) - length(ltrim(c, {_BLANKS})) + length(a) "
        f"- length(b) + length(o) - length(r) END AS start_position FROM ({r}))"
    )


def chunks(
    docs: str = PLAIN, separators: tuple[str, ...] = DEFAULT_SEPARATORS, size: int = 1000,
    overlap: int = 200,
) -> list[str]:
    """CTEs up to ``chunks``, one row per chunk of ``docs``."""
    numbered = (
        "SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) "
        "AS chunk_index FROM cleaned WHERE whole OR content <> ''"
    )
    return [
        f"docs AS ({docs})", *spans(separators, size, overlap), pieces(size), cleaned_pieces(),
        "chunks AS (SELECT concat('chunk_', md5(d.source_file), '_', c.chunk_index) AS id, "
        "c.content, d.source_file, c.chunk_index, c.start_position, "
        "c.start_position + length(c.content) AS end_position, "
        "strlen(c.content) // 4 AS token_count, "
        "lag(c.start_position + length(c.content)) OVER (PARTITION BY c.doc_id ORDER BY c.s) "
        "- c.start_position AS overlap_previous, d.doc_id, d.session "
        f"FROM ({numbered}) c JOIN docs d ON c.doc_id = d.doc_id)",
    ]


def embedded(name: str, source: str, key: str, text: str) -> list[str]:
    """CTEs ``<name>_words`` and ``<name>(key, bucket, weight)``: hashed bags of words."""
    words = (
        f"SELECT {key}, unnest(string_split(replace(replace({text}, chr(10), ' '), chr(9), ' '), "
        f"' ')) AS word FROM {source}"
    )
    return [
        f"{name}_counts AS (SELECT {key}, ('0x' || substr(md5(word), 1, 8))::BIGINT "
        f"% {I.EMBED_DIM} AS bucket, count(*) AS n FROM ({words}) WHERE word <> '' GROUP BY ALL)",
        f"{name} AS (SELECT {key}, bucket, (n / sqrt((sum(n * n) OVER (PARTITION BY {key}))"
        f"::DOUBLE))::FLOAT AS weight FROM {name}_counts)",
    ]


CHAT = [
    "paths AS (" + documents() + ")",
    "chat AS (SELECT concat('src', conv_id % 20) AS session, "
    f"concat('id_', {I.CHAT_EPOCH} * 1000, '_', turn) AS id, text AS question, answer, "
    f"make_timestamp({I.CHAT_EPOCH} * 1000000) AS ts, source_file, "
    "[concat('chunk_', md5(source_file), '_0'), concat('chunk_', md5(source_file), '_1')] "
    "AS source_chunks, conv_id * 100000 + turn AS seq, conv_id, turn FROM "
    "(SELECT conv_id, turn, role, text, lead(role) OVER p AS next_role, lead(text) OVER p AS answer "
    "FROM conversations WINDOW p AS (PARTITION BY conv_id ORDER BY turn)) t "
    "JOIN (SELECT doc_id, source_file FROM paths) d ON d.doc_id = t.conv_id "
    "WHERE role = 'user' AND next_role = 'assistant')",
]
CHAT_TIME = "strftime(ts, '%Y-%m-%d %H:%M:%S')"

SESSIONS = [
    "stored AS (SELECT session, count(DISTINCT source_file) AS n_documents, "
    "count(*) AS total_chunks FROM chunks GROUP BY session)",
    "talked AS (SELECT session, count(*) AS total_messages, min(ts) AS created_at, "
    "max(ts) AS last_modified FROM chat GROUP BY session)",
    "sessions AS (SELECT session, coalesce(n_documents, 0) AS n_documents, "
    "coalesce(total_chunks, 0) AS total_chunks, coalesce(total_messages, 0) AS total_messages, "
    "created_at, last_modified, CASE WHEN total_messages > 0 "
    "THEN concat('notes of \"', session, '\"') ELSE '' END AS description "
    "FROM stored FULL JOIN talked USING (session))",
]


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


DIRECTORIES = (
    "directories AS (SELECT concat(name, '_', strftime(ts, '%Y-%m-%d-%H%M%S')) AS directory "
    "FROM (SELECT concat('user_', user_id) AS name, date_trunc('day', ts) AS day, "
    "min(ts) AS ts FROM events GROUP BY 1, 2))"
)
