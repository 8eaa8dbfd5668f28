"""DuckDB SQL of those queries that SQL can express."""

ORACLE: dict[str, str] = {}

#: Shingle sets as lists, linked when they share enough, and the smallest reachable id.
ORACLE["op8_near_duplicates"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
    FROM words
),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
repeated AS (
    SELECT * FROM shingles WHERE x IN (SELECT x FROM shingles GROUP BY x HAVING count(*) > 1)
),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM repeated a JOIN repeated b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id
    HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
),
reach AS (
    SELECT a AS node, a AS seen FROM links
    UNION
    SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a
),
least AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(l.component, s.doc_id) AS component_id,
    coalesce(l.component, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN least l ON l.node = s.doc_id
"""

#: Turns from the first one that holds the end mark are escaped; each escape adds a character.
ORACLE["op3_chat_format"] = r"""
WITH given AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
turns AS (
    SELECT *, row_number() OVER w AS place,
        max(CASE WHEN contains(text, '</s>') THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) = 1 AS escaped
    FROM given WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(11 + length(role) + length(text) + CASE WHEN escaped
        THEN length(text) - length(translate(text, '<[\', '')) ELSE 0 END) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

ORACLE["op9_top_k"] = r"""
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
    FROM whole a JOIN whole b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def _states(found: dict[str, list[str]]) -> str:
    """Per state the least of some ways there, each a struct of cost, audit and repaired text."""
    return "{" + ", ".join(f"'{s}': list_min([{', '.join(ways)}])" for s, ways in found.items()) + "}"


def _way(state: str, cost: object, letters: str, role: str = "", text: str = "") -> str:
    more = f"{state}.r || [{role} || ':' || {text}]" if role else f"{state}.r"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letters}', 'r': {more}}} END"


#: b, s, u, a: nothing put out yet, or a system, user or assistant turn at last.
_SPEAK = {"b": "u", "s": "u", "a": "u", "u": "a"}
_ROLE = {"u": "'user'", "a": "'assistant'"}


def _inserted(of: str) -> str:
    """At most one turn inserted: applied twice, as two may be."""
    found = {s: [f"{of}.{s}"] for s in "bsua"}
    for state, after in _SPEAK.items():
        found[after].append(_way(f"{of}.{state}", 5, "I", _ROLE[after], "''"))
    return _states(found)


def _edited(of: str) -> str:
    found = {s: [_way(f"{of}.{s}", 2, "D")] for s in "bsua"}
    free = "CASE WHEN fault IN ('blank', 'duplicate') THEN NULL ELSE {} END"
    extra = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    for state, after in _SPEAK.items():
        found[after].append(free.format(_way(f"{of}.{state}", f"1 + {extra}", "R", _ROLE[after], "text")))
    for initial, state, after in (("s", "b", "s"), ("u", "b", "u"), ("u", "s", "u"), ("u", "a", "u"), ("a", "u", "a")):
        kept = _way(f"{of}.{state}", extra, "K", "role", "text")
        found[after].append(free.format(f"CASE WHEN initial = '{initial}' THEN {kept} END"))
    return _states(found)


_BYTE = "CASE WHEN j % 8 = 0 THEN ascii(substr(key, CAST(j // 8 + 1 AS BIGINT), 1)) ELSE 0 END"
_WAY = "STRUCT(c BIGINT, a VARCHAR, r VARCHAR[])"

#: The rows of a conversation one after another, with the cheapest way to each state.
ORACLE["op11_conversation_repair"] = rf"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
    FROM conversations
),
marked AS (
    SELECT *, xor(list_reduce(range(8 * length(key)), lambda sum, j: xor(xor(sum, {_BYTE}) >> 1,
            CASE WHEN xor(sum, {_BYTE}) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295::BIGINT),
        4294967295) % 20 AS kind
    FROM keyed
),
damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM marked, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copies(copy)
),
placed AS (
    SELECT *, row_number() OVER w AS i, role[1] AS initial, lag(role[1]) OVER w AS earlier_initial
    FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
),
faulty AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen FROM placed)
),
counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (earlier_initial IS NOT NULL AND earlier_initial || initial NOT IN ('su', 'ua', 'au')) AS illegal,
        count(*) AS n
    FROM faulty GROUP BY conv_id
),
steps AS (
    SELECT conv_id, 0::BIGINT AS i, {{'b': {{'c': 0, 'a': '', 'r': []}}::{_WAY}, 's': NULL::{_WAY}, 'u': NULL::{_WAY}, 'a': NULL::{_WAY}}} AS dp
    FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT conv_id, i, {_edited('two')} AS dp FROM (
        SELECT *, {_inserted('one')} AS two FROM (
            SELECT f.*, {_inserted('s.dp')} AS one
            FROM steps s JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1))
),
ended AS (
    SELECT conv_id, list_min([dp.b, dp.a, {_way('dp.u', 5, 'I', "'assistant'", "''")},
        {_way('dp.s', 10, 'II', "'user:' || chr(10) || 'assistant'", "''")}]) AS best
    FROM steps s LEFT JOIN counted c USING (conv_id) WHERE s.i = coalesce(c.n, 0)
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit,
    sha256(array_to_string(best.r, chr(10))) AS repaired_sha256
FROM ended LEFT JOIN counted USING (conv_id)
"""
