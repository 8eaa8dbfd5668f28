"""SQL for DuckDB that states what each registered query must return.

The statements work on one row per record cell (``cells``) instead of maps, so
they share no logic with the DataFrame code.
"""

from __future__ import annotations

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"

# source, table, key, [(record key, SQL value)] in record order
CELLS = [
    (
        "customer",
        "customer LEFT JOIN nation ON c_nationkey = n_nationkey",
        "c_custkey",
        [("ref", "c_name"), ("segment", "c_mktsegment"), ("nation", "n_name"), ("balance", "CAST(c_acctbal AS DECIMAL(18,2))::VARCHAR")],
    ),
    (
        "supplier",
        "supplier LEFT JOIN nation ON s_nationkey = n_nationkey",
        "s_suppkey",
        [("ref", "s_name"), ("nation", "n_name"), ("balance", "CAST(s_acctbal AS DECIMAL(18,2))::VARCHAR")],
    ),
    (
        "part",
        "part",
        "p_partkey",
        [("brand", "p_brand"), ("part_type", "p_type"), ("size", "p_size::VARCHAR"), ("label", "p_name")],
    ),
    (
        "orders",
        "orders",
        "o_orderkey",
        [
            ("ref", "'Customer#' || lpad(o_custkey::VARCHAR, 9, '0')"),
            ("order_date", "strftime(o_orderdate, '%Y-%m-%d')"),
            ("status", "o_orderstatus"),
            ("priority", "o_orderpriority"),
        ],
    ),
    (
        "events",
        "events",
        "event_id",
        [("user", "user_id::VARCHAR"), ("type", "event_type"), ("k", "json_extract_string(props, '$.k')")],
    ),
    (
        "documents",
        "documents",
        "doc_id",
        [
            ("ref", "text"),
            ("email", "array_to_string(regexp_extract_all(text, '[^ @\\n]+@[^ @\\n]+'), ' ')"),
            ("lang", "lang"),
            ("source", "source"),
        ],
    ),
]

# field: (kind, shard prefix, shard hash)
FIELDS = {
    "ref": ("digits", 4, 2),
    "label": ("words", 4, 1),
    "email": ("email", 4, 1),
    "order_date": ("date", 4, 1),
    "user": ("digits_any", 4, 1),
    "k": ("digits_any", 4, 1),
    "brand": ("code", 3, 0),
    "segment": ("text", 3, 0),
    "nation": ("text", 3, 0),
    "status": ("text", 3, 0),
    "type": ("text", 3, 0),
    "lang": ("text", 3, 0),
    "source": ("text", 3, 0),
}
KNOWN = ", ".join(f"'{f}'" for f in FIELDS)


def day_sql(v: str) -> str:
    return (
        f"CASE WHEN regexp_full_match({v}, '[0-9]{{2}}([./-])[0-9]{{2}}[./-][0-9]{{4}}') AND substr({v}, 3, 1) = substr({v}, 6, 1)"
        f" THEN substr({v}, 1, 2) || '.' || substr({v}, 4, 2) || '.' || substr({v}, 7, 4)"
        f" WHEN regexp_full_match({v}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')"
        f" THEN substr({v}, 9, 2) || '.' || substr({v}, 6, 2) || '.' || substr({v}, 1, 4) END"
    )


def only_digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def _cells() -> str:
    parts = []
    for source, relation, key, cells in CELLS:
        for pos, (name, value) in enumerate([("id", f"{key}::VARCHAR"), *cells]):
            parts.append(
                f"SELECT '{source}' AS st, {key}::VARCHAR AS rid, {key} + 1 AS seq, {pos} AS pos, '{name}' AS k, {value} AS v FROM {relation}"
            )
    return " UNION ALL ".join(parts)


BASE = f"""
cells AS ({_cells()}),
given AS (SELECT st, rid, seq, pos, k, trim(v, {BLANKS}) AS g FROM cells WHERE v IS NOT NULL AND v <> ''),
digits AS (SELECT *, CASE WHEN k = 'ref' THEN {only_digits('g')} END AS d FROM given),
routed AS (
  SELECT *, CASE k
    WHEN 'ref' THEN CASE WHEN length(d) BETWEEN 9 AND 14 THEN d END
    WHEN 'label' THEN CASE WHEN regexp_full_match(g, '[a-zA-Z-]+([ \\t]+[a-zA-Z-]+)+') THEN upper(g) END
    WHEN 'email' THEN CASE WHEN regexp_full_match(g, '[^ @]+@[^ @]+\\.[^ @]+') THEN lower(g) END
    WHEN 'order_date' THEN {day_sql('g')}
    WHEN 'user' THEN CASE WHEN regexp_full_match(g, '[0-9]+') THEN g END
    WHEN 'k' THEN CASE WHEN regexp_full_match(g, '[0-9]+') THEN g END
    ELSE CASE WHEN g <> '' OR k NOT IN ({KNOWN}) THEN g END END AS clean
  FROM digits
),
termed AS (
  SELECT st, rid, seq, k, clean AS term FROM routed WHERE k = 'ref' AND clean IS NOT NULL
  UNION
  SELECT st, rid, seq, k, unnest(list_distinct(regexp_extract_all(g, '[0-9]{{9,14}}'))) FROM routed WHERE k = 'ref' AND clean IS NULL
  UNION
  SELECT st, rid, seq, k, CASE k
    WHEN 'label' THEN regexp_replace(upper(g), '[ \\t]+', ' ', 'g')
    WHEN 'email' THEN lower(g)
    WHEN 'order_date' THEN coalesce({day_sql('g')}, g)
    WHEN 'user' THEN {only_digits('g')}
    WHEN 'k' THEN {only_digits('g')}
    WHEN 'brand' THEN regexp_replace(upper(g), '[ \\t]+', '', 'g')
    ELSE g END
  FROM routed WHERE k IN ({KNOWN}) AND k <> 'ref'
),
bodied AS (
  SELECT *, CASE WHEN k = 'ref' THEN {only_digits('term')} ELSE regexp_replace(lower(term), '[^a-z0-9]', '', 'g') END AS body
  FROM termed WHERE term <> ''
),
post AS (
  SELECT k AS field,
    CASE WHEN k IN ({", ".join(f"'{f}'" for f, s in FIELDS.items() if s[2] == 0)}) THEN rpad(substr(body, 1, 3), 3, '_')
      WHEN body = '' THEN '____'
      ELSE rpad(substr(body, 1, 4), 4, '_') || '~' || substr(md5(k || ':' || body), 1, CASE WHEN k = 'ref' THEN 2 ELSE 1 END) END AS shard,
    term, st || ':' || rid AS doc_id, st AS source_table, rid AS row_id, seq
  FROM bodied
),
shown AS (
  SELECT st || ':' || rid AS doc_id, st AS source_table, seq,
    CASE WHEN clean IS NULL THEN 1 ELSE 0 END AS bad, pos,
    CASE WHEN clean IS NULL THEN 'no_valid_' || k ELSE k END AS k, coalesce(clean, g) AS v
  FROM routed WHERE clean IS NOT NULL OR g <> ''
),
source_rows AS (
  SELECT st AS source_table, st || '.json' AS file_name, upper(st[1]) || st[2:] AS name,
    CASE WHEN st = 'part' THEN 'Parts on offer' END AS description,
    CASE st WHEN 'customer' THEN 'parties' WHEN 'supplier' THEN 'parties' WHEN 'part' THEN 'goods' END AS type
  FROM (VALUES ('customer'), ('supplier'), ('part'), ('orders')) t(st)
)
"""


def on_base(sql: str, more: str = "") -> str:
    return f"WITH {BASE.strip()}{more} {sql}"


IDS = "doc_id, source_table"
REF_HITS = "SELECT DISTINCT doc_id, source_table FROM post WHERE field = 'ref' AND term = '000000001'"
RANGE_HITS = "SELECT DISTINCT doc_id, source_table FROM post WHERE field = 'ref' AND term LIKE '0000001%'"
STATUS_HITS = "SELECT DISTINCT doc_id, source_table FROM post WHERE field = 'status' AND term = 'F'"


def found(hits: str) -> str:
    return f""",
hits AS ({hits}),
found AS (SELECT s.* FROM shown s JOIN hits h USING (doc_id, source_table)),
recs AS (
  SELECT doc_id, source_table, seq, string_agg(k || '=' || v, ';' ORDER BY bad, pos) AS fields FROM found GROUP BY ALL
),
heads AS (
  SELECT r.source_table, coalesce(s.name, r.source_table) AS name,
    coalesce(s.description, 'Import from file ' || s.file_name, 'Local source') AS info,
    coalesce(s.type, 'local-import') AS type, r.records
  FROM (SELECT source_table, count(*) AS records FROM recs GROUP BY 1) r LEFT JOIN source_rows s USING (source_table)
)"""


ORACLE: dict[str, str] = {}

ORACLE["postings"] = on_base("SELECT field, shard, term, doc_id, source_table, row_id FROM post")
ORACLE["search_exact"] = on_base(REF_HITS)
ORACLE["search_and"] = on_base(f"{REF_HITS} INTERSECT {STATUS_HITS}")
ORACLE["search_wildcard"] = on_base(f"SELECT DISTINCT {IDS} FROM post WHERE field = 'ref' AND term LIKE '000000_1%'")
ORACLE["search_phrase"] = on_base(f"SELECT DISTINCT {IDS} FROM post WHERE field = 'label' AND term LIKE 'SMALL%W%'")
ORACLE["search_widening"] = on_base(STATUS_HITS)
ORACLE["search_records"] = on_base("SELECT doc_id, source_table, seq, fields FROM recs", found(REF_HITS))
ORACLE["search_headers"] = on_base("SELECT source_table, name, info, type, records FROM heads", found(REF_HITS))
ORACLE["search_stream"] = on_base(
    """SELECT position, kind, source_table, doc_id, body, position // 200 AS chunk FROM (
  SELECT row_number() OVER (ORDER BY source_table, kind, seq, doc_id) - 1 AS position, * FROM (
    SELECT 'header' AS kind, source_table, NULL::BIGINT AS seq, NULL::VARCHAR AS doc_id, name || ' | ' || info || ' | ' || type AS body FROM heads
    UNION ALL SELECT 'record', source_table, seq, doc_id, fields FROM recs))""",
    found(RANGE_HITS),
)
ORACLE["search_totals"] = on_base(
    """SELECT count(*) + count(DISTINCT source_table) AS total_results, count(*) AS matched_documents,
  count(DISTINCT source_table) AS matched_sources FROM recs""",
    found(RANGE_HITS),
)
ORACLE["suggest_next"] = on_base(
    f"""SELECT field, value FROM (
  SELECT k AS field, v AS value, min((source_table, seq, pos)) AS place FROM (
    SELECT source_table, seq, k, v, row_number() OVER (PARTITION BY doc_id ORDER BY bad, pos) AS pos FROM found)
  WHERE k IN ({KNOWN}) AND v <> '' AND NOT (k = 'ref' AND v = '000000001') GROUP BY 1, 2)
ORDER BY place, field, value LIMIT 24""",
    found(REF_HITS),
)
ORACLE["facet_counts"] = on_base("SELECT k AS key, v AS value, count(*) AS n FROM found GROUP BY 1, 2", found(STATUS_HITS))
ORACLE["field_labels"] = """
SELECT p_size::VARCHAR AS key, count(*) AS n, coalesce(any_value(n_name), p_size::VARCHAR) AS label
FROM part LEFT JOIN nation ON p_size = n_nationkey GROUP BY p_size"""

ORACLE["batch_search"] = on_base(
    f"""SELECT q.query_id, p.{IDS.replace(', ', ', p.')} FROM post p JOIN (
  SELECT c_custkey AS query_id, 'ref' AS field, {only_digits('c_name')} AS term FROM customer
  UNION ALL SELECT -1 - n_nationkey, 'nation', n_name FROM nation) q USING (field, term)"""
)
ORACLE["batch_wildcard"] = on_base(
    f"""SELECT DISTINCT q.query_id, p.{IDS.replace(', ', ', p.')} FROM post p JOIN (
  SELECT n_nationkey AS query_id, 'ref' AS field, printf('%07d__', n_nationkey) AS pattern FROM nation
  UNION ALL SELECT min(p_partkey) + 1000, 'label', '%' || upper(split_part(p_name, ' ', 2)) FROM part GROUP BY 3) q
  ON p.field = q.field AND p.term LIKE q.pattern"""
)

ORACLE["batch_mixed"] = on_base(
    f"""SELECT DISTINCT q.query_id, p.{IDS.replace(', ', ', p.')} FROM post p JOIN (
  SELECT n_nationkey AS query_id, 'ref' AS field, printf('%07d__', n_nationkey) AS pattern FROM nation
  UNION ALL SELECT min(p_partkey) + 1000, 'label', '%' || upper(split_part(p_name, ' ', 2)) FROM part GROUP BY 3
  UNION ALL SELECT s_suppkey + 10000000, 'ref', {only_digits('s_name')} FROM supplier
  UNION ALL SELECT min(event_id) + 20000000, 'type', replace(event_type, '_', '\\_') FROM events GROUP BY event_type) q
  ON p.field = q.field AND p.term LIKE q.pattern ESCAPE '\\'"""
)

ORACLE["batch_infix"] = on_base(
    f"""SELECT DISTINCT q.query_id, p.{IDS.replace(', ', ', p.')} FROM post p JOIN (
  SELECT min(p_partkey) + 1000000 AS query_id, 'label' AS field, '%' || upper(substr(p_name, 3, 3)) || '_%' AS pattern FROM part GROUP BY 3
  UNION ALL SELECT min(p_partkey) + 2000000, 'brand', '_%' || substr(p_brand, 7, 1) || '%' FROM part GROUP BY 3
  UNION ALL SELECT min(event_id) + 30000000, 'type', repeat('_', length(event_type)) FROM events GROUP BY 3) q
  ON p.field = q.field AND p.term LIKE q.pattern"""
)

LINE_HITS = f""",
lines AS (
  SELECT c_custkey AS query_id, 'ref' AS field, {only_digits('c_name')} AS pattern FROM customer
  UNION ALL SELECT c_custkey, 'status', 'F' FROM customer WHERE c_acctbal >= 0
  UNION ALL SELECT c_custkey, 'order_date', '%.2001' FROM customer WHERE c_mktsegment = 'BUILDING'),
refs AS (SELECT DISTINCT l.query_id, p.doc_id, p.source_table FROM lines l JOIN post p ON l.field = 'ref' AND p.field = 'ref' AND p.term = l.pattern),
rest AS (SELECT r.*, l.field FROM refs r JOIN lines l USING (query_id) WHERE l.field <> 'ref' AND NOT EXISTS (
  SELECT 1 FROM post p WHERE p.doc_id = r.doc_id AND p.field = l.field AND p.term LIKE l.pattern)),
line_hits AS (SELECT * FROM refs ANTI JOIN rest USING (query_id, doc_id))"""
ORACLE["batch_and"] = on_base("SELECT query_id, doc_id, source_table FROM line_hits", LINE_HITS)
LINE_RECORDS = LINE_HITS + found("SELECT DISTINCT doc_id, source_table FROM line_hits")
ORACLE["batch_records"] = on_base("SELECT query_id, r.* FROM line_hits JOIN recs r USING (doc_id, source_table)", LINE_RECORDS)
ORACLE["batch_headers"] = on_base(
    """SELECT query_id, h.source_table, h.name, h.info, h.type, l.records
FROM (SELECT query_id, source_table, count(*) AS records FROM line_hits GROUP BY 1, 2) l JOIN heads h USING (source_table)""",
    LINE_RECORDS,
)

ORACLE["search_during_build"] = on_base(
    """SELECT h.*, step FROM hits h JOIN (VALUES ('wave 1 indexed', 1), ('wave 2 arrived', 1), ('wave 2 indexed', 2)) t(step, wave)
  ON wave = 2 OR source_table IN ('customer', 'orders')""",
    f", hits AS ({REF_HITS})",
)
ORACLE["index_upkeep"] = on_base(
    """SELECT field, shard, count(*) AS n, count(*) AS found FROM post
WHERE source_table <> 'orders' OR doc_id IN (SELECT 'orders:' || o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1, 2"""
)

ORACLE["shard_stats"] = on_base("SELECT field, shard, count(*) AS n FROM post GROUP BY 1, 2")
ORACLE["staged_publish"] = ORACLE["shard_stats"]
SHARDS = """,
shards AS (SELECT field, shard, count(*) AS n,
  sum(strlen(term) + strlen(doc_id) + strlen(source_table) + strlen(row_id))::BIGINT AS bytes FROM post GROUP BY 1, 2)"""
ORACLE["hot_shards"] = on_base("SELECT field, shard, n, bytes FROM shards ORDER BY n DESC, bytes DESC, field, shard LIMIT 20", SHARDS)
ORACLE["shard_profile"] = on_base(
    """SELECT field, shards, entries, mean_entries,
  CASE WHEN total < 1024 THEN total || ' B' WHEN total < 1024 * 1024 THEN printf('%.2f KB', total / 1024)
    WHEN total < 1024 * 1024 * 1024 THEN printf('%.2f MB', total / (1024 * 1024)) ELSE printf('%.2f GB', total / (1024 * 1024 * 1024)) END AS size,
  largest.shard AS largest_shard, largest.n AS largest_entries, largest.bytes AS largest_bytes
FROM (SELECT field, count(*) AS shards, sum(n)::BIGINT AS entries, floor(sum(n) / count(*) + 0.5)::BIGINT AS mean_entries,
  sum(bytes)::BIGINT AS total, max({'n': n, 'bytes': bytes, 'shard': shard}) AS largest FROM shards GROUP BY field)""",
    SHARDS,
)
ORACLE["doc_shards"] = on_base(
    "SELECT substr(md5(st || ':' || rid), 1, 3) AS shard, count(*) AS n FROM cells WHERE k = 'id' GROUP BY 1"
)
ORACLE["index_summary"] = on_base(
    """SELECT source_table, field, count(*) AS entries, count(DISTINCT doc_id) AS documents
FROM post GROUP BY ROLLUP (source_table, field)"""
)
ORACLE["sample_stats"] = """
SELECT event_type, count(*) AS samples, min(value) AS "min", max(value) AS "max",
  round(avg(value), 4) AS mean, round(median(value), 4) AS median FROM events GROUP BY 1"""

DATED = """CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN strftime(o_orderdate, '%d.%m.%Y') WHEN '2' THEN strftime(o_orderdate, '%d/%m/%Y')
  WHEN '3' THEN strftime(o_orderdate, '%d-%m-%Y') WHEN '4' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y/%m/%d') END"""
TYPED = f"""typed AS (
  SELECT 'ref' AS field, c_custkey AS row, ' +' || substr(c_name, 10, 3) || '-' || substr(c_name, 13, 6) AS value FROM customer
  UNION ALL SELECT 'label', p_partkey, ' ' || replace(p_name, ' ', '  ') || chr(9) FROM part
  UNION ALL SELECT 'brand', o_orderkey, lower(o_orderpriority) FROM orders
  UNION ALL SELECT 'order_date', o_orderkey, {DATED} FROM orders
  UNION ALL SELECT 'email', c_custkey, replace(c_name, '#', '.') || '@Mail.Example.COM' FROM customer
  UNION ALL SELECT 'user', event_id, 'u' || user_id FROM events
  UNION ALL SELECT 'type', event_id, event_type FROM events
  UNION ALL SELECT 'k', event_id, 'k ' || json_extract_string(props, '$.k') FROM events
  UNION ALL SELECT 'segment', c_custkey, lower(c_mktsegment) || '!' FROM customer
  UNION ALL SELECT 'nation', n_nationkey, chr(10) || n_name FROM nation
  UNION ALL SELECT 'status', o_orderkey, o_orderstatus || '?' FROM orders
  UNION ALL SELECT 'lang', doc_id, lang FROM documents
  UNION ALL SELECT 'source', doc_id, ' ' || source FROM documents)"""
TERM = f"""CASE field WHEN 'ref' THEN {only_digits('v')} WHEN 'user' THEN {only_digits('v')} WHEN 'k' THEN {only_digits('v')}
  WHEN 'label' THEN regexp_replace(upper(v), ' +', ' ', 'g') WHEN 'brand' THEN replace(upper(v), ' ', '')
  WHEN 'email' THEN lower(v) WHEN 'order_date' THEN coalesce({day_sql('v')}, v) ELSE v END"""
ORACLE["norm_terms"] = f"WITH {TYPED} SELECT field, row, {TERM} AS term FROM (SELECT *, trim(value, {BLANKS}) AS v FROM typed)"
ORACLE["norm_date"] = f"""
SELECT o_orderkey, given, CASE WHEN substr(o_orderpriority, 1, 1) < '5' THEN strftime(o_orderdate, '%d.%m.%Y') END AS day,
  CASE WHEN substr(o_orderpriority, 1, 1) < '5' THEN strftime(o_orderdate, '%Y-%m-%d') END AS calendar_day
FROM (SELECT *, {DATED} AS given FROM orders)"""
ORACLE["extract_numbers"] = """
SELECT doc_id, count(run) AS found, coalesce(string_agg(run, ',' ORDER BY nth), '') AS runs FROM (
  SELECT doc_id, run, min(nth) AS nth FROM (
    SELECT doc_id, unnest(runs) AS run, unnest(range(len(runs))) AS nth
    FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]{9,14}') AS runs FROM documents))
  GROUP BY 1, 2
  UNION ALL SELECT doc_id, NULL, NULL FROM documents) GROUP BY 1"""
ORACLE["query_terms"] = f"""
WITH {TYPED}, asked AS (
  SELECT field, row, trim(value, {BLANKS}) AS v FROM typed
  UNION ALL SELECT field, row, trim(replace(value, '1', '?') || '_%', {BLANKS}) FROM typed WHERE field IN ('ref', 'email')),
termed AS (SELECT field, row, CASE WHEN field IN ('ref', 'user', 'k') THEN regexp_replace(v, '[^0-9?%]', '', 'g')
  WHEN field = 'label' THEN regexp_replace(upper(v), ' +', '%', 'g') || '%' ELSE {TERM} END AS term FROM asked)
SELECT field, row, term, contains(term, '?') OR contains(term, '%') AS wildcard, regexp_extract(term, '^[^?%]+') AS prefix,
  replace(replace(replace(term, '\\', '\\\\'), '_', '\\_'), '?', '_') AS pattern FROM termed WHERE term <> ''"""
ORACLE["sanitize_terms"] = f"""
WITH {TYPED}, cut AS (SELECT field, row, CASE field
  WHEN 'ref' THEN substr(regexp_replace(value, '[^0-9?%]', '', 'g'), 1, 15)
  WHEN 'user' THEN regexp_replace(value, '[^0-9?%]', '', 'g')
  WHEN 'k' THEN regexp_replace(value, '[^0-9?%]', '', 'g')
  WHEN 'label' THEN substr(regexp_replace(value, '[^a-zA-Z ?%]', '', 'g'), 1, 255)
  WHEN 'brand' THEN substr(regexp_replace(value, '[^a-zA-Z0-9?%]', '', 'g'), 1, 17)
  WHEN 'order_date' THEN substr(regexp_replace(value, '[^0-9.?%]', '', 'g'), 1, 10)
  WHEN 'email' THEN value ELSE regexp_replace(value, '[^a-zA-Z0-9?%]', '', 'g') END AS value FROM typed),
dot AS (SELECT field, row, CASE WHEN field = 'order_date' AND length(value) > 2 AND value[3] <> '.'
  THEN value[1:2] || '.' || value[3:] ELSE value END AS value FROM cut)
SELECT field, row, CASE WHEN field = 'order_date' AND length(value) > 5 AND value[6] <> '.'
  THEN value[1:5] || '.' || value[6:] ELSE value END AS value FROM dot"""
ORACLE["validate_queries"] = f"""
WITH {TYPED} SELECT field, row, CASE WHEN contains(v, '?') OR contains(v, '%') THEN true
  WHEN field = 'ref' THEN regexp_full_match(v, '\\+?[0-9]{{8,15}}') WHEN field = 'email' THEN regexp_full_match(v, '[^ @]+@[^ @]+\\.[^ @]+')
  ELSE true END AS acceptable FROM (SELECT *, trim(value, {BLANKS}) AS v FROM typed)"""

ORACLE["shape_name"] = "SELECT p_partkey + 1 AS seq, p_name AS label, 'id,brand,part_type,size,label' AS keys FROM part"
ORACLE["route_fields"] = on_base(
    """SELECT source_table, seq, coalesce(string_agg(k || '=' || v, ';' ORDER BY pos) FILTER (bad = 0), '') AS fields,
  count(*) FILTER (bad = 1) AS invalid_fields,
  md5(coalesce(string_agg(k || '=' || v, ';' ORDER BY pos) FILTER (bad = 1), '')) AS invalid_md5
FROM shown GROUP BY source_table, seq"""
)

LINES = """lined AS (
  SELECT l_orderkey, 'order_' || l_orderkey || '.json' AS file_name, o_orderpriority, l_partkey, l_suppkey, l_returnflag,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag) AS seq
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
ORACLE["ingest_layouts"] = f"""
WITH {LINES} SELECT file_name, seq, l_partkey::VARCHAR AS part, CASE WHEN o_orderpriority < '3' THEN 'a}} {{b' ELSE 'ab' END AS note FROM lined"""
ORACLE["file_record_counts"] = f"WITH {LINES} SELECT file_name, count(*) AS records FROM lined GROUP BY 1"
ORACLE["doc_ids"] = f"""
WITH {LINES} SELECT source_table || ':' || row_id AS doc_id, source_table, row_id, seq FROM (
  SELECT 'order_' || l_orderkey AS source_table, CASE WHEN l_returnflag = 'A' THEN l_suppkey ELSE seq END::VARCHAR AS row_id, seq FROM lined)"""
ORACLE["json_fields"] = """
SELECT event_id, array_to_string(json_keys(props), ',') AS keys, json_extract_string(props, '$.k') AS k,
  list_contains(json_keys(props), 'k') AS has_k, '{"k":"' || json_extract_string(props, '$.k') || '"}' AS props FROM events"""
ORACLE["ingest_scan"] = "SELECT c_custkey::VARCHAR AS id, c_name AS ref, c_mktsegment AS segment, c_nationkey::VARCHAR AS nation FROM customer"
ORACLE["ingest_jsonl"] = ORACLE["ingest_scan"]

ORACLE["byte_offsets"] = """
SELECT file_name, seq, (sum(size + 1) OVER (PARTITION BY file_name ORDER BY seq) - size - 1)::BIGINT AS byte_offset, size AS byte_length FROM (
  SELECT 'orders_' || o_orderstatus || '.jsonl' AS file_name, o_orderkey AS seq,
    strlen('{"id": ' || o_orderkey || ', "priority": "' || o_orderpriority || '"}') AS size FROM orders)"""
ORACLE["segment_plan"] = """
WITH RECURSIVE sized AS (SELECT lang || '.jsonl' AS file_name, doc_id AS seq, strlen(text) + 1 AS bytes,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS nth FROM documents),
packed AS (
  SELECT file_name, seq, bytes, nth, 1::BIGINT AS segment, bytes AS used FROM sized WHERE nth = 1
  UNION ALL
  SELECT s.file_name, s.seq, s.bytes, s.nth, p.segment + CASE WHEN p.used + s.bytes > 40000 THEN 1 ELSE 0 END,
    CASE WHEN p.used + s.bytes > 40000 THEN s.bytes ELSE p.used + s.bytes END
  FROM packed p JOIN sized s ON s.file_name = p.file_name AND s.nth = p.nth + 1)
SELECT file_name, seq, bytes, segment, (sum(bytes) OVER (PARTITION BY file_name, segment))::BIGINT AS segment_bytes,
  replace(file_name, '.jsonl', '') || '_part_' || lpad(segment::VARCHAR, 4, '0') || '.jsonl' AS part_name FROM packed"""
MANIFESTS = """feeds AS (SELECT c_name || '.jsonl' AS file_name, * FROM orders JOIN customer ON o_custkey = c_custkey),
old AS (SELECT file_name, sum(strlen(o_orderpriority))::BIGINT AS size, max(o_orderdate) AS mtime FROM feeds
  WHERE o_orderdate < TIMESTAMP '2001-06-01' GROUP BY 1),
new AS (SELECT file_name, sum(strlen(o_orderpriority))::BIGINT AS size, max(o_orderdate) AS mtime FROM feeds WHERE c_acctbal >= 0 GROUP BY 1),
diff AS (SELECT coalesce(o.file_name, n.file_name) AS file_name, o.size AS old_size, n.size AS size,
  CASE WHEN o.file_name IS NULL THEN 'new' WHEN n.file_name IS NULL THEN 'removed'
    WHEN o.size = n.size AND o.mtime = n.mtime THEN 'unchanged' ELSE 'changed' END AS state
  FROM old o FULL JOIN new n ON o.file_name = n.file_name)"""
ORACLE["manifest_diff"] = f"WITH {MANIFESTS} SELECT * FROM diff"
ORACLE["build_mode"] = f"""
WITH {MANIFESTS}, c AS (SELECT count(*) FILTER (state = 'new') AS new, count(*) FILTER (state = 'changed') AS changed,
  count(*) FILTER (state = 'removed') AS removed, count(*) FILTER (state = 'unchanged') AS unchanged FROM diff)
SELECT CASE WHEN changed + removed > 0 THEN 'full' WHEN new > 0 THEN 'incremental' ELSE 'noop' END AS mode, * FROM c"""
ORACLE["stage_check"] = f"""
WITH {MANIFESTS} SELECT moved = 0 AND missing = 0 AS allowed, moved, missing FROM (
  SELECT (SELECT count(*) FROM diff WHERE state <> 'unchanged') AS moved,
    (SELECT count(*) FROM old WHERE file_name NOT IN (SELECT file_name FROM new)) AS missing)"""

ORACLE["source_names"] = """
WITH files AS (SELECT p_partkey AS file_no, p_name || '.json' AS file_name, replace(p_name, ' ', '_') AS base FROM part),
existing AS (SELECT DISTINCT replace(p_name, ' ', '_') AS base FROM part WHERE p_size = 1
  UNION SELECT DISTINCT replace(p_name, ' ', '_') || '_3' FROM part WHERE p_size = 2),
placed AS (SELECT f.*, row_number() OVER (PARTITION BY f.base ORDER BY file_no) + (e.base IS NOT NULL)::INT AS place
  FROM files f LEFT JOIN existing e ON f.base = e.base),
free AS (SELECT base, n, row_number() OVER (PARTITION BY base ORDER BY n) + 1 AS place FROM (
  SELECT base, unnest(range(2, 3 + count(*))) AS n FROM files GROUP BY base)
  WHERE base || '_' || n NOT IN (SELECT base FROM existing UNION SELECT base FROM files))
SELECT file_no, file_name, CASE WHEN place = 1 THEN p.base ELSE p.base || '_' || n END AS source_table
FROM placed p LEFT JOIN free USING (base, place)"""
ORACLE["export_sheet_names"] = """
WITH groups AS (SELECT p_partkey, p_name || ' / ' || p_type || ' [all] of the year' AS title FROM part),
based AS (SELECT *, substr(regexp_replace(title, '[/\\\\?*\\[\\]:]', '_', 'g'), 1, 31) AS base FROM groups),
placed AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) > 1 AS again FROM based),
numbered AS (SELECT *, '_' || sum(again::INT) OVER (PARTITION BY substr(base, 1, 24) ORDER BY p_partkey) AS suffix FROM placed)
SELECT p_partkey, title, CASE WHEN again THEN substr(base, 1, 31 - length(suffix)) || suffix ELSE base END AS sheet_name FROM numbered"""
ORACLE["source_rows"] = """
WITH files AS (SELECT o_custkey AS key, count(*) AS documents_imported FROM orders GROUP BY 1)
SELECT printf('Feed %09d.json', key) AS file_name, printf('Feed_%09d', key) AS source_table, documents_imported,
  coalesce(s_name, 'Feeds (' || printf('Feed_%09d', key) || ')') AS name,
  'Imported from file ' || printf('Feed %09d.json', key) AS description,
  CASE WHEN s_acctbal > 0 THEN 'supplier' ELSE 'feed' END AS type
FROM files LEFT JOIN supplier ON key = s_suppkey"""
ORACLE["sources_upsert"] = """
SELECT coalesce(s.key, c.key) AS source_table, CASE WHEN s.key IS NULL THEN c_name WHEN s_nationkey < 5 THEN lower(s_name) ELSE s_name END AS name,
  coalesce(s_nationkey, c_nationkey) AS nation
FROM (SELECT substr(c_name, 10) AS key, * FROM customer) c FULL JOIN (SELECT substr(s_name, 10) AS key, * FROM supplier) s ON c.key = s.key"""

FEEDS = """feeds AS (SELECT o_custkey, count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last
  FROM orders GROUP BY 1),
cat AS (SELECT 'feed_' || c_custkey AS name_table, CASE WHEN c_acctbal >= 0 THEN c_name ELSE 'feed_' || c_custkey END AS name,
  'Import from file ' || c_name || '.json' AS info, '' AS country, c_nationkey::VARCHAR AS access_level, coalesce(n, 0)::VARCHAR AS count,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'local-import' ELSE c_mktsegment END AS type,
  CASE WHEN c_acctbal >= 0 THEN 'true' ELSE 'false' END AS trust, coalesce(last, '') AS updated_at, coalesce(first, '') AS created_at,
  coalesce(last, '') AS relevance_date, CASE WHEN c_acctbal >= 0 THEN 'false' ELSE 'true' END AS search_email
  FROM customer LEFT JOIN feeds ON c_custkey = o_custkey)"""
ORACLE["catalog_rows"] = f"""
WITH {FEEDS} SELECT *, {", ".join(f"'true' AS search_{f}" for f in FIELDS if f != "email")} FROM cat"""
ORACLE["catalog_filter"] = f"WITH {FEEDS} SELECT name_table, name, type, count FROM cat WHERE type = 'MACHINERY'"
ORACLE["catalog_sorted"] = f"WITH {FEEDS} SELECT name_table, count FROM cat ORDER BY count::BIGINT DESC, name_table"
ORACLE["catalog_totals"] = f"WITH {FEEDS} SELECT count(*) AS rows, sum(count::BIGINT)::BIGINT AS records FROM cat WHERE type = 'MACHINERY'"
ORACLE["catalog_types"] = """
SELECT DISTINCT CASE WHEN c_mktsegment = 'BUILDING' THEN 'unknown' ELSE c_mktsegment END AS type FROM customer"""
ORACLE["timeline_rows"] = f"""
WITH {FEEDS} SELECT year(day)::INT AS year, month(day)::INT AS month, day(day)::INT AS day, strftime(day, '%d.%m.%Y') AS shown_date,
  coalesce(nullif(name, ''), name_table) AS name, count::BIGINT AS records
FROM (SELECT *, updated_at::DATE AS day FROM cat WHERE updated_at <> '')"""
ORACLE["update_timeline"] = f"""
WITH {FEEDS} SELECT year(day)::INT AS year, month(day)::INT AS month, count(*) AS sources, sum(count::BIGINT)::BIGINT AS records,
  strftime(max(day), '%Y-%m-%d') AS newest FROM (SELECT *, updated_at::DATE AS day FROM cat WHERE updated_at <> '') GROUP BY 1, 2"""

ORACLE["stream_postings"] = ORACLE["postings"]
ORACLE["stream_alerts"] = on_base(
    f"""SELECT q.s_suppkey AS query_id, p.{IDS.replace(', ', ', p.')} FROM post p JOIN supplier q
  ON p.field = 'ref' AND p.term = {only_digits('q.s_name')}"""
)
ORACLE["stream_wildcard_alerts"] = on_base(
    """SELECT q.query_id, p.doc_id, p.source_table, p.field, p.term FROM post p JOIN (
  SELECT n_nationkey AS query_id, 'ref' AS field, printf('%07d__', n_nationkey) AS pattern FROM nation
  UNION ALL SELECT min(p_partkey) + 1000, 'label', '%' || upper(split_part(p_name, ' ', 2)) FROM part GROUP BY 3) q
  ON p.field = q.field AND p.term LIKE q.pattern"""
)

CELL = "CASE WHEN regexp_matches({0}, '[\",\\n]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"
ORACLE["export_rows"] = on_base(
    f"""SELECT source_table, 0 AS part, 0 AS seq, 'Source: ' || {CELL.format('name')} AS line FROM heads WHERE source_table <> 'supplier'
UNION ALL SELECT source_table, 1, 0, {CELL.format('info')} FROM heads WHERE source_table <> 'supplier'
UNION ALL SELECT source_table, 2, 0, string_agg({CELL.format('k')}, ',' ORDER BY place) FROM cols WHERE source_table <> 'supplier' GROUP BY 1
UNION ALL SELECT r.source_table, 3, r.seq, string_agg(coalesce({CELL.format('f.v')}, ''), ',' ORDER BY c.place)
  FROM recs r JOIN cols c USING (source_table) LEFT JOIN found f ON f.doc_id = r.doc_id AND f.k = c.k
  WHERE r.source_table <> 'supplier' GROUP BY r.source_table, r.doc_id, r.seq""",
    found(RANGE_HITS)
    + """,
places AS (SELECT source_table, seq, k, row_number() OVER (PARTITION BY doc_id ORDER BY bad, pos) AS nth FROM found),
cols AS (SELECT source_table, k, min((seq, nth)) AS place FROM places GROUP BY 1, 2)""",
)
ORACLE["export_text"] = on_base(
    """SELECT source_table, 0 AS part, 0 AS seq, 'Source: ' || name AS line FROM heads
UNION ALL SELECT source_table, 1, 0, info FROM heads
UNION ALL SELECT source_table, 3, seq, string_agg(k || ' = ' || v, chr(10) ORDER BY bad, pos) || chr(10) FROM found GROUP BY source_table, doc_id, seq""",
    found(RANGE_HITS),
)
ORACLE["batch_export"] = on_base(
    f"""SELECT value, source_table, 0 AS part, 0 AS seq, 'Source: ' || {CELL.format('name')} AS line FROM asked_heads
UNION ALL SELECT value, source_table, 1, 0, {CELL.format('info')} FROM asked_heads
UNION ALL SELECT value, source_table, 2, 0, string_agg({CELL.format('k')}, ',' ORDER BY place) FROM cols GROUP BY 1, 2
UNION ALL SELECT a.value, a.source_table, 3, r.seq, string_agg(coalesce({CELL.format('f.v')}, ''), ',' ORDER BY c.place)
  FROM asked a JOIN recs r USING (doc_id, source_table) JOIN cols c USING (value, source_table)
  LEFT JOIN found f ON f.doc_id = r.doc_id AND f.k = c.k GROUP BY a.value, a.source_table, r.doc_id, r.seq""",
    f""",
asked AS (SELECT DISTINCT s_name AS value, doc_id, source_table FROM post JOIN supplier ON field = 'ref' AND term = {only_digits('s_name')})"""
    + found("SELECT DISTINCT doc_id, source_table FROM asked")
    + """,
asked_heads AS (SELECT DISTINCT value, h.* FROM asked JOIN heads h USING (source_table)),
places AS (SELECT source_table, doc_id, seq, k, row_number() OVER (PARTITION BY doc_id ORDER BY bad, pos) AS nth FROM found),
cols AS (SELECT value, source_table, k, min((seq, nth)) AS place FROM places JOIN asked USING (doc_id, source_table) GROUP BY 1, 2, 3)""",
)

ORACLE["search_page"] = on_base(
    """SELECT * FROM (SELECT position, kind, source_table, doc_id, body, position // 200 AS chunk FROM (
  SELECT row_number() OVER (ORDER BY source_table, kind, seq, doc_id) - 1 AS position, * FROM (
    SELECT 'header' AS kind, source_table, NULL::BIGINT AS seq, NULL::VARCHAR AS doc_id, name || ' | ' || info || ' | ' || type AS body FROM heads
    UNION ALL SELECT 'record', source_table, seq, doc_id, fields FROM recs)))
QUALIFY position > max(position) OVER () - 200""",
    found(RANGE_HITS),
)
ORACLE["shard_drift"] = on_base(
    """SELECT field, shard, coalesce(s.n, 0) AS n, coalesce(z.bytes, 0) AS bytes
FROM (SELECT * FROM shards WHERE field IN ('label', 'brand', 'ref', 'status')) s
FULL JOIN (SELECT * FROM shards WHERE field IN ('ref', 'email', 'status', 'nation')) z USING (field, shard)""",
    SHARDS,
)
ORACLE["norm_exact"] = f"""
WITH coded AS (SELECT c_custkey, ' ' || right(repeat('7', 13) || c_custkey, 9 + length(c_mktsegment) % 5) || CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END AS given
  FROM customer)
SELECT c_custkey, field, given, CASE WHEN regexp_full_match(trim(given), digits) THEN trim(given) END AS clean, {only_digits('given')} AS term
FROM coded, (VALUES ('eleven', '[0-9]{{11}}'), ('ten_or_twelve', '[0-9]{{10}}|[0-9]{{12}}'), ('ten', '[0-9]{{10}}')) f(field, digits)"""
ORACLE["source_moments"] = """
SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN strftime(o_orderdate, '%d.%m.%Y')
    WHEN '2' THEN ' ' || strftime(o_orderdate, '%Y-%m-%d') || 'T10:20:30Z' WHEN '3' THEN strftime(o_orderdate, '%Y-%m-%d') || ' or so'
    WHEN '4' THEN 'soon' ELSE '' END AS given,
  CASE substr(o_orderpriority, 1, 1) WHEN '2' THEN strftime(o_orderdate, '%Y-%m-%d') || ' 10:20:30' WHEN '4' THEN NULL
    WHEN '5' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE strftime(o_orderdate, '%Y-%m-%d 00:00:00') END AS moment
FROM orders"""
ORACLE["catalog_by_name"] = f"""
WITH {FEEDS} SELECT row_number() OVER (ORDER BY lower(name), name_table) AS place, name_table, name FROM cat"""

ALL_HEADS = """,
all_heads AS (
  SELECT source_table, name, info, type FROM heads
  UNION ALL SELECT source_table, name, coalesce(description, 'Import from file ' || file_name), coalesce(type, 'local-import')
  FROM source_rows WHERE source_table NOT IN (SELECT source_table FROM heads)),
placed AS (SELECT *, row_number() OVER (ORDER BY source_table) AS place FROM all_heads),
frame AS (
  SELECT place, 2 AS part, '' AS line FROM placed
  UNION ALL SELECT place, 3, NULL FROM placed WHERE source_table NOT IN (SELECT source_table FROM recs)
  UNION ALL SELECT place, 5, NULL FROM placed WHERE place < (SELECT max(place) FROM placed))"""
ORACLE["export_csv_file"] = on_base(
    f"""SELECT place, 0 AS part, 0 AS seq, CASE WHEN place = 1 THEN chr(65279) ELSE '' END || 'Source: ' || {CELL.format('name')} AS line FROM placed
UNION ALL SELECT place, 1, 0, {CELL.format('info')} FROM placed
UNION ALL SELECT place, part, 0, CASE part WHEN 3 THEN '"No data"' ELSE '' END FROM frame
UNION ALL SELECT place, 3, 0, string_agg({CELL.format('k')}, ',' ORDER BY nth) FROM cols JOIN placed USING (source_table) GROUP BY 1
UNION ALL SELECT p.place, 4, r.seq, string_agg(coalesce({CELL.format('f.v')}, ''), ',' ORDER BY c.nth)
  FROM recs r JOIN placed p USING (source_table) JOIN cols c USING (source_table) LEFT JOIN found f ON f.doc_id = r.doc_id AND f.k = c.k
  GROUP BY p.place, r.doc_id, r.seq""",
    found(REF_HITS)
    + ALL_HEADS
    + """,
cells_in AS (SELECT source_table, seq, k, row_number() OVER (PARTITION BY doc_id ORDER BY bad, pos) AS nth FROM found),
cols AS (SELECT source_table, k, min((seq, nth)) AS nth FROM cells_in GROUP BY 1, 2)""",
)
ORACLE["export_text_file"] = on_base(
    """SELECT place, 0 AS part, 0 AS seq, 'Source: ' || name AS line FROM placed
UNION ALL SELECT place, 1, 0, info FROM placed
UNION ALL SELECT place, part, 0, CASE part WHEN 3 THEN 'No data' || chr(10) WHEN 5 THEN '-----------------------' || chr(10) ELSE '' END FROM frame
UNION ALL SELECT place, 4, seq, string_agg(k || ' = ' || v, chr(10) ORDER BY bad, pos) || chr(10) FROM found JOIN placed USING (source_table)
  GROUP BY place, doc_id, seq""",
    found(REF_HITS) + ALL_HEADS,
)
