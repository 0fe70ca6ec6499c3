"""The queries again in SQL, over the same re-labelled views."""

from __future__ import annotations

from ..model import DEFAULT_BASE_IRI
from ..operators.gold_checks import DELIVERABLES, ENUM_COVERAGE
from ..operators.gold_schema import FILES, enum_values

_W = r"[\t-\r\x1c-\x20\x85\p{Z}]"

#: The views of plans.views in SQL, by name.
VIEWS = {
    "v_chunk": """SELECT 'TMM/Part' || (conv_id % 60 + 1) || '/' || conv_id AS page_ref, 'TMM/Part' || (conv_id % 60 + 1) || '/' || conv_id || '#' || turn AS chunk_ref,
  turn::INTEGER AS ordinal, role AS kind, text, 'sha256:' || sha256(text) AS content_hash FROM conversations""",
    "v_edge": """SELECT 'TMM/Part' || (c % 60 + 1) || '/' || c AS page_ref, 'TMM/Part' || (c % 60 + 1) || '/' || c || '#' || (l_linenumber % 2) AS chunk_ref,
  CASE WHEN l_partkey % 97 = 0 THEN 'AIA1901/s7' WHEN l_returnflag = 'R' THEN 'TMR1995/r' || l_suppkey || '.' || l_linenumber
       ELSE 'TMA1995/s' || l_partkey || CASE WHEN l_linenumber > 3 THEN '(' || l_linenumber || ')' ELSE '' END END AS id,
  CASE WHEN l_linestatus = 'F' THEN 'href' ELSE 'regex' END AS extraction,
  CASE WHEN l_linestatus = 'F' THEN NULL WHEN l_linenumber % 3 = 0 THEN 'default' WHEN l_linenumber % 3 = 1 THEN 'ambiguous' ELSE 'explicit' END AS certainty
  FROM (SELECT *, l_orderkey % (SELECT max(conv_id) + 1 FROM conversations) AS c FROM lineitem)""",
    "v_prov": "SELECT 'TMA1995/s' || p_partkey AS ref, p_name AS text, 'sha256:' || sha256(p_name) AS content_hash FROM part WHERE p_partkey % 11 <> 0",
    "v_unit": """SELECT 'TMA1995/s' || p_partkey || t AS ref, p_type AS text, 'sha256:' || sha256(p_type) AS content_hash FROM (
  SELECT *, '(4)' AS t FROM part WHERE p_size > 10 UNION ALL SELECT *, '(5)' FROM part WHERE p_size > 10 UNION ALL SELECT *, '' FROM part WHERE p_partkey % 7 = 0)""",
    "v_known": "SELECT ref FROM v_prov UNION SELECT ref FROM v_unit",
    "v_gold": """SELECT l.doc_id, 'GE-' || lpad(l.doc_id::VARCHAR, 9, '0') AS id, 'TMM/Part1/' || l.doc_id || '#0' AS source_ref,
  CASE WHEN l.doc_id % 13 = 0 THEN '~' ELSE '' END || substr(text, 1, 10) AS surface, CASE WHEN l.doc_id % 23 = 0 THEN 0 ELSE 10 END AS span_end,
  'sha256:' || CASE WHEN l.doc_id % 10 = 0 THEN sha256('old') ELSE sha256(text) END AS recorded, lang AS type,
  CASE WHEN toxic <> 1 THEN 'reviewer' END AS approved_by, CASE WHEN quality <> 0 THEN '2024-01-01' END AS approved_date, quality, toxic
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "v_target": """SELECT 'TMM/Part1/' || doc_id || '#0' AS ref, CASE WHEN doc_id % 19 = 0 THEN 'page' ELSE 'chunk' END AS level,
  CASE WHEN doc_id % 19 = 0 THEN NULL ELSE text END AS text, 'sha256:' || sha256(text) AS content_hash FROM documents WHERE doc_id % 17 <> 0""",
    "v_retired": "SELECT 'GE-' || lpad(doc_id::VARCHAR, 9, '0') AS id FROM labels WHERE quality = 0",
    "v_cited": r"SELECT DISTINCT chunk_ref, page_ref FROM v_edge WHERE id = 'TMA1995/s43' OR starts_with(id, 'TMA1995/s43(') OR starts_with(id, 'TMA1995/s43~') OR starts_with(id, 'TMA1995/s43/')",
    "v_span": """SELECT g.*, t.level, t.text, t.content_hash, CASE WHEN t.ref IS NULL THEN 'lands' WHEN t.text IS NULL THEN 'no text' WHEN span_end > length(t.text) THEN 'out of bounds'
  WHEN surface <> substr(t.text, 1, span_end) THEN 'mismatch' ELSE 'lands' END AS outcome FROM v_gold g LEFT JOIN v_target t ON g.source_ref = t.ref""",
    "v_finding": """SELECT id AS subject, 'approval' AS "check", 'gap' AS severity FROM v_gold WHERE approved_by IS NULL
  UNION ALL SELECT id, 'approval', 'gap' FROM v_gold WHERE approved_date IS NULL
  UNION ALL SELECT g.id, 'ids', 'defect' FROM v_gold g JOIN v_retired r ON g.id = r.id
  UNION ALL SELECT id, 'schema', 'defect' FROM v_gold WHERE doc_id % 5 = 0 UNION ALL SELECT id, 'schema', 'defect' FROM v_gold WHERE surface = ''
  UNION ALL SELECT * FROM (VALUES {fixed})
  UNION ALL SELECT 'entities.yaml', 'completeness', 'gap' WHERE (SELECT count(*) FROM v_gold) NOT BETWEEN 100 AND 300
  UNION ALL SELECT id, 'resolution', 'defect' FROM v_span WHERE level IS NULL
  UNION ALL SELECT id, 'span', 'defect' FROM v_span WHERE outcome <> 'lands'
  UNION ALL SELECT id, 'staleness', 'defect' FROM v_span WHERE content_hash <> recorded""",
    "v_ref": """SELECT p_partkey, s.shape, s.ref FROM part, LATERAL (SELECT unnest([0,1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16,17]) AS shape, unnest([
  'TMM/Part' || p_partkey || '/1/2', 'TMM/Part26/' || p_partkey || '#3~2', 'TMA1995/s' || p_partkey, 'TMR1995/r' || p_partkey || '.3', 'TMR1995/sch' || p_partkey, 'TMR1995/sch3/item' || p_partkey,
  'TMA1995/s' || p_partkey || '(3)(a)', 'TMA1995/front~' || p_partkey, 'CASE/2018/FCAFC/' || p_partkey, 'CASE/18/FCAFC/' || p_partkey, 'TMR1995/s' || p_partkey, 'TMA1995/s' || p_partkey || '.7',
  'CCA1995/s6.' || p_partkey, 'tma1995/s' || p_partkey, ' TMA1995/s' || p_partkey, 'TMA1995/s' || p_partkey || chr(10), 'TMR1995/r' || p_partkey, 'Part22/' || p_partkey]) AS ref) s""",
    "v_kind": r"""SELECT *, CASE WHEN shape IN (9, 10, 11, 13, 14, 15, 16, 17) THEN NULL WHEN shape = 0 THEN CASE WHEN p_partkey <= 999 THEN 'manual' END
  WHEN shape = 1 THEN 'manual_chunk' WHEN shape IN (2, 3, 4) THEN 'provision' WHEN shape = 5 THEN 'legislation' WHEN shape IN (6, 7) THEN 'unit' WHEN shape = 8 THEN 'case' WHEN shape = 12 THEN 'provision' END AS kind FROM v_ref""",
}


def _fixed() -> str:
    """What is wrong whatever the tables hold: an odd file, enumerations and deliverables of which there is no record."""
    rows = [("odd.yaml", "gold-file", "defect"), ("eval/pilot-scope.md", "completeness", "gap")]
    rows += [(f"{label} '{value}'", "coverage", "gap") for t, field, label in ENUM_COVERAGE for value in enum_values(t, field)]
    rows += [(FILES[d.record_type], "completeness", "gap") for d in DELIVERABLES if d.record_type not in (None, "gold_entity")]
    quoted = ["'" + "', '".join(x.replace("'", "''") for x in row) + "'" for row in rows]
    return "(" + "), (".join(quoted) + ")"


VIEWS["v_finding"] = VIEWS["v_finding"].replace("{fixed}", _fixed())


def _needs(sql: str) -> str:
    """The SQL with the views that it uses in front."""
    used: list[str] = []

    def add(text: str) -> None:
        for name, body in VIEWS.items():
            if name in text and name not in used:
                add(body)
                used.append(name)

    add(sql)
    return ("WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in used) + "\n" if used else "") + sql


_RAW = {
    "scan_typed_projection": "SELECT chunk_ref, page_ref, ordinal, 'body' AS kind, 'h' AS headings, 0 AS n_edges, content_hash FROM v_chunk",
    "nested_json_projection": "SELECT event_id, '.k' AS pointer, json_extract_string(props, '$.k') AS value FROM events",
    "unknown_field_drift": "SELECT event_id, 'extra' AS unknown FROM events WHERE event_id % 5 = 0",
    "part_id_projection": "SELECT chunk_ref, split_part(chunk_ref, '/', 2) AS part_id, split_part(chunk_ref, '/', 1) AS root, substr(chunk_ref, instr(chunk_ref, '/') + 1) AS address FROM v_chunk",
    "text_slice": "SELECT doc_id, substr(text, 1, 10) AS head, substr(text, 6, 20) AS middle, length(text)::INTEGER AS n FROM documents",
    "needs_human_edges": "SELECT chunk_ref, id FROM v_edge WHERE certainty = 'ambiguous'",
    "scope_match_prefix": "SELECT id, count(*) AS n, (id = 'TMA1995/s43' OR substr(id, 12, 1) IN ('(', '~', '/')) AS matches FROM v_edge WHERE starts_with(id, 'TMA1995/s43') GROUP BY id",
    "chunks_citing_any": "SELECT chunk_ref, page_ref FROM v_cited",
    "multi_scope_ancestor_join": """SELECT scope, sum(n)::BIGINT AS n, count(*) AS n_ids FROM (SELECT 'TMA1995/s' || p_partkey AS scope FROM part) s
  JOIN (SELECT id, count(*) AS n FROM v_edge GROUP BY id) e ON e.id = scope OR starts_with(e.id, scope || '(') OR starts_with(e.id, scope || '~') OR starts_with(e.id, scope || '/') GROUP BY scope""",
    "authors_own_links": "SELECT chunk_ref, id FROM v_edge WHERE extraction = 'href'",
    "misprinted_pages": "SELECT page_id::VARCHAR AS page_ref, 'TMM/Part' || page_id AS printed_page_ref FROM pages WHERE page_id % 7 = 0",
    "provision_unit_refs": """SELECT 'TMA1995/s' || p_partkey AS ref, coalesce(array_to_string(list_transform(k, lambda i: 'TMA1995/s' || p_partkey || '(' || i || ')'), ','), '') AS unit_refs, len(k)::INTEGER AS n
  FROM (SELECT p_partkey, CASE WHEN p_size > 10 THEN range(1, (p_size % 4 + 2)::BIGINT) ELSE [] END AS k FROM part)""",
    "page_mates_semi": "SELECT page_ref, chunk_ref, ordinal, chunk_ref IN (SELECT chunk_ref FROM v_cited) AS citing FROM v_chunk WHERE page_ref IN (SELECT page_ref FROM v_cited)",
    "resolve_priority_join": """SELECT e.id, CASE WHEN p.ref IS NOT NULL THEN 'provision' WHEN u.ref IS NOT NULL THEN 'unit' END AS level, coalesce(p.content_hash, u.content_hash) AS target_hash
  FROM (SELECT DISTINCT id FROM v_edge) e LEFT JOIN v_prov p ON e.id = p.ref LEFT JOIN v_unit u ON e.id = u.ref""",
    "join_coverage": """SELECT total, in_scope, resolved, in_scope - resolved AS unresolved, round(resolved / in_scope, 6) AS coverage FROM (
  SELECT count(*) AS total, count(*) FILTER (held) AS in_scope, count(*) FILTER (held AND id IN (SELECT ref FROM v_known)) AS resolved FROM (SELECT id, split_part(id, '/', 1) IN ('TMA1995', 'TMR1995') AS held FROM v_edge))""",
    "unresolved_anti": "SELECT DISTINCT id FROM v_edge WHERE split_part(id, '/', 1) IN ('TMA1995', 'TMR1995') AND id NOT IN (SELECT ref FROM v_known)",
    "trust_metadata_counts": "SELECT extraction, coalesce(certainty, '—') AS certainty, count(*) AS n FROM v_edge WHERE starts_with(id, 'TMA1995/') GROUP BY ALL",
    "counts_by_part_kind": "SELECT split_part(chunk_ref, '/', 2) AS part, kind, count(*) AS n FROM v_chunk GROUP BY ALL",
    "case_mentions_topk": """SELECT 'CASE/' || y || '/FCA/' || k AS case_id, max_by('[' || y || '] ' || o_orderpriority, o_orderkey) AS citation, count(*) AS n
  FROM (SELECT *, year(o_orderdate) AS y, o_custkey % 50 AS k FROM orders) GROUP BY 1 ORDER BY n DESC, case_id LIMIT 20""",
    "distinct_pages": "SELECT DISTINCT page_ref FROM v_cited",
    "word_volume": rf"""SELECT kind, count(*) AS chunks, sum(len(list_filter(regexp_split_to_array(text, '{_W}+'), lambda w: w <> '')))::BIGINT AS words,
  printf('%.1f%%', 100.0 * count(*) / (SELECT count(*) FROM v_chunk)) AS share FROM v_chunk GROUP BY kind""",
    "dedup_last_wins": "SELECT sha256(text) AS key, max(doc_id) AS doc_id, max_by(lang, doc_id) AS lang, max_by(source, doc_id) AS source FROM documents GROUP BY 1",
    "duplicate_ids_lag": """SELECT l_orderkey, l_linenumber, n, before, CASE WHEN before = l_returnflag THEN 'an earlier record has this id' ELSE 'one id for a ' || before || ' and a ' || l_returnflag END AS said FROM (
  SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER w::INTEGER AS n, lag(l_returnflag) OVER w AS before FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_returnflag, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus, l_shipdate)) WHERE n > 1""",
    "page_break_flag": "SELECT chunk_ref, ordinal = min(ordinal) OVER (PARTITION BY page_ref) AS opens_page FROM v_chunk",
    "sequential_ids": """SELECT 'CU-' || lpad((top + n)::VARCHAR, greatest(4, length((top + n)::VARCHAR))::INTEGER, '0') AS id, c_custkey FROM (
  SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n, (SELECT max(c_custkey) FROM customer WHERE c_custkey % 2 = 0) AS top FROM customer WHERE c_custkey % 2 = 1)""",
    "ordered_page_lists": "SELECT page_ref, string_agg(chunk_ref, ',' ORDER BY ordinal, chunk_ref) AS chunk_refs FROM v_chunk GROUP BY page_ref",
    "page_digest": "SELECT page_ref, sha256(string_agg(chunk_ref || chr(0) || sha256(text) || chr(10), '' ORDER BY chunk_ref)) AS digest FROM v_chunk GROUP BY page_ref",
    "approval_gaps": "SELECT id AS subject, 'approved_by' AS field FROM v_gold WHERE approved_by IS NULL UNION ALL SELECT id, 'approved_date' FROM v_gold WHERE approved_date IS NULL",
    "judgement_notes": "SELECT 'note' AS severity, 'test_ref' AS \"check\", 'PU-' || doc_id AS subject FROM labels WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0",
    "blank_fields": """SELECT id, unnest(list_filter([CASE WHEN id = '' THEN 'id' END, CASE WHEN doc_id % 13 = 0 OR surface = '' THEN 'surface' END, CASE WHEN doc_id % 3 = 0 THEN 'approved' END,
  CASE WHEN doc_id % 3 <> 0 AND approved_by IS NULL THEN 'approved.by' END, CASE WHEN doc_id % 3 <> 0 AND approved_date IS NULL THEN 'approved.date' END, CASE WHEN doc_id % 4 = 0 THEN 'types' END], lambda f: f IS NOT NULL)) AS field FROM v_gold""",
    "cross_reference_anti": """SELECT subject, names FROM (SELECT 'GC-' || lpad(doc_id::VARCHAR, 9, '0') AS subject, unnest(['GC-' || lpad((doc_id - 1)::VARCHAR, 9, '0'), 'GC-' || lpad((doc_id + 1)::VARCHAR, 9, '0')]) AS names FROM labels WHERE doc_id % 5 <> 0)
  WHERE names NOT IN (SELECT 'GC-' || lpad(doc_id::VARCHAR, 9, '0') FROM labels WHERE doc_id % 5 <> 0)""",
    "retired_reuse": "SELECT g.id AS subject, 'reuses a retired id (withdrawn 2023-05-01)' AS message FROM v_gold g JOIN v_retired r ON g.id = r.id",
    "span_landing": "SELECT id, coalesce(level, 'none') AS level, outcome FROM v_span",
    "stale_hash": "SELECT 'defect' AS severity, id AS subject FROM v_span WHERE content_hash <> recorded",
    "page_lookup": """SELECT c.chunk_ref, p.url, CASE WHEN c.chunk_ref IN (SELECT chunk_ref FROM v_cited) THEN '★' ELSE '' END AS mark FROM v_chunk c
  JOIN pages p ON p.page_id = split_part(c.chunk_ref, '/', 2)[5:]::BIGINT WHERE c.page_ref IN (SELECT page_ref FROM v_cited)""",
    "parent_child_attach": """SELECT o_orderkey AS id, coalesce(string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || l_returnflag, ';' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag), '') AS children,
  count(l_orderkey)::INTEGER AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
    "orphan_children": "SELECT l_orderkey AS parent_id, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0) GROUP BY 1",
    "enum_coverage_anti": "SELECT v.value, count(e.event_id) AS n, count(e.event_id) = 0 AS unused FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('withdrawn')) v(value) LEFT JOIN events e ON e.event_type = v.value GROUP BY 1",
    "band_gate": """SELECT key, CASE WHEN high IS NULL THEN 'at least ' || low ELSE low || '–' || high END AS target, n, CASE WHEN n < low THEN (low - n) || ' short' WHEN n > high THEN (n - high) || ' above the band' ELSE 'in band' END AS status FROM (
  SELECT key, low, high, CASE WHEN key = 'entities' THEN (SELECT count(*) FROM v_gold) ELSE 0 END AS n FROM (VALUES ('competency_questions', 6, NULL), ('prohibited_uses', 6, NULL), ('concepts', 50, 100), ('entities', 100, 300),
  ('relationships', 50, 100), ('search_questions', 20, 50), ('retrieval_questions', 20, 50), ('reasoning', 1, NULL)) d(key, low, high))""",
    "pinned_count_compare": """SELECT name, expected::BIGINT AS expected, measured FROM (VALUES ('region', 5), ('nation', 25), ('part', -1), ('ghost', 3)) p(name, expected) LEFT JOIN (SELECT 'region' AS m, count(*) AS measured FROM region
  UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier) ON m = name WHERE expected IS DISTINCT FROM measured""",
    "header_full_outer": "SELECT * FROM (VALUES ('tier', 'missing'), ('notes', 'missing'), ('source', 'unknown'), ('n_chars', 'unknown')) h(header, state)",
    "status_exists_flag": "SELECT * FROM (VALUES ('pilot_scope', 'not written'), ('measures', 'written')) s(key, status)",
    "majority_check": "SELECT lang, count(*) FILTER (quality = 0) AS plain, count(*) AS n, 2 * count(*) FILTER (quality = 0) <= count(*) AS gap FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY lang",
    'findings_union': 'SELECT "check", severity, count(*) AS n, count(DISTINCT subject) AS subjects FROM v_finding GROUP BY ALL',
    "exit_code": """SELECT *, gaps = 0 AS complete, CASE WHEN defects > 0 THEN 1 WHEN gaps = 0 THEN 0 ELSE 3 END AS exit_code FROM (
  SELECT count(*) FILTER (severity = 'defect') AS defects, count(*) FILTER (severity = 'gap') AS gaps, count(*) FILTER (severity = 'note') AS notes FROM v_finding)""",
    "method_agreement": """SELECT 'cand-' || substr(sha256('TMA1995/s' || user_id || '|0|' || length(event_type) || '|' || event_type), 1, 16) AS candidate_id, count(DISTINCT m)::INTEGER AS agreement, string_agg(m, ',' ORDER BY first) AS methods,
  coalesce(string_agg(m, ',' ORDER BY first) FILTER (n > 1), '') AS repeated FROM (SELECT user_id, event_type, (['regex', 'yake', 'human'])[event_id % 3 + 1] AS m, min(event_id) AS first, count(*) AS n
  FROM events GROUP BY ALL) GROUP BY user_id, event_type""",
    "ref_parse_kinds": """SELECT ref, kind, CASE WHEN kind IN ('provision', 'unit', 'legislation') THEN split_part(ref, '/', 1) END AS instrument, CASE WHEN kind = 'unit' THEN regexp_extract(ref, '^[^(~]*') END AS root FROM v_kind""",
    "instrument_invariants": "SELECT ref, shape NOT IN (10, 11, 16) AS holds FROM v_ref WHERE shape NOT IN (13, 14, 15, 17)",
    "iri_round_trip": f"""SELECT ref, CASE WHEN kind IS NOT NULL THEN '{DEFAULT_BASE_IRI}ref/' || replace(ref, '#', '%23') END AS iri, CASE WHEN kind IS NOT NULL THEN ref END AS back, '{DEFAULT_BASE_IRI}concept/' || p_partkey AS minted FROM v_kind""",
    "normalise_ascii": "SELECT c_custkey, lower(c_name) || ' ' || lower(c_mktsegment) AS value FROM customer",
    "cell_parse": """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE trunc(round(c_acctbal, 2))::BIGINT::VARCHAR END AS number, CASE WHEN c_custkey % 4 = 0 THEN 'true' WHEN c_custkey % 4 = 1 THEN 'false' END AS flag,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment END AS segment,
  CASE WHEN c_custkey % 5 = 0 THEN '1' ELSE '0' END || CASE WHEN c_custkey % 4 = 2 THEN '1' ELSE '0' END || CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN '0' ELSE '1' END AS bad FROM customer""",
    "list_cell_split": rf"""SELECT doc_id, len(items)::INTEGER AS n, array_to_string(items, '¦') AS items FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
  lambda x: regexp_replace(x, '^{_W}+|{_W}+$', '', 'g')), lambda x: x <> '') AS items FROM documents)""",
    "provenance_checks": """SELECT event_id, array_to_string(list_filter([
  CASE WHEN e % 3 = 2 THEN 'unknown method' END, CASE WHEN e % 3 = 1 AND e % 2 <> 0 THEN 'a model-backed method must name its model' END,
  CASE WHEN e % 7 = 1 THEN 'the span''s ref is not a ref' END, CASE WHEN e % 7 = 0 THEN 'a case holds no text to span' END, CASE WHEN e % 11 < e % 5 THEN 'the span is nonsensical' END,
  CASE WHEN e % 19 = 0 THEN 'the content hash must begin with sha256:' END, CASE WHEN e % 13 = 0 THEN 'unknown extraction' END, CASE WHEN e % 3 <> 0 AND e % 17 = 0 THEN 'unknown certainty' END,
  CASE WHEN e % 13 <> 0 AND e % 2 = 0 AND (e % 3 = 0 OR e % 17 = 0) THEN 'certainty belongs to regex edges only' END, CASE WHEN e % 23 = 0 THEN 'no extraction method' END,
  CASE WHEN value / 50 < 0 OR value / 50 > 1 THEN 'confidence outside 0 to 1' END, CASE WHEN e % 4 = 0 AND e % 8 <> 0 THEN 'a decision needs a reviewer and a date' END,
  CASE WHEN e % 29 = 0 THEN 'a candidate needs a value' END], lambda f: f IS NOT NULL), '; ') AS faults FROM (SELECT *, event_id AS e FROM events)""",
    "blockquote_render": """SELECT c.chunk_ref, '> ' || replace(text, chr(10), chr(10) || '> ') AS quote, coalesce(edges, '—') AS edges FROM v_chunk c LEFT JOIN (SELECT chunk_ref, string_agg('`' || id || '` (' || extraction || coalesce(', ' || certainty, '') || ')'
  || CASE WHEN id = 'TMA1995/s43' OR (starts_with(id, 'TMA1995/s43') AND substr(id, 12, 1) IN ('(', '~', '/')) THEN ' ←' ELSE '' END, '; ' ORDER BY id, extraction, certainty NULLS FIRST) AS edges
  FROM v_edge GROUP BY 1) e ON e.chunk_ref = c.chunk_ref""",
    "schema_validate": """SELECT doc_id::INTEGER AS pos, 'type' AS path FROM v_gold WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id::INTEGER, 'surface' FROM v_gold WHERE surface = ''""",
    "events_tumbling": "SELECT (floor(epoch(ts) / 300) * 300)::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}

SQL = {name: _needs(sql) for name, sql in _RAW.items()}
