"""The same answers in SQL, for the queries that SQL can express."""

from __future__ import annotations

_ORPHANS = """
refs AS (
  SELECT 'edges' AS ref_table, 'source_id' AS ref_column, repo_id, edge_id AS ref_id, source_id AS key, 'node' AS parent, written_at AS w_at FROM edges
  UNION ALL SELECT 'edges', 'target_id', repo_id, edge_id, target_id, 'node', written_at FROM edges
  UNION ALL SELECT 'declarations', 'symbol_node_id', repo_id, declaration_id, symbol_node_id, 'node', written_at FROM declarations
  UNION ALL SELECT 'units', 'run_id', repo_id, unit_id, run_id, 'run', recorded_at FROM units),
live AS (
  SELECT DISTINCT 'node' AS parent, repo_id, node_id AS key FROM nodes WHERE deleted_at IS NULL
  UNION SELECT DISTINCT 'run', repo_id, run_id FROM runs),
orphan AS (
  SELECT r.* FROM refs r ANTI JOIN live l ON r.parent = l.parent AND r.repo_id = l.repo_id AND r.key = l.key WHERE r.key IS NOT NULL)
"""

_PUBLISHED = """
cmd AS (
  SELECT DISTINCT coalesce(replacement.repo_id, repo_id) AS repo_id, coalesce(replacement.plugin_id, plugin_id) AS plugin_id,
    coalesce(replacement.unit_id, unit_id) AS unit_id, coalesce(replacement.run_id, run_id) AS run_id, kind, seq
  FROM command_log WHERE kind IN ('replace', 'delete', 'stage-replace', 'stage-delete')),
ends AS (
  SELECT repo_id, run_id, min(seq) AS e, arg_min(kind, seq) AS kind FROM command_log
  WHERE kind = 'complete' OR kind = 'run' AND run_status <> 'Running' GROUP BY ALL),
acting AS (
  SELECT repo_id, plugin_id, unit_id, seq AS w_at, kind, seq FROM cmd WHERE kind IN ('replace', 'delete')
  UNION ALL
  SELECT c.repo_id, c.plugin_id, c.unit_id, e.e, arg_max(c.kind, c.seq), max(c.seq) FROM cmd c JOIN ends e ON c.repo_id = e.repo_id AND c.run_id = e.run_id
  WHERE c.kind LIKE 'stage-%' AND e.kind = 'complete' AND c.seq < e.e GROUP BY c.repo_id, c.run_id, c.plugin_id, c.unit_id, e.e)
"""

_LINKS = """
links AS (SELECT DISTINCT repo_id, source_id AS parent, target_id AS child FROM edges
  WHERE kind IN ('contains', 'declares') AND source_id IS NOT NULL AND target_id IS NOT NULL)
"""

_REACH = _LINKS + """,
reach AS (SELECT repo_id, parent AS a, child AS b FROM links UNION SELECT r.repo_id, r.a, l.child FROM reach r JOIN links l ON l.repo_id = r.repo_id AND l.parent = r.b)
"""

_TREE = _REACH + """,
class AS (SELECT x.repo_id, x.a AS node_id, min(x.b) AS class FROM reach x JOIN reach y ON x.repo_id = y.repo_id AND x.a = y.b AND x.b = y.a GROUP BY ALL),
ids AS (SELECT i.*, coalesce(c.class, i.node_id) AS class, c.class IS NOT NULL AS on_cycle FROM (SELECT DISTINCT repo_id, unnest([parent, child]) AS node_id FROM links) i LEFT JOIN class c ON c.repo_id = i.repo_id AND c.node_id = i.node_id),
outside AS (SELECT l.repo_id, c.class, min(l.parent) AS parent FROM links l JOIN ids p ON p.repo_id = l.repo_id AND p.node_id = l.parent JOIN ids c ON c.repo_id = l.repo_id AND c.node_id = l.child WHERE p.class <> c.class GROUP BY ALL),
up AS (SELECT i.repo_id, i.node_id AS child, o.parent FROM ids i JOIN outside o ON o.repo_id = i.repo_id AND o.class = i.class),
tree AS (
  SELECT i.repo_id, i.node_id, NULL::VARCHAR AS parent_id, i.node_id AS root_id, 0::BIGINT AS depth, [i.node_id] AS path
  FROM ids i LEFT JOIN up u ON u.repo_id = i.repo_id AND u.child = i.node_id WHERE u.child IS NULL
  UNION ALL
  SELECT u.repo_id, u.child, u.parent, t.root_id, t.depth + 1, list_append(t.path, u.child) FROM tree t JOIN up u ON u.repo_id = t.repo_id AND u.parent = t.node_id)
"""

_HIERARCHY = f"""WITH RECURSIVE {_TREE}
        SELECT i.repo_id, i.node_id, t.parent_id, t.root_id, t.depth, to_json(t.path)::VARCHAR AS path, i.on_cycle, coalesce(n.n, 0)::BIGINT AS n_descendants
        FROM ids i LEFT JOIN tree t ON t.repo_id = i.repo_id AND t.node_id = i.node_id
        LEFT JOIN (SELECT repo_id, a, count(*) AS n FROM reach WHERE a <> b GROUP BY ALL) n ON n.repo_id = i.repo_id AND n.a = i.node_id"""

_PLAN = r"""
lastrun AS (SELECT repo_id, arg_max(run_id, (completed_at, run_id)) AS run_id FROM runs WHERE status = 'Completed' AND completed_at IS NOT NULL GROUP BY repo_id),
st AS (SELECT s.repo_id, s.run_id, arg_max(s.sources, s.recorded_at) AS sources FROM index_states s JOIN lastrun l ON s.repo_id = l.repo_id AND s.run_id = l.run_id GROUP BY ALL),
was AS (
  SELECT DISTINCT repo_id, x.plugin_id AS plugin_id, replace(x.path, '\', '/') AS path, x.plugin_version AS plugin_version, replace(lower(x.hash), 'sha256:', '') AS digest
  FROM (SELECT repo_id, unnest(sources) AS x FROM st)),
cur AS (
  SELECT repo_id, plugin_id, path, arg_max(plugin_version, (observed_at, file_id)) AS plugin_version, replace(lower(arg_max(source_hash, (observed_at, file_id))), 'sha256:', '') AS digest
  FROM source_files GROUP BY ALL),
plan AS (
  SELECT coalesce(c.repo_id, w.repo_id) AS repo_id, coalesce(c.plugin_id, w.plugin_id) AS plugin_id, coalesce(c.path, w.path) AS path,
    CASE WHEN w.path IS NULL THEN 'New' WHEN c.path IS NULL THEN 'Deleted' WHEN c.digest <> w.digest OR c.plugin_version <> w.plugin_version THEN 'Changed' ELSE 'Unchanged' END AS change
  FROM cur c FULL JOIN was w ON c.repo_id = w.repo_id AND c.plugin_id = w.plugin_id AND c.path = w.path)
"""

_LIVE = """
ln AS (SELECT * FROM nodes WHERE deleted_at IS NULL),
n1 AS (SELECT DISTINCT repo_id, node_id, plugin_id, unit_id, kind, name, qualified_name, symbol_id, language, access, properties FROM ln WHERE node_id IS NOT NULL),
nm AS (
  SELECT a.repo_id, a.node_id, a.kind, a.name, a.qualified_name, a.symbol_id, a.language, a.access, a.properties, b.contributors, b.conflict
  FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, node_id ORDER BY plugin_id, unit_id, kind, name, qualified_name NULLS FIRST, symbol_id NULLS FIRST, language NULLS FIRST, access NULLS FIRST, properties NULLS FIRST) AS rn FROM n1) a
  JOIN (SELECT repo_id, node_id, count(DISTINCT (plugin_id, unit_id)) AS contributors, count(DISTINCT (kind, name, qualified_name, symbol_id, language, access, properties)) > 1 AS conflict FROM n1 GROUP BY ALL) b
    ON a.repo_id = b.repo_id AND a.node_id = b.node_id WHERE a.rn = 1),
e1 AS (SELECT DISTINCT repo_id, edge_id, plugin_id, unit_id, source_id, target_id, kind, ev_quality, ev_provider, ev_provider_version, ev_location, ev_confidence FROM edges WHERE edge_id IS NOT NULL),
em AS (
  SELECT a.repo_id, a.edge_id, a.source_id, a.target_id, a.kind, a.ev_quality, a.ev_location, b.contributors, b.conflict
  FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, edge_id ORDER BY plugin_id, unit_id, source_id, target_id NULLS FIRST, kind, ev_quality, ev_provider, ev_provider_version NULLS FIRST) AS rn FROM e1) a
  JOIN (SELECT repo_id, edge_id, count(DISTINCT (plugin_id, unit_id)) AS contributors, count(DISTINCT (source_id, target_id, kind, ev_quality, ev_provider, ev_provider_version, ev_location, ev_confidence)) > 1 AS conflict FROM e1 GROUP BY ALL) b
    ON a.repo_id = b.repo_id AND a.edge_id = b.edge_id WHERE a.rn = 1),
d1 AS (SELECT DISTINCT repo_id, declaration_id, plugin_id, unit_id, symbol_id, symbol_node_id, path, start_line, start_col, end_line, end_col, properties FROM declarations WHERE declaration_id IS NOT NULL),
dm AS (
  SELECT a.repo_id, a.declaration_id, a.symbol_id, a.symbol_node_id, a.path, a.start_line, a.start_col, a.end_line, a.end_col, b.contributors, b.conflict
  FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, declaration_id ORDER BY plugin_id, unit_id, symbol_id, symbol_node_id, path, start_line, start_col, end_line, end_col, properties NULLS FIRST) AS rn FROM d1) a
  JOIN (SELECT repo_id, declaration_id, count(DISTINCT (plugin_id, unit_id)) AS contributors, count(DISTINCT (symbol_id, symbol_node_id, path, start_line, start_col, end_line, end_col, properties)) > 1 AS conflict FROM d1 GROUP BY ALL) b
    ON a.repo_id = b.repo_id AND a.declaration_id = b.declaration_id WHERE a.rn = 1)
"""

_PRESETS = {
    "callers": ("'calls'", True),
    "callees": ("'calls'", False),
    "references": ("'references'", True),
    "implementations": ("'implements', 'inherits'", True),
    "dependencies": ("'depends-on'", False),
    "dependents": ("'depends-on'", True),
}

_NEIGHBOURS = {
    name: f"""WITH {_LIVE} SELECT DISTINCT repo_id, {'target_id' if back else 'source_id'} AS node_id, {'source_id' if back else 'target_id'} AS neighbour_id, kind, edge_id
        FROM em WHERE kind IN ({kinds}) AND source_id IS NOT NULL AND target_id IS NOT NULL"""
    for name, (kinds, back) in _PRESETS.items()
}

_GRAPH = {
    "merge_nodes": f"WITH {_LIVE} SELECT repo_id, node_id, kind, name, qualified_name, symbol_id, contributors, conflict FROM nm",
    "merge_edges": f"WITH {_LIVE} SELECT repo_id, edge_id, source_id, target_id, kind, ev_quality, contributors, conflict FROM em",
    "merge_declarations": f"WITH {_LIVE} SELECT repo_id, declaration_id, symbol_id, path, start_line, contributors, conflict FROM dm",
    "provenance_nodes": "SELECT DISTINCT repo_id, 'node' AS fact_kind, node_id AS fact_id, plugin_id, unit_id FROM nodes WHERE deleted_at IS NULL",
    "violations": f"""WITH {_LIVE},
        v AS (
          SELECT repo_id, 'replacement.node.duplicate' AS code, node_id AS id FROM n1 GROUP BY repo_id, plugin_id, unit_id, node_id HAVING count(*) > 1
          UNION ALL SELECT repo_id, 'replacement.edge.duplicate', edge_id FROM e1 GROUP BY repo_id, plugin_id, unit_id, edge_id HAVING count(*) > 1
          UNION ALL SELECT repo_id, 'replacement.declaration.duplicate', declaration_id FROM d1 GROUP BY repo_id, plugin_id, unit_id, declaration_id HAVING count(*) > 1
          UNION ALL SELECT repo_id, 'graph.node.conflict', node_id FROM nm WHERE conflict
          UNION ALL SELECT repo_id, 'graph.edge.conflict', edge_id FROM em WHERE conflict
          UNION ALL SELECT repo_id, 'graph.declaration.conflict', declaration_id FROM dm WHERE conflict
          UNION ALL SELECT repo_id, 'graph.symbol.duplicate', symbol_id FROM ln WHERE symbol_id IS NOT NULL GROUP BY repo_id, symbol_id HAVING count(DISTINCT node_id) > 1
          UNION ALL SELECT d.repo_id, 'graph.declaration.symbol-missing', declaration_id FROM declarations d
            WHERE NOT EXISTS (SELECT 1 FROM ln n WHERE n.repo_id = d.repo_id AND n.node_id = d.symbol_node_id AND n.symbol_id = d.symbol_id)
          UNION ALL SELECT e.repo_id, 'graph.edge.endpoint-missing', edge_id FROM edges e
            WHERE NOT EXISTS (SELECT 1 FROM ln n WHERE n.repo_id = e.repo_id AND n.node_id = e.source_id) OR NOT EXISTS (SELECT 1 FROM ln n WHERE n.repo_id = e.repo_id AND n.node_id = e.target_id)
          UNION ALL SELECT repo_id, 'edge.evidence.invalid', edge_id FROM edges WHERE ev_quality NOT IN ('Structural', 'Resolved', 'Derived', 'Inferred') OR ev_confidence IS NOT NULL AND (ev_quality <> 'Inferred' OR ev_confidence NOT BETWEEN 0 AND 1)
          UNION ALL SELECT repo_id, 'edge.evidence.calls-requires-resolved', edge_id FROM edges WHERE kind = 'calls' AND ev_quality <> 'Resolved')
        SELECT repo_id, code, count(DISTINCT id) AS n FROM v GROUP BY ALL""",
    "violations_first": f"""WITH {_LIVE} SELECT repo_id, fact_id FROM (
          SELECT DISTINCT e.repo_id, edge_id AS fact_id FROM edges e
          WHERE NOT EXISTS (SELECT 1 FROM ln n WHERE n.repo_id = e.repo_id AND n.node_id = e.source_id) OR NOT EXISTS (SELECT 1 FROM ln n WHERE n.repo_id = e.repo_id AND n.node_id = e.target_id))
        ORDER BY fact_id, repo_id LIMIT 100""",
    "symbol_batch": f"WITH {_LIVE} SELECT qualified_name AS name, repo_id, node_id, count(*) OVER (PARTITION BY qualified_name) AS candidates FROM nm WHERE qualified_name IS NOT NULL AND trim(qualified_name) <> ''",
    "symbol_by_id": f"WITH {_LIVE} SELECT repo_id, symbol_id, min(node_id) AS node_id FROM nm WHERE symbol_id IS NOT NULL GROUP BY ALL",
    "name_pattern_topk": f"WITH {_LIVE} SELECT repo_id, node_id, qualified_name, name FROM nm WHERE contains(lower(qualified_name), 'ledger') OR contains(lower(name), 'ledger') ORDER BY qualified_name NULLS FIRST, node_id, repo_id LIMIT 50",
    "name_pattern_total": f"WITH {_LIVE}, t AS (SELECT count(*) AS total FROM nm WHERE contains(lower(qualified_name), 'ledger') OR contains(lower(name), 'ledger')) SELECT total, least(total, 50) AS returned, total > 50 AS truncated FROM t",
    "discovery_unscoped": f"""WITH {_LIVE}, top AS (SELECT * FROM nm WHERE contains(lower(qualified_name), 'meter') OR contains(lower(name), 'meter') ORDER BY qualified_name NULLS FIRST, node_id, repo_id LIMIT 200)
        SELECT repo_id, node_id, qualified_name FROM top WHERE kind = 'callable' AND language IN ('csharp', 'typescript')""",
    "discovery_counts": f"""WITH {_LIVE}, m AS (SELECT *, row_number() OVER (ORDER BY qualified_name NULLS FIRST, node_id, repo_id) AS rn FROM nm WHERE contains(lower(qualified_name), 'meter') OR contains(lower(name), 'meter'))
        SELECT count(*) AS total, count(*) FILTER (rn <= 200 AND kind = 'callable' AND language IN ('csharp', 'typescript')) AS returned, count(*) > 200 AS truncated FROM m""",
    "discovery_scoped": f"""WITH RECURSIVE {_LIVE},
        walk AS (SELECT node_id AS root_id, repo_id, node_id, 0 AS depth FROM nm WHERE kind = 'project'
          UNION SELECT w.root_id, w.repo_id, e.target_id, w.depth + 1 FROM walk w JOIN em e ON e.repo_id = w.repo_id AND e.source_id = w.node_id
          WHERE w.depth < 3 AND e.target_id IS NOT NULL AND e.kind IN ('contains', 'declares')),
        far AS (SELECT DISTINCT w.repo_id, w.root_id FROM walk w JOIN em e ON e.repo_id = w.repo_id AND e.source_id = w.node_id
          WHERE e.target_id IS NOT NULL AND e.kind IN ('contains', 'declares')
          GROUP BY w.repo_id, w.root_id, w.node_id HAVING min(w.depth) = 3),
        r AS (SELECT DISTINCT w.root_id, w.repo_id, w.node_id, n.qualified_name FROM walk w JOIN nm n ON n.repo_id = w.repo_id AND n.node_id = w.node_id
          WHERE w.node_id <> w.root_id AND n.symbol_id IS NOT NULL AND (contains(lower(n.qualified_name), 'er') OR contains(lower(n.name), 'er'))),
        o AS (SELECT *, row_number() OVER (PARTITION BY repo_id, root_id ORDER BY qualified_name NULLS LAST, node_id) AS ord, count(*) OVER (PARTITION BY repo_id, root_id) AS total FROM r)
        SELECT o.root_id, o.repo_id, o.node_id, o.ord, o.total, o.total > 10 OR f.root_id IS NOT NULL AS truncated FROM o LEFT JOIN far f ON f.repo_id = o.repo_id AND f.root_id = o.root_id WHERE o.ord <= 10""",
    "symbols_in_file": f"""WITH {_LIVE},
        f AS (SELECT repo_id, qualified_name AS path, min(node_id) AS node_id FROM nm WHERE kind = 'file' AND qualified_name IS NOT NULL GROUP BY ALL),
        s AS (SELECT DISTINCT f.repo_id, f.path, n.node_id, n.qualified_name FROM f JOIN em e ON e.repo_id = f.repo_id AND e.source_id = f.node_id AND e.kind = 'declares'
          JOIN nm n ON n.repo_id = e.repo_id AND n.node_id = e.target_id WHERE n.symbol_id IS NOT NULL)
        SELECT repo_id, path, node_id, row_number() OVER (PARTITION BY repo_id, path ORDER BY qualified_name NULLS LAST, node_id) AS ord FROM s""",
    "declarations_in_project": f"""WITH RECURSIVE {_LIVE},
        walk AS (SELECT node_id AS root_id, repo_id, node_id, 0 AS depth FROM nm WHERE kind = 'project'
          UNION SELECT w.root_id, w.repo_id, e.target_id, w.depth + 1 FROM walk w JOIN em e ON e.repo_id = w.repo_id AND e.source_id = w.node_id
          WHERE w.depth < 3 AND e.target_id IS NOT NULL AND e.kind IN ('contains', 'declares')),
        s AS (SELECT DISTINCT w.root_id, w.repo_id, n.symbol_id FROM walk w JOIN nm n ON n.repo_id = w.repo_id AND n.node_id = w.node_id WHERE w.node_id <> w.root_id AND n.symbol_id IS NOT NULL)
        SELECT s.root_id, s.repo_id, d.declaration_id, row_number() OVER (PARTITION BY s.root_id, s.repo_id ORDER BY path, start_line, start_col, declaration_id) AS ord FROM s JOIN dm d ON d.repo_id = s.repo_id AND d.symbol_id = s.symbol_id""",
    "node_by_id": f"WITH {_LIVE} SELECT repo_id, node_id, kind, name FROM nm n WHERE EXISTS (SELECT 1 FROM edges e WHERE e.repo_id = n.repo_id AND e.source_id = n.node_id)",
    "declarations_of_symbol": f"WITH {_LIVE} SELECT repo_id, symbol_id, declaration_id, row_number() OVER (PARTITION BY repo_id, symbol_id ORDER BY path, start_line, start_col, declaration_id) AS ord FROM dm",
    "declarations_in_file": f"""WITH {_LIVE},
        f AS (SELECT repo_id, qualified_name AS path, min(node_id) AS node_id FROM nm WHERE kind = 'file' AND qualified_name IS NOT NULL GROUP BY ALL),
        s AS (SELECT DISTINCT f.repo_id, f.path, n.symbol_id FROM f JOIN em e ON e.repo_id = f.repo_id AND e.source_id = f.node_id AND e.kind = 'declares'
          JOIN nm n ON n.repo_id = e.repo_id AND n.node_id = e.target_id WHERE n.symbol_id IS NOT NULL)
        SELECT d.repo_id, d.path, d.declaration_id, d.symbol_id, row_number() OVER (PARTITION BY d.repo_id, d.path ORDER BY start_line, start_col, declaration_id) AS ord
        FROM dm d SEMI JOIN s ON s.repo_id = d.repo_id AND s.path = d.path AND s.symbol_id = d.symbol_id""",
    "enclosing_symbol": f"""WITH {_LIVE},
        p AS (SELECT DISTINCT repo_id, ev_location.path AS path, ev_location.start_line AS line, ev_location.start_col AS col FROM edges WHERE ev_location IS NOT NULL),
        j AS (SELECT p.*, d.declaration_id, d.symbol_id, d.symbol_node_id, row_number() OVER (PARTITION BY p.repo_id, p.path, p.line, p.col
            ORDER BY (end_line - start_line)::BIGINT * 1000000 + (end_col - start_col) NULLS LAST, start_line DESC, start_col DESC, declaration_id) AS rn
          FROM p LEFT JOIN dm d ON d.repo_id = p.repo_id AND d.path = p.path AND d.end_line >= d.start_line AND (p.line, p.col) >= (d.start_line, d.start_col) AND (p.line, p.col) < (d.end_line, d.end_col))
        SELECT repo_id, path, line, col, declaration_id, symbol_id, symbol_node_id FROM j WHERE rn = 1""",
    "neighborhood": f"""WITH {_LIVE}, x AS (SELECT repo_id, source_id AS node_id, edge_id FROM em WHERE target_id IS NOT NULL AND source_id IS NOT NULL UNION ALL SELECT repo_id, target_id, edge_id FROM em WHERE target_id IS NOT NULL AND source_id IS NOT NULL)
        SELECT repo_id, node_id, count(DISTINCT edge_id) AS n_edges FROM x GROUP BY ALL""",
    "impact_d2": f"""WITH RECURSIVE {_LIVE},
        walk AS (SELECT repo_id || '|' || node_id AS seed, repo_id, node_id, 0 AS depth FROM nm WHERE kind = 'package'
          UNION SELECT w.seed, w.repo_id, e.source_id, w.depth + 1 FROM walk w JOIN em e ON e.repo_id = w.repo_id AND e.target_id = w.node_id
          WHERE w.depth < 2 AND e.source_id IS NOT NULL AND e.kind IN ('references', 'calls', 'implements', 'inherits', 'depends-on'))
        SELECT seed, node_id, min(depth) AS depth FROM walk GROUP BY ALL""",
    "symbols_in_project": f"""WITH RECURSIVE {_LIVE},
        walk AS (SELECT node_id AS root_id, repo_id, node_id, 0 AS depth FROM nm WHERE kind = 'project'
          UNION SELECT w.root_id, w.repo_id, e.target_id, w.depth + 1 FROM walk w JOIN em e ON e.repo_id = w.repo_id AND e.source_id = w.node_id
          WHERE w.depth < 3 AND e.target_id IS NOT NULL AND e.kind IN ('contains', 'declares'))
        SELECT w.root_id, w.repo_id, w.node_id, min(w.depth) AS depth FROM walk w JOIN nm n ON n.repo_id = w.repo_id AND n.node_id = w.node_id
        WHERE w.node_id <> w.root_id AND n.symbol_id IS NOT NULL GROUP BY ALL""",
    "public_surface": f"""WITH RECURSIVE {_LIVE},
        walk AS (SELECT node_id AS root_id, repo_id, node_id, 0 AS depth FROM nm WHERE kind = 'project'
          UNION SELECT w.root_id, w.repo_id, e.target_id, w.depth + 1 FROM walk w JOIN em e ON e.repo_id = w.repo_id AND e.source_id = w.node_id
          WHERE w.depth < 10 AND e.target_id IS NOT NULL AND e.kind IN ('contains', 'declares')),
        r AS (SELECT DISTINCT root_id, repo_id, node_id FROM walk)
        SELECT r.root_id, r.repo_id, r.node_id, row_number() OVER (PARTITION BY r.repo_id, r.root_id ORDER BY coalesce(n.qualified_name, n.name), r.node_id) AS ord
        FROM r JOIN nm n ON n.repo_id = r.repo_id AND n.node_id = r.node_id WHERE n.access = 'public' AND n.kind NOT IN ('project', 'file')""",
    "exercised_by": f"""WITH {_LIVE} SELECT DISTINCT e.repo_id, e.target_id AS source_id, e.source_id AS target_id FROM em e JOIN nm n ON n.repo_id = e.repo_id AND n.node_id = e.source_id
        WHERE e.kind = 'calls' AND e.target_id IS NOT NULL AND json_extract_string(n.properties, '$."test-method"') = 'true'""",
    "documentation_merge": f"""WITH {_LIVE}, x AS (SELECT DISTINCT repo_id, symbol_id, json_extract_string(properties, '$."doc-summary"') AS doc FROM ln WHERE symbol_id IS NOT NULL)
        SELECT repo_id, symbol_id, left(string_agg(doc, chr(10) || chr(10) ORDER BY doc), 2048) AS doc FROM x WHERE doc IS NOT NULL AND trim(doc) <> '' GROUP BY ALL""",
    "coverage_rollup": f"""WITH {_LIVE}, e AS (SELECT DISTINCT repo_id, plugin_id, unit_id, edge_id, kind, target_id FROM edges),
        j AS (SELECT e.*, EXISTS (SELECT 1 FROM ln n WHERE n.repo_id = e.repo_id AND n.plugin_id = e.plugin_id AND n.unit_id = e.unit_id AND n.node_id = e.target_id) AS own,
          EXISTS (SELECT 1 FROM ln n WHERE n.repo_id = e.repo_id AND n.node_id = e.target_id) AS known FROM e)
        SELECT repo_id, plugin_id, kind, count(*) AS emitted, count(*) FILTER (own) AS internal, count(*) FILTER (NOT own AND known) AS cross_project, count(*) FILTER (NOT known) AS unresolved
        FROM j GROUP BY ROLLUP (repo_id, plugin_id, kind) HAVING repo_id IS NOT NULL""",
    "source_freshness": f"""WITH {_PLAN}, c AS (SELECT repo_id, count(*) FILTER (change = 'New') AS n, count(*) FILTER (change = 'Changed') AS ch, count(*) FILTER (change = 'Unchanged') AS u, count(*) FILTER (change = 'Deleted') AS de FROM plan GROUP BY ALL)
        SELECT c.repo_id, CASE WHEN l.repo_id IS NULL THEN 'Unknown' WHEN n + ch + de = 0 THEN 'Fresh' ELSE 'Stale' END AS state, n AS "new", ch AS changed, u AS unchanged, de AS deleted FROM c LEFT JOIN lastrun l ON l.repo_id = c.repo_id""",
    "index_identities": r"""WITH s AS (SELECT DISTINCT repo_id, run_id, is_consistent, snapshot_identity, sources FROM index_states),
        x AS (SELECT repo_id, run_id, is_consistent, snapshot_identity, list_sort(list_transform(sources, lambda a: {'p': a.plugin_id, 'q': a.path, 'v': a.plugin_version, 'h': a.hash})) AS o FROM s)
        SELECT DISTINCT repo_id, run_id, sha256(repo_id || chr(10) || CASE WHEN is_consistent THEN 'True' ELSE 'False' END || chr(10) || coalesce(snapshot_identity, '') || chr(10)
          || coalesce(array_to_string(list_transform(o, lambda a: a.p || chr(9) || a.v || chr(9) || a.q || chr(9) || a.h || chr(10)), ''), '')) AS identity FROM x""",
    "log_fold": "SELECT repo_id, run_id, max(seq) AS seq, arg_max(kind, seq) AS kind, arg_max(run_status, seq) AS run_status FROM command_log WHERE kind IN ('run', 'complete') GROUP BY ALL",
    "unit_overlay": """SELECT DISTINCT repo_id, plugin_id, unit_id FROM units u WHERE NOT EXISTS (
        SELECT 1 FROM units b JOIN runs r ON r.repo_id = b.repo_id AND r.run_id = b.run_id WHERE r.status IN ('Failed', 'Cancelled') AND b.repo_id = u.repo_id AND b.plugin_id = u.plugin_id AND b.unit_id = u.unit_id)""",
    "obsolete_units": f"""WITH {_PUBLISHED}, final AS (SELECT repo_id, plugin_id, unit_id, arg_max(kind, w_at) AS kind FROM acting GROUP BY ALL)
        SELECT repo_id, plugin_id, unit_id FROM final f WHERE kind LIKE '%replace' AND NOT EXISTS (SELECT 1 FROM units u WHERE u.repo_id = f.repo_id AND u.plugin_id = f.plugin_id AND u.unit_id = f.unit_id)""",
    "run_diagnostics": """WITH l AS (SELECT *, row_number() OVER (PARTITION BY repo_id, run_id ORDER BY status <> 'Running' DESC, completed_at DESC NULLS LAST) AS rn FROM runs),
        a AS (SELECT repo_id, count(*) AS n_runs, sum(coalesce(unresolved_relationships, 0))::BIGINT AS unresolved_relationships, sum(coalesce(unresolved_targets, 0))::BIGINT AS unresolved_targets, sum(coalesce(changed_count, 0))::BIGINT AS changed_count FROM l WHERE rn = 1 GROUP BY ALL),
        w AS (SELECT repo_id, string_agg(c, ',' ORDER BY c) AS warning_codes FROM (SELECT DISTINCT repo_id, unnest(warning_codes) AS c FROM l WHERE rn = 1) GROUP BY ALL)
        SELECT a.*, coalesce(w.warning_codes, '') AS warning_codes FROM a LEFT JOIN w ON w.repo_id = a.repo_id""",
    "health": """WITH r AS (SELECT repo_id FROM units UNION SELECT repo_id FROM nodes UNION SELECT repo_id FROM declarations UNION SELECT repo_id FROM edges)
        SELECT repo_id, (SELECT count(DISTINCT (plugin_id, unit_id)) FROM units x WHERE x.repo_id = r.repo_id) AS units, (SELECT count(DISTINCT node_id) FROM nodes x WHERE x.repo_id = r.repo_id) AS nodes,
          (SELECT count(DISTINCT declaration_id) FROM declarations x WHERE x.repo_id = r.repo_id) AS declarations, (SELECT count(DISTINCT edge_id) FROM edges x WHERE x.repo_id = r.repo_id) AS edges FROM r""",
} | _NEIGHBOURS

_GRAPH["impact_mirrored"] = _GRAPH["impact_d2"]

ORACLES = _GRAPH | {
    "p1_found": f"WITH {_ORPHANS} SELECT DISTINCT ref_table, ref_column, repo_id, ref_id FROM orphan",
    "p1_counts": f"""WITH {_ORPHANS},
        a AS (SELECT ref_table, ref_column, repo_id, ref_id, min(w_at) AS w_at FROM refs WHERE key IS NOT NULL GROUP BY ALL),
        b AS (SELECT ref_table, ref_column, repo_id, ref_id, min(w_at) AS w_at FROM orphan GROUP BY ALL),
        m AS (SELECT ref_table, ref_column, strftime(w_at, '%Y-%m') AS month, 1 AS n, 0 AS o FROM a UNION ALL SELECT ref_table, ref_column, strftime(w_at, '%Y-%m'), 0, 1 FROM b)
        SELECT ref_table, ref_column, month, sum(n)::BIGINT AS n_refs, sum(o)::BIGINT AS n_orphans FROM m GROUP BY ALL""",
    "p1_snapshots": f"""WITH {_ORPHANS},
        life AS (SELECT 'node' AS parent, repo_id, node_id AS key, written_at AS a, deleted_at AS z FROM nodes UNION ALL SELECT 'run', repo_id, run_id, started_at, NULL FROM runs),
        ev AS (SELECT w_at AS t FROM refs WHERE key IS NOT NULL UNION ALL SELECT a FROM life UNION ALL SELECT z FROM life WHERE z IS NOT NULL),
        low AS (SELECT min(year(t) * 4 + quarter(t) - 1) AS b FROM (SELECT a AS t FROM life UNION ALL SELECT z FROM life)),
        p AS (SELECT DISTINCT coalesce(year(t) * 4 + quarter(t) - 1, (SELECT b FROM low)) AS batch FROM ev),
        r AS (SELECT *, coalesce(year(w_at) * 4 + quarter(w_at) - 1, (SELECT b FROM low)) AS b FROM refs WHERE key IS NOT NULL),
        l AS (SELECT parent, repo_id, key, coalesce(year(a) * 4 + quarter(a) - 1, (SELECT b FROM low)) AS b, CASE WHEN z IS NOT NULL THEN year(z) * 4 + quarter(z) - 1 END AS e FROM life),
        live_at AS (SELECT DISTINCT p.batch, l.parent, l.repo_id, l.key FROM p JOIN l ON l.b <= p.batch AND (l.e IS NULL OR l.e > p.batch)),
        o AS (SELECT DISTINCT p.batch, r.ref_table, r.ref_column, r.repo_id, r.ref_id, strftime(r.w_at, '%Y-%m') AS month FROM p JOIN r ON r.b <= p.batch
          ANTI JOIN live_at x ON x.batch = p.batch AND x.parent = r.parent AND x.repo_id = r.repo_id AND x.key = r.key)
        SELECT batch, ref_table, ref_column, month, count(*) AS n_orphans FROM o GROUP BY ALL""",
    "p2_found": f"""WITH {_PUBLISHED},
        final AS (SELECT repo_id, plugin_id, unit_id, arg_max(kind, w_at) AS kind, arg_max(seq, w_at) AS seq FROM acting GROUP BY ALL)
        SELECT repo_id, plugin_id, unit_id, seq FROM final WHERE kind LIKE '%replace'""",
    "p6_found": f"WITH RECURSIVE {_REACH} SELECT DISTINCT repo_id, a AS node_id FROM reach WHERE a = b",
    "p6_hierarchy": _HIERARCHY,
    "p6_split": _HIERARCHY,
    "p6_descendants": f"WITH RECURSIVE {_REACH} SELECT repo_id, a AS ancestor, b AS descendant FROM reach WHERE a <> b",
    "p7_found": f"WITH {_PLAN} SELECT DISTINCT repo_id, plugin_id, path FROM plan WHERE change IN ('New', 'Changed')",
    "p7_batches": rf"""WITH {_PLAN},
        early AS (
          SELECT repo_id, plugin_id, path, arg_max(plugin_version, (observed_at, file_id)) AS plugin_version, replace(lower(arg_max(source_hash, (observed_at, file_id))), 'sha256:', '') AS digest
          FROM source_files WHERE observed_at < TIMESTAMP '2025-07-01' GROUP BY ALL),
        one AS (
          SELECT c.repo_id, CASE WHEN w.path IS NULL THEN 'New' ELSE 'Changed' END AS change FROM early c LEFT JOIN was w ON c.repo_id = w.repo_id AND c.plugin_id = w.plugin_id AND c.path = w.path
          WHERE w.path IS NULL OR c.digest <> w.digest OR c.plugin_version <> w.plugin_version),
        held AS (SELECT repo_id, plugin_id, path, plugin_version, digest FROM early UNION ALL SELECT repo_id, plugin_id, path, plugin_version, digest FROM was WHERE repo_id NOT IN (SELECT repo_id FROM early)),
        two AS (
          SELECT c.repo_id, CASE WHEN w.path IS NULL THEN 'New' ELSE 'Changed' END AS change FROM cur c LEFT JOIN held w ON c.repo_id = w.repo_id AND c.plugin_id = w.plugin_id AND c.path = w.path
          WHERE w.path IS NULL OR c.digest <> w.digest OR c.plugin_version <> w.plugin_version)
        SELECT repo_id, 'first' AS batch, change, count(*) AS n FROM one GROUP BY ALL UNION ALL SELECT repo_id, 'second', change, count(*) FROM two GROUP BY ALL""",
    "p7_plan": f"WITH {_PLAN} SELECT repo_id, change, count(*) AS n FROM plan GROUP BY ALL",
}
