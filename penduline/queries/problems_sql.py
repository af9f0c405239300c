"""SQL twins of the problem queries (DuckDB)."""

from __future__ import annotations

_SNAPSHOTS = """
named AS (SELECT * FROM view_a WHERE dataset_id IS NOT NULL AND release_no IS NOT NULL),
deliveries AS (SELECT dataset_id, release_no, max(delivered_at) AS at FROM named GROUP BY ALL),
releases AS (SELECT dataset_id, release_no, lag(release_no) OVER (PARTITION BY dataset_id ORDER BY release_no) AS prev_no FROM deliveries),
scene_rows AS (SELECT v.dataset_id, v.release_no, unnest(map_entries(v.scenes)) AS s FROM named v JOIN deliveries d ON v.dataset_id = d.dataset_id AND v.release_no = d.release_no AND v.delivered_at IS NOT DISTINCT FROM d.at),
group_rows AS (SELECT dataset_id, release_no, s.key AS scene, unnest(map_entries(s.value)) AS g FROM scene_rows),
id_rows AS (SELECT dataset_id, release_no, scene, g.key AS grp, unnest(g.value) AS case_id FROM group_rows),
places AS (SELECT dataset_id, release_no, case_id, list_sort(list(DISTINCT scene || '|' || grp)) AS place FROM id_rows WHERE case_id IS NOT NULL GROUP BY ALL)
"""

_ORPHANS = """
listed AS (SELECT view_id, delivered_at, unnest(map_entries(scenes)) AS s FROM view_b),
grouped AS (SELECT view_id, delivered_at, unnest(map_entries(s.value)) AS g FROM listed),
ids AS (SELECT view_id, delivered_at, unnest(g.value) AS id FROM grouped),
every AS (
  SELECT 'cases' AS ref_table, 'parent_case_id' AS ref_field, case_id AS ref_key, provenance.parent_case_id AS target_key, 'cases' AS parent, received_at AS seen FROM cases
  UNION ALL SELECT 'cases', 'physics_reference_video', case_id, assets['physics_reference_video'], 'asset_lock', received_at FROM cases
  UNION ALL SELECT 'view_b', 'scenes', view_id, id, 'cases', delivered_at FROM ids
  UNION ALL SELECT 'predictions', 'case_id', job_id, case_id, 'cases', submitted_at FROM predictions),
refs AS (SELECT ref_table, ref_field, ref_key, target_key, parent, min(seen) AS seen FROM every WHERE target_key IS NOT NULL AND target_key <> '' GROUP BY ALL),
arrivals AS (SELECT DISTINCT 'cases' AS parent, case_id AS target_key, received_at AS seen FROM cases UNION SELECT 'asset_lock', path, locked_at FROM asset_lock),
deletions AS (SELECT DISTINCT 'cases' AS parent, case_id AS target_key, deleted_at AS seen FROM case_deletions WHERE deleted_at IS NOT NULL UNION SELECT 'asset_lock', path, withdrawn_at FROM asset_lock WHERE withdrawn_at IS NOT NULL),
firsts AS (SELECT parent, target_key, min(seen) AS seen FROM arrivals GROUP BY ALL),
last_deletion AS (SELECT r.ref_table, r.ref_field, r.ref_key, r.target_key, max(d.seen) AS seen FROM refs r JOIN deletions d ON d.parent = r.parent AND d.target_key = r.target_key AND d.seen <= r.seen GROUP BY ALL),
judged AS (
  SELECT r.*, CASE WHEN f.seen IS NULL THEN 'missing' WHEN f.seen > r.seen THEN 'late'
    WHEN l.seen IS NOT NULL AND NOT EXISTS (SELECT 1 FROM arrivals a WHERE a.parent = r.parent AND a.target_key = r.target_key AND a.seen > l.seen AND a.seen <= r.seen) THEN 'deleted' END AS reason
  FROM refs r LEFT JOIN firsts f ON f.parent = r.parent AND f.target_key = r.target_key
  LEFT JOIN last_deletion l ON l.ref_table = r.ref_table AND l.ref_field = r.ref_field AND l.ref_key = r.ref_key AND l.target_key = r.target_key),
orphan AS (SELECT ref_table, ref_field, ref_key, target_key, strftime(seen, '%Y-%m') AS period, reason FROM judged WHERE reason IS NOT NULL)
"""

_DRIFT = """
docs AS (SELECT row_no, stream_id, file_no, CASE WHEN json_valid(body) THEN body END AS body FROM manifest_lines),
objects AS (SELECT row_no, stream_id, file_no, body, json_extract_string(body, '$.site') AS site FROM docs WHERE json_type(body) = 'OBJECT'),
tree AS (SELECT o.row_no, o.stream_id, o.file_no, o.site, t.fullkey, t.type, t.value FROM objects o, json_tree(o.body) t),
leaves AS (SELECT stream_id, file_no, site, replace(substr(fullkey, 3), '"', '') AS path,
    CASE WHEN type = 'VARCHAR' THEN 'string' WHEN type = 'BOOLEAN' THEN 'boolean' WHEN type = 'ARRAY' THEN 'array' WHEN type = 'NULL' THEN NULL ELSE 'number' END AS type,
    CASE WHEN type <> 'NULL' THEN type || value::VARCHAR END AS v
  FROM tree WHERE type <> 'OBJECT' AND fullkey NOT LIKE '%[%' AND fullkey <> '$.site'),
files AS (SELECT stream_id, file_no, lag(file_no) OVER (PARTITION BY stream_id ORDER BY file_no) AS prev_no FROM (SELECT DISTINCT stream_id, file_no FROM manifest_lines)),
paths AS (SELECT stream_id, file_no, path, list_sort(list(DISTINCT type) FILTER (type IS NOT NULL)) AS types FROM leaves GROUP BY ALL),
come AS (SELECT f.stream_id, f.file_no, f.prev_no, p.path FROM files f JOIN paths p ON p.stream_id = f.stream_id AND p.file_no = f.file_no
  WHERE f.prev_no IS NOT NULL AND NOT EXISTS (SELECT 1 FROM paths q WHERE q.stream_id = f.stream_id AND q.file_no = f.prev_no AND q.path = p.path)),
gone AS (SELECT f.stream_id, f.file_no, f.prev_no, p.path FROM files f JOIN paths p ON p.stream_id = f.stream_id AND p.file_no = f.prev_no
  WHERE NOT EXISTS (SELECT 1 FROM paths q WHERE q.stream_id = f.stream_id AND q.file_no = f.file_no AND q.path = p.path)),
said AS (SELECT stream_id, file_no, site, path, list_sort(list(DISTINCT v)) AS v FROM leaves WHERE v IS NOT NULL AND site IS NOT NULL GROUP BY ALL),
renamed AS (SELECT g.stream_id, g.file_no, g.path AS old_path, c.path AS new_path FROM gone g JOIN come c ON c.stream_id = g.stream_id AND c.file_no = g.file_no
  JOIN said a ON a.stream_id = g.stream_id AND a.file_no = g.prev_no AND a.path = g.path
  JOIN said b ON b.stream_id = c.stream_id AND b.file_no = c.file_no AND b.path = c.path AND b.site = a.site
  GROUP BY ALL HAVING bool_and(a.v = b.v))
"""

_RECORDS = """
-- values and the texts in them that are JSON themselves, down to objects that are cases
walk(record_id, j) AS (
  SELECT record_id, ltrim(body, chr(65279))::JSON FROM case_records WHERE json_valid(ltrim(body, chr(65279)))
  UNION ALL
  SELECT record_id, e.v FROM walk, LATERAL (
    SELECT unnest(CASE json_type(j)
      WHEN 'ARRAY' THEN json_extract(j, '$[*]')
      WHEN 'OBJECT' THEN CASE WHEN list_contains(json_keys(j), 'case_id') THEN [] ELSE json_extract(j, '$.*') END
      WHEN 'VARCHAR' THEN CASE WHEN json_valid(ltrim(j->>'$', chr(65279))) AND left(ltrim(j->>'$', chr(65279) || ' ' || chr(9) || chr(10) || chr(13)), 1) IN ('{', '[', '"')
        THEN [ltrim(j->>'$', chr(65279))::JSON] ELSE [] END
      ELSE [] END) AS v) e),
found_cases AS (SELECT row_number() OVER () AS case_no, record_id, j FROM walk WHERE json_type(j) = 'OBJECT' AND list_contains(json_keys(j), 'case_id')),
parts AS (SELECT case_no, record_id, p.child_table, p.inner_table, p.inner_name, p.name_field, j->p.part AS held
  FROM found_cases, (VALUES ('physical_parameters', 'quantity', 'reading', 'readings', 'name'), ('input_views', 'view', 'crop', 'crops', 'view'), ('assets', 'asset', 'rendition', 'renditions', 'role')) p(part, child_table, inner_table, inner_name, name_field)),
entries AS (
  SELECT * EXCLUDE (held, k), k AS item_path, held->('$."' || k || '"') AS entry FROM (SELECT *, unnest(json_keys(held)) AS k FROM parts WHERE json_type(held) = 'OBJECT')
  UNION ALL
  SELECT * EXCLUDE (held, e, i, entry_names), coalesce(list_filter(entry_names, lambda x: x IS NOT NULL)[1], (i - 1)::VARCHAR), e FROM (
    SELECT *, list_transform([name_field, 'name', 'view', 'role'], lambda f: CASE WHEN json_type(e, '$.' || f) = 'VARCHAR' THEN e->>('$.' || f) END) AS entry_names
    FROM (SELECT *, unnest(json_extract(held, '$[*]')) AS e, generate_subscripts(json_extract(held, '$[*]'), 1) AS i FROM parts WHERE json_type(held) = 'ARRAY'))),
given AS (SELECT * FROM entries WHERE json_type(entry) <> 'NULL'),
inner_lists AS (SELECT record_id, inner_table AS child_table, item_path AS parent_path, entry->inner_name AS held FROM given WHERE json_type(entry, '$.' || inner_name) = 'ARRAY'),
step_lists AS (SELECT case_no, record_id, j->'$.provenance.generator.steps' AS held FROM found_cases WHERE json_type(j, '$.provenance.generator.steps') = 'ARRAY'),
steps AS (SELECT record_id, (i - 1)::VARCHAR AS item_path, e AS entry FROM (
  SELECT record_id, unnest(json_extract(held, '$[*]')) AS e, generate_subscripts(json_extract(held, '$[*]'), 1) AS i FROM step_lists) WHERE json_type(e) <> 'NULL'),
lists AS (SELECT * FROM inner_lists UNION ALL SELECT record_id, 'step_input', item_path, entry->'inputs' FROM steps WHERE json_type(entry, '$.inputs') = 'ARRAY'),
items AS (SELECT record_id, child_table, parent_path || '/' || (i - 1) AS item_path, parent_path, e AS entry FROM (
  SELECT record_id, child_table, parent_path, unnest(json_extract(held, '$[*]')) AS e, generate_subscripts(json_extract(held, '$[*]'), 1) AS i FROM lists) WHERE json_type(e) <> 'NULL'),
children AS (
  SELECT record_id, child_table, item_path, entry, '' AS parent_path FROM given
  UNION ALL SELECT record_id, 'step', item_path, entry, '' FROM steps
  UNION ALL SELECT record_id, child_table, item_path, entry, parent_path FROM items)
"""

SQL: dict[str, str] = {
    "p2_found": f"WITH RECURSIVE {_RECORDS} SELECT record_id, child_table, item_path FROM children",
    "p2_tables": f"""WITH RECURSIVE {_RECORDS}
      SELECT 'case' AS tag, count(*) AS n_rows, count(DISTINCT record_id) AS n_records FROM found_cases HAVING count(*) > 0
      UNION ALL SELECT child_table, count(*), count(DISTINCT record_id) FROM children GROUP BY child_table""",
    "p2_cases": f"""WITH RECURSIVE {_RECORDS} SELECT record_id, j->>'schema_version' AS schema_version, j->>'case_id' AS case_id, j->>'scene_id' AS scene_id,
      j->>'$.ood.level' AS ood_level, (j->'$.ood.factors')::VARCHAR[] AS ood_factors FROM found_cases""",
    "p2_quantities": f"""WITH RECURSIVE {_RECORDS} SELECT record_id, item_path, 'case' AS parent_tag, parent_path,
      CASE WHEN json_type(entry) = 'OBJECT' THEN entry->>'value' ELSE entry->>'$' END AS value, entry->>'unit' AS unit,
      CASE WHEN json_type(entry, '$.annotated') = 'BOOLEAN' THEN (entry->>'annotated')::BOOLEAN END AS annotated FROM children WHERE child_table = 'quantity'""",
    "p2_readings": f"""WITH RECURSIVE {_RECORDS} SELECT record_id, item_path, 'quantity' AS parent_tag, parent_path,
      try_cast(CASE WHEN json_type(entry) = 'OBJECT' THEN entry->>'value' ELSE entry->>'$' END AS DOUBLE) AS value, entry->>'by' AS by FROM children WHERE child_table = 'reading'""",
    "p2_views": f"""WITH RECURSIVE {_RECORDS} SELECT record_id, item_path, 'case' AS parent_tag, parent_path,
      CASE WHEN json_type(entry) = 'OBJECT' THEN entry->>'prompt' ELSE entry->>'$' END AS prompt, entry->>'first_frame' AS first_frame FROM children WHERE child_table = 'view'""",
    "p2_crops": f"""WITH RECURSIVE {_RECORDS} SELECT record_id, item_path, 'view' AS parent_tag, parent_path, (entry->'box')::INTEGER[] AS box, (entry->>'frame')::INTEGER AS frame FROM children WHERE child_table = 'crop'""",
    "p2_assets": f"""WITH RECURSIVE {_RECORDS} SELECT record_id, item_path, 'case' AS parent_tag, parent_path,
      CASE WHEN json_type(entry) = 'OBJECT' THEN entry->>'path' ELSE entry->>'$' END AS path FROM children WHERE child_table = 'asset'""",
    "p2_renditions": f"""WITH RECURSIVE {_RECORDS} SELECT record_id, item_path, parent_path, (entry->>'height')::INTEGER AS height, entry->>'path' AS path,
      (entry->>'$.audio.channels')::INTEGER AS audio_channels FROM children WHERE child_table = 'rendition'""",
    "p2_steps": f"""WITH RECURSIVE {_RECORDS} SELECT s.record_id, s.item_path, CASE WHEN json_type(s.entry) = 'OBJECT' THEN s.entry->>'op' ELSE s.entry->>'$' END AS op, a.arg,
      (s.entry->>('$.args."' || a.arg || '"'))::DOUBLE AS arg_value
      FROM (SELECT * FROM children WHERE child_table = 'step') s LEFT JOIN LATERAL (SELECT unnest(json_keys(s.entry, '$.args')) AS arg) a ON true""",
    "p2_step_inputs": f"""WITH RECURSIVE {_RECORDS} SELECT record_id, item_path, parent_path, CASE WHEN json_type(entry) = 'OBJECT' THEN (entry->>'frame')::INTEGER ELSE (entry->>'$')::INTEGER END AS frame,
      (entry->'$.mask.rle')::INTEGER[] AS mask_rle FROM children WHERE child_table = 'step_input'""",
    "p3_found": f"""WITH {_SNAPSHOTS},
      later AS (SELECT r.dataset_id, r.release_no, p.case_id, p.place FROM releases r JOIN places p ON p.dataset_id = r.dataset_id AND p.release_no = r.release_no WHERE r.prev_no IS NOT NULL),
      earlier AS (SELECT r.dataset_id, r.release_no, p.case_id, p.place FROM releases r JOIN places p ON p.dataset_id = r.dataset_id AND p.release_no = r.prev_no)
      SELECT coalesce(l.dataset_id, e.dataset_id) AS dataset_id, coalesce(l.release_no, e.release_no) AS release_no, coalesce(l.case_id, e.case_id) AS case_id,
        CASE WHEN e.case_id IS NULL THEN 'added' WHEN l.case_id IS NULL THEN 'removed' ELSE 'changed' END AS change
      FROM later l FULL JOIN earlier e ON l.dataset_id = e.dataset_id AND l.release_no = e.release_no AND l.case_id = e.case_id
      WHERE l.place IS DISTINCT FROM e.place""",
    "p3_digests": """WITH ids AS (SELECT view_id, dataset_id, release_no, delivered_at, case_set_sha256, list_sort(list_distinct(flatten(list_transform(map_values(scenes), lambda g: flatten(map_values(g)))))) AS ids FROM view_a),
      own AS (SELECT *, sha256('[' || array_to_string(list_transform(ids, lambda x: '"' || x || '"'), ',') || ']') AS own_sha256 FROM ids)
      SELECT view_id, dataset_id, release_no, delivered_at, len(ids)::INTEGER AS n_ids, own_sha256, case_set_sha256 AS stated_sha256,
        CASE WHEN case_set_sha256 IS NULL THEN 'not_stated' WHEN case_set_sha256 = own_sha256 THEN 'match' ELSE 'mismatch' END AS verdict FROM own""",
    "p4_found": f"WITH {_ORPHANS} SELECT * FROM orphan",
    "p4_report": f"WITH {_ORPHANS} SELECT ref_table, ref_field, period, reason, count(*) AS n_refs, count(DISTINCT target_key) AS n_targets FROM orphan GROUP BY ALL",
    "p5_found": f"""WITH {_DRIFT}
      SELECT stream_id, file_no, 'renamed' AS change, old_path, new_path FROM renamed
      UNION ALL SELECT stream_id, file_no, 'added', '', path FROM come c WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.stream_id = c.stream_id AND r.file_no = c.file_no AND r.new_path = c.path)
      UNION ALL SELECT stream_id, file_no, 'removed', path, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.stream_id = g.stream_id AND r.file_no = g.file_no AND r.old_path = g.path)
      UNION ALL SELECT f.stream_id, f.file_no, 'type_changed', p.path, p.path FROM files f JOIN paths p ON p.stream_id = f.stream_id AND p.file_no = f.file_no
        JOIN paths q ON q.stream_id = f.stream_id AND q.file_no = f.prev_no AND q.path = p.path WHERE p.types <> q.types AND len(p.types) > 0 AND len(q.types) > 0""",
}
