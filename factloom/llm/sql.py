"""SQL for the subpackage's queries, where SQL can express them (SQL has no tokenizer or parser)."""

ORACLES: dict[str, str] = {
    "p3_declared": r"""WITH f AS (SELECT DISTINCT file_id, replace(path, '\', '/') AS p FROM source_files),
        r AS (SELECT file_id, p LIKE '%.ex' AS generated, p LIKE 'web/%' AND (regexp_matches(p, 'View\.js$') OR NOT regexp_matches(p, '(^|/)[^/]*Plan\.[^/]*(/|$)')) AS vendored,
          regexp_matches(p, '(^|/)[^/]*Plan\.[^/]*(/|$)') AND NOT (p LIKE 'web/%' AND regexp_matches(p, 'View\.js$')) AS not_vendored, p LIKE 'web/%' AND regexp_matches(p, 'Store\.js$') AS denied FROM f)
        SELECT file_id, bool_or(generated) AS generated, bool_or(vendored) AS vendored, bool_or(not_vendored) AS not_vendored FROM r GROUP BY file_id HAVING bool_or(generated OR vendored OR not_vendored OR denied)""",
}
