"""The recursive splitter as SQL that DuckDB runs: recursive queries over pieces and separators.

Written from the definition, apart from the splitter's code: pieces that are too long are cut
by the next separator that they hold, and runs of parts that fit are merged.
"""

from __future__ import annotations

#: The separators, as SQL strings, by level from 1; the last one cuts between all characters.
LEVELS = ("chr(10) || chr(10)", "chr(10)", "'. '", "'; '", "', '", "' '", "''")


def pieces(source: str, size: int, overlap: int, name: str) -> str:
    """CTEs that end with ``name`` (key, part, start, text): the pieces of ``source`` (key, text)."""
    last = len(LEVELS)
    level = "CASE " + " ".join(f"WHEN level <= {k} AND contains(body, {s}) THEN {k}" for k, s in enumerate(LEVELS[:-1], 1)) + f" ELSE {last} END"
    separator = "CASE " + " ".join(f"WHEN lv = {k} THEN {s}" for k, s in enumerate(LEVELS, 1)) + " END"
    following = lambda s, i: f"coalesce(list_min(list_filter(range({i} + 1, m + 1), lambda j: b[j + 1] - b[{s}] > {size})), m + 1)"
    begin = f"list_min(list_filter(range(s, j + 1), lambda x: b[j] - b[x] <= {overlap} AND (b[j] = b[x] OR b[j + 1] - b[x] <= {size})))"
    return f"""
{name}_cut AS (
  SELECT key, '' AS path, 0 AS i, text AS body, CAST(0 AS BIGINT) AS off, 1 AS level, TRUE AS big FROM {source} WHERE text <> ''
  UNION ALL
  SELECT key, path || '/' || i, place, part, CAST(off + upto AS BIGINT), lv + 1, lv < {last} AND length(part) >= {size}
  FROM (
    SELECT *, unnest(parts) AS part, generate_subscripts(parts, 1) AS place, unnest(sums) AS upto
    FROM (
      SELECT *, list_transform(range(1, len(parts) + 1), lambda k: coalesce(list_sum(list_transform(parts[1 : k - 1], lambda p: length(p))), 0)) AS sums
      FROM (
        SELECT key, path, i, body, off, lv, list_filter(list_concat([cut[1]], list_transform(cut[2:], lambda x: {separator} || x)), lambda x: x <> '') AS parts
        FROM (SELECT *, string_split(body, {separator}) AS cut FROM (SELECT *, {level} AS lv FROM {name}_cut WHERE big)))))),
{name}_runs AS (SELECT key, path, off, length(body) AS n, big, count(*) FILTER (big) OVER (PARTITION BY key, path ORDER BY i) AS run FROM {name}_cut WHERE i > 0),
{name}_groups AS (SELECT key, list_append(list(off ORDER BY off), max(off + n)) AS b, count(*) AS m FROM {name}_runs WHERE NOT big GROUP BY key, path, run),
{name}_merged AS (
  SELECT key, b, m, CAST(1 AS BIGINT) AS s, CAST({following(1, 1)} AS BIGINT) AS j FROM {name}_groups
  UNION ALL
  SELECT key, b, m, s, CAST({following("s", "i")} AS BIGINT) FROM (SELECT key, b, m, CAST({begin} AS BIGINT) AS s, j AS i FROM {name}_merged WHERE j <= m)),
{name}_texts AS (
  SELECT key, row_number() OVER (PARTITION BY key ORDER BY b[s], b[j]) AS part, piece FROM (
    SELECT key, b, s, j, regexp_replace(substr(text, b[s] + 1, b[j] - b[s]), '^\\s+|\\s+$', '', 'g') AS piece FROM {name}_merged JOIN {source} USING (key)) WHERE piece <> ''),
{name}_placed AS (
  SELECT key, part, piece, CAST(instr(text, piece) - 1 AS BIGINT) AS start FROM {name}_texts JOIN {source} USING (key) WHERE part = 1
  UNION ALL
  SELECT t.key, t.part, t.piece, CAST(greatest(0, p.start + length(p.piece) - {overlap}) + instr(substr(text, CAST(greatest(0, p.start + length(p.piece) - {overlap}) + 1 AS BIGINT)), t.piece) - 1 AS BIGINT)
  FROM {name}_placed p JOIN {name}_texts t ON t.key = p.key AND t.part = p.part + 1 JOIN {source} d ON d.key = t.key),
{name} AS (SELECT key, CAST(part - 1 AS INT) AS part, CAST(start AS INT) AS start, piece AS text FROM {name}_placed)"""
