"""Recursive chunking in SQL: the twin of ``chunk_recursive``."""

from __future__ import annotations

from ..config import ChunkConfig
from .tables import sql_strip


def recursive_chunks(source: str, key: str, text: str, cfg: ChunkConfig = ChunkConfig()) -> str:
    """CTEs, for WITH RECURSIVE, up to ``cut`` (key, chunk_no, content).

    ``node`` opens a text at the first separator that it has, and what is still too long at
    a finer one. Neighbours that are short enough make a run (``run``), with the characters
    before each of its ends. ``step`` fills chunks: from place s, up to place e.
    """
    size, overlap = cfg.size, cfg.overlap
    pieces = "list_filter(list_concat([p[1]], list_transform(p[2:], lambda x: {sep} || x)), lambda x: x <> '')"
    opened = " ".join(
        f"WHEN {n} THEN {pieces.format(sep=sep)}" for n, sep in ((1, "chr(10) || chr(10)"), (2, "chr(10)"), (3, "' '"))
    )
    return f"""node AS (
  SELECT {key}, []::INTEGER[] AS path, {text} AS body, 0 AS used, true AS long FROM {source}
  UNION ALL
  SELECT {key}, list_append(path, unnest(range(len(ps)))::INTEGER), unnest(ps), sep, length(unnest(ps)) >= {size} FROM (
    SELECT {key}, path, sep, CASE sep {opened} ELSE list_filter(p, lambda x: x <> '') END AS ps FROM (
      SELECT {key}, path, sep, string_split(body, CASE sep WHEN 1 THEN chr(10) || chr(10) WHEN 2 THEN chr(10) WHEN 3 THEN ' ' ELSE '' END) AS p FROM (
        SELECT {key}, path, body, CASE WHEN used < 1 AND contains(body, chr(10) || chr(10)) THEN 1
          WHEN used < 2 AND contains(body, chr(10)) THEN 2 WHEN used < 3 AND contains(body, ' ') THEN 3 ELSE 4 END AS sep
        FROM node WHERE long)))),
leaf AS (
  SELECT {key}, path, path[1:len(path) - 1] AS parent, body, long,
    sum(long::INTEGER) OVER (PARTITION BY {key}, path[1:len(path) - 1] ORDER BY path) AS gap
  FROM node WHERE len(path) > 0),
ends AS (
  SELECT *, sum(length(body)) OVER (PARTITION BY {key}, parent, gap ORDER BY path) AS upto FROM leaf WHERE NOT long),
run AS (
  SELECT {key}, min(path) AS first, list(body ORDER BY path) AS bodies,
    list_prepend(0, list(upto::INTEGER ORDER BY path)) AS upto FROM ends GROUP BY {key}, parent, gap),
step AS (
  SELECT *, 0 AS k, 0 AS s, len(list_filter(upto, lambda x: x <= {size})) - 1 AS e FROM run
  UNION ALL
  SELECT {key}, first, bodies, upto, k, s, len(list_filter(upto, lambda x: x <= upto[s + 1] + {size})) - 1 FROM (
    SELECT {key}, first, bodies, upto, k + 1 AS k, list_filter(range(s, e + 1), lambda i: upto[e + 1] - upto[i + 1] <= {overlap}
      AND (upto[e + 2] - upto[i + 1] <= {size} OR i = e))[1] AS s
    FROM step WHERE e < len(bodies))),
filled AS (SELECT {key}, first, k, {sql_strip("array_to_string(bodies[s + 1:e], '')")} AS content FROM step),
cut AS (
  SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY first, k) - 1 AS chunk_no, content
  FROM filled WHERE content <> '')"""
