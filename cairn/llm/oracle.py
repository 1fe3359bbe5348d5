"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from cairn.llm import licenses, mixing


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_sql() -> str:
    """The license scan: every rule on every text, without keyword gates; words stand two spaces apart."""
    rows = ", ".join(f"({r.priority}, {r.weight}, {quoted(r.label)}, {quoted(' (' + r.expression.replace(' ', '  ') + ') ')})" for r in licenses.rules())
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
    WITH rule AS (SELECT * FROM (VALUES {rows}) AS r(priority, weight, label, pattern)),
    w AS (SELECT doc_id, ' ' || trim(regexp_replace(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g')) || ' ' AS s FROM documents),
    m AS (SELECT w.doc_id, priority, weight, label, string_split(trim(regexp_replace(s, pattern, ' ' || chr(1) || '\1' || chr(2) || ' ', 'g')), '  ') AS parts
          FROM w JOIN rule ON regexp_matches(s, pattern)),
    p AS (SELECT doc_id, priority, weight, label,
                 unnest(list_filter(range(0, len(parts)), lambda i: starts_with(parts[i + 1], chr(1)))) AS start,
                 unnest(list_filter(range(0, len(parts)), lambda i: suffix(parts[i + 1], chr(2)))) AS stop FROM m),
    kept AS (SELECT * FROM p d WHERE priority = {licenses.BASE_PRIORITY} OR NOT EXISTS (
        SELECT 1 FROM p e WHERE e.doc_id IS NOT DISTINCT FROM d.doc_id AND e.start <= d.start AND e.stop >= d.stop
          AND (e.priority > d.priority OR (e.priority = d.priority AND (e.start < d.start OR e.stop > d.stop))))),
    k AS (SELECT doc_id, count(*) FILTER (WHERE priority = {licenses.BASE_PRIORITY}) AS n_base,
                 min(start) FILTER (WHERE priority = {licenses.BASE_PRIORITY}) AS first_word, max(start) FILTER (WHERE priority = {licenses.BASE_PRIORITY}) AS last_word,
                 array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE priority = {licenses.BASE_PRIORITY})), ',') AS base_labels,
                 array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(weight) AS score FROM kept GROUP BY doc_id)
    SELECT w.doc_id AS doc_id, CAST(CASE WHEN trim(s) = '' THEN 0 ELSE len(string_split(trim(s), '  ')) END AS BIGINT) AS n_words,
           coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
    FROM w LEFT JOIN k ON w.doc_id = k.doc_id
    """


def mixing_sql() -> str:
    """The mixing schedule: earliest deadline first over all slots as one recursion (tables of one period)."""
    return f"""
    WITH RECURSIVE keyed AS (SELECT doc_id, source, count(*) AS n FROM documents GROUP BY doc_id, source),
    per AS (SELECT source, sum(n) AS rows, (count(*) + {mixing.BLOCK_ROWS - 1}) // {mixing.BLOCK_ROWS} AS m FROM keyed GROUP BY source),
    top AS (SELECT source, m, CAST(floor(sqrt(rows) * {mixing.SCALE}) AS BIGINT) AS w, row_number() OVER (ORDER BY rows DESC, source NULLS FIRST) - 1 AS rank FROM per),
    t AS (SELECT list(w ORDER BY rank) AS w, list(m ORDER BY rank) AS m, CAST(sum(w) AS BIGINT) AS total, any_value(last) AS last
          FROM (SELECT *, max((m * total + w - 1) // w) OVER () AS last FROM (SELECT *, CAST(sum(w) OVER () AS BIGINT) AS total FROM top))),
    sched AS (
        SELECT CAST(-1 AS BIGINT) AS slot, list_transform(w, lambda x: CAST(0 AS BIGINT)) AS done, CAST(NULL AS BIGINT) AS rank, CAST(NULL AS BIGINT) AS block FROM t
        UNION ALL
        SELECT slot + 1, list_transform(range(0, len(done)), lambda i: done[i + 1] + CASE WHEN i = p THEN 1 ELSE 0 END), p, done[p + 1]
        FROM (SELECT slot, done, list_min(list_transform(range(0, len(done)), lambda i: CASE WHEN done[i + 1] < m[i + 1] AND done[i + 1] * total // w[i + 1] <= slot + 1
              THEN (((done[i + 1] + 1) * total + w[i + 1] - 1) // w[i + 1]) * 100000 + i END)) % 100000 AS p FROM sched, t WHERE slot + 1 < last)),
    numbered AS (SELECT doc_id, source, n, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos FROM keyed)
    SELECT r.doc_id AS doc_id, r.source AS source, n, c.block AS block, c.block * total // top.w AS release, ((c.block + 1) * total + top.w - 1) // top.w AS deadline, slot, pos % {mixing.BLOCK_ROWS} AS place
    FROM numbered r JOIN top ON r.source IS NOT DISTINCT FROM top.source JOIN sched c ON c.rank = top.rank AND c.block = r.pos // {mixing.BLOCK_ROWS}, (SELECT total FROM t)
    """
