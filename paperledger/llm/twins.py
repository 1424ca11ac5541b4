"""SQL twins that are put together from repeated pieces."""

from __future__ import annotations


def conversations() -> str:
    """Twin of ``op12_conversations``: a walk over each conversation's rows with the best edits up to each state.

    A column of the walk holds 8 digits of cost and the letters behind them, so
    the least text is the cheapest, and of equals the least in ASCII.
    """

    def add(value: str, cost: str, letter: str) -> str:
        return f"lpad((CAST(substr({value}, 1, 8) AS INT) + {cost})::VARCHAR, 8, '0') || substr({value}, 9) || '{letter}'"

    def edit(values: list[str], cost: str, letter: str, given: str) -> str:
        return f"CASE WHEN {given} THEN least({', '.join(add(v, cost, letter) for v in values)}) END"

    into_user = ["w0", "w1", "w3"]
    inserted = f"""SELECT *, least(v3, {add("u", "2", "I")}) AS w3, u AS w2, v0 AS w0, v1 AS w1
    FROM (SELECT *, least(v2, {", ".join(add(v, "2", "I") for v in ("v0", "v1", "v3"))}) AS u FROM walk)"""
    return rf"""
WITH RECURSIVE steps AS (
    SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: xor(c >> 1, (c & 1) * 3988292384), n)) AS t
), hashed AS (
    SELECT c.*, xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
                                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS kind
    FROM conversations c, steps
), damaged AS (
    SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
           unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM hashed
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), copy) AS i FROM damaged
), judged AS (
    SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
           CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
    FROM placed
), facts AS MATERIALIZED (
    SELECT *, coalesce(fault NOT IN ('blank', 'duplicate'), true) AS whole, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS extra FROM judged
), walk AS (
    SELECT conv_id, 0::BIGINT AS i, '00000000' AS v0, NULL::VARCHAR AS v1, NULL::VARCHAR AS v2, NULL::VARCHAR AS v3 FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT f.conv_id, f.i, {add("w0", "3", "D")},
           least({add("w1", "3", "D")}, {edit(["w0"], "extra", "K", "whole AND initial = 's'")}),
           least({add("w2", "3", "D")}, {edit(into_user, "extra", "K", "whole AND initial = 'u'")}, {edit(into_user, "extra + 2", "R", "whole")}),
           least({add("w3", "3", "D")}, {edit(["w2"], "extra", "K", "whole AND initial = 'a'")}, {edit(["w2"], "extra + 2", "R", "whole")})
    FROM ({inserted}) w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
), best AS (
    SELECT conv_id, CAST(substr(b, 1, 8) AS BIGINT) AS cost, substr(b, 9) AS audit
    FROM (SELECT conv_id, least(w0, w3) AS b FROM ({inserted}) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)
), letters AS (
    SELECT conv_id, unnest(string_split(audit, '')) AS letter, unnest(range(length(audit))) AS j FROM best WHERE audit <> ''
), aligned AS (
    SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER sofar AS i, count(*) FILTER (WHERE letter <> 'D') OVER sofar AS o
    FROM letters WINDOW sofar AS (PARTITION BY conv_id ORDER BY j)
), outcome AS (
    SELECT a.conv_id, a.j, a.letter, a.o, f.role, CASE a.letter WHEN 'I' THEN '' ELSE f.text END AS text,
           max(CASE WHEN a.o = 1 AND a.letter = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY a.conv_id) AS led
    FROM aligned a LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM a.conv_id AND f.i = a.i WHERE a.letter <> 'D'
), repaired AS (
    SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS body
    FROM outcome GROUP BY conv_id
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
           count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
           count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM facts GROUP BY conv_id
)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM best b LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM b.conv_id
"""


def centroids(clusters: int = 40, rounds: int = 5, size: int = 64) -> str:
    """Twin of ``op13_centroids``: every vector against every centroid, round by round."""
    distance = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [
        f"""kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) = {size} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
)""",
        f"""c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster, v AS c FROM kept ORDER BY sha256('2:' || vec_id) LIMIT {clusters}
)""",
    ]
    for k in range(rounds + 1):
        parts.append(f"""a{k} AS MATERIALIZED (
    SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': {distance}, 'n': cluster}}) AS near FROM kept, c{k} GROUP BY r
)""")
        if k < rounds:
            parts.append(f"""c{k + 1} AS MATERIALIZED (
    SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{k} o LEFT JOIN (
        SELECT n, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY i) AS c
        FROM (SELECT near.n AS n, i, sum(x) AS s, count(*) AS m FROM (SELECT near, unnest(v) AS x, unnest(range({size})) AS i FROM a{k}) GROUP BY near.n, i)
        GROUP BY n
    ) m ON m.n = o.cluster
)""")
    return "WITH " + ", ".join(parts) + f"""
SELECT vec_id, CAST(near.n AS INT) AS cluster, CAST(near.d AS BIGINT) AS distance, CAST(sum(near.d) OVER (PARTITION BY near.n) AS BIGINT) AS cluster_inertia,
       CAST(sum(near.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON cluster = near.n
"""
