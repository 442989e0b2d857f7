"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_ORACLES: dict[str, str] = {
    "op5_near_dedup": r"""
        WITH RECURSIVE words AS (
          SELECT doc_id, list_filter(string_split_regex(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
          FROM documents),
        sets AS (
          SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                 END AS s
          FROM words),
        shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
        links AS (
          SELECT a.doc_id AS a, b.doc_id AS b
          FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        reached AS (
          SELECT doc_id, doc_id AS root FROM documents
          UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.root = l.a)
        SELECT s.doc_id, len(s.s) AS n_shingles, min(r.root) AS component_id, s.doc_id = min(r.root) AS kept
        FROM sets s JOIN reached r ON s.doc_id = r.doc_id GROUP BY s.doc_id, s.s""",
    "op6_exact_dedup": """
        SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, false) AS kept, text_sha256
        FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256,
                     max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size
              FROM documents WINDOW same AS (PARTITION BY coalesce(text, '')))""",
    "op11_hard_negatives": """
        WITH v AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE) AS e
          FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
          SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same,
                 list_dot_product(a.e, c.e)::BIGINT AS score
          FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
        positives AS (
          SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT p.anchor_id, p.positive_id, (row_number() OVER best)::INTEGER AS rank, n.id AS negative_id,
               p.positive_score, n.score AS negative_score
        FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
         AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
        WINDOW best AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id)
        QUALIFY row_number() OVER best <= 5""",
    "op13_conversation_repair": r"""
        WITH RECURSIVE keyed AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 xor(4294967295, list_reduce(
                   list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
                   lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                     lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::BIGINT)) % 20 AS fault
          FROM conversations),
        damaged AS (
          SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
                 CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
          FROM keyed, range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
        placed AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos,
                 rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
          FROM damaged),
        judged AS (
          SELECT *, CASE WHEN bare = '' THEN 'blank'
                         WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                         WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS kind,
                 left(role, 1) AS first,
                 coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS odd
          FROM placed),
        counted AS (
          SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                 count(*) FILTER (kind = 'blank') AS blank, count(*) FILTER (kind = 'duplicate') AS duplicate,
                 count(*) FILTER (kind = 'truncated') AS truncated, count(*) FILTER (odd) AS illegal, max(pos) AS n
          FROM judged GROUP BY conv_id),
        paths AS (
          SELECT conv_id, 0::BIGINT AS pos, {'c': 0, 's': '', 't': []::VARCHAR[]} AS e, {'c': 1000000, 's': '', 't': []::VARCHAR[]} AS s,
                 {'c': 2, 's': 'I', 't': ['user:']} AS u, {'c': 4, 's': 'II', 't': ['user:', 'assistant:']} AS a
          FROM counted
          UNION ALL
          SELECT conv_id, pos, e, s, u1 AS u,
                 list_min([a, {'c': u1.c + 2, 's': u1.s || 'I', 't': list_append(u1.t, 'assistant:')}]) AS a
          FROM (
            SELECT conv_id, pos, e, s, a, list_min([u, {'c': x.c + 2, 's': x.s || 'I', 't': list_append(x.t, 'user:')}]) AS u1
            FROM (
              SELECT conv_id, pos, list_min([e, s, a]) AS x, e, s, u, a
              FROM (
                SELECT p.conv_id, r.pos, {'c': e.c + 3, 's': e.s || 'D', 't': e.t} AS e,
                       list_min([{'c': s.c + 3, 's': s.s || 'D', 't': s.t},
                                 {'c': e.c + more + CASE WHEN first = 's' THEN 0 ELSE 1000000 END, 's': e.s || 'K', 't': list_append(e.t, line)}]) AS s,
                       list_min([{'c': u.c + 3, 's': u.s || 'D', 't': u.t},
                                 {'c': b.c + more + 2, 's': b.s || 'R', 't': list_append(b.t, 'user:' || text)},
                                 {'c': b.c + more + CASE WHEN first = 'u' THEN 0 ELSE 1000000 END, 's': b.s || 'K', 't': list_append(b.t, line)}]) AS u,
                       list_min([{'c': a.c + 3, 's': a.s || 'D', 't': a.t},
                                 {'c': u.c + more + 2, 's': u.s || 'R', 't': list_append(u.t, 'assistant:' || text)},
                                 {'c': u.c + more + CASE WHEN first = 'a' THEN 0 ELSE 1000000 END, 's': u.s || 'K', 't': list_append(u.t, line)}]) AS a
                FROM (SELECT *, list_min([e, s, a]) AS b FROM paths) p
                JOIN (SELECT conv_id, pos, first, text, role || ':' || text AS line,
                             CASE kind WHEN 'truncated' THEN 1 WHEN '' THEN 0 ELSE 1000000 END AS more FROM judged) r
                  ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND r.pos = p.pos + 1)))),
        solved AS (
          SELECT k.*, list_min([e, a]) AS w
          FROM paths p JOIN counted k ON p.conv_id IS NOT DISTINCT FROM k.conv_id AND p.pos = k.n)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(w.c, 0)::BIGINT AS cost,
               coalesce(w.s, '') AS audit, sha256(coalesce(array_to_string(w.t, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN solved q ON o.conv_id IS NOT DISTINCT FROM q.conv_id""",
}


def all_oracles() -> dict[str, str]:
    return dict(_ORACLES)
