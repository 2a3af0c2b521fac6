"""SQL for the queries of this folder that SQL can express, over the given tables."""

from __future__ import annotations

#: crc32 of the decimal digits of {0}, bit by bit: each digit enters the register, then eight shifts follow
_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
    string_split(CAST({0} AS VARCHAR), ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END), 4294967295)"""

TRIE = f"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, {_CRC32.format("c")} % 4 AS h FROM (SELECT DISTINCT c FROM turns)),
placed AS (
  SELECT convs.c, 0 AS own, p, r, x FROM convs JOIN turns ON turns.c = convs.c - convs.c % 20 AND p <= h
  UNION ALL
  SELECT convs.c, 1, p, r, x FROM convs JOIN turns ON turns.c = convs.c AND p > h),
built AS (
  SELECT convs.c, coalesce(s.seq, []) AS seq FROM convs
  LEFT JOIN (SELECT c, list({{'r': r, 'x': x}} ORDER BY own, p) AS seq FROM placed GROUP BY c) s ON s.c = convs.c),
prefixes AS (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM built),
nodes AS (
  SELECT seq[1:d] AS node, d, min(c) AS conv, count(*) AS n,
         coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len(seq) = d), '') AS ends
  FROM prefixes GROUP BY ALL),
kids AS (SELECT node[1:d - 1] AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
own AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children,
         CASE WHEN d = 0 THEN 0 ELSE (n - 1) * len(regexp_extract_all(nodes.node[d].x, '[^\\x20\\x09-\\x0D]+')) END AS saved
  FROM nodes LEFT JOIN kids ON kids.node = nodes.node),
sums AS (
  SELECT node[1:k] AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM own) GROUP BY ALL)
SELECT CAST(own.conv AS BIGINT) AS conv_id, CAST(own.d AS BIGINT) AS depth, CAST(up.conv AS BIGINT) AS parent_conv_id,
       CAST(own.n AS BIGINT) AS n_convs, CAST(own.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(own.ends) AS ends_sha256
FROM own JOIN sums ON sums.node = own.node
LEFT JOIN nodes up ON own.d > 0 AND up.d = own.d - 1 AND up.node = own.node[1:own.d - 1]
"""

_TERMS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""

SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS documents, sum(len(terms))::BIGINT AS total FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
q AS (SELECT row_number() OVER () AS i, item_id, list_distinct({_TERMS}) AS terms FROM benchmark),
qt AS (SELECT i, unnest(terms) AS term FROM q),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(documents) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
      FROM tf, s WHERE term IN (SELECT term FROM qt) GROUP BY term),
m AS (SELECT r, doc_id, 100 - 50 + (50 * len(terms)::BIGINT * documents) // total AS m FROM d, s WHERE len(terms) > 0),
scores AS (
  SELECT i, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM qt JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY i, r)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS place
      FROM scores JOIN m USING (r) JOIN q USING (i) WHERE score > 0)
WHERE place <= 50
"""
