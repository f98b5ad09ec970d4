"""DuckDB SQL with the results of the operators that SQL can express."""

from __future__ import annotations

# crc32 of the decimal digits of an integer: `crc` is the usual table of 256 values, fixed by its polynomial.
_CRC_TABLE = """
crc_steps(i, v, k) AS (
    SELECT range, range, 0 FROM range(256)
    UNION ALL
    SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1
    FROM crc_steps WHERE k < 8
),
crc AS (SELECT list(v ORDER BY i) AS t FROM crc_steps WHERE k = 8)"""


def _crc32(number: str) -> str:
    digits = f"CAST({number} AS VARCHAR)"
    codes = f"list_transform(range(1, length({digits}) + 1), lambda i: CAST(ord(substr({digits}, i, 1)) AS BIGINT))"
    step = "xor(crc.t[(xor(a, b) & 255) + 1], a >> 8)"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda a, b: {step}), 4294967295)"


TRIE = f"""
WITH RECURSIVE {_CRC_TABLE},
turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS spot
    FROM conversations WHERE conv_id IS NOT NULL
),
ids AS (
    SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32("conv_id")} % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM turns), crc
),
rebuilt AS (
    SELECT i.conv_id, 0 AS part, t.spot, t.role, t.text
    FROM ids i JOIN turns t ON t.conv_id = i.base AND t.spot <= i.h
    UNION ALL
    SELECT i.conv_id, 1, t.spot, t.role, t.text
    FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.spot > i.h
),
prefixes AS (
    SELECT conv_id, depth, size, sha256(string_agg(own, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS prefix
    FROM (
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, spot) AS depth,
            strlen(text) AS size, sha256(strlen(role) || ':' || role || text) AS own
        FROM rebuilt
    )
    UNION ALL
    SELECT conv_id, 0, 0, '' FROM ids
),
lengths AS (SELECT conv_id, max(depth) AS length FROM prefixes GROUP BY conv_id),
nodes AS (
    SELECT depth, prefix, min(conv_id) AS low, count(*) AS n, max(size) AS size,
        string_agg(CASE WHEN depth = length THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends
    FROM prefixes JOIN lengths USING (conv_id) GROUP BY depth, prefix
),
linked AS (
    SELECT n.*, p.low AS parent
    FROM nodes n LEFT JOIN prefixes x ON x.conv_id = n.low AND x.depth = n.depth - 1
    LEFT JOIN nodes p ON p.depth = x.depth AND p.prefix = x.prefix
),
kids AS (SELECT parent, depth - 1 AS depth, count(*) AS n FROM linked WHERE depth > 0 GROUP BY ALL),
counted AS (
    SELECT l.*, coalesce(k.n, 0) AS children
    FROM linked l LEFT JOIN kids k ON k.parent = l.low AND k.depth = l.depth
),
sums AS (
    SELECT x.depth, x.prefix, count(*) FILTER (c.children = 0) AS leaves, sum((c.n - 1) * c.size) AS saved
    FROM counted c JOIN prefixes x ON x.conv_id = c.low AND x.depth <= c.depth
    GROUP BY x.depth, x.prefix
)
SELECT c.low AS conv_id, CAST(c.depth AS BIGINT) AS depth, c.parent AS parent_conv_id, c.n AS n_convs,
    CAST(c.children AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
    CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(c.ends, '')) AS ends_sha256
FROM counted c JOIN sums s USING (depth, prefix)
"""


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def _siblings(tree: str) -> str:
    """Every node that has a parent, with the nodes of its run to the left and to the right."""
    run = "PARTITION BY key, level, pos // 3 ORDER BY pos ROWS BETWEEN"
    return f"""
    SELECT key, level, pos,
        coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM {tree} WHERE level < (SELECT max(level) FROM {tree} AS t WHERE t.key = {tree}.key)"""


def _tree(name: str, leaves: str) -> str:
    return f"""
{name}(key, level, pos, node) AS (
    SELECT key, 0, pos, node FROM {leaves}
    UNION ALL
    SELECT key, level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos))
    FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM {name}) WHERE n > 1
    GROUP BY key, level, pos // 3
)"""


MERKLE = f"""
WITH RECURSIVE {_CRC_TABLE},
leaves AS (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, node) - 1 AS pos
    FROM (
        SELECT coalesce('s' || source, '') AS key, doc_id, {_leaf("text")} AS node,
            CASE WHEN {_crc32("doc_id")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS changed
        FROM documents, crc
    )
),
{_tree("tree", "leaves")},
tops AS (SELECT key AS source, max(level) AS height, arg_max(node, level) AS node FROM tree GROUP BY key),
subroots AS (SELECT '' AS key, source, height, node, row_number() OVER (ORDER BY source) - 1 AS pos FROM tops),
{_tree("above", "subroots")},
inner_pairs AS ({_siblings("tree")}),
outer_pairs AS ({_siblings("above")}),
steps AS (
    SELECT f.key, f.pos, s.level AS step, s.l, s.r
    FROM leaves f JOIN inner_pairs s ON s.key = f.key AND s.pos = f.pos // CAST(3 ** s.level AS BIGINT)
    UNION ALL
    SELECT f.key, f.pos, t.height + s.level, s.l, s.r
    FROM leaves f JOIN subroots t ON t.source = f.key
    JOIN outer_pairs s ON s.pos = t.pos // CAST(3 ** s.level AS BIGINT)
),
proofs AS (SELECT key, pos, sha256(string_agg(l || r, '' ORDER BY step)) AS proof FROM steps GROUP BY key, pos),
folded(key, pos, step, node) AS (
    SELECT key, pos, 0, coalesce(changed, node) FROM leaves
    UNION ALL
    SELECT f.key, f.pos, f.step + 1, sha256(s.l || f.node || s.r)
    FROM folded f JOIN steps s ON s.key = f.key AND s.pos = f.pos AND s.step = f.step
),
last AS (SELECT key, pos, arg_max(node, step) AS node FROM folded GROUP BY key, pos),
root AS (SELECT arg_max(node, level) AS node FROM above)
SELECT f.doc_id, f.node AS leaf, t.node AS subroot, root.node AS root,
    coalesce(p.proof, sha256('')) AS proof_sha256, l.node AS folded_root, l.node = root.node AS verified
FROM leaves f JOIN subroots t ON t.source = f.key JOIN last l ON l.key = f.key AND l.pos = f.pos
LEFT JOIN proofs p ON p.key = f.key AND p.pos = f.pos, root
"""


_REACHED = """
reached(a, b) AS (
    SELECT a, b FROM links
    UNION
    SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
)"""

JACCARD = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
),
spread AS (SELECT doc_id, len(w) AS n_words, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
runs AS (
    SELECT doc_id, n_words, i, concat_ws(' ', word, lead(word, 1) OVER own, lead(word, 2) OVER own,
        lead(word, 3) OVER own) AS gram
    FROM spread WINDOW own AS (PARTITION BY doc_id ORDER BY i)
),
single AS (SELECT DISTINCT doc_id, gram FROM runs WHERE i <= greatest(n_words - 3, 1)),
sizes AS (SELECT doc_id, count(*) AS n FROM single GROUP BY doc_id),
shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
    FROM single x JOIN single y ON y.gram = x.gram AND y.doc_id <> x.doc_id GROUP BY x.doc_id, y.doc_id
),
pairs AS (
    SELECT a, b, c, x.n + y.n AS n FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (n - c)),
{_REACHED},
smallest AS (SELECT a, min(b) AS b FROM reached GROUP BY a)
SELECT w.doc_id, coalesce(z.n, 0) AS n_shingles, least(w.doc_id, coalesce(b, w.doc_id)) AS component_id
FROM words w LEFT JOIN sizes z ON z.doc_id = w.doc_id LEFT JOIN smallest ON a = w.doc_id
"""

VECTORS = f"""
WITH RECURSIVE vectors AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y
        ON y.vec_id <> x.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.9
),
{_REACHED},
smallest AS (SELECT a, min(b) AS b FROM reached GROUP BY a),
direct AS (SELECT a, count(*) AS n FROM links GROUP BY a),
found AS (
    SELECT v.vec_id, coalesce(d.n, 0) AS n_links, least(v.vec_id, coalesce(s.b, v.vec_id)) AS component_id
    FROM embeddings v LEFT JOIN direct d ON d.a = v.vec_id LEFT JOIN smallest s ON s.a = v.vec_id
)
SELECT *, vec_id = component_id AS kept FROM found
"""

WARC = """
WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS payload FROM pages
),
hashed AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS size, sha1(payload) AS digest FROM payloads),
ranked AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS target FROM hashed),
judged AS (SELECT *, size >= 1000 AND target IS NOT NULL AND page_id IS DISTINCT FROM target AS again FROM ranked)
SELECT page_id, size AS payload_bytes, digest AS payload_digest,
    CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN again THEN target END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM judged
"""
