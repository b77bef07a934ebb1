"""The registered queries of this subpackage; their SQL is in `oracle_sql`, where SQL can express them.

The others are tested against brute force, the library or held-out labels: shards and likenesses depend on
hashes that SQL lacks, scores and packings on fitting and search, ids on a tokenizer.
"""

from __future__ import annotations

from .fingerprints import op6_fingerprints
from .jaccard import op10_jaccard
from .media import op5_image_copies
from .merge_dropout import op3_merge_dropout
from .packing import op9_packing
from .quality import op2_quality
from .secrets import _KEY, op7_secret_scans
from .sharding import op1_sharding
from .suffixes import op8_suffixes
from .token_counts import op4_token_counts

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _spans_sql(kind: int, name: str, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: a match begins behind all that was split off and all matches before it."""
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""
m{kind} AS (SELECT rid, unnest(regexp_extract_all(x, {p})) m, unnest(regexp_split_to_array(x, {p})) p, unnest(range(len(regexp_extract_all(x, {p})))) i FROM t WHERE regexp_matches(x, {p})),
s{kind} AS (SELECT rid, {kind} kind, '{name}' AS name, m, sum(length(p) + length(m)) OVER (PARTITION BY rid ORDER BY i) AS b FROM m{kind} WHERE m IS NOT NULL),
k{kind} AS (SELECT rid, kind, name, b - length(m) AS a, b FROM s{kind} WHERE length(regexp_extract(m, {p}, {group})) >= {least})"""


_KINDS = [
    (0, "assign", rf"""({_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    (1, "access", "AKIA[A-Z0-9]+", 0, 18),
    (2, "hex", "[0-9a-f]+", 0, 16),
]

_SECRETS = f"""
WITH t AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') x FROM documents),{",".join(_spans_sql(*k) for k in _KINDS)},
s AS (SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2),
g AS (SELECT rid, count(*) FILTER (kind = 0) n0, count(*) FILTER (kind = 1) n1, count(*) FILTER (kind = 2) n2,
string_agg(name || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, kind) spans FROM s GROUP BY 1)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (rid)"""

# texts are cut into overlapping chunks first, as a substring far into a text is slow
_REPEATS = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h, octet_length(encode(coalesce(text, ''))) n FROM documents),
c AS (SELECT doc_id, n, o, substr(h, 2 * o + 1, 2 * (512 + 99)) h FROM t, LATERAL (SELECT unnest(range(0, greatest(n - 99, 0), 512)) o)),
w AS (SELECT doc_id, o + j AS i, md5_number(substr(h, 2 * j + 1, 200)) s FROM c, LATERAL (SELECT unnest(range(0, least(512, n - 99 - o))) j)),
l AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) k FROM w) WHERE k > 1),
q AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) run FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END new FROM l)),
r AS (SELECT doc_id, run, min(i) a, max(i) + 100 b FROM q GROUP BY 1, 2),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) before FROM r),
k AS (SELECT doc_id, sum(b - a) gone, count(*) spans, max(b) last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) head FROM p JOIN t USING (doc_id) GROUP BY 1)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)"""

_COMPONENTS = rf"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) g FROM t WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
c AS (SELECT a.doc_id u, b.doc_id v, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(id, root) AS (SELECT doc_id, doc_id FROM t UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.id)
SELECT t.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id FROM t LEFT JOIN n USING (doc_id) JOIN r ON r.id = t.doc_id GROUP BY 1"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_sharding, op2_quality, op3_merge_dropout, op4_token_counts, op5_image_copies, op6_fingerprints, op7_secret_scans, op8_suffixes, op9_packing, op10_jaccard)}


def oracle_sql() -> dict[str, str]:
    return {"op7_secret_scans": _SECRETS, "op8_suffixes": _REPEATS, "op10_jaccard": _COMPONENTS}
