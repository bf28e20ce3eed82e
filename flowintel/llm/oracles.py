"""SQL counterparts of the queries that SQL can express, for DuckDB.

Fingerprints, trained models, trigram-free hashes and greedy packing have none; their queries are
tested against brute force in tests/llm.
"""

from __future__ import annotations

from flowintel.llm.secret_scan import BASE_RULES, RULES

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

MIX_TARGETS = f"""
WITH sized AS (
    SELECT doc_id, CASE WHEN source IS NULL THEN 'z' ELSE 's' || source END AS src, {WORDS} AS size FROM documents
), totals AS (
    SELECT src, sum(size)::BIGINT AS source_size FROM sized GROUP BY src
), ranked AS (
    SELECT *, (row_number() OVER (ORDER BY src) - 1) % 3 AS place FROM totals
), weighted AS (
    SELECT *, CASE place WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM ranked
), running AS (
    SELECT *, coalesce(sum(source_size) OVER (ORDER BY source_size / weight, src
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS filled,
        (sum(weight) OVER (ORDER BY source_size / weight, src
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open_weight,
        (sum(source_size) OVER ())::BIGINT AS everything
    FROM weighted
), levelled AS (
    SELECT *, (everything * 1.5::DOUBLE - filled * 2) / open_weight AS own_level FROM running
), settled AS (
    SELECT *, max(CASE WHEN own_level * weight < source_size * 2 THEN own_level END) OVER () AS level FROM levelled
), targets AS (
    SELECT src, source_size,
        coalesce(least(source_size * 2.0::DOUBLE, level * weight), source_size * 2.0::DOUBLE) AS target FROM settled
)"""


def _span_list(rule, place: int) -> str:
    """List of (start, place, kind, end) of one rule, from the pieces between its matches."""
    pattern = rule.pattern.replace("'", "''")
    value = f"regexp_extract(m[i], '{pattern}', {rule.group})" if rule.group else "m[i]"
    return f"""
    SELECT doc_id, unnest(list_filter([{{'s': list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT
              + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)::BIGINT, 'p': {place}, 'k': '{rule.kind}',
              'n': length(m[i]), 'v': length({value})}} FOR i IN range(1, len(m) + 1)], lambda x: x.v >= {rule.least})) AS span
    FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS m, string_split_regex(t, '{pattern}') AS p FROM texts)"""


def _secrets() -> str:
    parts = " UNION ALL ".join(_span_list(rule, place) for place, rule in enumerate(RULES))
    joined = "string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, p)"
    counts = ", ".join(f"coalesce(count(*) FILTER (k = '{r.kind}'), 0) AS n_{r.kind}" for r in BASE_RULES)
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({parts}),
spans AS (SELECT doc_id, span.s AS s, span.s + span.n AS e, span.p AS p, span.k AS k FROM raw)
SELECT d.doc_id, {counts},
    sha256(coalesce(string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, p) FILTER (p < {len(BASE_RULES)}), '')) AS base_sha256,
    coalesce({joined}, '') AS spans
FROM documents d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id"""


LANG_LEVELS, TOP_LEVELS = 8, 5  # trees of up to 8 ** 8 rows a language and 8 ** 5 languages


def _crc_table() -> str:
    """The 256 remainders of the reflected CRC-32 polynomial, as a list literal."""
    found = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        found.append(value)
    return f"[{', '.join(map(str, found))}]"


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR)::VARCHAR || ':' || {name}::VARCHAR, '-')"


def _tree(prefix: str, base: str, levels: int) -> str:
    """Tables {prefix}0 ... of nodes with the joined digests of their siblings; `base` has grp, place, n, digest."""
    side = "coalesce(string_agg(digest, '') OVER (PARTITION BY grp, place // 8 ORDER BY place ROWS BETWEEN {}), '') AS {}"
    sides = ", ".join([side.format("UNBOUNDED PRECEDING AND 1 PRECEDING", "l"), side.format("1 FOLLOWING AND UNBOUNDED FOLLOWING", "r")])
    out = [f"{prefix}0 AS MATERIALIZED (SELECT grp, place, n, digest, {sides} FROM ({base}))"]
    for k in range(levels):
        out.append(f"""{prefix}{k + 1} AS MATERIALIZED (SELECT grp, place, n, digest, {sides} FROM (
    SELECT grp, place // 8 AS place, (n + 7) // 8 AS n,
        CASE WHEN n = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY place)) END AS digest
    FROM {prefix}{k} GROUP BY grp, place // 8, n))""")
    return ",\n".join(out)


def _fold(prefix: str, start: str, levels: int) -> str:
    """Tables {start}1 ... that carry every row one level up: the proof gains the siblings, folded becomes the parent."""
    return ",\n".join(f"""{start}{k + 1} AS MATERIALIZED (
    SELECT x.* REPLACE (proof || y.l || y.r AS proof, up // 8 AS up,
        CASE WHEN y.n = 1 THEN folded ELSE sha256(y.l || folded || y.r) END AS folded)
    FROM {start}{k} x JOIN {prefix}{k} y ON x.grp IS NOT DISTINCT FROM y.grp AND x.up = y.place)""" for k in range(levels))


def _manifest() -> str:
    fields = [_field(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf, changed = (f"sha256({' || '.join([*fields, _field(t)])})" for t in (
        "text", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))
    ones = "4294967295::UBIGINT"
    crc = f"""xor(list_reduce(list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::UBIGINT),
        lambda c, b: xor(c >> 8, list_extract({_crc_table()}, (xor(c, b) & 255)::BIGINT + 1)::UBIGINT), {ones}), {ones})"""
    names = f"SELECT 0 AS grp, grp AS name, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS place, digest FROM a{LANG_LEVELS}"
    return f"""
WITH leaves AS MATERIALIZED (
    SELECT doc_id, lang AS grp, {leaf} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {changed} ELSE {leaf} END AS tampered FROM documents
), placed AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY grp) AS n
    FROM leaves
),
{_tree("a", "SELECT grp, place, n, leaf AS digest FROM placed", LANG_LEVELS)},
{_tree("b", f"SELECT grp, place, count(*) OVER () AS n, digest FROM ({names})", TOP_LEVELS)},
x0 AS MATERIALIZED (SELECT doc_id, grp, leaf, place AS up, '' AS proof, tampered AS folded FROM placed),
{_fold("a", "x", LANG_LEVELS)},
y0 AS MATERIALIZED (
    SELECT doc_id, 0 AS grp, leaf, s.digest AS subroot, s.place AS up, proof, folded
    FROM x{LANG_LEVELS} x JOIN ({names}) s ON x.grp IS NOT DISTINCT FROM s.name
),
{_fold("b", "y", TOP_LEVELS)}
SELECT doc_id, leaf, subroot, b.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = b.digest AS verified
FROM y{TOP_LEVELS} CROSS JOIN b{TOP_LEVELS} b"""


NEGATIVES = """
WITH numbered AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS MATERIALIZED (
    SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same,
        coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: coalesce(z[1] * z[2], 0))), 0)::BIGINT AS score
    FROM numbered a JOIN numbered b ON a.id <> b.id WHERE a.id % 100 = 0
), positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id,
    (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id))::INTEGER AS rank,
    s.id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scored s USING (anchor_id)
WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY rank <= 10"""

ORACLES: dict[str, str] = {"op6_secret_index": _secrets(), "op12_merkle_manifest": _manifest(), "op13_hard_negatives": NEGATIVES}
