"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_ITEM_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACES = r"[\x09-\x0D\x20]+"


def _words(separators: str) -> str:
    lower = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    return f"list_filter(regexp_split_to_array({lower}, '{separators}'), lambda x: x <> '')"


_COMPONENTS = """
    both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (
        SELECT id, id AS low FROM ids
        UNION
        SELECT l.b, r.low FROM reach r JOIN both_ways l ON l.a = r.id
    ),
    component AS (SELECT id, min(low) AS low FROM reach GROUP BY id)
"""

ORACLE: dict[str, str] = {
    "op4_parity_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_words(_SPACES)} AS w FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, list_slice(w, i, i + 2) AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)
        ),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
            FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
        ),
        links AS (
            SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
            WHERE 100 * k >= 90 * (x.n + y.n - k)
        ),
        ids AS (SELECT doc_id AS id FROM documents),
        {_COMPONENTS}
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, low AS component_id
        FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN component ON id = d.doc_id
    """,
    "op6_line_dedup": """
        WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
        windows AS (
            SELECT doc_id, i - 1 AS pos, list_slice(lines, i, i + 2) AS w
            FROM (SELECT doc_id, lines, unnest(range(1, greatest(len(lines) - 2, 1) + 1)) AS i FROM d)
        ),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS r
            FROM windows WHERE trim(array_to_string(w, '')) <> ''
        ),
        gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + len(w))) AS pos FROM ranked WHERE r > 1),
        line AS (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS pos FROM d),
        kept AS (
            SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS text
            FROM line ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(len(lines), 0) AS n_lines,
            coalesce(len(lines), 0) - coalesce(n, 0) AS n_removed,
            CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op9_decontamination": f"""
        WITH b AS (SELECT item_id, {_words(_ITEM_BREAKS)} AS w FROM benchmark),
        d AS (SELECT doc_id, {_words(_ITEM_BREAKS)} AS w FROM documents),
        wanted AS (
            SELECT DISTINCT item_id, list_slice(w, i, i + least(13, len(w)) - 1) AS g
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
        ),
        grams AS (
            SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS g
            FROM (
                SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                FROM d JOIN (SELECT DISTINCT len(g) AS n FROM wanted) ON len(w) >= n
            )
        ),
        hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN wanted USING (g)),
        words AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
        ),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op10_embedding_dedup": f"""
        WITH RECURSIVE v AS (
            SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ),
        usable AS (
            SELECT * FROM v
            WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x <> 0)) > 0
                AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ),
        links AS (
            SELECT x.id AS a, y.id AS b FROM usable x JOIN usable y
            ON x.label = y.label AND x.id < y.id AND list_cosine_similarity(x.e, y.e) >= 0.98
        ),
        ids AS (SELECT id FROM v),
        {_COMPONENTS},
        degree AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a)
        SELECT v.id AS vec_id, coalesce(n, 0) AS n_links, low AS component_id, v.id = low AS kept
        FROM v LEFT JOIN degree USING (id) JOIN component USING (id)
    """,
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS lab,
                list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ),
        a AS (SELECT row_number() OVER () AS akey, vec_id AS anchor_id, lab AS alab, q AS aq FROM v WHERE vec_id % 100 = 0),
        s AS (
            SELECT akey, anchor_id, alab, vec_id, lab, coalesce(list_sum(list_transform(
                range(1, least(len(aq), len(q)) + 1), lambda i: aq[i] * q[i])), 0) AS score
            FROM a, v
        ),
        p AS (
            SELECT akey, anchor_id, vec_id AS positive_id, score AS ps,
                row_number() OVER (PARTITION BY akey ORDER BY score DESC, vec_id) AS slot
            FROM s WHERE lab = alab AND vec_id <> anchor_id
            QUALIFY slot <= 5
        ),
        n AS (
            SELECT p.anchor_id, p.positive_id, p.ps, s.vec_id AS negative_id, s.score AS ns,
                row_number() OVER (PARTITION BY p.akey, p.slot ORDER BY s.score DESC, s.vec_id) AS rank
            FROM p JOIN s ON s.akey = p.akey
            WHERE s.lab <> s.alab AND 80 * p.ps <= 100 * s.score AND s.score <= p.ps
            QUALIFY rank <= 5
        )
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id,
            ps AS positive_score, ns AS negative_score
        FROM n
    """,
}
