"""DuckDB SQL for those queries that SQL can express over whole tables. The rest are tested against brute force."""

OP1 = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS window_text
      FROM i, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(s) WHERE len(w) > 0),
k AS (SELECT DISTINCT k FROM q),
p AS (SELECT doc_id, k, s, array_to_string(w[s : s + k - 1], ' ') AS window_text FROM d, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS u(s)),
h AS (SELECT p.doc_id, p.s, q.k, q.item FROM p JOIN q ON p.k = q.k AND p.window_text = q.window_text),
n AS (SELECT doc_id, count(DISTINCT s + o) AS n_hit FROM h, unnest(range(0, k)) AS u(o) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

OP2 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
b AS (SELECT page_id, first, octet_length(encode(p.html)) AS n, list_transform(range(0, 8), lambda g: CAST('0x' || substr(h, CAST(5 * g + 1 AS INT), 5) AS BIGINT)) AS v FROM p JOIN f ON p.html = f.html)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda r: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((x >> r) & 31) + 1 AS INT), 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""

OP8 = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, s, array_to_string(w[s : s + 12], ' ') AS window_text FROM d, unnest(range(1, greatest(len(w) - 11, 1))) AS u(s)),
f AS (SELECT window_text, min(doc_id) AS first FROM p GROUP BY window_text),
c AS (SELECT DISTINCT p.doc_id, p.s + o AS k FROM p JOIN f ON p.window_text = f.window_text AND first < p.doc_id, unnest(range(0, 13)) AS u(o)),
g AS (SELECT doc_id, list(k) AS gone FROM c GROUP BY doc_id),
t AS (SELECT d.doc_id, k, w[k] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(k)),
r AS (SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.k) AS kept, count(*) AS n FROM t LEFT JOIN c ON c.doc_id = t.doc_id AND c.k = t.k WHERE c.k IS NULL GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(r.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""

# The pages of the given tables mark their article and have no element but text blocks, bold and line breaks in it.
OP11 = r"""
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '') AS h FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS h FROM a),
c AS (SELECT page_id, url, replace(replace(replace(regexp_replace(h, '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'), '&#x27;', '''') AS h FROM b),
t AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(h, '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""

OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY term),
m AS (SELECT doc_id, 100 - 90 + ((90 * CAST(len(w) AS BIGINT) * n_docs) // n_terms) AS m FROM d, s WHERE len(w) > 0),
x AS (SELECT q.item_id, p.doc_id, CAST(sum(f.weight * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m))) AS BIGINT) AS score
      FROM q JOIN p USING (term) JOIN f USING (term) JOIN m ON m.doc_id = p.doc_id GROUP BY q.item_id, p.doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


def _codes() -> str:
    """Every round is the same text: the parts of each vector against each entry, the nearest one, and the floored means."""
    steps = [
        "k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS (SELECT vec_id, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS v FROM k, range(0, 4) AS r(part))",
        "e0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS c FROM p QUALIFY entry < 256)",
    ]
    distance = "list_sum(list_transform(list_zip(p.v, e.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for r in range(5):
        steps.append(f"d{r} AS MATERIALIZED (SELECT vec_id, p.part, p.v, entry, CAST({distance} AS BIGINT) AS error FROM p JOIN e{r} e ON p.part = e.part QUALIFY row_number() OVER (PARTITION BY vec_id, p.part ORDER BY error, entry) = 1)")
        if r < 4:
            steps.append(f"u{r} AS (SELECT part, entry, pos, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS c FROM (SELECT part, entry, unnest(v) AS x, unnest(range(0, len(v))) AS pos FROM d{r}) GROUP BY part, entry, pos)")
            steps.append(f"m{r} AS (SELECT part, entry, list(c ORDER BY pos) AS c FROM u{r} GROUP BY part, entry)")
            steps.append(f"e{r + 1} AS MATERIALIZED (SELECT e.part, e.entry, coalesce(m.c, e.c) AS c FROM e{r} e LEFT JOIN m{r} m ON m.part = e.part AND m.entry = e.entry)")
    steps += [
        "s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM e4)",
        "v AS (SELECT vec_id, string_agg(printf('%02x', CAST(entry AS INT)), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM d4 GROUP BY vec_id)",
        "l AS (SELECT v.*, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error FROM v JOIN k USING (vec_id))",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, label_error, codebooks_sha256 FROM l, s"


ORACLES = {"op1_decontaminate": OP1, "op2_warc": OP2, "op8_substring": OP8, "op11_html": OP11, "op12_search": OP12, "op13_codes": _codes()}
