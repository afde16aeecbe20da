"""Plain SQL for the registered queries that SQL can express."""

OP9_LINE_DEDUP = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, unnest(range(len(s))) AS k, unnest(s) AS line
      FROM (SELECT r, doc_id, string_split(text, chr(10)) AS s FROM d)),
m AS (SELECT r, doc_id, k, line,
             regexp_replace(trim(regexp_replace(line, '[ \t\r\x0B\f]+', ' ', 'g')), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS m
      FROM l),
p AS (SELECT *, string_split(m, ' ') AS w, len(string_split(m, ' ')) AS n FROM m),
h AS (SELECT *, 2 + (n - 2) // 2 AS mid FROM p WHERE m <> ''),
t AS (SELECT r, doc_id, k, n || '|' || m AS template FROM h
      UNION ALL
      SELECT r, doc_id, k, n || '|a|' || array_to_string(w[1:2], ' ') || '|' || array_to_string(w[mid + 1:n], ' ') FROM h WHERE n >= 8
      UNION ALL
      SELECT r, doc_id, k, n || '|b|' || array_to_string(w[1:mid], ' ') || '|' FROM h WHERE n >= 8),
found AS (SELECT template, min(doc_id) AS first FROM t GROUP BY template HAVING count(DISTINCT r) >= 5),
gone AS (SELECT DISTINCT t.r, t.k FROM t JOIN found f ON t.template = f.template WHERE t.doc_id <> f.first)
SELECT any_value(l.doc_id) AS doc_id, count(*) AS n_lines, count(g.k) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.k) FILTER (WHERE g.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN gone g ON l.r = g.r AND l.k = g.k
GROUP BY l.r
"""



def _level(k: int) -> str:
    """One level of the template tree: a<k> to a<k+1>."""
    return f"""
b{k} AS MATERIALIZED (
  SELECT host, template, seg[{k + 1}] AS s, sum(n) AS n, sum(labelled) AS l, sum(good) AS g
  FROM a{k} WHERE len(seg) > {k} GROUP BY ALL),
o{k} AS MATERIALIZED (
  SELECT b.host, b.template, b.s
  FROM b{k} b JOIN (SELECT host, template, sum(l) AS al, sum(g) AS ag FROM b{k} GROUP BY ALL) t
    ON b.host = t.host AND b.template = t.template
  WHERE n >= 5 AND l * ag * (al - ag) > 0
    AND CAST(g * al - ag * l AS DOUBLE) * CAST(g * al - ag * l AS DOUBLE) >= 3.84::DOUBLE * CAST(l * ag * (al - ag) AS DOUBLE)),
a{k + 1} AS MATERIALIZED (
  SELECT a.host, a.masked, a.seg, a.n, a.labelled, a.good,
         a.template || CASE WHEN len(a.seg) <= {k} THEN '' ELSE '/' || coalesce(o.s, '*') END AS template
  FROM a{k} a LEFT JOIN o{k} o ON a.host = o.host AND a.template = o.template AND a.seg[{k + 1}] = o.s),"""


OP8_URL_TEMPLATES = (
    r"""
WITH r AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages),
h AS (
  SELECT page_id, path, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz') AS host
  FROM (SELECT *, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)),
u AS MATERIALIZED (
  SELECT *, regexp_replace(path, '[0-9]+', '*', 'g') AS masked,
         CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS decided
  FROM (SELECT *, CASE
          WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
          WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
          WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
          WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
          WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
        FROM h)),
a0 AS MATERIALIZED (
  SELECT host, masked, list_filter(string_split(masked, '/'), lambda x: x <> '') AS seg, count(*) AS n,
         count(decided) AS labelled, count(*) FILTER (WHERE decided = 'allow') AS good, '' AS template
  FROM u GROUP BY host, masked),"""
    + "".join(map(_level, range(3)))
    + """
f AS MATERIALIZED (
  SELECT host, masked, labelled, good, template || CASE WHEN len(seg) > 3 THEN '/**' ELSE '' END AS template FROM a3),
e AS (SELECT CASE WHEN sum(labelled) > 0 THEN sum(good)::DOUBLE / sum(labelled) ELSE 1.0 END AS share FROM f),
s AS (
  SELECT host, (sum(good) + 4.0::DOUBLE * any_value(share)) / (sum(labelled) + 4.0::DOUBLE) AS host_share
  FROM f, e GROUP BY host),
p AS (
  SELECT f.host, f.template, (sum(good) + 4.0::DOUBLE * any_value(host_share)) / (sum(labelled) + 4.0::DOUBLE) AS purity
  FROM f JOIN s ON f.host = s.host GROUP BY f.host, f.template)
SELECT u.page_id, u.host, u.path, u.rule,
       coalesce(u.decided, CASE WHEN p.purity < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM u JOIN f ON u.host = f.host AND u.masked = f.masked JOIN p ON f.host = p.host AND f.template = p.template
"""
)

#: Vectors are compared component by component; every query meets every row.
OP3_KD_SEARCH = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, v AS q FROM v WHERE vec_id % 100 = 0),
s AS (
  SELECT query_id, vec_id, CAST(list_inner_product(q::DOUBLE[], v::DOUBLE[]) AS BIGINT) AS score
  FROM q JOIN v ON vec_id <> query_id AND len(q) = len(v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP10_TOKEN_ROLLUPS = r"""
WITH f AS (SELECT doc_id AS labelled, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT *, coalesce(text, '') AS t FROM documents LEFT JOIN f ON doc_id = labelled WHERE toxic IS DISTINCT FROM 1),
c AS (
  SELECT source, lang, 'words' AS tokenizer,
         len(regexp_extract_all(t, CASE WHEN quality = 0 THEN '[^ \t\n\x0B\f\r]*\p{L}[^ \t\n\x0B\f\r]*'
                                        ELSE '[^ \t\n\x0B\f\r]+' END)) AS n FROM d
  UNION ALL
  SELECT source, lang, 'marks', len(regexp_extract_all(t, '[\p{L}\p{N}]+|[^ \t\n\x0B\f\r\p{L}\p{N}]')) FROM d)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM c GROUP BY ALL
"""

def _jaccard(percent: int, columns: str) -> str:
    """Components of texts whose sets of three-word shingles are this similar."""
    return rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                            ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS t
  FROM d),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
l AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM s a JOIN s b ON a.t = b.t AND a.r <> b.r JOIN n x ON x.r = a.r JOIN n y ON y.r = b.r
  GROUP BY a.r, b.r, x.n, y.n HAVING 100 * count(*) >= {percent} * (x.n + y.n - count(*))),
reached AS (SELECT r AS a, r AS b FROM d UNION SELECT reached.a, l.b FROM reached JOIN l ON reached.b = l.a),
c AS (SELECT a AS r, min(doc_id) AS component_id FROM reached JOIN d ON d.r = reached.b GROUP BY a)
SELECT {columns} FROM d JOIN c ON d.r = c.r LEFT JOIN n ON n.r = d.r
"""


OP5_NEAR_DUPLICATES = _jaccard(
    85, "doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept"
)
OP11_PARITY_JOIN = _jaccard(90, "doc_id, coalesce(n, 0) AS n_shingles, component_id")


def _lloyd_round(k: int) -> str:
    """Codebooks c<k> to c<k+1>: assign every part, then take floors of means."""
    return f"""
n{k} AS MATERIALIZED (
  SELECT x.r, x.part, any_value(x.v) AS v,
         min(struct_pack(d := list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i]))),
                         e := c.e)) AS best
  FROM x JOIN c{k} c ON x.part = c.part GROUP BY x.r, x.part),
m{k} AS (
  SELECT part, e, pos, sum(y) AS s, count(*) AS n
  FROM (SELECT part, best.e AS e, unnest(v) AS y, unnest(range(len(v))) AS pos FROM n{k}) GROUP BY ALL),
c{k + 1} AS MATERIALIZED (
  SELECT c.part, c.e, coalesce(any_value(t.v), any_value(c.v)) AS v
  FROM c{k} c LEFT JOIN (
    SELECT part, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS v FROM m{k} GROUP BY ALL) t
    ON c.part = t.part AND c.e = t.e GROUP BY c.part, c.e),"""


OP12_VECTOR_CODES = (
    r"""
WITH w AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(4096 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (
  SELECT r, part, v[part * len(v) // 8 + 1:(part + 1) * len(v) // 8] AS v
  FROM (SELECT r, v, unnest(range(8)) AS part FROM w)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS e, v FROM x WHERE r <= 16),"""
    + "".join(_lloyd_round(k) for k in range(7))
    + r"""
b AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c6),
g AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error
      FROM n6 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM w JOIN g ON w.r = g.r, b
"""
)

OP13_SOURCE_DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
           FROM documents),
w AS MATERIALIZED (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
full_groups AS MATERIALIZED (
  SELECT lang, source, term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS MATERIALIZED (
  SELECT lang, source, term, n,
         1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p
  FROM full_groups JOIN v USING (lang)),
l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
q AS MATERIALIZED (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang) + v) AS q
  FROM l JOIN v USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every_pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
      FROM (SELECT * FROM every_pair UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 200
"""

ORACLES: dict[str, str] = {
    "op3_kd_search": OP3_KD_SEARCH,
    "op8_url_templates": OP8_URL_TEMPLATES,
    "op9_line_dedup": OP9_LINE_DEDUP,
    "op10_token_rollups": OP10_TOKEN_ROLLUPS,
    "op5_near_duplicates": OP5_NEAR_DUPLICATES,
    "op11_parity_join": OP11_PARITY_JOIN,
    "op12_vector_codes": OP12_VECTOR_CODES,
    "op13_source_divergence": OP13_SOURCE_DIVERGENCE,
}
