"""DuckDB SQL for the queries that SQL can express."""

OP1 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s
    FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
hits AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM hits JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node)
SELECT d.doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(root) AS component_id, d.doc_id = min(root) AS kept
FROM documents d JOIN reach r ON r.node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
GROUP BY d.doc_id
"""

OP5 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""

OP8 = r"""
WITH lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
firsts AS (SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (
  SELECT d.doc_id, d.pos, d.line, f.first_doc IS NOT NULL AND d.doc_id <> f.first_doc AS gone
  FROM keyed d LEFT JOIN firsts f ON f.k = d.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP4 = r"""
WITH rules(rhost, rpath, verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
hits AS (
  SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS n
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN hits ON hits.page_id = p.page_id AND n = 1
"""



def _op11() -> str:
    """Four rounds of assignment and update, then the codes, one table expression each."""
    nearest = """nearest{k} AS MATERIALIZED (
  SELECT rid, pos, part, struct_extract(best, 'e') AS entry, struct_extract(best, 'd') AS d FROM (
    SELECT p.rid, p.pos, any_value(p.part) AS part, min({{'d': list_sum(list_transform(list_zip(p.part, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': c.entry}}) AS best
    FROM parts p JOIN book{k} c ON c.pos = p.pos GROUP BY p.rid, p.pos))"""
    update = """book{n} AS MATERIALIZED (
  SELECT c.pos, c.entry, coalesce(m.v, c.v) AS v FROM book{k} c LEFT JOIN (
    SELECT pos, entry, list(mean ORDER BY i) AS v FROM (
      SELECT pos, entry, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS mean
      FROM (SELECT pos, entry, unnest(part) AS x, generate_subscripts(part, 1) AS i FROM nearest{k}) GROUP BY pos, entry, i)
    GROUP BY pos, entry) m ON m.pos = c.pos AND m.entry = c.entry)"""
    steps = ",\n".join(s for k in range(4) for s in (nearest.format(k=k), update.format(k=k, n=k + 1)))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS MATERIALIZED (
  SELECT rid, vec_id, label, pos, v[pos * len(v) // 4 + 1 : (pos + 1) * len(v) // 4] AS part FROM kept, (SELECT unnest([0, 1, 2, 3]) AS pos)),
book0 AS MATERIALIZED (SELECT pos, rid - 1 AS entry, part AS v FROM parts WHERE rid <= 256),
{steps},
{nearest.format(k=4)},
digest AS (
  SELECT sha256(string_agg(x, ',' ORDER BY pos, entry, i)) AS codebooks_sha256
  FROM (SELECT pos, entry, unnest(v)::VARCHAR AS x, generate_subscripts(v, 1) AS i FROM book4)),
codes AS (SELECT rid, string_agg(lpad(format('{{:x}}', entry), 2, '0'), '' ORDER BY pos) AS code, sum(d)::BIGINT AS error FROM nearest4 GROUP BY rid)
SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, g.codebooks_sha256
FROM kept k JOIN codes c ON c.rid = k.rid CROSS JOIN digest g
"""


OP11 = _op11()

OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS MATERIALIZED (
  SELECT lang, k, gram, count(*) AS f FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS gram
    FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
  GROUP BY lang, k, gram HAVING count(*) >= 30 OR k = 1),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, k, gram, f AS a, string_split(gram, ' ') AS p FROM grams WHERE k > 1 AND f >= 30),
cuts AS (SELECT c.*, j, array_to_string(p[: j], ' ') AS head, array_to_string(p[j + 1 :], ' ') AS tail FROM candidates c, (SELECT unnest([1, 2, 3]) AS j) WHERE j < k),
scored AS (
  SELECT c.lang, c.gram, c.k, c.a, j, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.gram = c.head AND x.k = j JOIN grams y ON y.lang = c.lang AND y.gram = c.tail AND y.k = c.k - j),
worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, gram ORDER BY score, j) AS nth FROM scored) WHERE nth = 1),
inside AS (
  SELECT lang, sub, max(a) AS around FROM (
    SELECT c.lang, c.a, array_to_string(p[i : i + m - 1], ' ') AS sub
    FROM candidates c, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i) WHERE m < c.k AND i + m - 1 <= c.k)
  GROUP BY lang, sub),
ranked AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, w.a DESC, encode(w.gram)) AS rank
  FROM worst w LEFT JOIN inside i ON i.lang = w.lang AND i.sub = w.gram WHERE i.around IS NULL OR 100 * i.around < 80 * w.a)
SELECT r.lang, rank, gram AS phrase, a, l, r.r, n, score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""

ORACLES = {"op13_phrases": OP13, "op11_vector_codes": OP11, "op4_url_filter": OP4, "op8_line_dedup": OP8, "op1_minhash_dedup": OP1, "op5_exact_dedup": OP5}
