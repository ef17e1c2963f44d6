"""SQL for the same rows, where SQL can say it (DuckDB)."""

URL_FILTERS = r"""
WITH rules(rule_host, rule_path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), urls AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path
  FROM urls
), judged AS (
  SELECT p.*, r.rule_host || r.rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule_host || r.rule_path) DESC) AS nth
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM judged WHERE nth = 1
"""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_no
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][(source_no - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS most
  FROM by_source
), levels AS (
  SELECT *,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (
            ORDER BY most / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY most / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked
), targets AS (
  SELECT *, least(most, coalesce(
            (min(CASE WHEN level * weight <= most THEN {'at': most / weight, 'no': source_no, 'level': level} END) OVER ()).level * weight, most)) AS target
  FROM levels
), limits AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS due, CAST(sum(floor(target + 0.5)) OVER () AS BIGINT) AS mix, count(*) OVER () AS n_sources
  FROM targets
), sizes AS (
  SELECT *, greatest(1, mix // 10000) AS block_size FROM limits
), seats AS (
  SELECT source_no, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, source_no) AS award, mix // block_size AS seats
  FROM (
    SELECT *, unnest(range(CAST(least(floor(most / block_size),
              ceil(target / block_size) + 1 + ceil(n_sources * target / mix)) AS BIGINT))) AS j
    FROM sizes
  )
), quotas AS (
  SELECT source_no, (award - 1) % 8 AS shard, count(*) AS quota FROM seats WHERE award <= seats GROUP BY ALL
), whole AS (
  SELECT source_no, CAST(sum(quota) AS BIGINT) AS quota FROM quotas GROUP BY 1
), filled AS (
  SELECT s.*, coalesce(quota, 0) * block_size AS whole_blocks, due - coalesce(quota, 0) * block_size AS last_block
  FROM sizes s LEFT JOIN whole USING (source_no)
), passes AS (
  SELECT *, CASE WHEN source_size > 0 THEN (whole_blocks + last_block) // source_size ELSE 0 END AS full_passes,
         CASE WHEN source_size > 0 THEN (whole_blocks + last_block) % source_size ELSE 0 END AS last_pass
  FROM filled
), cut AS (
  SELECT source_no, block_size, last_pass, block, least(block_size, source_size - block * block_size) AS n
  FROM (SELECT *, unnest(range((source_size + block_size - 1) // block_size)) AS block FROM passes)
), ordered AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY source_no ORDER BY n < block_size, md5(source_no || ':' || block || ':42'), block
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM cut
), selected AS (
  SELECT source_no, block, block * block_size AS low,
         block * block_size + greatest(0, least(before + n, last_pass) - before) AS high
  FROM ordered
), placed AS (
  SELECT s.doc_id, s.size, p.source_no, p.source_size, p.target, p.full_passes, p.block_size, row_number() OVER () AS row_no,
         coalesce(sum(s.size) OVER (PARTITION BY p.source_no ORDER BY md5(s.doc_id || ':42'), s.doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN passes p ON s.source IS NOT DISTINCT FROM p.source
), met AS (
  SELECT row_no, sum(greatest(0, least(start + size, high) - greatest(start, low))) AS again
  FROM (SELECT *, unnest(range(CAST(start // block_size AS BIGINT), CAST((start + size - 1) // block_size + 1 AS BIGINT))) AS block
        FROM placed WHERE size > 0) JOIN selected USING (source_no, block)
  GROUP BY 1
)
SELECT doc_id, size, source_size, target, CAST(full_passes * size + coalesce(again, 0) AS BIGINT) AS taken
FROM placed LEFT JOIN met USING (row_no)
"""

SUBSTRING_DEDUP = r"""
WITH split AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), windows AS (
  SELECT doc_id, s, md5(array_to_string(w[s + 1 : s + 20], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS s FROM split)
), repeated AS (
  SELECT doc_id, s FROM (
    SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS nth FROM windows
  ) WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, s + k AS i FROM repeated, range(20) r(k)
), gathered AS (
  SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
), kept AS (
  SELECT s.doc_id, s.w, coalesce(g.gone, []) AS gone FROM split s LEFT JOIN gathered g USING (doc_id)
), words AS (
  SELECT doc_id, i, w[i + 1] AS word FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM split)
), texts AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS text
  FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id
)
SELECT k.doc_id, CAST(len(k.w) AS BIGINT) AS n_words, CAST(len(k.gone) AS BIGINT) AS n_removed,
       sha256(coalesce(t.text, '')) AS kept_sha256
FROM kept k LEFT JOIN texts t USING (doc_id)
"""

NGRAM_JOIN = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[s + 1 : s + 5], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS s FROM split WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_common FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE n_common / (x.n + y.n - n_common) >= 0.8
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least_id AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
), degrees AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
), copies AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 ELSE count(*) OVER (PARTITION BY w) - 1 END AS n FROM split
)
SELECT d.doc_id, least(d.doc_id, l.b) AS class_id, CAST(coalesce(g.n, 0) AS BIGINT) AS n_links, CAST(c.n AS BIGINT) AS n_copies
FROM documents d LEFT JOIN least_id l ON l.a = d.doc_id LEFT JOIN degrees g ON g.a = d.doc_id JOIN copies c USING (doc_id)
"""


def vector_codes(parts: int, entries: int, rounds: int, scale: int) -> str:
    """Product codes by comparing every part with every entry, round after round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS (
  SELECT r, p, piece, arg_min(e, d * {entries} + e) AS e, min(d) AS d
  FROM (
    SELECT x.r, x.p, x.piece, b.e, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(x.piece, b.piece)]) AS d
    FROM pieces x JOIN book{k} b USING (p)
  ) GROUP BY r, p, piece
)""")
        if k < rounds:
            steps.append(f"""
mean{k} AS (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS piece
  FROM (
    SELECT p, e, i, sum(piece[i]) AS s, count(*) AS n FROM near{k}, (SELECT unnest(range(1, w + 1)) AS i FROM width) GROUP BY p, e, i
  ) GROUP BY p, e
), book{k + 1} AS (
  SELECT p, e, coalesce(m.piece, b.piece) AS piece FROM book{k} b LEFT JOIN mean{k} m USING (p, e)
)""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id, v) AS r FROM kept
), width AS (SELECT max(len(v)) // {parts} AS w FROM kept
), pieces AS (
  SELECT r, p, v[p * w + 1 : (p + 1) * w] AS piece FROM numbered, width, (SELECT unnest(range({parts})) AS p)
), book0 AS (SELECT p, r - 1 AS e, piece FROM pieces WHERE r <= {entries}
),{",".join(steps)},
coded AS (
  SELECT r, string_agg(lpad(lower(hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near{rounds} GROUP BY r
), books AS (
  SELECT sha256(string_agg(array_to_string(piece, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}
)
SELECT n.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY n.label) AS BIGINT) AS label_error, b.codebooks_sha256
FROM numbered n JOIN coded c USING (r), books b
"""


VECTOR_CODES = vector_codes(8, 16, 6, 4096)
