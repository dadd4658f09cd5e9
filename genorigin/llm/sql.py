"""DuckDB SQL for the queries that SQL can express."""

URL_RULES = r"""
WITH parts AS (
  SELECT page_id,
    coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest
  FROM pages
), named AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path
  FROM parts
), rules(rhost, rpath, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
  SELECT page_id, max(struct_pack(n := length(rhost || rpath), rule := rhost || rpath, v := v)) AS b
  FROM named JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT named.page_id, host, path, b.rule AS rule, coalesce(b.v, 'allow') AS verdict
FROM named LEFT JOIN best USING (page_id)
"""

MIXING = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '-') || '|' || md5(coalesce(text, ''))) AS k
  FROM documents
), s1 AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), s2 AS (
  SELECT *, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2 AS cap,
    count(*) OVER () + 1 - 2 * row_number() OVER (ORDER BY source NULLS LAST) AS turn FROM s1
), s3 AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS i FROM s2
), s4 AS (
  SELECT *, ((1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM s3
), s5 AS (
  SELECT *, (SELECT arg_min(level, i) FROM s4 WHERE level * weight < cap) AS shared FROM s4
), t AS (
  SELECT source, source_size, turn, CASE WHEN shared IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, shared * weight) END AS target FROM s5
), t1 AS (
  SELECT *, turn::DOUBLE * (SELECT sum(floor(target)::HUGEINT) FROM t)::DOUBLE - (SELECT sum(floor(target)::HUGEINT * turn) FROM t)::DOUBLE AS off FROM t
), t2 AS (
  SELECT *, CASE WHEN (SELECT max(abs(off)) FROM t1) > 0 THEN 0.5::DOUBLE * off / (SELECT max(abs(off)) FROM t1) ELSE 0::DOUBLE END AS lean FROM t1
), p AS (
  SELECT doc_id, size, source_size, target, lean, floor(target)::BIGINT AS due,
    (sum(size) OVER (PARTITION BY sizes.source ORDER BY k) - size)::BIGINT AS b
  FROM sizes JOIN t2 ON sizes.source IS NOT DISTINCT FROM t2.source
), q AS (
  SELECT *, (least(greatest(due - b, 0), size) + least(greatest(due - b - source_size, 0), size))::BIGINT AS taken FROM p
)
SELECT doc_id, size, source_size, target, lean, taken,
  CASE WHEN taken > 0 THEN 2::DOUBLE * (b / target)::DOUBLE
    / ((1::DOUBLE + lean) + sqrt(greatest((1::DOUBLE + lean) * (1::DOUBLE + lean) - 4::DOUBLE * lean * (b / target)::DOUBLE, 0::DOUBLE))) END AS position
FROM q
"""



def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Codes of the embeddings by comparing every part with every entry; one step of the text for each round."""
    steps = [
        """kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
)""",
        f"""v AS (
  SELECT r, (i // d)::BIGINT AS p, (i % d)::BIGINT AS i, floor(4096 * x::DOUBLE)::BIGINT AS x FROM (
    SELECT r, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS x, len(embedding) // {parts} AS d FROM kept)
)""",
        f"c0 AS (SELECT p, r - 1 AS e, i, x FROM v WHERE r <= {entries})",
    ]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT r, p, min(struct_pack(d := d, e := e)) AS b FROM (
    SELECT v.r, v.p, c.e, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{k} c ON v.p = c.p AND v.i = c.i GROUP BY ALL) GROUP BY r, p
)""")
        if k < rounds:
            steps.append(f"""c{k + 1} AS MATERIALIZED (
  SELECT c.p, c.e, c.i, coalesce(m.x, c.x)::BIGINT AS x FROM c{k} c LEFT JOIN (
    SELECT p, e, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS x FROM (
      SELECT v.p, a.b.e AS e, v.i, sum(v.x)::BIGINT AS s, count(*)::BIGINT AS n FROM v JOIN a{k} a ON v.r = a.r AND v.p = a.p GROUP BY ALL)) m
    ON c.p = m.p AND c.e = m.e AND c.i = m.i
)""")
    steps.append(f"""coded AS (
  SELECT r, string_agg(printf('%02x', b.e), '' ORDER BY p) AS code, sum(b.d)::BIGINT AS error FROM a{rounds} GROUP BY r
)""")
    steps.append("rows AS (SELECT vec_id, label, code, error FROM kept JOIN coded USING (r))")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) FROM c{rounds}) AS codebooks_sha256
FROM rows"""


COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL
), listed AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), f AS (
  SELECT lang, k, phrase, count(*) AS a FROM (
    SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase FROM listed, (VALUES (1), (2), (3), (4)) sizes(k))
  GROUP BY ALL
), n AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30
), cuts AS (
  SELECT lang, k, phrase, a, cut, array_to_string(w[1:cut], ' ') AS first, array_to_string(w[cut + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)
), best AS (
  SELECT cuts.lang, cuts.phrase, cuts.a,
    min(struct_pack(score := (2000000::HUGEINT * cuts.a // (x.a + y.a))::BIGINT, cut := cut, l := x.a, r := y.a)) AS b
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first JOIN f y ON y.lang = cuts.lang AND y.phrase = rest GROUP BY ALL
), kept AS (
  SELECT lang, phrase, a, b.l AS l, b.r AS r, b.score AS score FROM best
  WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = best.lang AND c.phrase <> best.phrase AND c.a * 100 >= best.a * 80 AND contains(' ' || c.phrase || ' ', ' ' || best.phrase || ' '))
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM placed JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLE = {"op4_url_rules": URL_RULES, "op8_mixing": MIXING, "op11_vector_codes": vector_codes(), "op12_collocations": COLLOCATIONS}
