"""SQL (DuckDB) for the operators that SQL can express; the others are tested against brute force."""

WORDS = r"'[^\x20\x09-\x0D]+'"
_unit = lambda key: f"((('0x' || substr(md5({key}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"

OP1 = """
    WITH signs AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
    pairs AS (
        SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(range(1, 65), lambda i: (q.s[i] <> d.s[i])::INT))::INT AS distance
        FROM signs q, signs d WHERE q.vec_id % 100 = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM pairs)
    SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10"""

OP7 = f"""
    WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, coalesce(text, '') AS x FROM documents),
    sums AS (SELECT doc_id, k, strlen(x) + 16 AS size, xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, crc),
    placed AS (
        SELECT doc_id, size, text_crc32, ('0x' || substr(md5(k || ':' || text_crc32), 1, 6))::BIGINT % 256 AS sub, (SELECT arg_min(s, -ln({_unit("k || ':' || s")})) FROM range(40) AS r(s))::INT AS shard, (SELECT arg_min(s, -ln({_unit("k || ':' || s")})) FROM range(41) AS r(s))::INT AS grown_shard
        FROM sums)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY sub, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM placed"""

OP9 = f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS ws FROM documents),
    sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
    edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reach AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT e.y, r.m FROM reach r JOIN edges e ON e.x = r.doc_id)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(m) FROM reach r WHERE r.doc_id = d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"""

_close = lambda i: f"""
    p{i} AS (SELECT source, row, size FROM (SELECT f.*, row_number() OVER (PARTITION BY f.source ORDER BY abs(gap - size), q, row) AS nth_ FROM f JOIN g{i - 1} g ON f.source IS NOT DISTINCT FROM g.source
        WHERE q IS NOT NULL AND NOT fits AND abs(gap - size) < abs(gap) AND NOT list_contains(g.taken, row)) WHERE nth_ = 1),
    g{i} AS (SELECT g.source, gap - coalesce(p.size, 0) AS gap, CASE WHEN p.size IS NULL THEN g.taken ELSE list_append(g.taken, p.row) END AS taken FROM g{i - 1} g LEFT JOIN p{i} p ON g.source IS NOT DISTINCT FROM p.source)"""  # noqa: E731

_measure = "floor(1024 * sqrt(size::DOUBLE))::BIGINT"

OP10 = f"""
    WITH s0 AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {WORDS})), 0)::BIGINT AS size, md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':' || coalesce('s' || source, '')) AS key FROM documents),
    s1 AS (SELECT *, row_number() OVER (PARTITION BY key) - 1 AS nth FROM s0),
    s AS (SELECT doc_id, source, size, key || ':' || nth AS row, {_unit("CASE WHEN nth = 0 THEN key ELSE key || ':' || nth END")} AS u FROM s1),
    a AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM s GROUP BY source),
    b AS (SELECT *, (nth - 1) % 3 + 1 AS w, 3 * source_size AS cap, (3 * source_size)::DOUBLE / ((nth - 1) % 3 + 1) AS ratio FROM a),
    c AS (SELECT *, ((sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::DOUBLE) AS level FROM b WINDOW o AS (ORDER BY ratio, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT max(level) AS level FROM c WHERE NOT ratio <= level),
    t0 AS (SELECT source, source_size, ratio <= c.level AS capped, CASE WHEN ratio <= c.level THEN cap::DOUBLE ELSE l.level * w END AS target FROM c, l),
    t AS (SELECT *, CASE WHEN capped THEN 3 ELSE coalesce(floor(target / nullif(source_size, 0)), 0) END::BIGINT AS whole FROM t0),
    r AS (SELECT *, greatest(target - (whole * source_size)::DOUBLE, 0.0) AS rest FROM t),
    z AS (SELECT s.source, size, max(rest) AS rest, (count(*) * size)::BIGINT AS words FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source WHERE size > 0 AND rest > 0 GROUP BY s.source, size),
    y AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS larger, sum(words * {_measure}) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS mass FROM z),
    x AS (SELECT *, (rest - larger) / mass AS rate FROM y),
    i AS (SELECT source, max(size) AS top, arg_max(rate, size) AS rate, arg_max(larger, size) AS certain FROM x WHERE rate * {_measure} < 1 GROUP BY source),
    e0 AS (SELECT s.*, r.source_size, r.target, r.whole, rest - coalesce(certain, 0) AS left_over, coalesce(CASE WHEN size > top THEN 1.0 ELSE rate * {_measure} END, 0.0)::DOUBLE AS p FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source LEFT JOIN i ON s.source IS NOT DISTINCT FROM i.source),
    q AS (SELECT *, CASE WHEN p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM e0),
    f AS (SELECT *, q IS NOT NULL AND sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, row ROWS UNBOUNDED PRECEDING) <= left_over AS fits FROM q),
    g0 AS (SELECT source, max(left_over) - sum(CASE WHEN fits THEN size ELSE 0 END) AS gap, []::VARCHAR[] AS taken FROM f WHERE q IS NOT NULL GROUP BY source),{_close(1)},{_close(2)},{_close(3)}
    SELECT f.doc_id, size, source_size, target, size * copies AS taken, copies, p FROM (
        SELECT f.*, whole + (p >= 1 OR fits OR coalesce(list_contains(g3.taken, row), false))::INT AS copies FROM f LEFT JOIN g3 ON f.source IS NOT DISTINCT FROM g3.source) f"""

ORACLE = {"op1_hamming_topk": OP1, "op7_rendezvous_sharding": OP7, "op9_jaccard_join": OP9, "op10_source_mixing": OP10}
