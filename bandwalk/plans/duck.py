"""DuckDB text of the same tables, put before each query's own SQL."""

D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))"


def d2(a: str, b: str) -> str:
    return D2.format(a=a, b=b)


PARTS = {
    "v": "v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY label, vec_id) - 1 AS pos, vec_id, CAST(label AS BIGINT) AS label, embedding, CAST(label AS BIGINT) AS x, vec_id * 7919 % 1009 AS y FROM embeddings)",
    "q": "q AS MATERIALIZED (SELECT vec_id AS query_id, embedding AS qv, vec_id % 6 AS ql, vec_id % 6 + 3 AS qr, 100 AS ly, 700 AS ry FROM embeddings WHERE vec_id % 20 = 0)",
    "iv": "iv AS (SELECT query_id, min(pos) AS first_pos, max(pos) + 1 AS end_pos FROM q JOIN v ON v.label BETWEEN ql AND qr GROUP BY query_id)",
    "knn": f"knn AS MATERIALIZED (SELECT src, row_number() OVER (PARTITION BY src ORDER BY d2, dst) - 1 AS rank, dst, d2 FROM (SELECT a.pos AS src, b.pos AS dst, {d2('b.embedding', 'a.embedding')} AS d2 FROM v a JOIN v b ON a.pos <> b.pos) QUALIFY row_number() OVER (PARTITION BY src ORDER BY d2, dst) <= 16)",
    "dom": f"dom AS MATERIALIZED (SELECT a.src, a.dst, b.dst AS by FROM knn a JOIN knn b ON a.src = b.src AND b.d2 < a.d2 JOIN v x ON x.pos = a.dst JOIN v y ON y.pos = b.dst WHERE {d2('y.embedding', 'x.embedding')} < a.d2)",
    "e": "e AS MATERIALIZED (SELECT src, row_number() OVER (PARTITION BY src ORDER BY d2, dst) - 1 AS rank, dst, d2 FROM knn k WHERE NOT EXISTS (SELECT 1 FROM dom WHERE dom.src = k.src AND dom.dst = k.dst))",
    "c": f"c AS (SELECT list(round(m, 9) ORDER BY dim) AS c FROM (SELECT dim, avg(CAST(embedding[dim] AS DOUBLE)) AS m FROM v, range(1, 65) t(dim) GROUP BY dim)), s AS MATERIALIZED (SELECT pos, label, {d2('embedding', 'c')} AS d FROM v, c)",
}
NEEDS = {"iv": ("v", "q"), "knn": ("v",), "dom": ("v", "knn"), "e": ("v", "knn", "dom"), "c": ("v",)}


def sql(parts: str, body: str) -> str:
    """``body`` after the named parts (space-separated) and what they need."""
    names: list[str] = []
    for p in parts.split():
        names += [n for n in (*NEEDS.get(p, ()), p) if n not in names]
    order = [n for n in PARTS if n in names]
    return ("WITH " + ",\n".join(PARTS[n] for n in order) + "\n" if order else "") + body
