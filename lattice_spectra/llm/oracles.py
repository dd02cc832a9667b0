"""DuckDB SQL of the ``opN_*`` queries that SQL can express."""

_USABLE = """
    SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
"""

ORACLES: dict[str, str] = {
    "op1_exact_top_k": f"""
        WITH v AS (SELECT id, list_transform(vec, lambda x: floor(64 * x)) AS code FROM ({_USABLE})),
        s AS (SELECT q.id AS query_id, c.id AS vec_id, list_inner_product(q.code, c.code)::BIGINT AS score
              FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
    """,
}
