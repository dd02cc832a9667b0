"""DuckDB SQL of the registered queries, built from common table expressions."""

from __future__ import annotations

NODES = """nodes AS (
    SELECT c.c_nationkey AS network, c.c_custkey AS node_id,
        48.8e0 + 0.1e0 * (c.c_custkey * 0.6180339887498949e0 - floor(c.c_custkey * 0.6180339887498949e0)) AS lat,
        2.3e0 + 0.1e0 * (c.c_custkey * 0.7548776662466927e0 - floor(c.c_custkey * 0.7548776662466927e0)) AS lng,
        c.c_acctbal AS x1, o.x2, o.y
    FROM customer c LEFT JOIN (SELECT o_custkey, count(*)::DOUBLE AS x2, avg(o_totalprice) AS y FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey)"""


def haversine(a: str, b: str) -> str:
    part = f"sin((radians({b}.lat) - radians({a}.lat)) / 2) * sin((radians({b}.lat) - radians({a}.lat)) / 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * sin((radians({b}.lng) - radians({a}.lng)) / 2) * sin((radians({b}.lng) - radians({a}.lng)) / 2)"
    return f"12742000e0 * asin(sqrt(least(1e0, greatest(0e0, {part}))))"


PAIRS = f"""dist AS (SELECT a.network, a.node_id AS src, b.node_id AS dst, {haversine("a", "b")} AS d
    FROM nodes a JOIN nodes b ON a.network = b.network AND a.node_id <> b.node_id)"""
KNN = """knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY network, src ORDER BY d, dst) AS rk FROM dist) WHERE rk <= 6)"""
SIGMA = """last AS (SELECT network, src, max(rk) AS rk FROM knn GROUP BY 1, 2),
sig AS (SELECT k.network, median(k.d) AS sigma FROM knn k JOIN last l USING (network, src, rk) GROUP BY 1)"""
EDGES = """edge AS (SELECT k.network, k.src, k.dst, exp(-k.d * k.d / (2 * s.sigma * s.sigma)) AS w FROM knn k JOIN sig s USING (network))"""
WEIGHTS = """wt AS (SELECT network, src, dst, 0.5e0 * sum(w) AS w FROM (
    SELECT network, src, dst, w FROM edge UNION ALL SELECT network, dst, src, w FROM edge) GROUP BY 1, 2, 3)"""
DEGREE = """deg AS (SELECT network, src, sum(w) AS deg FROM wt GROUP BY 1, 2)"""
LAPLACIAN = """lap AS (SELECT w.network, w.src, w.dst, -w.w / sqrt(a.deg * b.deg) AS v FROM wt w
    JOIN deg a ON a.network = w.network AND a.src = w.src JOIN deg b ON b.network = w.network AND b.src = w.dst
    UNION ALL SELECT network, node_id, node_id, 1e0 FROM nodes)"""
GRAPH = ", ".join([NODES, PAIRS, KNN, SIGMA, EDGES, WEIGHTS, DEGREE])
FEATURE_KNN = """v AS (SELECT vec_id AS node_id, embedding::DOUBLE[] AS vec FROM embeddings),
fd AS (SELECT a.node_id AS src, b.node_id AS dst, list_distance(a.vec, b.vec) AS d FROM v a JOIN v b ON a.node_id <> b.node_id),
fk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rk FROM fd) WHERE rk <= 6)"""


def graph(select: str, *more: str) -> str:
    return f"WITH {', '.join([GRAPH, *more])} {select}"


def nodes(select: str, *more: str) -> str:
    return f"WITH {', '.join([NODES, *more])} {select}"


# Balance of each customer as a mode of its nation; customers as eigenvalues and participations of their nation.
MODE = """mode AS (SELECT network, node_id, x1 AS psi FROM nodes)"""
SPEC = """spec AS (SELECT network, row_number() OVER (PARTITION BY network ORDER BY node_id) - 1 AS mode, lat * 10 + x1 / 100000 AS "lambda",
    (abs(x1) + 1) / 20000 AS ipr, count(*) OVER (PARTITION BY network) AS n FROM nodes)"""
RESCALED = """resc AS (SELECT network, 'eig' AS kind, ("lambda" - min("lambda") OVER w) / (max("lambda") OVER w - min("lambda") OVER w) AS v FROM spec WINDOW w AS (PARTITION BY network)
    UNION ALL SELECT network, 'ipr', log10(ipr + 1e-12) FROM spec)"""


def distances(samples: str, also: str = "", out: str = "w1") -> str:
    """Wasserstein and Kolmogorov distances of all pairs of networks of a table (network, also, v)."""
    x = f"{also}, " if also else ""
    using = f"{also}, " if also else ""
    return f"""{out}_c AS (SELECT network, {x}v, count(*) AS c FROM {samples} GROUP BY ALL),
{out}_p AS (SELECT a.network AS a, b.network AS b FROM (SELECT DISTINCT network FROM {samples}) a JOIN (SELECT DISTINCT network FROM {samples}) b ON a.network < b.network),
{out}_b AS (SELECT {x}a, b, v, sum(na) AS na, sum(nb) AS nb FROM (
    SELECT {x}p.a, p.b, c.v, c.c AS na, 0 AS nb FROM {out}_c c JOIN {out}_p p ON c.network = p.a
    UNION ALL SELECT {x}p.a, p.b, c.v, 0, c.c FROM {out}_c c JOIN {out}_p p ON c.network = p.b) GROUP BY {using}a, b, v),
{out}_s AS (SELECT {x}a, b, abs(sum(na) OVER r / sum(na) OVER t - sum(nb) OVER r / sum(nb) OVER t) AS g, coalesce(lead(v) OVER o, v) - v AS w FROM {out}_b
    WINDOW t AS (PARTITION BY {using}a, b), o AS (PARTITION BY {using}a, b ORDER BY v), r AS (PARTITION BY {using}a, b ORDER BY v ROWS UNBOUNDED PRECEDING)),
{out} AS (SELECT {x}a, b, sum(g * w) AS wasserstein, max(g) AS ks FROM {out}_s GROUP BY {using}a, b)"""


BALANCE = "bal AS (SELECT network, x1 AS v FROM nodes)"
SIMILAR = ", ".join([NODES, BALANCE, distances("bal")]) + ", sim AS (SELECT a, b, exp(-5e0 * wasserstein / 10000) AS s FROM w1)"
GROUPS = "grp AS (SELECT n_nationkey AS name, CASE n_regionkey WHEN 0 THEN 'A' ELSE 'B' END AS grp FROM nation WHERE n_regionkey IN (0, 1))"
LABELLED = "lab AS (SELECT s.*, x.grp AS ga, y.grp AS gb FROM sim s JOIN grp x ON x.name = s.a JOIN grp y ON y.name = s.b)"
BANDS = "bands AS (SELECT * FROM (VALUES ('low', 0e0, 0.1e0), ('mid', 0.1e0, 0.5e0), ('high', 0.5e0, 1e0)) t(band, q_lo, q_hi))"
BANDED = """rk AS (SELECT network, "lambda", row_number() OVER (PARTITION BY network ORDER BY "lambda", mode) - 1 AS r, n FROM spec),
cut AS (SELECT rk.network, band, "lambda" FROM rk JOIN bands ON r >= floor(q_lo * n) AND r < greatest(ceil(q_hi * n), floor(q_lo * n) + 1)),
bd AS (SELECT network, band, CASE WHEN max("lambda") OVER w - min("lambda") OVER w < 1e-12 THEN 0e0 ELSE ("lambda" - min("lambda") OVER w) / (max("lambda") OVER w - min("lambda") OVER w) END AS v FROM cut WINDOW w AS (PARTITION BY network, band))"""
CURVE = """grid AS (SELECT network, row_number() OVER (PARTITION BY network ORDER BY abs(x1) DESC, node_id) AS k,
    sum(x1 * x1) OVER (PARTITION BY network ORDER BY abs(x1) DESC, node_id ROWS UNBOUNDED PRECEDING) / sum(x1 * x1) OVER (PARTITION BY network) AS r2 FROM nodes)"""
WITH_Y = "own AS (SELECT * FROM nodes WHERE y IS NOT NULL)"

MATRIX = """mx AS (SELECT a, b, round(s, 9) AS s FROM (SELECT a, b, s FROM sm UNION ALL SELECT b, a, s FROM sm UNION ALL SELECT DISTINCT network, network, 1e0 FROM nodes))"""
SM = "sm AS (SELECT a, b, exp(-5e0 * (0.5e0 * max(wasserstein) FILTER (WHERE kind = 'eig') + 0.5e0 * max(wasserstein) FILTER (WHERE kind = 'ipr') / 3)) AS s FROM w1 GROUP BY 1, 2)"
TWO = "two AS (SELECT * FROM spec WHERE network IN (0, 1))"
ONE_MODE = graph(
    """SELECT e.network, e.fold::INTEGER AS fold, round(1 - sum((y - a - b * x) * (y - a - b * x)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) AS baseline,
    round(1 - sum((y - c - w1 * x - w2 * z) * (y - c - w1 * x - w2 * z)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) AS augmented
    FROM e JOIN w ON w.network = e.network AND w.fold = e.fold WHERE e.test GROUP BY 1, 2""",
    "base AS (SELECT n.network, n.node_id % 5 AS own, n.x1 / 10000 AS x, coalesce(n.y, 0) / 100000 AS y, sqrt(d.deg) AS u FROM nodes n JOIN deg d ON d.src = n.node_id)",
    "z AS (SELECT network, own, x, y, u / stddev_pop(u) OVER (PARTITION BY network) AS z FROM base)",
    "e AS (SELECT z.*, f.f AS fold, z.own = f.f AS test FROM z JOIN (SELECT DISTINCT network, own AS f FROM base) f ON f.network = z.network)",
    """m AS (SELECT network, fold, count(*) AS n, sum(x) AS sx, sum(z) AS sz, sum(y) AS sy, sum(x * x) - sum(x) * sum(x) / count(*) + 1 AS m11, sum(z * z) - sum(z) * sum(z) / count(*) + 1 AS m22,
    sum(x * z) - sum(x) * sum(z) / count(*) AS m12, sum(x * y) - sum(x) * sum(y) / count(*) AS t1, sum(z * y) - sum(z) * sum(y) / count(*) AS t2 FROM e WHERE NOT test GROUP BY 1, 2)""",
    """w AS (SELECT *, (sy - sx * b) / n AS a, (sy - sx * w1 - sz * w2) / n AS c FROM (SELECT *, t1 / m11 AS b, (t1 * m22 - t2 * m12) / (m11 * m22 - m12 * m12) AS w1, (t2 * m11 - t1 * m12) / (m11 * m22 - m12 * m12) AS w2 FROM m))""",
)

ORACLES: dict[str, str] = {
    "haversine_pairs": nodes("SELECT network, src, dst, round(d, 6) AS d FROM dist", PAIRS),
    "knn_geo_edges": nodes("SELECT network, src, dst, round(d, 6) AS d, rk::INTEGER AS rk FROM knn", PAIRS, KNN),
    "knn_geo_grid": nodes("SELECT network, src, dst, round(d, 6) AS d, rk::INTEGER AS rk FROM knn", PAIRS, KNN),
    "knn_feature_edges": f"WITH {FEATURE_KNN} SELECT 0 AS network, src, dst, round(d, 9) AS d, rk::INTEGER AS rk FROM fk",
    "sigma_auto": nodes("SELECT network, round(sigma, 6) AS sigma FROM sig", PAIRS, KNN, SIGMA),
    "rbf_weights": nodes("SELECT network, src, dst, round(w, 9) AS w FROM edge", PAIRS, KNN, SIGMA, EDGES),
    "sym_adjacency": graph("SELECT network, src, dst, round(w, 9) AS w FROM wt"),
    "degree": graph("SELECT network, src, round(deg, 9) AS deg FROM deg"),
    "lap_unnorm": graph("SELECT network, src, dst, round(-w, 9) AS v FROM wt UNION ALL SELECT network, src, src, round(deg, 9) FROM deg"),
    "lap_sym": graph("SELECT network, src, dst, round(v, 9) AS v FROM lap", LAPLACIAN),
    "knn_out_of_sample": nodes(
        f"""SELECT network, src, dst, round(d, 6) AS d, rk::INTEGER AS rk FROM (SELECT *, row_number() OVER (PARTITION BY network, src ORDER BY d, dst) AS rk FROM (
        SELECT a.network, a.node_id AS src, b.node_id AS dst, {haversine("a", "b")} AS d FROM nodes a JOIN nodes b ON a.network = b.network WHERE a.x2 > 10 AND coalesce(b.x2, 0) <= 10)) WHERE rk <= 6"""
    ),
    "eigs_moments": graph("SELECT network, round(sum(CASE WHEN src = dst THEN v ELSE 0 END), 6) AS m1, round(sum(v * v), 6) AS m2 FROM lap GROUP BY 1", LAPLACIAN),
    "eigs_feature_moments": f"""WITH {FEATURE_KNN}, sg AS (SELECT median(d) AS sigma FROM fk WHERE rk = 6), e AS (SELECT src, dst, exp(-d * d / (2 * sigma * sigma)) AS w FROM fk, sg),
        wt AS (SELECT src, dst, 0.5e0 * sum(w) AS w FROM (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e) GROUP BY 1, 2), deg AS (SELECT src, sum(w) AS deg FROM wt GROUP BY 1)
        SELECT 0 AS network, round((SELECT count(*) FROM v)::DOUBLE, 6) AS m1, round((SELECT count(*) FROM v) + sum(wt.w * wt.w / (a.deg * b.deg)), 6) AS m2 FROM wt JOIN deg a ON a.src = wt.src JOIN deg b ON b.src = wt.dst""",
    "eigs_partial": nodes("""SELECT DISTINCT network, 0 AS mode, 0e0 AS "lambda" FROM nodes"""),
    "eigs_cube_moment": graph(
        """SELECT x.network, round(sum(x.v * y.v * z.v), 6) AS m3 FROM l x JOIN l y ON x.network = y.network AND x.dst = y.src JOIN l z ON z.network = x.network AND y.dst = z.src AND z.dst = x.src GROUP BY 1""",
        LAPLACIAN, "l AS (SELECT network, src, dst, sum(v) AS v FROM lap GROUP BY 1, 2, 3)",
    ),
    "ipr_modes": nodes("SELECT network, round(sum(psi * psi * psi * psi) / (sum(psi * psi) * sum(psi * psi)), 9) AS ipr FROM mode GROUP BY 1", MODE),
    "pr_modes": nodes("SELECT network, round(1 / (count(*) * (sum(psi * psi * psi * psi) / (sum(psi * psi) * sum(psi * psi))) + 1e-30), 9) AS pr FROM mode GROUP BY 1", MODE),
    "ipr_trivial_mode": graph("SELECT network, round(sum(deg * deg) / (sum(deg) * sum(deg)), 9) AS ipr FROM deg GROUP BY 1"),
    "dirichlet": graph(
        """SELECT e.network, round(e.t / (s.s + 1e-30), 9) AS energy FROM
        (SELECT w.network, 0.5e0 * sum(w.w * (a.x1 - b.x1) * (a.x1 - b.x1)) AS t FROM wt w JOIN nodes a ON a.node_id = w.src JOIN nodes b ON b.node_id = w.dst GROUP BY 1) e
        JOIN (SELECT network, sum((x1 - m) * (x1 - m)) AS s FROM (SELECT network, x1, avg(x1) OVER (PARTITION BY network) AS m FROM nodes) GROUP BY 1) s USING (network)"""
    ),
    "rayleigh": graph(
        """SELECT e.network, round(e.t / (s.s + 1e-30), 9) AS energy FROM
        (SELECT l.network, sum(l.v * a.c * b.c) AS t FROM lap l JOIN cen a ON a.node_id = l.src JOIN cen b ON b.node_id = l.dst GROUP BY 1) e JOIN (SELECT network, sum(c * c) AS s FROM cen GROUP BY 1) s USING (network)""",
        LAPLACIAN, "cen AS (SELECT network, node_id, x1 - avg(x1) OVER (PARTITION BY network) AS c FROM nodes)",
    ),
    "dirichlet_by_modes": graph(
        """SELECT e.network, round(e.t / s.s, 6) AS energy FROM
        (SELECT l.network, sum(l.v * a.c * b.c) AS t FROM lap l JOIN cen a ON a.node_id = l.src JOIN cen b ON b.node_id = l.dst GROUP BY 1) e JOIN (SELECT network, sum(c * c) AS s FROM cen GROUP BY 1) s USING (network)""",
        LAPLACIAN, "cen AS (SELECT network, node_id, x1 - avg(x1) OVER (PARTITION BY network) AS c FROM nodes)",
    ),
    "level_spacing": nodes(
        """SELECT network, position::INTEGER AS position, round(least(s, t) / (greatest(s, t) + 1e-30), 9) AS r FROM (SELECT *, lead(s) OVER (PARTITION BY network ORDER BY position) AS t FROM (
        SELECT network, row_number() OVER o AS position, lead("lambda") OVER o - "lambda" AS s FROM spec WINDOW o AS (PARTITION BY network ORDER BY "lambda"))) WHERE t IS NOT NULL""",
        SPEC,
    ),
    "r2_single_feature": nodes("SELECT network, round(sum(x1 * y) * sum(x1 * y) / (sum(x1 * x1) * sum(y * y)), 9) AS r2 FROM own GROUP BY 1", WITH_Y),
    "r2_subspace": nodes(
        """SELECT network, round((b1 * b1 * c22 - 2 * b1 * b2 * c12 + b2 * b2 * c11) / ((c11 * c22 - c12 * c12) * yy), 9) AS r2 FROM (
        SELECT network, sum(x1 * y) AS b1, sum(x2 * y) AS b2, sum(x1 * x1) AS c11, sum(x1 * x2) AS c12, sum(x2 * x2) AS c22, sum(y * y) AS yy FROM own GROUP BY 1)""",
        WITH_Y,
    ),
    "r2_full_basis": nodes("SELECT DISTINCT network, 1e0 AS r2 FROM nodes"),
    "spectral_bound": graph(
        """SELECT network, round(b1 * b1 / (c11 * yy), 9) AS r2_imd, round(b2 * b2 / (c22 * yy), 9) AS r2_spectral_only,
        round((b1 * b1 * c22 - 2 * b1 * b2 * c12 + b2 * b2 * c11) / ((c11 * c22 - c12 * c12) * yy), 9) AS r2_augmented,
        round((b1 * b1 * c22 - 2 * b1 * b2 * c12 + b2 * b2 * c11) / ((c11 * c22 - c12 * c12) * yy) - b1 * b1 / (c11 * yy), 9) AS delta_r2, 1 AS k, 1 AS n_imd_features FROM (
        SELECT network, sum(x1 * c) AS b1, sum(u * c) AS b2, sum(x1 * x1) AS c11, sum(x1 * u) AS c12, sum(u * u) AS c22, sum(c * c) AS yy FROM (
        SELECT n.network, n.lat * 10 + n.x1 / 100000 AS x1, sqrt(d.deg) AS u, n.x1 - avg(n.x1) OVER (PARTITION BY n.network) AS c FROM nodes n JOIN deg d ON d.src = n.node_id) GROUP BY 1)"""
    ),
    "augment_wide": graph(
        "SELECT network, node_id, round(u / stddev_pop(u) OVER (PARTITION BY network), 6) AS mode_0 FROM (SELECT n.network, n.node_id, sqrt(d.deg / sum(d.deg) OVER (PARTITION BY n.network)) AS u FROM nodes n JOIN deg d ON d.src = n.node_id)"
    ),
    "select_k_fixed": nodes("SELECT network, least(16, count(*))::INTEGER AS k FROM nodes GROUP BY 1"),
    "select_k_ratio": nodes("SELECT network, min(k)::INTEGER AS k FROM (SELECT g.*, max_by(r2, k) OVER (PARTITION BY network) AS t FROM grid g) WHERE r2 >= 0.95e0 * t GROUP BY 1", CURVE),
    "select_k_elbow": nodes(
        """SELECT network, coalesce(min_by(pk, k) FILTER (WHERE pr >= 0.5e0 * m AND r2 - pr < 0.01e0), max(l))::INTEGER AS k FROM (
        SELECT network, k, r2, lag(k) OVER o AS pk, lag(r2) OVER o AS pr, max(r2) OVER t AS m, max(k) OVER t AS l FROM grid WINDOW o AS (PARTITION BY network ORDER BY k), t AS (PARTITION BY network)) GROUP BY 1""",
        CURVE,
    ),
    "bottleneck_modes": nodes("SELECT network, zone_rank::INTEGER AS zone_rank, mode::INTEGER AS mode, round(ipr, 9) AS ipr FROM (SELECT *, row_number() OVER (PARTITION BY network ORDER BY ipr DESC, mode) AS zone_rank FROM spec) WHERE zone_rank <= 5", SPEC),
    "bottleneck_nodes": nodes(
        """SELECT network, node_id, round(mass, 9) AS mass FROM (SELECT *, coalesce(sum(mass) OVER (PARTITION BY network ORDER BY mass DESC, node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
        SELECT network, node_id, psi * psi / sum(psi * psi) OVER (PARTITION BY network) AS mass FROM mode)) WHERE before < 0.95e0 AND mass >= 1e-3""",
        MODE,
    ),
    "extended_fraction": nodes("SELECT network, round(avg(CASE WHEN ipr < 5e0 / n THEN 1e0 ELSE 0e0 END), 9) AS extended_fraction FROM spec GROUP BY 1", SPEC),
    "bottleneck_zones": graph(
        """SELECT network, 1 AS zone_rank, 0 AS mode, node_id, round(lat, 9) AS lat, round(lng, 9) AS lng, round(mass, 6) AS mass FROM (SELECT *, coalesce(sum(mass) OVER (PARTITION BY network ORDER BY mass DESC, node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
        SELECT n.network, n.node_id, n.lat, n.lng, d.deg / sum(d.deg) OVER (PARTITION BY n.network) AS mass FROM nodes n JOIN deg d ON d.src = n.node_id)) WHERE before < 0.95e0 AND mass >= 1e-3"""
    ),
    "profile_checked": graph("SELECT n.network, count(*)::INTEGER AS n, round(max(s.sigma), 6) AS sigma, 6 AS k_nn, 'geographic' AS graph_type, 0e0 AS lambda_min, false AS has_features, true AS has_target FROM nodes n JOIN sig s USING (network) GROUP BY 1"),
    "wasserstein_pairs": nodes("SELECT a, b, round(wasserstein, 6) AS wasserstein FROM w1", BALANCE, distances("bal")),
    "ks_pairs": nodes("SELECT a, b, round(ks, 9) AS ks FROM w1", BALANCE, distances("bal")),
    "compare_networks": nodes(
        """SELECT a, b, (SELECT count(*) FROM spec WHERE network = a)::INTEGER AS n_a, (SELECT count(*) FROM spec WHERE network = b)::INTEGER AS n_b, round(we, 9) AS wasserstein_eigvals, round(wi, 9) AS wasserstein_ipr, round(ke, 9) AS ks_eigvals, round(ki, 9) AS ks_ipr,
        round(exp(-5e0 * (0.5e0 * we + 0.5e0 * wi / 3)), 9) AS spectral_similarity FROM (SELECT a, b, max(wasserstein) FILTER (WHERE kind = 'eig') AS we, max(wasserstein) FILTER (WHERE kind = 'ipr') AS wi,
        max(ks) FILTER (WHERE kind = 'eig') AS ke, max(ks) FILTER (WHERE kind = 'ipr') AS ki FROM w1 GROUP BY 1, 2)""",
        SPEC, RESCALED, distances("resc", "kind"),
    ),
    "similarity_matrix": nodes(
        """SELECT a, b, round(s, 9) AS s FROM (SELECT a, b, s FROM sm UNION ALL SELECT b, a, s FROM sm UNION ALL SELECT DISTINCT network, network, 1e0 FROM nodes)""",
        SPEC, RESCALED, distances("resc", "kind"), "sm AS (SELECT a, b, exp(-5e0 * (0.5e0 * max(wasserstein) FILTER (WHERE kind = 'eig') + 0.5e0 * max(wasserstein) FILTER (WHERE kind = 'ipr') / 3)) AS s FROM w1 GROUP BY 1, 2)",
    ),
    "multiscale": nodes("SELECT a, b, band, round(wasserstein, 9) AS wasserstein, round(exp(-5e0 * wasserstein), 9) AS similarity FROM w1", SPEC, BANDS, BANDED, distances("bd", "band")),
    "multiscale_matrix": nodes(
        "SELECT band, a, b, round(s, 9) AS s FROM (SELECT band, a, b, exp(-5e0 * wasserstein) AS s FROM w1 UNION ALL SELECT band, b, a, exp(-5e0 * wasserstein) FROM w1 UNION ALL SELECT DISTINCT band, network, network, 1e0 FROM bd)", SPEC, BANDS, BANDED, distances("bd", "band")
    ),
    "band_split": nodes("SELECT network, band, count(*) AS n, round(sum(v), 9) AS v FROM bd GROUP BY 1, 2", SPEC, BANDS, BANDED),
    "subsample_sizes": nodes("SELECT network, least(count(*), greatest(30, round_even(count(*) * 0.7e0, 0)))::BIGINT AS n FROM nodes GROUP BY 1"),
    "matched_sizes": nodes("SELECT network, least(count(*), 40)::BIGINT AS n FROM nodes GROUP BY 1"),
    "bootstrap_intervals": nodes(
        """SELECT a, b, round(m, 6) AS median, round(l, 6) AS lower, round(u, 6) AS upper, round(u - l, 6) AS ci_width FROM (
        SELECT 0 AS a, c.network + 1 AS b, quantile_cont(o.o_totalprice, 0.5) AS m, quantile_cont(o.o_totalprice, 0.025) AS l, quantile_cont(o.o_totalprice, 0.975) AS u FROM orders o JOIN nodes c ON c.node_id = o.o_custkey GROUP BY 2)"""
    ),
    "block_contrast": f"""WITH {SIMILAR}, {GROUPS}, {LABELLED} SELECT round(wa, 9) AS within_a, round(wb, 9) AS within_b, round(ab, 9) AS between, round(0.5e0 * (wa + wb) - ab, 9) AS contrast FROM (
        SELECT avg(s) FILTER (WHERE ga = 'A' AND gb = 'A') AS wa, avg(s) FILTER (WHERE ga = 'B' AND gb = 'B') AS wb, avg(s) FILTER (WHERE ga <> gb) AS ab FROM lab)""",
    "permutation_observed": f"""WITH {SIMILAR}, {GROUPS}, {LABELLED} SELECT round(0.5e0 * (wa + wb) - ab, 9) AS observed, 500 AS n_perm FROM (
        SELECT avg(s) FILTER (WHERE ga = 'A' AND gb = 'A') AS wa, avg(s) FILTER (WHERE ga = 'B' AND gb = 'B') AS wb, avg(s) FILTER (WHERE ga <> gb) AS ab FROM lab)""",
    "block_similarity_diag": f"""WITH {SIMILAR}, {GROUPS}, {LABELLED}, whole AS (SELECT ga, gb, s FROM lab UNION ALL SELECT gb, ga, s FROM lab UNION ALL SELECT grp, grp, 1e0 FROM grp)
        SELECT round(wa, 9) AS within_a, round(wb, 9) AS within_b, round(ab, 9) AS between, round(0.5e0 * (wa + wb) - ab, 9) AS contrast FROM (
        SELECT avg(s) FILTER (WHERE ga = 'A' AND gb = 'A') AS wa, avg(s) FILTER (WHERE ga = 'B' AND gb = 'B') AS wb, avg(s) FILTER (WHERE ga = 'A' AND gb = 'B') AS ab FROM whole)""",
    "mantel_spearman": f"""WITH {SIMILAR}, t AS (SELECT a, b, s AS x, round(s, 2) AS y FROM sim),
        r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2e0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2e0 AS ry FROM t)
        SELECT round(corr(rx, ry), 9) AS rho, count(*) AS n FROM r""",
    "top_bottom_pairs": f"""WITH {SIMILAR} SELECT 'top' AS "end", row_number() OVER (ORDER BY s DESC, a, b)::INTEGER AS rank, a, b, round(s, 9) AS s FROM sim QUALIFY rank <= 5
        UNION ALL SELECT 'bottom', row_number() OVER (ORDER BY s, a, b)::INTEGER AS rank, a, b, round(s, 9) FROM sim QUALIFY rank <= 5""",
    "verdicts": """SELECT n_nationkey AS recipe, n_nationkey / 25e0 AS rho, n_regionkey / 40e0 AS contrast, CASE WHEN n_nationkey / 25e0 > 0.7e0 THEN 'strong' WHEN n_nationkey / 25e0 > 0.3e0 THEN 'moderate' ELSE 'weak' END AS verdict, n_regionkey / 40e0 > 0.05e0 AS robust FROM nation""",
    "kfold_sizes": nodes("SELECT network, f::INTEGER AS fold, (n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END)::BIGINT AS n FROM (SELECT network, count(*) AS n FROM nodes GROUP BY 1), range(5) t(f)"),
    "nystrom_extend": nodes(
        f"""SELECT network, src AS node_id, round(CASE WHEN sum(w) <= 1e-12 THEN sum(w * psi) ELSE sum(w * psi) / sum(w) END, 6) AS psi FROM (SELECT network, src, exp(-d * d / (2 * 500e0 * 500e0)) AS w, psi FROM (SELECT *, row_number() OVER (PARTITION BY network, src ORDER BY d, dst) AS rk FROM (
        SELECT a.network, a.node_id AS src, b.node_id AS dst, b.x1 AS psi, {haversine("a", "b")} AS d FROM nodes a JOIN nodes b ON a.network = b.network WHERE a.x2 > 10 AND coalesce(b.x2, 0) <= 10)) WHERE rk <= 6) GROUP BY 1, 2"""
    ),
    "ridge_fit": nodes("SELECT network, round((sy - b * sx) / n, 4) AS intercept, round(b, 6) AS slope FROM (SELECT network, count(*) AS n, sum(x1) AS sx, sum(y) AS sy, (sum(x1 * y) - sum(x1) * sum(y) / count(*)) / (sum(x1 * x1) - sum(x1) * sum(x1) / count(*) + 1) AS b FROM own GROUP BY 1)", WITH_Y),
    "r2_score": nodes("SELECT network, round(1 - sum((y - yh) * (y - yh)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) AS r2 FROM (SELECT network, y, 140000 + x1 AS yh FROM own) GROUP BY 1", WITH_Y),
    "station_load": """SELECT CASE WHEN length(k) < 6 THEN lpad(k, 6, '0') ELSE k END AS station_id, round(x1, 6) AS x1, round(y + 0.00013e0, 3) AS y FROM (
        SELECT c.c_custkey::VARCHAR AS k, c.c_acctbal AS x1, avg(exp(ln(1 + o.o_totalprice)) - 1) AS y FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY ALL)""",
    "zfill_ids": "SELECT p_partkey, CASE WHEN length(p_partkey::VARCHAR) < 6 THEN lpad(p_partkey::VARCHAR, 6, '0') ELSE p_partkey::VARCHAR END AS id FROM part",
    "size_gate": nodes("SELECT network, count(*) AS n FROM nodes GROUP BY 1 HAVING count(*) >= 60"),
    "standardise": nodes("SELECT network, node_id, round((x1 - avg(x1) OVER w) / (stddev_pop(x1) OVER w + 1e-12), 9) AS z FROM nodes WINDOW w AS (PARTITION BY network)"),
    "scale_modes": nodes("SELECT network, node_id, round(x1 / stddev_pop(x1) OVER (PARTITION BY network), 9) AS z FROM nodes"),
    "minmax": nodes("SELECT network, node_id, round((x1 - min(x1) OVER w) / (max(x1) OVER w - min(x1) OVER w), 9) AS z FROM nodes WINDOW w AS (PARTITION BY network)"),
    "centre": nodes("SELECT network, node_id, round(x1 - avg(x1) OVER (PARTITION BY network), 6) AS z FROM nodes"),
    "hist_density": nodes(
        """SELECT e.network, g.bin::INTEGER AS bin, round(e.lo + g.bin * w, 6) AS "left", round(w, 6) AS width, round(coalesce(c.c, 0) / (e.n * w), 9) AS density FROM (SELECT network, min(x1) AS lo, (max(x1) - min(x1)) / 50 AS w, max(x1) AS hi, count(*) AS n FROM nodes GROUP BY 1) e, range(50) g(bin)
        LEFT JOIN (SELECT n.network, least(floor((n.x1 - e.lo) / (e.hi - e.lo) * 50), 49) AS bin, count(*) AS c FROM nodes n JOIN (SELECT network, min(x1) AS lo, max(x1) AS hi FROM nodes GROUP BY 1) e USING (network) GROUP BY 1, 2) c ON c.network = e.network AND c.bin = g.bin"""
    ),
    "bottleneck_map": nodes("SELECT network, node_id, round(lng, 9) AS lng, round(lat, 9) AS lat, round(mass, 9) AS mass, row_number() OVER (PARTITION BY network ORDER BY mass, node_id)::INTEGER AS position FROM (SELECT *, x1 * x1 / sum(x1 * x1) OVER (PARTITION BY network) AS mass FROM nodes)"),
    "spectrum_lines": nodes("""SELECT network, mode::INTEGER AS mode, round("lambda", 9) AS "lambda", round(ipr, 9) AS ipr, round(1e0 / n, 9) AS uniform, round(5e0 / n, 9) AS extended FROM spec""", SPEC),
    "cv_panel": """SELECT s_nationkey AS network, s_suppkey::INTEGER AS fold, round(s_acctbal, 6) AS baseline, round(2 * s_acctbal, 6) AS augmented, round(avg(s_acctbal) OVER w, 6) AS baseline_mean, round(avg(2 * s_acctbal) OVER w, 6) AS augmented_mean FROM supplier WINDOW w AS (PARTITION BY s_nationkey)""",
    "cv_means": "SELECT s_nationkey AS network, round(avg(s_acctbal), 6) AS baseline_mean, round(avg(2 * s_acctbal), 6) AS augmented_mean, round(avg(s_acctbal), 6) AS gain_mean, count(*)::INTEGER AS n_folds FROM supplier GROUP BY 1",
    "statistics": nodes("""SELECT network, max(n)::BIGINT AS n, round(avg(ipr), 9) AS mean_ipr, round(median(ipr), 9) AS median_ipr, round(max(ipr), 9) AS ipr_max, round(min("lambda"), 9) AS lambda_min, round(max("lambda"), 9) AS lambda_max FROM spec GROUP BY 1""", SPEC),
    "atlas_excess": nodes(
        """SELECT network, round((m - a) / s, 9) AS ipr_excess_z, round(m / a, 9) AS ipr_ratio, CASE WHEN n <= 200 THEN 'small' WHEN n <= 800 THEN 'medium' ELSE 'large' END AS size_bin FROM (SELECT network, avg(x1) AS m, avg(abs(x1)) AS a, stddev_samp(x1) AS s, count(*) AS n FROM nodes GROUP BY 1)"""
    ),
    "atlas_crosstab": """SELECT c_mktsegment, count(*) FILTER (WHERE c_nationkey % 3 = 0) AS "0", count(*) FILTER (WHERE c_nationkey % 3 = 1) AS "1", count(*) FILTER (WHERE c_nationkey % 3 = 2) AS "2" FROM customer GROUP BY 1""",
    "atlas_label_summary": "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS std, round(median(c_acctbal), 6) AS median FROM customer GROUP BY 1",
    "block_gain": """SELECT city, round(b, 6) AS r2_base, round(a, 6) AS r2_aug, round(a - b, 6) AS gain, round(ra, 6) AS r2_aug_random, round(ra - rb, 6) AS gain_random, round(ra - a, 6) AS r2_drop, round((ra - rb) - (a - b), 6) AS gain_drop FROM
        (SELECT c_nationkey AS city, avg(c_acctbal) AS b, avg(c_acctbal + c_custkey) AS a FROM customer GROUP BY 1) x JOIN (SELECT s_nationkey AS city, avg(s_acctbal) AS rb, avg(s_acctbal + s_suppkey) AS ra FROM supplier GROUP BY 1) y USING (city)""",
    "knn_geo_large": f"""WITH nodes AS (SELECT o_orderkey AS node_id, 48.8e0 + 0.1e0 * (o_orderkey * 0.6180339887498949e0 - floor(o_orderkey * 0.6180339887498949e0)) AS lat,
        2.3e0 + 0.1e0 * (o_orderkey * 0.7548776662466927e0 - floor(o_orderkey * 0.7548776662466927e0)) AS lng FROM orders), cell AS (SELECT *, floor(lat / 0.01e0) AS c FROM nodes),
        far AS (SELECT a.node_id AS src, b.node_id AS dst, {haversine("a", "b")} AS d FROM cell a JOIN (SELECT node_id, lat, lng, unnest([c - 1, c, c + 1]) AS c FROM cell) b ON a.c = b.c AND a.node_id <> b.node_id)
        SELECT 0 AS network, src, dst, round(d, 5) AS d, rk::INTEGER AS rk FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rk FROM far) WHERE rk <= 3""",
    "similarity_wide": nodes("SELECT a, " + ", ".join(f'max(s) FILTER (WHERE b = {i}) AS "{i}"' for i in range(25)) + " FROM mx GROUP BY 1", SPEC, RESCALED, distances("resc", "kind"), SM, MATRIX),
    "permutation_exact": f"""WITH {SIMILAR}, {GROUPS}, {LABELLED}, mem AS (SELECT name, grp, row_number() OVER (ORDER BY name) - 1 AS i FROM grp WHERE name IN (SELECT a FROM sim UNION SELECT b FROM sim)),
        msk AS (SELECT m FROM range(1024) t(m) WHERE m < (SELECT pow(2, count(*)) FROM mem) AND bit_count(m) = (SELECT count(*) FROM mem WHERE grp = 'A')),
        sp AS (SELECT m, s, (m >> x.i) & 1 AS p, (m >> y.i) & 1 AS q FROM msk, lab JOIN mem x ON x.name = lab.a JOIN mem y ON y.name = lab.b),
        con AS (SELECT m, 0.5e0 * (avg(s) FILTER (WHERE p = 1 AND q = 1) + avg(s) FILTER (WHERE p = 0 AND q = 0)) - avg(s) FILTER (WHERE p <> q) AS c FROM sp GROUP BY 1),
        obs AS (SELECT 0.5e0 * (avg(s) FILTER (WHERE ga = 'A' AND gb = 'A') + avg(s) FILTER (WHERE ga = 'B' AND gb = 'B')) - avg(s) FILTER (WHERE ga <> gb) AS o FROM lab)
        SELECT round(max(o), 9) AS observed, round(avg(c), 9) AS null_mean, round(stddev_pop(c), 9) AS null_std, round(avg(CASE WHEN c >= o - 1e-12 THEN 1e0 ELSE 0e0 END), 9) AS p_value, count(*)::INTEGER AS n_perm FROM con, obs""",
    "cv_one_mode": ONE_MODE,
    "cv_estimator_one_mode": ONE_MODE,
    "comparison_panel": nodes(
        """SELECT e.network, e.kind, g.bin::INTEGER AS bin, round(e.lo + g.bin * w, 6) AS "left", round(w, 6) AS width, round(coalesce(c.c, 0) / (e.n * w), 6) AS density FROM ends e CROSS JOIN range(50) g(bin)
        LEFT JOIN (SELECT v.network, v.kind, least(floor((v.v - e.lo) / (e.hi - e.lo) * 50), 49) AS bin, count(*) AS c FROM vals v JOIN ends e ON e.network = v.network AND e.kind = v.kind GROUP BY 1, 2, 3) c ON c.network = e.network AND c.kind = e.kind AND c.bin = g.bin""",
        SPEC, TWO, """vals AS (SELECT network, 'lambda' AS kind, "lambda" AS v FROM two UNION ALL SELECT network, 'log_ipr', log10(ipr + 1e-12) FROM two)""",
        "ends AS (SELECT network, kind, min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 50 AS w, count(*) AS n FROM vals GROUP BY 1, 2)",
    ),
    "comparison_statistics": nodes(
        """SELECT network, max(n)::BIGINT AS n, round(avg(ipr), 9) AS mean_ipr, round(median(ipr), 9) AS median_ipr, round(max(ipr), 9) AS ipr_max, round(min("lambda"), 9) AS lambda_min, round(max("lambda"), 9) AS lambda_max,
        round(avg(CASE WHEN ipr < 5e0 / n THEN 1e0 ELSE 0e0 END), 9) AS extended_fraction, round(max(sr), 9) AS mean_level_spacing_r FROM two JOIN (SELECT network, avg(least(s, t) / (greatest(s, t) + 1e-30)) AS sr FROM (SELECT *, lead(s) OVER (PARTITION BY network ORDER BY position) AS t FROM (
        SELECT network, row_number() OVER o AS position, lead("lambda") OVER o - "lambda" AS s FROM two WINDOW o AS (PARTITION BY network ORDER BY "lambda"))) WHERE t IS NOT NULL GROUP BY 1) USING (network) GROUP BY 1""",
        SPEC, TWO,
    ),
}
