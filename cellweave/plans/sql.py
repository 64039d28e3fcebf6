"""SQL for the queries of `catalog`, over the same tables, for comparison."""

from __future__ import annotations

VIEWS = {
    "counts": "SELECT o_custkey AS cell, l_partkey AS gene, sum(l_quantity)::DOUBLE AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2",
    "cells": "SELECT c_custkey AS cell, c_name AS barcode, c_mktsegment AS cluster FROM customer",
    "genes": "SELECT p_partkey AS gene, p_name AS name FROM part",
    "fragments": """SELECT l_returnflag AS chrom, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INTEGER AS "start", date_diff('day', DATE '1995-01-01', l_shipdate::DATE)::INTEGER AS "end", o_custkey AS cell
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate::DATE > o_orderdate::DATE""",
    "markers": """SELECT * FROM (VALUES ('m1', 'R', 1200, 1230, 'fwd'), ('m2', 'R', 1400, 1460, 'rev'), ('m3', 'A', 300, 310, 'rev'), ('m4', 'A', 900, 1000, 'fwd'), ('m5', 'N', 50, 60, 'fwd'), ('m6', 'N', 2000, 2100, 'rev')) t(gene, chrom, "start", "end", strand)""",
    "peaks": """SELECT p_partkey AS peak, substr('ANR', (p_partkey % 3)::INTEGER + 1, 1) AS chrom, ((p_partkey * 37) % 2500)::INTEGER AS "start", ((p_partkey * 37) % 2500 + 30)::INTEGER AS "end" FROM part""",
    "emb": "SELECT vec_id AS cell, list_transform(embedding, lambda x: x::DOUBLE) AS vec, label::VARCHAR AS cluster FROM embeddings",
    "deg": "SELECT cell, count(*) AS degree FROM counts GROUP BY 1",
    "fit_cells": "SELECT cell FROM deg WHERE degree BETWEEN 20 AND 60",
    "f1": "SELECT * FROM counts WHERE cell IN (SELECT cell FROM fit_cells)",
    "f2": "SELECT * FROM f1 WHERE gene IN (SELECT gene FROM f1 GROUP BY 1 HAVING sum(v) >= 1)",
    "norm": "SELECT cell, gene, ln(1 + v * 10000::DOUBLE / sum(v) OVER (PARTITION BY cell)) AS v FROM f2",
    "n": "SELECT (SELECT count(*) FROM fit_cells)::DOUBLE AS n_cells, (SELECT count(DISTINCT gene) FROM f2) AS n_genes",
    "stats": "SELECT gene, sum(v) / any_value(n_cells) AS mean, sum(v * v) / any_value(n_cells) AS msq FROM norm, n GROUP BY 1",
    "disp": "SELECT gene, mean, (msq - mean * mean) * n_genes::DOUBLE / (n_cells - 1) / mean AS d FROM stats, n",
    "edges": "SELECT quantile_cont(mean, [" + ", ".join(f"{p / 100}" for p in range(10, 101, 5)) + "]) AS e FROM disp",
    "binned": "SELECT gene, mean, d, len(list_filter(e, lambda x: x < mean)) AS bin FROM disp, edges",
    "med": "SELECT *, median(d) OVER (PARTITION BY bin) AS m FROM binned",
    "dev": "SELECT *, median(abs(d - m)) OVER (PARTITION BY bin) / 0.6744897501960817::DOUBLE AS s FROM med",
    "scored": "SELECT gene, bin, CASE WHEN s <> 0 THEN (d - m) / s WHEN d > m THEN 'inf'::DOUBLE WHEN d < m THEN '-inf'::DOUBLE END AS norm FROM dev",
    "picked": "SELECT *, coalesce(norm, 0) >= (SELECT min(norm) FROM (SELECT norm FROM scored WHERE norm IS NOT NULL ORDER BY norm DESC LIMIT greatest(1, (SELECT n_genes // 10 FROM n)))) AS selected FROM scored",
    "cov": """SELECT c.cell, coalesce(sum(v), 0)::DOUBLE AS n_counts, CASE WHEN coalesce(sum(v), 0) <> 0 THEN coalesce(sum(v) FILTER (WHERE starts_with(name, 'red')), 0) / sum(v) ELSE 0 END::DOUBLE AS percent
        FROM cells c LEFT JOIN counts USING (cell) LEFT JOIN genes USING (gene) GROUP BY 1""",
    "logged": "SELECT cell, gene, ln(1 + v) AS v FROM counts",
    "gram": "SELECT count(*)::DOUBLE AS a, sum(n_counts) AS b, sum(percent) AS c, sum(n_counts * n_counts) AS d, sum(n_counts * percent) AS e, sum(percent * percent) AS f FROM cov",
    "det": "SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS q FROM gram",
    "rhs": "SELECT g.gene, coalesce(sum(v), 0) AS y0, coalesce(sum(v * n_counts), 0) AS y1, coalesce(sum(v * percent), 0) AS y2, coalesce(sum(v * v), 0) AS squares FROM genes g LEFT JOIN (logged JOIN cov USING (cell)) USING (gene) GROUP BY 1",
    "beta": """SELECT gene, squares, y0, y1, y2,
        ((d * f - e * e) * y0 + (c * e - b * f) * y1 + (b * e - c * d) * y2) / q AS b0,
        ((c * e - b * f) * y0 + (a * f - c * c) * y1 + (b * c - a * e) * y2) / q AS b1,
        ((b * e - c * d) * y0 + (b * c - a * e) * y1 + (a * d - b * b) * y2) / q AS b2 FROM rhs, det""",
    "whole": "SELECT c.cell, g.gene, coalesce(v, 0)::DOUBLE AS v FROM cells c CROSS JOIN genes g LEFT JOIN counts k ON k.cell = c.cell AND k.gene = g.gene",
    "spread": "SELECT gene, avg(v) AS m, stddev_pop(v) AS s0, stddev_samp(v) AS s1 FROM whole GROUP BY 1",
    "region": """SELECT * FROM fragments WHERE chrom = 'R' AND "start" < 1465 AND "end" > 1100""",
    "clustered": """SELECT f.*, c.cluster FROM region f JOIN cells c USING (cell)""",
    "cut": """SELECT cluster, greatest("start", 1100) AS s, least("end", 1465) AS e FROM clustered""",
    "depths": "SELECT cluster, pos, count(*) AS depth FROM (SELECT cluster, unnest(range(s, e))::INTEGER AS pos FROM cut) GROUP BY 1, 2",
    "grid": "SELECT cluster, pos FROM (SELECT DISTINCT cluster FROM cells), (SELECT unnest(range(1100, 1465))::INTEGER AS pos)",
    "dense": "SELECT cluster, pos, coalesce(depth, 0) AS depth FROM grid LEFT JOIN depths USING (cluster, pos)",
    "fcount": "SELECT cell, count(*) AS fragments FROM fragments GROUP BY 1",
    "padded": """SELECT gene, chrom, strand, "start" AS gs, "end" AS ge, "start" - CASE strand WHEN 'rev' THEN @DOWN ELSE @UP END AS lo, "end" + CASE strand WHEN 'rev' THEN @UP ELSE @DOWN END AS hi FROM markers""",
    "frame": """SELECT e.vec[1] AS x, e.vec[2] AS y, e.cluster::INTEGER AS labels, greatest(e.vec[3], 0) AS mk, e.cluster::INTEGER AS mk_labels, e.cell AS point_index, 'cell-' || e.cell AS barcode FROM emb e""",
}


def sql(names: str, query: str, **replace: str) -> str:
    """A query over the named views, in which later ones may use earlier ones."""
    views = ", ".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in names.split())
    text = f"WITH {views} {query}"
    for k, v in replace.items():
        text = text.replace(f"@{k.upper()}", v)
    return text


HVG = "counts deg fit_cells f1 f2 norm n stats disp edges binned med dev scored picked"
REGRESS = "counts cells genes cov logged gram det rhs beta"
SCALED = "counts cells genes whole spread"
SUMMARY = "SELECT gene, round(min(z), 5) + 0.0 AS low, round(max(z), 5) + 0.0 AS high, round(sum(z), 5) + 0.0 AS total, round(sum(z * z), 5) + 0.0 AS squares FROM (SELECT gene, @Z AS z FROM whole JOIN spread USING (gene)) GROUP BY 1"

ORACLES = {
    "filter_cells": sql("counts deg fit_cells f1", "SELECT * FROM f1"),
    "sparse_cells": sql("counts cells deg", "SELECT cells.* FROM cells LEFT JOIN deg USING (cell) WHERE coalesce(degree, 0) BETWEEN 0 AND 30"),
    "filter_genes_sum": sql("counts", "SELECT * FROM counts WHERE gene IN (SELECT gene FROM counts GROUP BY 1 HAVING sum(v) >= 750)"),
    "filter_genes_nnz": sql("counts", "SELECT * FROM counts WHERE gene IN (SELECT gene FROM counts GROUP BY 1 HAVING count(*) >= 30)"),
    "filter_genes_strict": sql("counts", "SELECT * FROM counts WHERE gene IN (SELECT gene FROM counts GROUP BY 1 HAVING sum(v) > 750)"),
    "first_n_cells": sql("counts", "SELECT * FROM counts WHERE cell < 100"),
    "select_barcodes": sql("counts cells", "SELECT counts.* FROM counts JOIN cells USING (cell) WHERE barcode IN ('Customer#000000003', 'Customer#000000007', 'nobody')"),
    "reindex_genes": sql("counts deg fit_cells f1", "SELECT gene, (row_number() OVER (ORDER BY gene) - 1)::BIGINT AS position FROM (SELECT DISTINCT gene FROM f1)"),
    "unique_names": sql(
        "genes",
        """, t AS (SELECT regexp_extract(name, '^(.*)-([1-9][0-9]*)$', 1) AS base, list(DISTINCT regexp_extract(name, '^(.*)-([1-9][0-9]*)$', 2)::BIGINT ORDER BY 1) AS taken FROM genes WHERE regexp_matches(name, '-[1-9][0-9]*$') GROUP BY 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY gene) - 1 AS r FROM genes)
        SELECT gene, CASE WHEN r > 0 THEN name || '-' || list_reduce(list_prepend(r, coalesce(taken, [])), lambda x, t: CASE WHEN t <= x THEN x + 1 ELSE x END) ELSE name END AS name FROM r LEFT JOIN t ON name = base""",
    ),
    "normalize_total": sql("counts", "SELECT cell, gene, round(v * 10000::DOUBLE / sum(v) OVER (PARTITION BY cell), 6) AS v FROM counts"),
    "log_normalize": sql("counts", "SELECT cell, gene, round(ln(1 + v * 10000::DOUBLE / sum(v) OVER (PARTITION BY cell)), 6) AS v FROM counts"),
    "marker_expression": sql(
        "counts cells genes",
        """, m AS (SELECT name, min(gene) AS gene FROM genes WHERE name IN ('red widget', 'blue bolt', 'hot gear') GROUP BY 1), l AS (SELECT cell, gene, ln(1 + v * 10000::DOUBLE / sum(v) OVER (PARTITION BY cell)) AS v FROM counts)
        SELECT cell, round(coalesce(max(v) FILTER (WHERE name = 'red widget'), 0), 6) AS red_widget_raw, round(coalesce(max(v) FILTER (WHERE name = 'blue bolt'), 0), 6) AS blue_bolt_raw, round(coalesce(max(v) FILTER (WHERE name = 'hot gear'), 0), 6) AS hot_gear_raw
        FROM cells LEFT JOIN (l JOIN m USING (gene)) USING (cell) GROUP BY 1""",
    ),
    "gene_stats": sql("counts cells", "SELECT gene, sum(v) AS total, sum(v * v) AS squares, round(sum(v) / (SELECT count(*) FROM cells), 6) AS mean, round(sum(v * v) / (SELECT count(*) FROM cells), 6) AS mean_sq, count(*) FILTER (WHERE v > 0) AS entries FROM counts GROUP BY 1"),
    "hvg": sql(HVG, "SELECT gene, bin, round(norm, 4) AS norm, selected FROM picked"),
    "hvg_batches": sql(HVG, "SELECT gene, bin, round(norm, 4) AS norm, selected FROM picked"),
    "preprocess_matrix": sql(HVG, "SELECT cell, gene, round(v, 6) AS v FROM norm WHERE gene IN (SELECT gene FROM picked WHERE selected)"),
    "qc_prefix_fraction": sql("counts cells genes cov", "SELECT cell, n_counts, round(percent, 6) AS percent FROM cov"),
    "regress_out": sql(REGRESS, "SELECT gene, round(b0, 5) AS b0, round(b1, 6) AS b1, round(b2, 5) AS b2, round(squares - b0 * y0 - b1 * y1 - b2 * y2, 4) AS rest FROM beta"),
    "regress_residuals": sql(REGRESS, ", r AS (SELECT cell, coalesce(v, 0) - b0 - b1 * n_counts - b2 * percent AS r FROM cov CROSS JOIN beta LEFT JOIN logged USING (cell, gene)) SELECT cell, round(sum(r), 3) AS total, round(sum(r * r), 3) AS squares FROM r GROUP BY 1"),
    "scale_clip": sql(SCALED, SUMMARY, z="greatest(-3, least(3, (v - m) / CASE WHEN s0 > 1e-12 THEN s0 ELSE 1 END))"),
    "tf_idf": sql("counts cells", ", f AS (SELECT gene, count(*) FILTER (WHERE v > 0) AS k FROM counts GROUP BY 1) SELECT cell, gene, round(v / sum(v) OVER (PARTITION BY cell) * ln(1 + (SELECT count(*) FROM cells)::DOUBLE / k), 6) AS v FROM counts JOIN f USING (gene)"),
    "log_tf_idf": sql("counts cells", ", f AS (SELECT gene, count(*) FILTER (WHERE v > 0) AS k FROM counts GROUP BY 1) SELECT cell, gene, round(v * ln(1 + 1000::DOUBLE / sum(v) OVER (PARTITION BY cell)) * ln(1 + (SELECT count(*) FROM cells)::DOUBLE / k), 5) AS v FROM counts JOIN f USING (gene)"),
    "top_peaks": sql("counts cells", "SELECT gene, round(count(*) FILTER (WHERE v > 0)::DOUBLE / (SELECT count(*) FROM cells), 6) AS frequency FROM counts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100"),
    "parse_peaks": sql("peaks", """SELECT peak, chrom || ':' || "start" || '-' || "end" AS name, chrom, "start", "end" FROM peaks"""),
    "interval_overlap": sql("fragments markers padded", """SELECT p.gene, f.chrom, f."start", f."end", f.cell, p.strand FROM padded p JOIN fragments f ON p.chrom = f.chrom AND f."start" <= p.hi AND f."end" >= p.lo""", up="100", down="0"),
    "gene_activity": sql("counts cells peaks markers padded", """, o AS (SELECT p.gene AS marker, peak FROM padded p JOIN peaks k ON p.chrom = k.chrom AND k."start" <= p.hi AND k."end" >= p.lo), s AS (SELECT cell, marker, sum(v) AS s FROM counts JOIN o ON counts.gene = o.peak GROUP BY 1, 2) SELECT cells.cell, m.gene, round(log2(1 + coalesce(s, 0)), 6) AS activity FROM cells CROSS JOIN markers m LEFT JOIN s ON s.cell = cells.cell AND s.marker = m.gene""", up="50", down="0"),
    "region_scan": sql("fragments region", "SELECT * FROM region"),
    "region_string_scan": sql("fragments", """SELECT * FROM fragments WHERE chrom = 'A' AND "start" < 400 AND "end" > 300"""),
    "read_fragments": sql("fragments region", """SELECT *, ("end" - "start")::INTEGER AS len, (row_number() OVER (PARTITION BY chrom ORDER BY "start", "end", cell) - 1)::BIGINT AS row_num FROM region"""),
    "cumulative_length": sql("fragments region", """SELECT row_num, (sum(len) OVER (ORDER BY row_num))::BIGINT AS end_index FROM (SELECT "end" - "start" AS len, row_number() OVER (ORDER BY "start", "end", cell) - 1 AS row_num FROM region)"""),
    "count_fragments": sql("fragments fcount", "SELECT * FROM fcount"),
    "cluster_fragment_sum": sql("fragments cells fcount", "SELECT cluster, sum(fragments)::BIGINT AS fragments FROM fcount JOIN cells USING (cell) GROUP BY 1"),
    "closest_to_depth": sql("fragments cells fcount", "SELECT cluster, sum(fragments)::BIGINT AS fragments, abs(sum(fragments) - 6000)::BIGINT AS distance FROM fcount JOIN cells USING (cell) GROUP BY 1 ORDER BY 3, 1 LIMIT 2"),
    "coverage": sql("fragments cells region clustered cut depths", "SELECT * FROM depths"),
    "coverage_sweep": sql("fragments cells region clustered cut depths", "SELECT * FROM depths"),
    "coverage_dense": sql("fragments cells region clustered cut depths grid dense", "SELECT * FROM dense"),
    "tile_padded": sql("fragments cells region clustered cut depths grid dense", """, t AS (SELECT unnest(range(0, 7)) AS tile) SELECT cluster, tile::INTEGER AS tile, pos - 1100 - tile * 50 AS k, depth::DOUBLE AS value FROM t JOIN dense ON pos - 1100 - tile * 50 BETWEEN 0 AND 59""").replace("pos - 1100 - tile * 50 AS k", "(pos - 1100 - tile * 50)::INTEGER AS k"),
    "denoise_identity": sql("fragments cells region clustered cut depths grid dense", "SELECT cluster, (pos - 1100)::INTEGER AS k, depth::DOUBLE AS signal FROM dense WHERE pos < 1450"),
    "call_peaks": sql("fragments cells region clustered cut depths grid dense", "SELECT cluster, pos::INTEGER AS pos, 1.0::DOUBLE AS chance FROM dense WHERE pos < 1450 AND depth > 0"),
    "denoise_average": sql("fragments cells region clustered cut depths grid dense", """SELECT cluster, (pos - 1100)::INTEGER AS k, round(sum(depth) OVER (PARTITION BY cluster ORDER BY pos ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING) / 51.0::DOUBLE, 6) AS signal FROM dense WHERE pos < 1450"""),
    "peak_counts": sql("fragments peaks", """SELECT peak, count(DISTINCT cell) AS cells, count(*) AS fragments FROM peaks p JOIN fragments f ON p.chrom = f.chrom AND f."start" <= p."end" AND f."end" >= p."start" GROUP BY 1"""),
    "denoise_network": sql(
        "fragments cells region clustered cut depths grid dense",
        """, s AS (SELECT cluster, pos, sum(depth) OVER (PARTITION BY cluster ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) / 25.0::DOUBLE AS s FROM dense)
        SELECT cluster, pos, round(s, 6) AS signal, round(1 / (1 + exp(-least(30, greatest(-30, 8 * s - 4)))), 6) AS peak FROM s WHERE pos >= 1112 AND pos < 1412""",
    ),
    "connectivities": sql(
        "emb",
        """, near AS MATERIALIZED (SELECT src, list(dst ORDER BY dist, dst) AS dsts, list(dist ORDER BY dist, dst) AS ds FROM (@NEAR) WHERE rank <= 15 GROUP BY 1),
        start AS (SELECT src, list_transform(ds, lambda x: greatest(x - coalesce(list_min(list_filter(ds, lambda y: y > 0)), 0), 0)) AS ex, log2(greatest(2, len(ds))) AS target FROM near),
        steps(src, i, lo, hi, sigma) AS (
          SELECT src, 0, 0::DOUBLE, 'inf'::DOUBLE, 1::DOUBLE FROM start
          UNION ALL
          SELECT src, i + 1, nlo, nhi, CASE WHEN isfinite(nhi) THEN (nlo + nhi) / 2 ELSE sigma * 2 END FROM (
            SELECT src, i, sigma, CASE WHEN total > target THEN lo ELSE sigma END AS nlo, CASE WHEN total > target THEN sigma ELSE hi END AS nhi FROM (
              SELECT s.*, target, list_sum(list_transform(ex, lambda x: exp(-x / sigma))) AS total FROM steps s JOIN start USING (src)) WHERE i < 64 AND abs(total - target) >= 1e-6)),
        fit AS (SELECT src, greatest(arg_max(sigma, i), 1e-3 * any_value(list_avg(ds)), 1e-12) AS sigma FROM steps JOIN near USING (src) GROUP BY 1),
        w AS MATERIALIZED (SELECT src, unnest(dsts) AS dst, exp(-unnest(ex) / sigma) AS weight FROM near JOIN start USING (src) JOIN fit USING (src)),
        two AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, coalesce(max(weight) FILTER (WHERE src < dst), 0) AS a, coalesce(max(weight) FILTER (WHERE src > dst), 0) AS b FROM w GROUP BY 1, 2)
        SELECT u AS src, v AS dst, round(a + b - a * b, 6) AS weight FROM two""",
        near="SELECT a.cell AS src, b.cell AS dst, list_distance(a.vec, b.vec) AS dist, row_number() OVER (PARTITION BY a.cell ORDER BY list_distance(a.vec, b.vec), b.cell) AS rank FROM emb a JOIN emb b ON a.cell <> b.cell",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "pca_rotation": sql("emb", ", e AS (SELECT cell, unnest(vec) AS x, unnest(range(0, len(vec))) AS i FROM emb), m AS (SELECT i, avg(x) AS m FROM e GROUP BY 1) SELECT cell, round(sum((x - m) * (x - m)), 5) AS square FROM e JOIN m USING (i) GROUP BY 1"),
    "pca_variances": sql("emb", ", e AS (SELECT cell, unnest(vec) AS x, unnest(range(0, len(vec))) AS i FROM emb), v AS (SELECT i, var_samp(x) AS v FROM e GROUP BY 1) SELECT count(*)::BIGINT AS components, round(sum(v), 5) AS total, 0.0::DOUBLE AS covariances, true AS falling FROM v"),
    "scale_ddof1": sql(SCALED, SUMMARY, z="greatest(-10, least(10, (v - m) / CASE WHEN s1 > 1e-12 THEN s1 ELSE 1 END))"),
    "clip_only": sql(SCALED, SUMMARY, z="greatest(-20, least(20, v))"),
    "transposed": sql("counts", "SELECT gene AS cell, cell AS gene, v FROM counts"),
    "matrix_shape": sql("counts cells genes", "SELECT (SELECT count(*) FROM cells) AS cells, (SELECT count(*) FROM genes) AS genes, (SELECT count(*) FROM counts) AS entries"),
    "group_sizes": sql("cells", 'SELECT cluster AS "group", count(*) AS n FROM cells GROUP BY 1'),
    "matrix_written_and_read": sql("counts", "SELECT * FROM counts WHERE cell < 200"),
    "filtered_read": sql("counts deg fit_cells f1", "SELECT * FROM (SELECT cell, gene, ln(1 + v) AS w FROM f1) JOIN (SELECT gene FROM f1 GROUP BY 1 HAVING sum(ln(1 + v)) > 5) USING (gene)").replace("SELECT * FROM (SELECT cell", "SELECT cell, gene, round(w, 6) AS v FROM (SELECT cell"),
    "fragments_file": sql("fragments", 'SELECT chrom, "start", "end", cell::VARCHAR AS cell FROM fragments'),
    "dense_csv": "SELECT o_orderpriority AS barcode, o_custkey::VARCHAR AS name, sum(o_totalprice)::DOUBLE AS v FROM orders GROUP BY 1, 2 HAVING sum(o_totalprice) <> 0",
    "dense_unpivot": "SELECT o_custkey::VARCHAR AS \"row\", o_orderpriority AS \"column\", sum(o_totalprice) AS v FROM orders GROUP BY 1, 2 HAVING sum(o_totalprice) <> 0",
    "knn_exact": sql("emb", "SELECT src, dst, round(dist, 6) AS dist, rank FROM (SELECT a.cell AS src, b.cell AS dst, list_distance(a.vec, b.vec) AS dist, row_number() OVER (PARTITION BY a.cell ORDER BY list_distance(a.vec, b.vec), b.cell) AS rank FROM emb a JOIN emb b ON a.cell <> b.cell) WHERE rank <= 15"),
    "knn_descent": sql("emb", "SELECT count(DISTINCT cell) FILTER (WHERE cell % 50 = 0) AS asked, 15 * count(DISTINCT cell) FILTER (WHERE cell % 50 = 0) AS neighbours, true AS nearly_all FROM emb"),
    "pca_stored": sql(
        "counts cells genes",
        """, g AS (SELECT gene, sum(v) AS s, sum(v * v) AS q FROM counts GROUP BY 1), n AS (SELECT count(*) AS n FROM cells)
        SELECT any_value(n) AS cells, 20 AS components, round(sum(q - s * s / n), 2) AS squares, true AS apart, true AS lengths, true AS falling, true AS settled FROM g, n""",
    ),
    "leiden_quality": sql("emb", "SELECT count(*) AS cells, true AS connected, true AS settled, true AS modular FROM emb"),
    "tsne_quality": sql("emb", "SELECT count(*) AS cells, true AS whole, true AS nearer, true AS repulsion FROM emb"),
    "pca_covariance": sql("emb", ", e AS (SELECT cell, unnest(vec) AS x, unnest(range(0, len(vec))) AS i FROM emb) SELECT a.i::INTEGER AS i, b.i::INTEGER AS j, round(covar_samp(a.x, b.x), 6) AS cov FROM e a JOIN e b USING (cell) GROUP BY 1, 2"),
    "select_groups": sql("emb", "SELECT cluster AS \"group\", (row_number() OVER (ORDER BY cluster) - 1)::BIGINT AS ord FROM (SELECT DISTINCT cluster FROM emb)"),
    "dashboard_frame": sql("emb frame", "SELECT round(x, 6) AS x, round(y, 6) AS y, labels, round(mk, 6) AS mk, mk_labels, point_index, barcode FROM frame"),
    "violin_counts": sql("emb frame", "SELECT labels, round(mk, 1) AS value, count(*) AS n FROM frame GROUP BY 1, 2"),
    "scatter_series": sql("emb frame", "SELECT labels, point_index // 4096 AS part, count(*) AS n, round(sum(x), 5) AS sum_x, round(sum(y), 5) AS sum_y, min(point_index) AS first_point FROM frame GROUP BY 1, 2"),
    "label_toggle": sql("emb frame", "SELECT DISTINCT labels FROM frame WHERE (labels % 2 = 0) <> (labels < 5)"),
}
