"""All queries of the matrix and interval operators, by name, over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave import session
from cellweave.functions.columns import peak_name
from cellweave.functions.lineage import cut, scratch_folder
from cellweave.model import counts_view, dataset, embedding_view, fragments_view, marker_intervals, table
from cellweave.operators import community, coverage, descent, filters, graph, intervals, krylov, layout, normalize, reduce, variable
from cellweave.plans import pipelines
from cellweave.plans.sql import ORACLES
from cellweave.sources import files
from cellweave.sources.files import dense_to_long
from cellweave.streaming import batches

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}

MIN_GENES, MAX_GENES, TARGET = 20, 60, 1e4
MARKERS = ["red widget", "blue bolt", "hot gear"]
PREFIX = "red"
REGION = ("R", 1100, 1465)


def query(f: Query) -> Query:
    REGISTERED[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(REGISTERED)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def rounded(df: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def peaks_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as peaks: (peak, name) with a place that follows from the id."""
    key = F.col("p_partkey")
    start = (key * 37) % 2500
    return table(spark, sf_dir, "part").select(key.alias("peak"), peak_name(F.substring(F.lit("ANR"), (key % 3 + 1).cast("int"), F.lit(1)), start, start + 30).alias("name"))


def clustered_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = dataset(spark, sf_dir).cells.select("cell", "cluster")
    return intervals.region_scan(fragments_view(spark, sf_dir), *REGION).join(cells, "cell")


def region_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = coverage.dense_coverage(coverage.coverage_sweep(clustered_region(spark, sf_dir), *REGION[1:]), dataset(spark, sf_dir).cells, *REGION[1:])
    return coverage.tracks(dense)


def embedding_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = cut(embedding_view(spark, sf_dir))
    return vectors, cut(graph.connectivities(descent.knn_descent(vectors, 15)))


def vector_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dashboard frame over the vectors: their first two numbers as the place, the third as a marker."""
    v = embedding_view(spark, sf_dir)
    cells = v.select("cell", F.concat(F.lit("cell-"), F.col("cell").cast("string")).alias("barcode"))
    return session.dashboard_frame(cells, v.select("cell", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y")), v.select("cell", F.col("cluster").alias("community")), v.select("cell", F.greatest(F.col("vec")[2], F.lit(0.0)).alias("mk")))


@query
def filter_cells(spark, sf_dir):
    return filters.filter_cells(dataset(spark, sf_dir), MIN_GENES, MAX_GENES).counts


@query
def sparse_cells(spark, sf_dir):
    data = dataset(spark, sf_dir)
    return filters.kept_cells(data.cells, data.counts, 0, 30)


@query
def filter_genes_sum(spark, sf_dir):
    return filters.filter_genes(dataset(spark, sf_dir), 750, "sum").counts


@query
def filter_genes_nnz(spark, sf_dir):
    return filters.filter_genes(dataset(spark, sf_dir), 30, "entries").counts


@query
def filter_genes_strict(spark, sf_dir):
    return filters.filter_genes(dataset(spark, sf_dir), 750, "sum_strict").counts


@query
def first_n_cells(spark, sf_dir):
    return filters.first_cells(counts_view(spark, sf_dir), 100)


@query
def select_barcodes(spark, sf_dir):
    return filters.select_barcodes(dataset(spark, sf_dir), ["Customer#000000003", "Customer#000000007", "nobody"]).counts


@query
def reindex_genes(spark, sf_dir):
    return filters.reindex(filters.filter_cells(dataset(spark, sf_dir), MIN_GENES, MAX_GENES).counts.select("gene").distinct(), "gene")


@query
def unique_names(spark, sf_dir):
    return filters.unique_names(dataset(spark, sf_dir).genes)


@query
def normalize_total(spark, sf_dir):
    return rounded(normalize.normalize_total(counts_view(spark, sf_dir), TARGET), 6, "v")


@query
def log_normalize(spark, sf_dir):
    return rounded(normalize.log1p(normalize.normalize_total(counts_view(spark, sf_dir), TARGET)), 6, "v")


@query
def marker_expression(spark, sf_dir):
    data = dataset(spark, sf_dir)
    ids = {k.replace(" ", "_"): v for k, v in filters.marker_ids(data.genes, MARKERS).items()}
    found = filters.marker_expression(normalize.log1p(normalize.normalize_total(data.counts, TARGET)), data.cells, ids)
    return rounded(found, 6, *(f"{m}_raw" for m in ids))


@query
def gene_stats(spark, sf_dir):
    data = dataset(spark, sf_dir)
    return rounded(normalize.gene_moments(data.counts, data.cells.count()), 6, "mean", "mean_sq")


@query
def hvg(spark, sf_dir):
    kept = filters.filter_genes(filters.filter_cells(dataset(spark, sf_dir), MIN_GENES, MAX_GENES), 1, "sum")
    logged = cut(normalize.log1p(normalize.normalize_total(kept.counts, TARGET)))
    genes = cut(logged.select("gene").distinct())
    found = variable.highly_variable(logged, genes, logged.select("cell").distinct().count(), genes.count())
    return found.select("gene", F.col("bin").cast("long").alias("bin"), F.round("norm", 4).alias("norm"), "selected")


@query
def hvg_batches(spark, sf_dir):
    """`hvg` of entries that arrive in two batches, cells' entries in both; a batch is as many files as tasks may run."""
    path, files = new_path(spark), spark.sparkContext.defaultParallelism
    counts_view(spark, sf_dir).repartition(2 * files, F.xxhash64("cell", "gene")).write.parquet(path)
    found = batches.variable_genes(batches.preprocess_batches(spark, path, MIN_GENES, MAX_GENES, 1.0, TARGET, files))
    return found.select("gene", F.col("bin").cast("long").alias("bin"), F.round("norm", 4).alias("norm"), "selected")


@query
def preprocess_matrix(spark, sf_dir):
    data = dataset(spark, sf_dir)
    ready = pipelines.preprocess(data, MARKERS, MIN_GENES, MAX_GENES, 1, TARGET, gene_rule="sum")
    return rounded(ready.counts, 6, "v").select("cell", "gene", "v")


@query
def qc_prefix_fraction(spark, sf_dir):
    data = dataset(spark, sf_dir)
    return rounded(normalize.covariates(data.counts, data.cells, filters.with_prefix(data.genes, PREFIX)), 6, "percent")


@query
def regress_out(spark, sf_dir):
    data = dataset(spark, sf_dir)
    counts = cut(data.counts)
    covariates = cut(normalize.covariates(counts, data.cells, filters.with_prefix(data.genes, PREFIX)))
    fit = normalize.regression_coefficients(normalize.log1p(counts), data.genes, covariates)
    return fit.select("gene", F.round("b0", 5).alias("b0"), F.round("b1", 6).alias("b1"), F.round("b2", 5).alias("b2"), F.round(F.col("squares") - F.col("explained"), 4).alias("rest"))


@query
def regress_residuals(spark, sf_dir):
    """Sums of each cell's residuals over all genes."""
    data = dataset(spark, sf_dir)
    counts = cut(data.counts)
    covariates = cut(normalize.covariates(counts, data.cells, filters.with_prefix(data.genes, PREFIX)))
    return rounded(normalize.residual_sums(normalize.log1p(counts), data.genes, covariates), 3, "total", "squares")


def scaled(spark, sf_dir, **settings):
    """Each gene's least and largest scaled value over all cells, their sum and that of their squares."""
    data = dataset(spark, sf_dir)
    counts, n = cut(data.counts), data.cells.count()
    found = normalize.scaled_summary(*normalize.scale_stored(counts, data.genes, n, **settings), n)
    return found.select("gene", *((F.round(c, 5) + 0.0).alias(c) for c in ("low", "high", "total", "squares")))


@query
def scale_clip(spark, sf_dir):
    return scaled(spark, sf_dir, max_value=3.0)


@query
def scale_ddof1(spark, sf_dir):
    return scaled(spark, sf_dir, ddof=1)


@query
def clip_only(spark, sf_dir):
    return scaled(spark, sf_dir, max_value=20.0, zscore=False)


@query
def tf_idf(spark, sf_dir):
    data = dataset(spark, sf_dir)
    return rounded(normalize.tf_idf(data.counts, data.cells.count()), 6, "v")


@query
def log_tf_idf(spark, sf_dir):
    data = dataset(spark, sf_dir)
    return rounded(normalize.log_tf_idf(data.counts, data.cells.count(), 1e3), 5, "v")


@query
def top_peaks(spark, sf_dir):
    data = dataset(spark, sf_dir)
    return rounded(intervals.top_peaks(data.counts, data.cells.count(), 100), 6, "frequency")


@query
def parse_peaks(spark, sf_dir):
    return intervals.parse_peaks(peaks_view(spark, sf_dir))


@query
def interval_overlap(spark, sf_dir):
    found = intervals.overlap_join(marker_intervals(spark), fragments_view(spark, sf_dir), 100, 0, width=500)
    return found.select("gene", "chrom", "start", "end", "cell", "strand")


@query
def gene_activity(spark, sf_dir):
    data = dataset(spark, sf_dir)
    peaks = intervals.parse_peaks(peaks_view(spark, sf_dir))
    return rounded(intervals.gene_activity(data.counts, peaks, marker_intervals(spark), data.cells, 50, 0, width=500), 6, "activity")


@query
def region_scan(spark, sf_dir):
    return intervals.region_scan(fragments_view(spark, sf_dir), *REGION)


@query
def region_string_scan(spark, sf_dir):
    return intervals.region_string_scan(fragments_view(spark, sf_dir), "A:301-400")


@query
def read_fragments(spark, sf_dir):
    return intervals.fragment_table(intervals.region_scan(fragments_view(spark, sf_dir), *REGION))


@query
def cumulative_length(spark, sf_dir):
    rows = intervals.fragment_table(intervals.region_scan(fragments_view(spark, sf_dir), *REGION))
    return intervals.cumulative_length(rows).select("row_num", "end_index")


@query
def count_fragments(spark, sf_dir):
    return intervals.count_fragments(fragments_view(spark, sf_dir))


@query
def cluster_fragment_sum(spark, sf_dir):
    return coverage.cluster_fragment_sums(intervals.count_fragments(fragments_view(spark, sf_dir)), dataset(spark, sf_dir).cells)


@query
def closest_to_depth(spark, sf_dir):
    return coverage.closest_to(cluster_fragment_sum(spark, sf_dir), 6000, 2)


@query
def coverage_by_base(spark, sf_dir):
    return coverage.coverage(clustered_region(spark, sf_dir), *REGION[1:])


REGISTERED["coverage"] = REGISTERED.pop("coverage_by_base")


@query
def coverage_sweep(spark, sf_dir):
    return coverage.coverage_sweep(clustered_region(spark, sf_dir), *REGION[1:])


@query
def coverage_dense(spark, sf_dir):
    return coverage.dense_coverage(coverage.coverage_sweep(clustered_region(spark, sf_dir), *REGION[1:]), dataset(spark, sf_dir).cells, *REGION[1:])


@query
def tile_padded(spark, sf_dir):
    """Tiles of 50 bases with 5 more on each side."""
    found = coverage.tiles(region_tracks(spark, sf_dir), 50, 5)
    return found.select("cluster", "tile", F.posexplode("values").alias("k", "value"))


@query
def denoise_identity(spark, sf_dir):
    found = coverage.denoise(coverage.tiles(region_tracks(spark, sf_dir), 50), coverage.identity_model)
    return coverage.untile(found, value="signal").select("cluster", F.posexplode("track").alias("k", "signal"))


@query
def call_peaks(spark, sf_dir):
    found = coverage.denoise(coverage.tiles(region_tracks(spark, sf_dir), 50), coverage.identity_model)
    return coverage.call_peaks(coverage.untile(found, value="peak"), REGION[1])


@query
def denoise_average(spark, sf_dir):
    found = coverage.denoise(coverage.tiles(region_tracks(spark, sf_dir), 350), coverage.moving_average_model(51))
    return rounded(coverage.untile(found, value="signal").select("cluster", F.posexplode("track").alias("k", "signal")), 6, "signal")


@query
def peak_counts(spark, sf_dir):
    """All peaks against all fragments: of how many cells, and how many fragments of theirs, each peak is touched."""
    peaks = intervals.parse_peaks(peaks_view(spark, sf_dir)).select("peak", "chrom", "start", "end")
    return intervals.peak_totals(peaks, fragments_view(spark, sf_dir))


@query
def denoise_network(spark, sf_dir):
    """A network read from a table, over tiles of 50 bases with 12 more on each side: two averages of five, the second of each fifth base."""
    five, path = np.ones((1, 1, 5)) / 5, new_path(spark)
    out = coverage.Layer(np.array([[[1.0]], [[8.0]]]), np.array([0.0, -4.0]), positive=False)
    coverage.write_network(spark, [coverage.Layer(five, np.zeros(1)), coverage.Layer(five, np.zeros(1), dilation=5), out], path)
    model = coverage.network_model(coverage.read_network(spark, path))
    dense = coverage.dense_coverage(coverage.coverage_sweep(clustered_region(spark, sf_dir), *REGION[1:]), dataset(spark, sf_dir).cells, *REGION[1:])
    found = coverage.denoise(coverage.keyed_tiles(dense, *REGION[1:], 50, 12), model)
    return rounded(coverage.tile_positions(found, REGION[1], 50, 12, "signal", "peak"), 6, "signal", "peak")


@query
def pca_rotation(spark, sf_dir):
    """All components turn the centred vectors and leave their lengths: the sums of squares of each cell's scores."""
    vectors = cut(embedding_view(spark, sf_dir))
    scores = reduce.pca(vectors, len(vectors.first()["vec"]))
    return rounded(scores.select("cell", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x).alias("square")), 5, "square")


@query
def pca_variances(spark, sf_dir):
    """All components' scores have the vectors' variance in all, none in common, and less from one to the next."""
    vectors = cut(embedding_view(spark, sf_dir))
    found = cut(reduce.covariance(reduce.pca(vectors, len(vectors.first()["vec"]))))
    own = F.when(F.col("i") == F.col("j"), F.col("cov"))
    summed = found.agg(F.count(own).alias("components"), F.round(F.sum(own), 5).alias("total"), F.round(F.max(F.when(F.col("i") != F.col("j"), F.abs("cov"))), 6).alias("covariances"), F.array_sort(F.collect_list(F.when(F.col("i") == F.col("j"), F.struct("i", "cov")))).alias("a"))
    ordered = F.transform("a", lambda x: x["cov"])
    return summed.select("components", "total", "covariances", (ordered == F.reverse(F.array_sort(ordered))).alias("falling"))


@query
def transposed(spark, sf_dir):
    return filters.transpose(counts_view(spark, sf_dir))


@query
def matrix_shape(spark, sf_dir):
    data = dataset(spark, sf_dir)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(data.cells, "cells").crossJoin(count(data.genes, "genes")).crossJoin(count(data.counts, "entries"))


@query
def group_sizes(spark, sf_dir):
    return dataset(spark, sf_dir).cells.groupBy(F.col("cluster").alias("group")).agg(F.count("*").alias("n"))


def new_path(spark) -> str:
    return f"{scratch_folder(spark)}/query-{uuid.uuid4().hex}"


@query
def matrix_written_and_read(spark, sf_dir):
    path = new_path(spark)
    files.write_matrix(dataset(spark, sf_dir), path)
    return files.read_matrix(spark, path, 200).counts


@query
def filtered_read(spark, sf_dir):
    path = new_path(spark)
    files.write_matrix(dataset(spark, sf_dir), path)
    return rounded(files.read_with_filter(spark, path, MIN_GENES, MAX_GENES, 5, post_processor=normalize.log1p).counts.select("cell", "gene", "v"), 6, "v")


@query
def fragments_file(spark, sf_dir):
    """All fragments through a gzipped file of tab-separated values and back."""
    path = new_path(spark)
    rows = fragments_view(spark, sf_dir).select("chrom", "start", "end", F.col("cell").cast("string"), F.lit(1).alias("duplicate"))
    rows.write.option("sep", "\t").option("compression", "gzip").csv(path)
    return files.read_fragments_file(spark, path).drop("duplicate")


@query
def dense_csv(spark, sf_dir):
    """A dense table through CSV, a row a gene and a column a cell, and from there into a matrix with its names."""
    orders, path = table(spark, sf_dir, "orders"), new_path(spark)
    kinds = [r[0] for r in orders.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]
    orders.groupBy("o_custkey").pivot("o_orderpriority", kinds).agg(F.sum("o_totalprice")).na.fill(0.0).write.option("header", True).csv(path)
    data = files.read_matrix(spark, files.convert_dense_csv(spark, path, f"{path}-matrix"))
    return data.counts.join(data.cells, "cell").join(data.genes, "gene").select("barcode", "name", "v")


@query
def dense_unpivot(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    kinds = [r[0] for r in orders.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]
    dense = orders.groupBy("o_custkey").pivot("o_orderpriority", kinds).agg(F.sum("o_totalprice")).na.fill(0.0)
    return dense_to_long(dense, "o_custkey")


@query
def knn_exact(spark, sf_dir):
    return rounded(graph.knn(embedding_view(spark, sf_dir), 15), 6, "dist")


@query
def knn_approximate(spark, sf_dir):
    return rounded(graph.knn_approximate(cut(embedding_view(spark, sf_dir)), 15), 6, "dist")


@query
def knn_descent(spark, sf_dir):
    """The neighbours found for each 50th vector, against all others: how many they are, and whether 95 % were found."""
    vectors, k = cut(embedding_view(spark, sf_dir)), 15
    asked = F.col("src") % 50 == 0
    want = graph.knn_of(vectors.where("cell % 50 = 0"), vectors, k)
    found = descent.knn_descent(vectors, k).where(asked).select("src", "dst", F.lit(1).alias("hit"))
    both = want.join(found, ["src", "dst"], "left")
    return both.agg(F.countDistinct("src").alias("asked"), F.count("*").alias("neighbours"), (F.sum("hit") >= 0.95 * F.count("*")).alias("nearly_all"))


@query
def connectivities(spark, sf_dir):
    return rounded(graph.connectivities(graph.knn(embedding_view(spark, sf_dir), 15)), 6, "weight")


@query
def pca_covariance(spark, sf_dir):
    return rounded(reduce.covariance(embedding_view(spark, sf_dir)), 6, "cov")


@query
def pca_scores(spark, sf_dir):
    return reduce.pca(cut(embedding_view(spark, sf_dir)), 20)


@query
def pca_on_first(spark, sf_dir):
    return reduce.pca_on_first(cut(embedding_view(spark, sf_dir)), 20, 0.35)


@query
def leading_components(spark, sf_dir):
    return reduce.leading(pca_scores(spark, sf_dir), 10)


@query
def kmeans(spark, sf_dir):
    return reduce.kmeans(embedding_view(spark, sf_dir), 10)


@query
def pca_stored(spark, sf_dir):
    """Leading components of the counts from their stored entries, by what all of them have in common.

    The singular values fall and explain no more than all the matrix' squares, which SQL sums; the scores are
    centred, orthogonal, and as long as the singular values; A'A turns no component by more than a ten thousandth.
    """
    data, k = dataset(spark, sf_dir), 20
    found, rows = krylov.fit(data.counts, data.cells, data.genes, k)
    scores = cut(krylov.scores(found, rows, data.cells))
    at = lambda i: F.col("vec")[i]
    sums = scores.agg(F.count("*").alias("cells"), *(F.sum(at(i)).alias(f"s{i}") for i in range(k)), *(F.sum(at(i) * at(j)).alias(f"p{i}_{j}") for i in range(k) for j in range(i + 1))).first()
    own = [sums[f"p{i}_{i}"] for i in range(k)]
    near = lambda x, scale: abs(x) <= 1e-6 * scale
    apart = all(near(sums[f"p{i}_{j}"], own[0]) for i in range(k) for j in range(i)) and all(near(sums[f"s{i}"], own[0] ** 0.5 * sums["cells"] ** 0.5) for i in range(k))
    lengths = all(near(own[i] - found.singular[i] ** 2, own[0]) for i in range(k))
    falling = all(own[i] >= own[i + 1] for i in range(k - 1)) and sum(own) <= found.squares
    return spark.createDataFrame([(sums["cells"], k, round(found.squares, 2), apart, lengths, falling, found.error <= 1e-4)], "cells long, components int, squares double, apart boolean, lengths boolean, falling boolean, settled boolean")


@query
def select_groups(spark, sf_dir):
    return reduce.select_groups(embedding_view(spark, sf_dir).select("cell", F.col("cluster").alias("group")))


@query
def rank_groups_logreg(spark, sf_dir):
    v = embedding_view(spark, sf_dir)
    return reduce.rank_features(v.select("cell", "vec"), v.select("cell", F.col("cluster").alias("group")), n_features=20)


@query
def louvain(spark, sf_dir):
    vectors, edges = embedding_graph(spark, sf_dir)
    return community.louvain(edges, vectors)


@query
def leiden(spark, sf_dir):
    vectors, edges = embedding_graph(spark, sf_dir)
    return community.leiden(edges, vectors)


@query
def leiden_quality(spark, sf_dir):
    """Whether every community is connected, and no two of them would gain in modularity by merging."""
    vectors, edges = embedding_graph(spark, sf_dir)
    plain = cut(edges.select("src", "dst", F.lit(1.0).alias("weight")))
    labels = cut(community.leiden(edges, vectors).select(F.col("cell").alias("id"), F.col("community").cast("long").alias("c")))
    parts = community.split_disconnected(plain, labels).select("c").distinct().count()
    arcs = cut(community.contract(community.both_ways(plain), labels))
    total = arcs.agg(F.sum("weight")).first()[0]
    degree = arcs.groupBy("src").agg(F.sum("weight").alias("k"))
    between = arcs.where("src < dst").join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("k").alias("l")), "dst")
    gain = between.agg(F.max(F.col("weight") - F.col("k") * F.col("l") / total)).first()[0] or 0.0
    found = labels.agg(F.count("*").alias("cells"), F.countDistinct("c").alias("n"))
    return found.select("cells", (F.col("n") == parts).alias("connected"), (F.lit(gain) <= 1e-6).alias("settled"), F.lit(community.modularity(plain, labels) > 0).alias("modular"))


@query
def umap(spark, sf_dir):
    vectors, edges = embedding_graph(spark, sf_dir)
    return layout.umap(edges, layout.initial_positions(reduce.pca(vectors, 2)))


@query
def tsne(spark, sf_dir):
    vectors = cut(embedding_view(spark, sf_dir))
    near = cut(descent.knn_descent(vectors, 45))
    return layout.tsne(layout.affinities(near, 15), layout.initial_positions(reduce.pca(vectors, 2)))


@query
def tsne_quality(spark, sf_dir):
    """Whether the layout's divergence from the joint chances is below its start's, and its repulsion within 5 % of all pairs'."""
    vectors = cut(embedding_view(spark, sf_dir))
    joint = cut(layout.affinities(cut(descent.knn_descent(vectors, 45)), 15))
    start = cut(layout.initial_positions(reduce.pca(vectors, 2)))
    made = layout.tsne(joint, start)
    sums = layout.layout_sums(made)
    before, after = layout.divergence(joint, start), layout.divergence(joint, made, sums)
    return made.agg(F.count("*").alias("cells"), (F.count_if(F.isnan("x") | F.isnan("y")) == 0).alias("whole")).withColumns({"nearer": F.lit(after < before), "repulsion": F.lit(layout.repulsion_error(made, sums) < 0.05)})


@query
def recluster_subset(spark, sf_dir):
    """Components, graph and communities anew of the vectors whose first number is positive."""
    v = cut(embedding_view(spark, sf_dir))
    found = pipelines.recluster(v.select("cell", "vec"), v.where(F.col("vec")[0] > 0), n_pcs=20)
    return found["leiden"]


@query
def dashboard_frame(spark, sf_dir):
    return rounded(vector_frame(spark, sf_dir), 6, "x", "y", "mk")


@query
def violin_counts(spark, sf_dir):
    return session.violin_counts(vector_frame(spark, sf_dir), "mk")


@query
def scatter_series(spark, sf_dir):
    add = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, b: a + b), 5)
    found = session.scatter_series(vector_frame(spark, sf_dir))
    return found.select("labels", "part", "n", add("x").alias("sum_x"), add("y").alias("sum_y"), F.col("point_index")[0].alias("first_point"))


@query
def label_toggle(spark, sf_dir):
    labels = vector_frame(spark, sf_dir).select("labels")
    return session.toggle_rows(labels.where("labels % 2 = 0"), labels.where("labels < 5"))
