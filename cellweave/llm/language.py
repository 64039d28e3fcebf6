"""Language identification by Bayesian fusion of the text with what markup, address and host say."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table, small_batches, without_ids
from .words import pieces, text_buffer

#: Buckets of letter trigrams.
BITS = 16
#: A text's log likelihood counts as that of so many trigrams at most, since trigrams aren't independent.
EFFECTIVE = 64.0
#: Share of a language's trigrams that is spread evenly, so that unseen ones are possible.
SPREAD = 0.02
#: Prior of no known language, under which all trigrams are alike.
UNDETERMINED, PRIOR_UNDETERMINED = "und", 0.01
#: Pseudo-counts of the parent level in a host's, domain's or suffix's prior, and of a declaration's reliability.
PARENT_WEIGHT, DECLARED_WEIGHT, DECLARED_RIGHT = 8.0, 20.0, 0.7
#: Least posterior of the accepted languages together.
ACCEPT = 0.6

#: Bytes of text whose trigrams are held at once, some 60 bytes for each.
PIECE = 1 << 20

LETTER = np.zeros(256, bool)
LETTER[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams around each letter of lower-case texts, and their rows; all else is one separator."""
    body, offsets = text_buffer(column)
    b = np.where(LETTER[body], body, 0x20).astype(np.uint32)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    middle = np.flatnonzero(b != 0x20)
    left, right = np.maximum(middle - 1, 0), np.minimum(middle + 1, max(0, len(b) - 1))
    before = np.where((middle > 0) & (row[left] == row[middle]), b[left], 0x20)
    after = np.where((right > middle) & (row[right] == row[middle]), b[right], 0x20)
    code = (before << 16 | b[middle] << 8 | after).astype(np.uint32) * np.uint32(2654435769)
    return (code >> np.uint32(32 - BITS)).astype(np.int32), row[middle]


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages of `labelled` (text, lang) and their log trigram shares, a row each; the last row is for no language.

    Counts are over all rows; each task adds up its own, so at most 2**BITS counts a language are
    shuffled by a task or reach the driver. A label is two or three letters, with or without more
    after a dash (zh-cn is zh); other labels are left out.
    """
    label = F.regexp_extract(F.lower("lang"), "^([a-z]{2,3})([-_].*)?$", 1)
    named = labelled.where(label != "").select(F.lower(F.col("text").cast("string")).alias("t"), label.alias("lang"))
    languages = sorted(r.lang for r in named.select("lang").distinct().collect())
    index = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(index) << BITS, np.int64)
        for batch in (p for b in batches for p in pieces(b, 0, PIECE)):
            bucket, row = trigrams(batch.column(0))
            which = np.array([index[x] for x in batch.column(1).to_pylist()], np.int64)
            n += np.bincount((which[row] << BITS) + bucket, minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["at", "n"])

    counts = np.zeros(len(index) << BITS)
    if languages:
        got = named.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
        counts[got["at"].to_numpy()] = got["n"].to_numpy()
    counts = counts.reshape(len(index), 1 << BITS)
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1) * (1 - SPREAD) + SPREAD / (1 << BITS)
    return languages, np.log(np.vstack([share, np.full((1, 1 << BITS), 1 / (1 << BITS))]))


def text_evidence(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """`rows` (id columns, then text last) with the text replaced by n_grams and evidence, a log likelihood for each language."""
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.T))
    keep, text = rows.columns[:-1], rows.columns[-1]
    names = [*keep, "n_grams", "evidence"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b, len(keep), PIECE)):
            bucket, row = trigrams(batch.column(len(keep)))
            n = np.bincount(row, minlength=batch.num_rows)
            each = [np.bincount(row, weights=shared.value[:, k][bucket], minlength=batch.num_rows) for k in range(shared.value.shape[1])]
            mean = np.stack(each, axis=1) / np.maximum(n, 1)[:, None] if each else np.zeros((batch.num_rows, 0))
            evidence = mean * (n * EFFECTIVE / (n + EFFECTIVE))[:, None]
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * evidence.shape[1]), pa.array(evidence.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(n, pa.int64()), values], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1].fields)
    lower = rows.withColumn(text, F.lower(F.col(text).cast("string")))
    return lower.mapInArrow(score, f"{fields}, n_grams long, evidence array<double>")


def normalised(values: Column) -> Column:
    return F.transform(values, lambda v: v / F.aggregate(values, F.lit(0.0), lambda a, b: a + b))


def posterior(df: DataFrame, evidence: str, name: str) -> DataFrame:
    """`df` with the probabilities that an array of log evidence stands for."""
    weights = F.transform(evidence, lambda e: F.exp(e - F.array_max(evidence)))
    return df.withColumn("_weights", weights).withColumn(name, normalised(F.col("_weights"))).drop("_weights")


def constants(values) -> Column:
    return F.array(*(F.lit(v if isinstance(v, str) else float(v)) for v in values))


def identify(rows: DataFrame, languages: list[str], model: np.ndarray, accepted: list[str] | None = None) -> DataFrame:
    """`rows` without their text, with lang, posterior, n_grams and rejected.

    `rows` has any id columns, then declared (the markup's language), host, and text last. The
    posterior of a language combines the text's likelihood, the likelihood of the declaration and
    of the address suffix, and the host's prior. Those three come from grouped sums over all rows
    of what the text alone says; a host's prior leans on its domain's, that on the prior over all
    rows, the more the fewer rows there are, and leaves out the row itself. Null or unknown
    declarations and hosts add nothing. A row is rejected if the `accepted` languages (all known
    ones by default) have less than ACCEPT of the posterior together; so a text in two of them
    stays. A text without letters, a null one too, is `und` and rejected. Repeated rows stay; an
    empty table gives an empty result.
    """
    small_batches(rows.sparkSession)
    classes = [*languages, UNDETERMINED]
    L = len(classes)
    keep = [c for c in rows.columns if c not in ("declared", "host", "text")]
    host = F.lower(F.regexp_replace("host", r"^www\.|\.$", ""))
    declared = F.lower("declared")
    prepared = rows.select(
        *keep,
        F.when(declared.isin(languages), declared).when(declared.isNotNull(), "other").alias("declared"),
        host.alias("host"),
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"),
        F.regexp_extract(host, r"\.([a-z]{2,24})$", 1).alias("suffix"),
        "text",
    )
    prior = np.log([*[(1 - PRIOR_UNDETERMINED) / max(1, L - 1)] * (L - 1), PRIOR_UNDETERMINED])
    start = text_evidence(prepared, model).withColumn("start", F.zip_with("evidence", constants(prior), lambda e, p: e + p))
    zeros = constants([0.0] * L)
    scored = cut(posterior(start, "start", "says").withColumn("says", F.when(F.col("n_grams") > 0, F.col("says")).otherwise(zeros)).drop("start"))
    sums = [F.sum(F.col("says")[k]).alias(f"n{k}") for k in range(L)]

    def level(key: str) -> DataFrame:
        counted = scored.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(*sums)
        return counted.select(F.col(key).alias(f"{key}_key"), F.array(*(f"n{k}" for k in range(L))).alias(f"{key}_n"))

    everything = scored.agg(*sums).first()
    overall = np.array([everything[k] or 0.0 for k in range(L)])
    root = (overall + 1) / (overall + 1).sum()
    joined = scored
    for key in ("declared", "suffix", "domain", "host"):
        joined = joined.join(level(key), F.col(key) == F.col(f"{key}_key"), "left")

    def leaning(df: DataFrame, name: str, counts: str, parent: Column) -> DataFrame:
        """A level's prior from its counts without the row's own, and its parent's prior."""
        own = F.when(F.col(counts).isNotNull(), F.zip_with(counts, "says", lambda n, less: F.greatest(n - less, F.lit(0.0)))).otherwise(zeros)
        return df.withColumn("_sum", F.zip_with(own, parent, lambda n, p: n + PARENT_WEIGHT * p)).withColumn(name, normalised(F.col("_sum"))).drop("_sum")

    joined = leaning(joined, "domain_prior", "domain_n", constants(root))
    joined = leaning(joined, "host_prior", "host_n", F.col("domain_prior"))
    names, total = constants(classes), constants(overall)
    right = lambda k: F.when(k == L - 1, 1.0 / L).when(F.get(names, k) == F.col("declared"), DECLARED_RIGHT).otherwise((1 - DECLARED_RIGHT) / max(1, L - 1))
    by_markup = F.transform(F.coalesce("declared_n", zeros), lambda n, k: F.log((n + DECLARED_WEIGHT * right(k)) / (F.get(total, k) + DECLARED_WEIGHT)))
    by_suffix = F.transform("suffix_n", lambda n, k: F.log((n + PARENT_WEIGHT * F.get(constants(root), k)) / (F.get(total, k) + PARENT_WEIGHT)))
    add = lambda x, y: F.zip_with(x, y, lambda a, b: a + b)
    fused = add("evidence", F.transform("host_prior", lambda p: F.log(p)))
    fused = add(fused, F.when(F.col("declared").isNotNull(), by_markup).otherwise(zeros))
    fused = add(fused, F.coalesce(by_suffix, zeros))
    final = posterior(joined.withColumn("fused", fused), "fused", "p").withColumn("top", F.array_max("p"))
    best = F.element_at(names, F.array_position("p", F.col("top")).cast("int"))
    wanted = [float(c in (languages if accepted is None else accepted)) for c in classes]
    share = F.aggregate(F.zip_with("p", constants(wanted), lambda p, w: p * w), F.lit(0.0), lambda a, b: a + b)
    spoken = F.col("n_grams") > 0
    return final.select(*keep, F.when(spoken, best).otherwise(UNDETERMINED).alias("lang"), F.when(spoken, F.col("top")).otherwise(0.0).alias("posterior"), "n_grams", (~spoken | (share < ACCEPT)).alias("rejected"))


def model_of(documents: DataFrame) -> tuple[list[str], np.ndarray]:
    """Trigram shares learnt from the labelled documents whose crc32(doc_id as text) mod 5 is not 0."""
    small_batches(documents.sparkSession)
    return train(documents.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select("text", "lang"))


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents have no markup, and their source stands for the host."""
    return docs.select("doc_id", F.lit(None).cast("string").alias("declared"), F.col("source").alias("host"), "text")


def page_rows(pages: DataFrame) -> DataFrame:
    tags = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>"
    marked = F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1)
    return pages.select(
        "page_id",
        F.when(marked != "", marked).alias("declared"),
        F.when(F.col("url").isNotNull(), F.regexp_extract("url", r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)).alias("host"),
        F.regexp_replace("html", tags, " ").alias("text"),
    )


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out the documents that are rejected; rows without a doc_id stay."""
    languages, model = model_of(docs)
    # Cut first: a filter on the decision would be pushed below all that leads to it, and repeat it.
    found = cut(identify(document_rows(docs), languages, model).select("doc_id", "rejected"))
    return without_ids(docs, found.where("rejected"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents (doc_id set) and all pages (page_id set), by the model of the labelled documents."""
    documents = read_table(spark, sf_dir, "documents")
    languages, model = model_of(documents)
    no_id = F.lit(None).cast("long")
    both = document_rows(documents).select("doc_id", no_id.alias("page_id"), "declared", "host", "text").union(
        page_rows(read_table(spark, sf_dir, "pages")).select(no_id, "page_id", "declared", "host", "text")
    )
    return identify(both, languages, model)
