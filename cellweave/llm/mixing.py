"""Temperature mixing of sources to target weights, laid out as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read_table

#: Entropy of the weights, as a share of the most that the number of sources allows.
ENTROPY = 0.97
#: No source is repeated more often.
REPEATS = 4.0
#: Tokens of the mixture, as a share of all tokens, and of each of its blocks.
BUDGET, BLOCK = 1.0, 1 << 18
SEED = 7
#: The exponent is bisected 40 times between 0 and STEEPEST, four steps to a job.
STEEPEST, ROUNDS, SECTIONS, DIGITS = 32.0, 10, 16, 9
#: About so many rows are put in order in one task.
BUCKET_ROWS = 1024


def word_count(text: Column) -> Column:
    """Runs of other characters than space and 0x09-0x0D; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def mixing_exponent(sources: DataFrame, budget: float, entropy: float | None, repeats: float | None, strict: bool = False) -> float:
    """The exponent of the token shares, between 0 and STEEPEST, whose weights have the entropy, or the nearest one that keeps to the repeats.

    `sources` has n, the tokens of each source. The weights' entropy falls as the exponent grows;
    repeats fall up to an exponent of 1, where all sources are repeated alike, and grow from there
    on. Without an entropy it is the least exponent that keeps to the repeats. Where the repeats,
    or shares that are all alike, leave the entropy out of reach, `strict` makes that an error.
    Each job sums the powers of the shares for SECTIONS - 1 exponents and gives the driver two
    numbers for each.
    """
    total, count, least, most = sources.agg(F.sum("n"), F.count("*"), F.min("n"), F.max("n")).first()
    if not count:
        return 1.0
    share = F.col("n") / F.lit(float(total))
    target = math.inf if entropy is None else entropy * math.log(count)

    def sums(grid: list[float]) -> list[tuple[float, float]]:
        got = sources.agg(*(F.sum(F.pow(share, F.lit(t))) for t in grid), *(F.sum(F.pow(share, F.lit(t)) * F.log(share)) for t in grid)).first()
        return list(zip(got[: len(grid)], got[len(grid) :], strict=True))

    def too_low(t: float, z: float, a: float) -> bool:
        flat = math.log(z) - t * a / z > target
        often = repeats is not None and budget / total * max((least / total) ** (t - 1), (most / total) ** (t - 1)) / z > repeats
        return flat or often if t < 1 else flat and not often

    lo, hi = 0.0, STEEPEST
    for _ in range(ROUNDS):
        grid = [lo + (hi - lo) * j / SECTIONS for j in range(1, SECTIONS)]
        k = sum(too_low(t, z, a) for t, (z, a) in zip(grid, sums(grid), strict=True))
        lo, hi = ([lo, *grid, hi][k : k + 2])
    found = round(hi, DIGITS)
    if strict and entropy is not None:
        [(z, a)] = sums([found])
        if abs(math.log(z) - found * a / z - target) > 1e-6 * max(1.0, math.log(count)):
            raise ValueError(f"an entropy of {entropy} can't be met with {repeats} repeats: {(math.log(z) - found * a / z) / max(math.log(count), 1e-12):.4f} is the nearest")
    return found


def mixture_plan(rows: DataFrame, entropy: float | None = ENTROPY, repeats: float | None = REPEATS, budget: float = BUDGET, block: int = BLOCK, seed: int = SEED, strict: bool = False) -> DataFrame:
    """Rows (doc_id, source, epoch, tokens, block, position): which document stands where in the mixture.

    `rows` has doc_id, source and tokens. A source's weight is a power of its share of all
    tokens, by `mixing_exponent`; its quota is that weight of the budget, rounded down. Its
    documents are permuted once for each epoch by a hash and taken, epoch after epoch, while they
    fit the quota. The quota's tokens are spread evenly over the mixture's blocks of about
    `block` tokens; within a block, position is a hash's order over all sources.

    A null source is the source "". Rows without tokens have no place. Null and repeated ids are
    documents like others, equal rows taking each other's places. A text of any length is one
    document of so many tokens, which is left out where it doesn't fit its quota. A budget beyond
    `repeats` times all tokens is lowered to that, and an entropy that the repeats leave out of
    reach is met as nearly as they allow; `strict` makes either an error. Other columns are not
    looked at. An empty table gives an empty result. A source of any size is
    put in order in buckets of about BUCKET_ROWS rows by its hash, whose sums give each its start.
    """
    sized = cut(rows.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "tokens").where("tokens > 0"))
    sources = cut(sized.groupBy("source").agg(F.sum("tokens").alias("n"), F.count("*").alias("docs")))
    total = sources.agg(F.sum("n")).first()[0] or 0
    wanted = math.floor(total * (budget if repeats is None else min(budget, repeats)))
    if strict and repeats is not None and budget > repeats:
        raise ValueError(f"a budget of {budget} needs more than {repeats} repeats")
    exponent = mixing_exponent(sources, wanted, entropy, repeats, strict)
    power = F.pow(F.col("n") / F.lit(float(max(total, 1))), F.lit(exponent))
    scale = sources.agg(F.sum(power)).first()[0] or 1.0
    blocks = max(1, math.ceil(wanted / block))
    quotas = sources.select(
        F.col("source").alias("s"),
        "n",
        F.floor(power / F.lit(scale) * F.lit(float(wanted))).cast("long").alias("quota"),
        F.greatest(F.lit(0), F.ceil(F.log2(F.col("docs") / BUCKET_ROWS))).cast("int").alias("bits"),
    ).where("quota > 0")

    name = lambda *more: F.md5(F.concat_ws("|", F.lit(str(seed)), *more, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("epoch").cast("string")))
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / F.col("n")).cast("long")))
    placed = sized.join(quotas, F.col("source") == F.col("s")).select("doc_id", "source", "tokens", "n", "quota", "bits", epochs.alias("epoch"))
    placed = placed.withColumn("key", name()).withColumn("bucket", F.expr("shiftright(cast(conv(substr(key, 1, 8), 16, 10) as bigint), 32 - bits)"))
    group = ["source", "epoch", "bucket"]
    sums = placed.groupBy(*group).agg(F.sum("tokens").alias("t"))
    before = Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*(F.col(c).alias(f"{c}_") for c in group), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy(*group).orderBy("key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = [F.col(c) == F.col(f"{c}_") for c in group]
    at = placed.join(starts, on).withColumn("at", F.col("epoch") * F.col("n") + F.col("start") + F.sum("tokens").over(within) - F.col("tokens"))
    chosen = at.where("at + tokens <= quota").select(
        "doc_id", "source", "epoch", "tokens", F.floor(F.col("at").cast("double") / F.col("quota") * F.lit(float(blocks))).cast("long").alias("block"), name(F.lit("block")).alias("mix")
    )
    order = Window.partitionBy("block").orderBy("mix", "doc_id", "tokens")
    return chosen.select("doc_id", "source", "epoch", "tokens", "block", F.row_number().over(order).cast("long").alias("position"))


def counted(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("tokens"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, most: int = 1_000_000) -> DataFrame:
    """The documents' columns with epoch, tokens, block and position, a row for each place in the mixture.

    Every row is a document of its own. One whose doc_id is null or repeated goes by a key of its
    id, source, a hash of its text and its rank among equal rows, the others by their id. Up to
    `most` repeated ids are broadcast; more are joined by a shuffle. A text of any length is one
    document of so many tokens. Columns named like the four added ones are replaced by these; any
    other name stays.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    rows = docs.select("doc_id", "source", "text", F.struct(F.lit(0).alias("_only"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(others))).alias("others"))
    source, text = F.coalesce("source", F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    again = cut(rows.where("doc_id is not null").groupBy(F.col("doc_id").alias("again_id")).count().where("count > 1").select("again_id"))
    side = F.broadcast(again) if again.count() <= most else again
    at = rows["doc_id"] == side["again_id"]
    id_key = F.col("doc_id").cast("string")
    own = rows.where("doc_id is not null").join(side, at, "left_anti").withColumn("key", id_key)
    shared = rows.where("doc_id is null").unionByName(rows.join(side, at, "left_semi"))
    print_of = F.concat_ws("|", F.coalesce(id_key, F.lit("")), source, F.md5(text))
    equal = Window.partitionBy("key").orderBy("others")
    shared = shared.withColumn("key", print_of).withColumn("key", F.concat_ws("|", "key", F.row_number().over(equal).cast("string")))
    keyed = own.unionByName(shared)
    plan = mixture_plan(keyed.select(F.col("key").alias("doc_id"), "source", word_count(F.col("text")).alias("tokens")))
    placed = keyed.join(plan.drop("source").withColumnRenamed("doc_id", "placed"), F.col("key") == F.col("placed"))
    added = ("epoch", "tokens", "block", "position")
    found = {c: F.col(c) for c in ("doc_id", "source", "text")} | {c: F.col("others")[f"c{k}"] for k, c in enumerate(others)}
    return placed.select(*(found[c].alias(c) for c in docs.columns if c not in added), *added)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_plan(counted(read_table(spark, sf_dir, "documents")))


OP5_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^ \\t-\\r]+', 'x', 'g'), '[ \\t-\\r]+', '', 'g'))::BIGINT AS tokens FROM documents),
sized AS MATERIALIZED (SELECT * FROM d WHERE tokens > 0),
src AS MATERIALIZED (SELECT source, sum(tokens)::BIGINT AS n, sum(tokens)::DOUBLE / (SELECT sum(tokens)::DOUBLE FROM sized) AS p FROM sized GROUP BY 1),
whole AS MATERIALIZED (SELECT sum(n)::BIGINT AS total, floor(sum(n)::DOUBLE * {min(BUDGET, REPEATS)}::DOUBLE)::BIGINT AS wanted, count(*) AS m, min(p) AS low, max(p) AS high FROM src),
halves(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, {STEEPEST}::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN flat THEN mid ELSE lo END, CASE WHEN flat THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, mid, CASE WHEN mid < 1 THEN flat OR often ELSE flat AND NOT often END AS flat FROM (
    SELECT i, lo, hi, mid, ln(z) - mid * a / z > {ENTROPY}::DOUBLE * ln(m::DOUBLE) AS flat, wanted::DOUBLE / total::DOUBLE * greatest(pow(low, mid - 1), pow(high, mid - 1)) / z > {REPEATS}::DOUBLE AS often FROM (
      SELECT i, lo, hi, (lo + hi) / 2 AS mid, any_value(total) AS total, any_value(wanted) AS wanted, any_value(m) AS m, any_value(low) AS low, any_value(high) AS high, sum(pow(p, (lo + hi) / 2)) AS z, sum(pow(p, (lo + hi) / 2) * ln(p)) AS a
      FROM halves, src, whole WHERE i < {int(math.log2(SECTIONS)) * ROUNDS} GROUP BY i, lo, hi)))),
e AS (SELECT round(hi, {DIGITS}) AS t FROM halves ORDER BY i DESC LIMIT 1),
q AS (SELECT source, n, floor(pow(p, t) / (SELECT sum(pow(p, t)) FROM src, e) * wanted::DOUBLE)::BIGINT AS quota FROM src, e, whole),
placed AS (
  SELECT doc_id, source, tokens, n, quota, unnest(range(0, (quota - 1) // n + 1)) AS epoch FROM sized JOIN q USING (source) WHERE quota > 0),
positions AS (
  SELECT *, epoch * n + sum(tokens) OVER (PARTITION BY source, epoch ORDER BY md5(concat('{SEED}|', doc_id, '|', epoch)), doc_id, tokens ROWS UNBOUNDED PRECEDING) - tokens AS pos FROM placed),
chosen AS (
  SELECT doc_id, source, epoch, tokens, floor(pos::DOUBLE / quota::DOUBLE * greatest(1, ceil(wanted::DOUBLE / {BLOCK}::DOUBLE)))::BIGINT AS block FROM positions, whole WHERE pos + tokens <= quota)
SELECT doc_id, source, epoch, tokens, block, row_number() OVER (PARTITION BY block ORDER BY md5(concat('{SEED}|block|', doc_id, '|', epoch)), doc_id, tokens)::BIGINT AS position FROM chosen
"""
