"""Shards of near equal bytes by a k-d tree over the documents' metadata."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.ordered import row_numbers, running_sums

from .common import cut, read_table

SHARDS = 8
#: Copies of one text stay together while they fill no more than 1 / WHOLE of a shard.
WHOLE = 2
#: Points above 1 / HEAVY of a shard are placed first, and the cut between the others makes up for them.
HEAVY = 64
#: Texts with more than 1 / SALTED of all rows are joined back in several parts.
SALTED = 2048


def name_code(name: Column) -> Column:
    """The first six bytes of a string as a number, which keeps the strings' order; 0 for a null."""
    head = F.hex(F.substring(F.encode(F.coalesce(name.cast("string"), F.lit("")), "UTF-8"), 1, 6))
    return F.conv(F.rpad(head, 12, "0"), 16, 10).cast("double")


def dealt(key: Column, parts: Column) -> Column:
    """A part that a hash of the key picks; a null key is the empty one."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % parts


def kd_tree(points: DataFrame, dims: list[str], shards: int) -> DataFrame:
    """Rows (grp, piece, shard): points (grp, piece, weight and the dimensions) in `shards` leaves of near equal weight.

    A node for c shards is cut along the dimension in which its points reach furthest, as a share
    of the reach of all points (the first of equal ones), at the weighted median; for an odd c the
    smaller half goes left. Points in one place go by grp and piece. A heavy point lies left if its
    middle does, and the cut between the others is moved by what the heavy ones are off; so the
    sides differ from their due by at most half of a light point's weight while there are enough of
    these. All nodes of a level are cut at once, by running sums over ranges of the order; what is
    broadcast is a row for each node, and the driver sees the reach and weight of all points.
    """
    stats = points.agg(F.sum("weight"), *(f(d) for d in dims for f in (F.min, F.max))).first()
    total = stats[0] or 0
    reach = {d: stats[2 + 2 * k] - stats[1 + 2 * k] if total else 0.0 for k, d in enumerate(dims)}
    heavy = F.col("weight") * HEAVY * shards > F.lit(total)
    nodes = points.withColumns({"low": F.lit(0), "wide": F.lit(shards)})
    done = None
    for _ in range(math.ceil(math.log2(shards))):
        share = lambda d: (F.max(d) - F.min(d)) / F.lit(reach[d] or 1.0)
        widest = F.array_max(F.array(*(F.struct(share(d).alias("share"), F.lit(-k).alias("dim")) for k, d in enumerate(dims))))["dim"]
        half = F.floor(F.first("wide") / 2).cast("int")
        cuts = nodes.groupBy("low").agg(widest.alias("dim"), half.alias("half"), (F.sum("weight") * half / F.first("wide")).alias("due"))
        at = F.coalesce(*(F.when(F.col("dim") == -k, F.col(d)) for k, d in enumerate(dims)))
        placed = nodes.join(F.broadcast(cuts), "low").withColumns({"at": at, "heavy": heavy})
        sums = {"before": F.col("weight"), "light": F.when(F.col("heavy"), 0).otherwise(F.col("weight"))}
        summed = cut(running_sums(placed, sums, ["at", "grp", "piece"], ("low",)))
        first = F.col("heavy") & (2 * F.col("before") - F.col("weight") <= 2 * F.col("due"))
        taken = summed.groupBy("low").agg(F.sum(F.when(first, F.col("weight")).otherwise(0)).alias("taken"))
        left = first | (~F.col("heavy") & (2 * F.col("light") - F.col("weight") <= 2 * (F.col("due") - F.col("taken"))))
        sides = summed.join(F.broadcast(taken), "low").withColumn("left", left)
        low = F.when(F.col("left"), F.col("low")).otherwise(F.col("low") + F.col("half"))
        wide = F.when(F.col("left"), F.col("half")).otherwise(F.col("wide") - F.col("half"))
        after = cut(sides.select("grp", "piece", "weight", *dims, low.alias("low"), wide.alias("wide")))
        leaves = after.where("wide = 1")
        done = leaves if done is None else done.unionByName(leaves)
        nodes = after.where("wide > 1")
    return (nodes if done is None else done).select("grp", "piece", F.col("low").alias("shard"))


def kd_shards(docs: DataFrame, dims: Mapping[str, Column], shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot): documents in shards of near equal bytes, by `kd_tree`.

    `docs` has doc_id and text, and `dims` names numbers made of its columns. size is the UTF-8
    bytes of the text and one; slot numbers a shard's rows without gaps, by doc_id. There are
    `shards` shards, or as many as hold `target_bytes` each.

    Equal texts are one point, at the place of the one with the least doc_id, and stay in one
    shard unless they fill more than half of it; then a hash of doc_id deals them to pieces of at
    most 1 / HEAVY of a shard, so that one text may be any part of the bytes. Sizes differ by
    single documents that are larger than such a piece, and where few texts fill a shard.

    A null text has no bytes and the CRC of none, and counts as the empty text. Null numbers are 0.
    Null ids come first. Repeated rows are rows of their own, in one shard and piece. An empty table
    gives an empty result. Columns of any other name are not looked at.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = [f"dim_{k}" for k in range(len(dims))]
    numbers = F.struct(*(F.coalesce(c.cast("double"), F.lit(0.0)).alias(d) for d, c in zip(names, dims.values(), strict=True)))
    rows = cut(docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.md5(body).alias("grp"), numbers.alias("place")))
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    shards = shards or max(1, math.ceil((total or 0) / target_bytes))
    groups = cut(rows.groupBy("grp").agg(F.sum("size").alias("weight"), F.count("*").alias("n"), F.min(F.struct("doc_id", "place"))["place"].alias("place")))
    large = F.col("weight") * WHOLE * shards > F.lit(total or 0)
    # At most WHOLE * shards texts are large and SALTED are frequent, whatever the corpus: safe to broadcast.
    split = groups.where(large | (F.col("n") * SALTED > count)).select(
        "grp",
        F.when(large, F.least("n", F.ceil(F.col("weight") * HEAVY * shards / F.lit(max(total or 0, 1))))).otherwise(1).cast("long").alias("pieces"),
        F.ceil(F.col("n") * SALTED / F.lit(max(count, 1))).cast("long").alias("salts"),
    )
    split = cut(split)
    parts = lambda df: df.join(F.broadcast(split), "grp", "left").na.fill(1, ["pieces", "salts"])
    own = cut(parts(rows).withColumns({"piece": dealt(F.col("doc_id"), F.col("pieces")), "salt": dealt(F.col("doc_id"), F.col("salts"))}).drop("place", "pieces", "salts"))
    pieces = own.join(F.broadcast(split.where("pieces > 1").select("grp")), "grp", "left_semi").groupBy("grp", "piece").agg(F.sum("size").alias("weight"))
    whole = groups.join(F.broadcast(split.where("pieces > 1").select("grp")), "grp", "left_anti").select("grp", F.lit(0).cast("long").alias("piece"), "weight", "place.*")
    points = cut(whole.unionByName(pieces.join(groups.select("grp", "place.*"), "grp")))
    leaves = parts(kd_tree(points, names, shards)).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    placed = own.join(leaves.select("grp", "piece", "salt", "shard"), ["grp", "piece", "salt"]).select("doc_id", "size", "text_crc32", "shard")
    return row_numbers(placed, ["doc_id", "text_crc32", "size"], "slot", ("shard",))


def metadata(docs: DataFrame) -> dict[str, Column]:
    """A document's place: source, language, bytes and number."""
    return {"source": name_code(F.col("source")), "lang": name_code(F.col("lang")), "bytes": F.octet_length("text"), "id": F.col("doc_id")}


def op13_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    made = kd_shards(docs, metadata(docs), SHARDS)
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_sql(shards: int, whole: int, heavy: int) -> str:
    """The same tree, level by level."""
    dims = "d0, d1, d2, d3"
    parts = []
    for k in range(int(math.log2(shards))):
        reach = [f"(max(d{j}) - min(d{j})) / any_value(CASE WHEN r{j} = 0 THEN 1 ELSE r{j} END)" for j in range(4)]
        widest = " ".join(f"WHEN {reach[j]} >= greatest({', '.join(reach)}) THEN {j}" for j in range(4))
        parts.append(f"""c{k} AS MATERIALIZED (SELECT low, any_value(wide) // 2 AS half, sum(weight) * (any_value(wide) // 2) / any_value(wide) AS due, CASE {widest} END AS dim FROM p{k}, whole GROUP BY low),
s{k} AS MATERIALIZED (
  SELECT *, sum(weight) OVER o AS before, sum(CASE WHEN heavy THEN 0 ELSE weight END) OVER o AS light FROM (
    SELECT *, CASE dim WHEN 0 THEN d0 WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS place, weight * {heavy * shards} > total AS heavy FROM p{k} JOIN c{k} USING (low), whole)
  WINDOW o AS (PARTITION BY low ORDER BY place, grp, piece ROWS UNBOUNDED PRECEDING)),
t{k} AS MATERIALIZED (SELECT low, sum(CASE WHEN heavy AND 2 * before - weight <= 2 * due THEN weight ELSE 0 END) AS taken FROM s{k} GROUP BY low),
p{k + 1} AS MATERIALIZED (
  SELECT grp, piece, weight, {dims}, CASE WHEN l THEN low ELSE low + half END AS low, CASE WHEN l THEN half ELSE wide - half END AS wide FROM (
    SELECT *, CASE WHEN heavy THEN 2 * before - weight <= 2 * due ELSE 2 * light - weight <= 2 * (due - taken) END AS l FROM s{k} JOIN t{k} USING (low))),""")
    code = lambda c: f"('0x' || rpad(left(hex(coalesce({c}, '')), 12), 12, '0'))::BIGINT::DOUBLE"
    return f"""
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab),
d AS MATERIALIZED (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, md5(coalesce(text, '')) AS grp, {code("source")} AS d0, {code("lang")} AS d1, coalesce(strlen(text), 0)::DOUBLE AS d2, coalesce(doc_id, 0)::DOUBLE AS d3,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS crc FROM documents, t),
whole AS MATERIALIZED (SELECT sum(size) AS total, {", ".join(f"max(d{j}) - min(d{j}) AS r{j}" for j in range(4))} FROM d),
g AS MATERIALIZED (
  SELECT *, CASE WHEN weight * {whole * shards} > total THEN least(n, ceil(weight * {heavy * shards} / total)) ELSE 1 END::BIGINT AS pieces FROM (
    SELECT grp, sum(size) AS weight, count(*) AS n, {", ".join(f"first(d{j} ORDER BY doc_id NULLS FIRST, d0, d1, d2, d3) AS d{j}" for j in range(4))} FROM d GROUP BY grp), whole),
own AS MATERIALIZED (SELECT doc_id, size, crc, grp, {", ".join(f"g.d{j}" for j in range(4))}, ('0x' || left(md5(coalesce(doc_id::VARCHAR, '')), 8))::BIGINT % pieces AS piece FROM d JOIN g USING (grp)),
p0 AS MATERIALIZED (SELECT grp, piece, sum(size) AS weight, {", ".join(f"any_value(d{j}) AS d{j}" for j in range(4))}, 0 AS low, {shards} AS wide FROM own GROUP BY grp, piece),
{chr(10).join(parts)}
placed AS (SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, low::INT AS shard FROM own JOIN p{int(math.log2(shards))} USING (grp, piece))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, NULL::INT AS grown_shard FROM placed
"""


OP13_SQL = op13_sql(SHARDS, WHOLE, HEAVY)
