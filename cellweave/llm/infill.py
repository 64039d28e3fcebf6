"""Fill-in-the-middle rewriting by one match of a regex whose counted quantifiers each row fills in itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: White space and the word after it, or white space at the end. Nothing in it can give back what it took.
UNIT = r"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)"
#: Percent of the texts that are rewritten, and of these with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
SEED = 42
#: What a rewritten text is matched by, and its groups in the text's own order.
REBUILD = {"psm": (rf"(?s)\A{PREFIX}(.*){SUFFIX}(.*){MIDDLE}(.*)\z", "$1$3$2"), "spm": (rf"(?s)\A{SUFFIX}(.*){PREFIX}(.*){MIDDLE}(.*)\z", "$2$3$1")}


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of the seed, a colon and the key; a null key is the empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def restore(output: Column, form: Column) -> Column:
    """The text that a rewritten `output` of the given form was made of."""
    back = lambda name: F.regexp_replace(output, *map(F.lit, REBUILD[name]))
    return F.when(form == "psm", back("psm")).when(form == "spm", back("spm")).otherwise(output)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """Rows (key, text, n, form, output): each text with a middle part moved to its end, or as it is.

    A text has n units, words with the white space before them. Two of four numbers drawn from the
    key say after how many units prefix and middle end; the third whether the text is rewritten, the
    fourth which form: psm is prefix, suffix, middle behind their marks, spm has the suffix first.
    One match of a pattern made for the row, `(unit{a}+)(unit{b-a}+)(rest)`, finds all three. The
    counted groups are possessive: Java then matches them in a loop, without a stack frame for each
    unit, so a text may be of any length.

    A null text is empty; an empty one, and one that holds a mark, stays plain, as does a text of
    white space only where the draw says so (it has one unit). A null key draws like an empty one.
    Equal keys cut at the same units. Rows are independent, so repeated rows give repeated rows, an
    empty table an empty one, and columns of any other name are not looked at.
    """
    h1, h2, h3, h4 = draws(F.col(key), seed)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    marked = F.contains(body, F.lit(PREFIX)) | F.contains(body, F.lit(SUFFIX)) | F.contains(body, F.lit(MIDDLE))
    plain = (body == "") | marked | (h3 % 100 >= rate)
    rows = docs.select(F.col(key), body.alias("text"), F.regexp_count(body, F.lit(UNIT)).cast("long").alias("n"), F.when(plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm").alias("form"))
    at = [h % (F.col("n") + 1) for h in (h1, h2)]
    counted = lambda units: F.concat(F.lit(f"({UNIT}{{"), units.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"(?s)\A"), counted(F.least(*at)), counted(F.greatest(*at) - F.least(*at)), F.lit(r"(.*+)\z"))
    order = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    return rows.withColumn("output", F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order)))


def part_sizes(rows: DataFrame) -> DataFrame:
    """`rows` of fill_in_middle with prefix_chars and middle_chars, read off the marks in the output; null where plain."""
    place = lambda mark: F.locate(mark, F.col("output"))
    prefix = F.when(F.col("form") == "psm", place(SUFFIX) - len(PREFIX) - 1).when(F.col("form") == "spm", place(MIDDLE) - place(PREFIX) - len(PREFIX))
    middle = F.when(F.col("form") != "plain", F.length("output") - place(MIDDLE) - len(MIDDLE) + 1)
    return rows.withColumns({"prefix_chars": prefix.cast("long"), "middle_chars": middle.cast("long")})


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = part_sizes(fill_in_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS g FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    ('0x' || substr(g, 1, 8))::BIGINT AS h1, ('0x' || substr(g, 9, 8))::BIGINT AS h2, ('0x' || substr(g, 17, 8))::BIGINT AS h3, ('0x' || substr(g, 25, 8))::BIGINT AS h4 FROM d),
c AS (
  SELECT doc_id, t, units, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""
