"""The corpus operators' queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op9_decontamination
from .embeddings import OP3_SQL, op3_embedding_dedup
from .infill import OP12_SQL, op12_fill_in_middle
from .language import op1_language_id
from .manifest import OP11_SQL, op11_merkle_manifest
from .mixing import OP5_SQL, op5_mixing
from .pages import op7_main_text
from .preferences import OP4_SQL, op4_preferences
from .quality import op8_quality
from .sharding import OP13_SQL, op13_kd_shards
from .simhash import op2_simhash_dedup
from .substring import OP6_SQL, op6_substring_dedup
from .tokens import op10_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_simhash_dedup, op3_embedding_dedup, op4_preferences, op5_mixing, op6_substring_dedup, op7_main_text, op8_quality, op9_decontamination, op10_token_counts, op11_merkle_manifest, op12_fill_in_middle, op13_kd_shards)}


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_dedup": OP3_SQL, "op4_preferences": OP4_SQL, "op5_mixing": OP5_SQL, "op6_substring_dedup": OP6_SQL, "op11_merkle_manifest": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_kd_shards": OP13_SQL}
