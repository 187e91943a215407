"""The queries of this package, by name, and the SQL that should give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labflow.llm.bpe import op3_byte_bpe
from labflow.llm.langid import op7_language_id
from labflow.llm.linededup import OP5_SQL, op5_line_dedup
from labflow.llm.mixing import OP4_SQL, op4_mix_sources
from labflow.llm.sharding import op8_jump_shards
from labflow.llm.simhash import op1_simhash_near_dedup
from labflow.llm.tiff import op10_tiff_pages
from labflow.llm.tokencounts import op9_section_tokens
from labflow.llm.topk import OP2_SQL, op2_pivot_top_k
from labflow.llm.toxicity import op6_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_pivot_top_k": op2_pivot_top_k,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_mix_sources": op4_mix_sources,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_language_id": op7_language_id,
    "op8_jump_shards": op8_jump_shards,
    "op9_section_tokens": op9_section_tokens,
    "op10_tiff_pages": op10_tiff_pages,
}

ORACLES: dict[str, str] = {
    "op2_pivot_top_k": OP2_SQL,
    "op4_mix_sources": OP4_SQL,
    "op5_line_dedup": OP5_SQL,
}
