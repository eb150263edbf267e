"""The queries of this package, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.alignment import op11_token_alignment
from riskloom.llm.decontamination import OP7_SQL, op7_benchmark_decontamination
from riskloom.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from riskloom.llm.licenses import op2_license_scan
from riskloom.llm.lm_scoring import OP5_SQL, op5_lm_scoring
from riskloom.llm.mixing import OP4_SQL, op4_mixing
from riskloom.llm.simhash import op9_simhash_near_dedup
from riskloom.llm.substring_dedup import op3_substring_dedup
from riskloom.llm.suffix_trees import op13_passage_dedup
from riskloom.llm.token_counts import op1_token_counts
from riskloom.llm.toxicity import op10_toxicity
from riskloom.llm.vector_codes import OP12_SQL, op12_vector_codes
from riskloom.llm.warc import OP8_SQL, op8_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_license_scan": op2_license_scan,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_mixing": op4_mixing,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_warc": op8_warc,
    "op10_toxicity": op10_toxicity,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op11_token_alignment": op11_token_alignment,
    "op12_vector_codes": op12_vector_codes,
    "op13_passage_dedup": op13_passage_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op4_mixing": OP4_SQL,
    "op5_lm_scoring": OP5_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op7_benchmark_decontamination": OP7_SQL,
    "op8_warc": OP8_SQL,
    "op12_vector_codes": OP12_SQL,
}
