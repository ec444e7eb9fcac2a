"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bitlab.llm import conversations, hamming, lines, mixing, quality, substrings, variants
from bitlab.llm.conversations import op12_conversation_trie
from bitlab.llm.hamming import op8_hamming
from bitlab.llm.lines import op13_line_dedup
from bitlab.llm.mixing import op6_mixing
from bitlab.llm.packing import op3_packing
from bitlab.llm.quality import op1_host_quality
from bitlab.llm.secrets import op4_secrets
from bitlab.llm.sharding import op2_sharding
from bitlab.llm.simhash import op7_simhash
from bitlab.llm.substrings import op5_substrings
from bitlab.llm.tokenfile import op9_token_files
from bitlab.llm.toxicity import op10_toxicity
from bitlab.llm.variants import op11_spelling_variants


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name."""
    return {
        "op1_host_quality": op1_host_quality,
        "op2_sharding": op2_sharding,
        "op3_packing": op3_packing,
        "op4_secrets": op4_secrets,
        "op5_substrings": op5_substrings,
        "op6_mixing": op6_mixing,
        "op7_simhash": op7_simhash,
        "op8_hamming": op8_hamming,
        "op9_token_files": op9_token_files,
        "op10_toxicity": op10_toxicity,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_conversation_trie": op12_conversation_trie,
        "op13_line_dedup": op13_line_dedup,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express."""
    return {
        "op1_host_quality": quality.ORACLE,
        "op5_substrings": substrings.ORACLE,
        "op6_mixing": mixing.ORACLE,
        "op8_hamming": hamming.ORACLE,
        "op11_spelling_variants": variants.ORACLE,
        "op12_conversation_trie": conversations.ORACLE,
        "op13_line_dedup": lines.ORACLE,
    }
