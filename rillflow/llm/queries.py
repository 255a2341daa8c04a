"""Queries of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillflow.llm import oracles
from rillflow.llm.alignment import op11_alignment
from rillflow.llm.decontaminate import op1_decontaminate
from rillflow.llm.html import op9_main_text
from rillflow.llm.links import op7_link_trust
from rillflow.llm.minhash import op13_circulant_minhash
from rillflow.llm.neighbours import op2_neighbours
from rillflow.llm.packing import op3_packing
from rillflow.llm.repeats import op6_recompression
from rillflow.llm.secrets import op5_secrets
from rillflow.llm.sharding import op10_jump_shards
from rillflow.llm.simhash import op8_simhash
from rillflow.llm.toxicity import op4_toxicity
from rillflow.llm.whitening import op12_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_neighbours": op2_neighbours,
        "op3_packing": op3_packing,
        "op4_toxicity": op4_toxicity,
        "op5_secrets": op5_secrets,
        "op6_recompression": op6_recompression,
        "op7_link_trust": op7_link_trust,
        "op8_simhash": op8_simhash,
        "op9_main_text": op9_main_text,
        "op10_jump_shards": op10_jump_shards,
        "op11_alignment": op11_alignment,
        "op12_whitening": op12_whitening,
        "op13_circulant_minhash": op13_circulant_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_recompression": oracles.REPEATS,
    }
