"""The llm operators' queries, one for each operator, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from plumbline.llm import decontam, quality_rules
from plumbline.llm.bpe import op3_bpe
from plumbline.llm.chat import op1_chat
from plumbline.llm.decontam import op5_decontaminate
from plumbline.llm.lm import op10_lm
from plumbline.llm.pii import op2_pii
from plumbline.llm.quality_model import op7_quality
from plumbline.llm.quality_rules import op8_repetition
from plumbline.llm.secrets import op9_secrets
from plumbline.llm.sharding import op4_sharding
from plumbline.llm.simhash import op6_simhash

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_chat": op1_chat,
    "op2_pii": op2_pii,
    "op3_bpe": op3_bpe,
    "op4_sharding": op4_sharding,
    "op5_decontaminate": op5_decontaminate,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_repetition": op8_repetition,
    "op9_secrets": op9_secrets,
    "op10_lm": op10_lm,
}
ORACLES: dict[str, str] = {"op5_decontaminate": decontam.ORACLE, "op8_repetition": quality_rules.ORACLE}
