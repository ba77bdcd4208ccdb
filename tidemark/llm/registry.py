"""The training-data queries. Each entry applies one operator to its whole table."""

from __future__ import annotations

from tidemark.llm.bpe import op6_bpe
from tidemark.llm.chat_tree import op1_chat_tree
from tidemark.llm.decontaminate import decontaminate_near, op2_decontaminate
from tidemark.llm.html_text import op8_html_text
from tidemark.llm.quality import op9_quality
from tidemark.llm.shards import op5_shards
from tidemark.llm.simhash import op10_simhash
from tidemark.llm.suffix import op7_suffix_dedup
from tidemark.llm.token_files import op3_token_files
from tidemark.llm.topk import op4_topk
from tidemark.llm import oracles, topk


def queries() -> dict:
    return {"op1_chat_tree": op1_chat_tree, "op2_decontaminate": op2_decontaminate, "op3_token_files": op3_token_files, "op4_topk": op4_topk, "op5_shards": op5_shards, "op6_bpe": op6_bpe, "op7_suffix_dedup": op7_suffix_dedup, "op8_html_text": op8_html_text, "op9_quality": op9_quality, "op10_simhash": op10_simhash, "decontaminate_near": decontaminate_near}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_tree": oracles.CHAT_TREE, "op2_decontaminate": oracles.DECONTAMINATE, "op4_topk": topk.ORACLE, "op7_suffix_dedup": oracles.SUFFIX_DEDUP, "decontaminate_near": oracles.NEAR}
