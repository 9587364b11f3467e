"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from trustframe.llm.bytepairs import op11_byte_pairs
from trustframe.llm.chat import OP8_SQL, op8_format_chat
from trustframe.llm.decontaminate import op2_decontaminate
from trustframe.llm.infill import OP12_SQL, op12_fill_in_middle
from trustframe.llm.jaccard import op9_ngram_join
from trustframe.llm.language import op3_language_id
from trustframe.llm.mixing import op4_mix_sources
from trustframe.llm.quality import op7_quality
from trustframe.llm.resample import op13_resample
from trustframe.llm.sharding import op1_shuffle_shards
from trustframe.llm.tokens import op6_wavelet_tokens
from trustframe.llm.topk import OP5_SQL, op5_top_k
from trustframe.llm.toxicity import op10_toxicity

QUERIES = {f.__name__: f for f in (
    op1_shuffle_shards, op2_decontaminate, op3_language_id, op4_mix_sources, op5_top_k, op6_wavelet_tokens, op7_quality,
    op8_format_chat, op9_ngram_join, op10_toxicity, op11_byte_pairs, op12_fill_in_middle, op13_resample)}

SQL = {"op5_top_k": OP5_SQL, "op8_format_chat": OP8_SQL, "op12_fill_in_middle": OP12_SQL}
