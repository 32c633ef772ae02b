"""The registered queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

import corpus_pipeline
from ragscope.llm.alignment import op11_alignment
from ragscope.llm.bpe import op4_bpe
from ragscope.llm.itq import op1_embedding_dedup
from ragscope.llm.langid import op8_langid
from ragscope.llm.licenses import op5_licenses
from ragscope.llm.ngram_join import op7_ngram_jaccard
from ragscope.llm.packing import op9_packing
from ragscope.llm.residual_packing import op13_residual_packing
from ragscope.llm.secrets import op3_secrets
from ragscope.llm.substring import op10_substring_dedup
from ragscope.llm.syncmers import op6_syncmers
from ragscope.llm.toxicity import op2_toxicity
from ragscope.llm.whitening import op12_whitening

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_secrets": op3_secrets,
    "op4_bpe": op4_bpe,
    "op5_licenses": op5_licenses,
    "op6_syncmers": op6_syncmers,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_langid": op8_langid,
    "op9_packing": op9_packing,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_alignment": op11_alignment,
    "op12_whitening": op12_whitening,
    "op13_residual_packing": op13_residual_packing,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {}
