"""The registered queries of the training-data operators."""

from __future__ import annotations

from larder.llm.bpe import op8_bpe
from larder.llm.ctw import op6_ctw
from larder.llm.decontaminate import op3_decontaminate
from larder.llm.html_extract import op2_html_extract
from larder.llm.pii import op4_pii
from larder.llm.quality_model import op5_quality_model
from larder.llm.quality_rules import op7_quality_rules
from larder.llm.simhash import op9_simhash
from larder.llm.spelling import op12_spelling
from larder.llm.token_files import op13_token_files
from larder.llm.toxicity import op10_toxicity
from larder.llm.url_filter import op1_url_filter
from larder.llm.whitening import op11_whitening

LLM_REGISTRY = {f.__name__: f for f in (
    op1_url_filter, op2_html_extract, op3_decontaminate, op4_pii, op5_quality_model, op6_ctw, op7_quality_rules, op8_bpe,
    op9_simhash, op10_toxicity, op11_whitening, op12_spelling, op13_token_files)}
# Verdicts of trained models, parsers, hashes and tokenizers: not to be written in SQL.  tests/llm holds brute-force versions.
LLM_ORACLE: dict[str, str] = {}
