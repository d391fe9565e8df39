"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from vellum.llm import op11_line_dedup, op12_filter_audit, op13_lexical_search
from vellum.llm.op01_fingerprints import op1_fingerprints
from vellum.llm.op02_quality import op2_quality
from vellum.llm.op03_toxicity import op3_toxicity
from vellum.llm.op04_language import op4_language
from vellum.llm.op05_ann import op5_ann
from vellum.llm.op06_bpe import op6_bpe
from vellum.llm.op07_substring_dedup import op7_substring_dedup
from vellum.llm.op08_licenses import op8_licenses
from vellum.llm.op09_simhash import op9_simhash
from vellum.llm.op10_packing import op10_packing

QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_quality, op3_toxicity, op4_language, op5_ann, op6_bpe, op7_substring_dedup, op8_licenses, op9_simhash, op10_packing)}
SQL: dict[str, str] = {}

for module in (op11_line_dedup, op12_filter_audit, op13_lexical_search):
    name = module.__name__.rpartition(".")[2]
    QUERIES[name] = getattr(module, name)
    SQL[name] = module.SQL
