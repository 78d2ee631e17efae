"""The queries of the corpus operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from lodestone.llm import bpe, licenses, search, wand
from lodestone.llm.digest import op12_document_fingerprints
from lodestone.llm.html import op9_html_extraction
from lodestone.llm.language import op7_language_id
from lodestone.llm.minhash import op1_minhash_near_dedup
from lodestone.llm.packing import op10_best_fit_packing
from lodestone.llm.quality import op4_quality_classifier
from lodestone.llm.substrings import op8_substring_dedup
from lodestone.llm.vectors import op6_embedding_near_dedup

QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_bm25_top_k": search.op2_bm25_top_k,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_language_id": op7_language_id,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_wand_search": wand.op11_wand_search,
    "op12_document_fingerprints": op12_document_fingerprints,
    "pipeline": corpus_pipeline.run,
}
#: Further query sets of operators that QUERIES has already.
MORE = {"op2_bm25_corpus_top_k": search.op2_bm25_corpus_top_k}
ORACLES: dict[str, str] = {
    "op2_bm25_top_k": search.ORACLE,
    "op2_bm25_corpus_top_k": search.CORPUS_ORACLE,
    "op5_license_scan": licenses.oracle(),
    "op11_wand_search": wand.ORACLE,
}
