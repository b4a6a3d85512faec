"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from tessellar.llm.op1_best_fit_packing import op1_best_fit_packing
from tessellar.llm.op2_byte_bpe import op2_byte_bpe
from tessellar.llm.op3_license_scan import op3_license_scan
from tessellar.llm.op4_language_id import op4_language_id
from tessellar.llm.op5_embedding_near_dedup import OP5_SQL, op5_embedding_near_dedup
from tessellar.llm.op6_ngram_jaccard_join import OP6_SQL, op6_ngram_jaccard_join
from tessellar.llm.op7_token_counts import op7_token_counts
from tessellar.llm.op8_telephony_audio import op8_telephony_audio
from tessellar.llm.op9_quality_classifier import op9_quality_classifier
from tessellar.llm.op10_html_text import op10_html_text
from tessellar.llm.op11_private_terms import op11_private_terms
from tessellar.llm.op12_phrase_collocations import OP12_SQL, op12_phrase_collocations
from tessellar.llm.op13_source_divergence import OP13_SQL, op13_source_divergence

QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_byte_bpe, op3_license_scan, op4_language_id, op5_embedding_near_dedup, op6_ngram_jaccard_join, op7_token_counts, op8_telephony_audio, op9_quality_classifier, op10_html_text, op11_private_terms, op12_phrase_collocations, op13_source_divergence)}

ORACLES: dict[str, str] = {"op5_embedding_near_dedup": OP5_SQL, "op6_ngram_jaccard_join": OP6_SQL, "op12_phrase_collocations": OP12_SQL, "op13_source_divergence": OP13_SQL}
