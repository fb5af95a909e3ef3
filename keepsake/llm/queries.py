"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from keepsake.llm.bpe import op6_bpe
from keepsake.llm.centroids import OP13_SQL, op13_centroids
from keepsake.llm.decontaminate import op9_decontaminate
from keepsake.llm.exact_dedup import OP11_SQL, op11_exact_dedup
from keepsake.llm.jaccard import op3_jaccard
from keepsake.llm.language import op8_language
from keepsake.llm.licenses import op1_licenses
from keepsake.llm.quality import op7_quality
from keepsake.llm.resample import OP12_SQL, op12_resample
from keepsake.llm.secrets import op4_secrets
from keepsake.llm.suffix_tree import op10_suffix_tree
from keepsake.llm.token_files import op2_token_output
from keepsake.llm.topk import OP5_SQL, op5_topk

QUERIES = {"op10_suffix_tree": op10_suffix_tree, "op3_jaccard": op3_jaccard, "op7_quality": op7_quality, "op8_language": op8_language, "op1_licenses": op1_licenses, "op4_secrets": op4_secrets, "op6_bpe": op6_bpe, "op2_token_output": op2_token_output, "op5_topk": op5_topk, "op9_decontaminate": op9_decontaminate, "op13_centroids": op13_centroids, "op11_exact_dedup": op11_exact_dedup, "op12_resample": op12_resample}
ORACLE_SQL = {"op5_topk": OP5_SQL, "op13_centroids": OP13_SQL, "op11_exact_dedup": OP11_SQL, "op12_resample": OP12_SQL}
