"""Queries and oracle SQL of this subpackage, picked up by __spark_entry__.py."""

from threadlake.llm.decontaminate import OP1_SQL, op1_decontamination
from threadlake.llm.jaccard import OP4_SQL, op4_jaccard_join
from threadlake.llm.language import op5_language_id
from threadlake.llm.lsh_forest import OP13_SQL, op13_lsh_forest
from threadlake.llm.mixing import op7_mix_sources
from threadlake.llm.pii import op9_pii
from threadlake.llm.quality import ABLATION_SQL, OP3_SQL, op3_quality_ledger, quality_ablation
from threadlake.llm.secrets_scan import OP10_SQL, op10_secret_scan
from threadlake.llm.token_counts import op6_token_counts
from threadlake.llm.token_ids import op2_token_binary
from threadlake.llm.vector_codes import OP12_SQL, op12_vector_codes
from threadlake.llm.warc import OP8_SQL, op8_warc
from threadlake.llm.whitening import op11_whitening

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_token_binary": op2_token_binary,
    "op3_quality_ledger": op3_quality_ledger,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_language_id": op5_language_id,
    "op6_token_counts": op6_token_counts,
    "op7_mix_sources": op7_mix_sources,
    "op8_warc": op8_warc,
    "op9_pii": op9_pii,
    "op10_secret_scan": op10_secret_scan,
    "op11_whitening": op11_whitening,
    "op12_vector_codes": op12_vector_codes,
    "op13_lsh_forest": op13_lsh_forest,
    "quality_ablation": quality_ablation,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": OP1_SQL,
    "op3_quality_ledger": OP3_SQL,
    "op4_jaccard_join": OP4_SQL,
    "op8_warc": OP8_SQL,
    "op10_secret_scan": OP10_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_lsh_forest": OP13_SQL,
    "quality_ablation": ABLATION_SQL,
}
