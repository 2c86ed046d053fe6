"""The queries of this folder and the SQL that they are held against."""

from quittance.llm.audit import OP12_SQL, op12_filter_interactions
from quittance.llm.clustering import OP11_SQL, op11_centroid_clustering
from quittance.llm.decontam import OP1_SQL, op1_benchmark_decontamination
from quittance.llm.language import op9_language_id
from quittance.llm.mixing import OP2_SQL, op2_source_mixing
from quittance.llm.packing import op13_packing
from quittance.llm.quality import op10_quality_rules
from quittance.llm.secrets import op8_secret_scan
from quittance.llm.sharding import op4_sharding
from quittance.llm.simhash import op6_simhash_near_dedup
from quittance.llm.substring import op5_substring_dedup
from quittance.llm.tokencount import op7_token_counts
from quittance.llm.tokenio import op3_token_output

QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_source_mixing": op2_source_mixing,
    "op3_token_output": op3_token_output,
    "op4_sharding": op4_sharding,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_secret_scan": op8_secret_scan,
    "op9_language_id": op9_language_id,
    "op10_quality_rules": op10_quality_rules,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_filter_interactions": op12_filter_interactions,
    "op13_packing": op13_packing,
}
ORACLE_SQL: dict[str, str] = {
    "op1_benchmark_decontamination": OP1_SQL,
    "op2_source_mixing": OP2_SQL,
    "op11_centroid_clustering": OP11_SQL,
    "op12_filter_interactions": OP12_SQL,
}
