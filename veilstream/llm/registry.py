"""The registered queries of this subpackage, and the SQL for those that SQL can express."""

from .chat import OP11_SQL, op11_chat_formatting
from .decontamination import OP7_SQL, op7_decontamination
from .jaccard import op1_jaccard_join
from .licenses import op6_license_scan
from .lines import op4_line_dedup
from .merkle import OP12_SQL, op12_merkle_manifest
from .mixing import op9_mixing
from .quality import OP8_SQL, op8_quality_rules
from .sharding import op10_sharding
from .suffixes import op5_suffix_dedup
from .tokens import op2_token_counts
from .urls import op3_url_filters
from .vectors import OP13_SQL, op13_vector_codes

QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_token_counts": op2_token_counts,
    "op3_url_filters": op3_url_filters,
    "op4_line_dedup": op4_line_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_decontamination": op7_decontamination,
    "op8_quality_rules": op8_quality_rules,
    "op9_mixing": op9_mixing,
    "op10_sharding": op10_sharding,
    "op11_chat_formatting": op11_chat_formatting,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {"op7_decontamination": OP7_SQL, "op8_quality_rules": OP8_SQL, "op11_chat_formatting": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_vector_codes": OP13_SQL}
