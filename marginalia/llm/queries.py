"""The queries of the corpus operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontaminate import OP4_SQL, op4_decontaminate
from .exact_search import OP5_SQL, op5_exact_search
from .licenses import op7_licenses
from .mixing import op6_mixing
from .pii import op2_pii
from .quality import op9_quality
from .sharding import op8_sharding
from .simhash import op3_simhash
from .suffix_dedup import op10_suffix_dedup
from .toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_pii": op2_pii,
    "op3_simhash": op3_simhash,
    "op4_decontaminate": op4_decontaminate,
    "op5_exact_search": op5_exact_search,
    "op6_mixing": op6_mixing,
    "op7_licenses": op7_licenses,
    "op8_sharding": op8_sharding,
    "op9_quality": op9_quality,
    "op10_suffix_dedup": op10_suffix_dedup,
}
ORACLES = {"op4_decontaminate": OP4_SQL, "op5_exact_search": OP5_SQL}
