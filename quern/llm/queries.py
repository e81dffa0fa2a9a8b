"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from quern.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from quern.llm.fingerprint import op1_fingerprint
from quern.llm.lm_score import op7_lm_score
from quern.llm.mixing import op8_mixing
from quern.llm.packing import op3_packing
from quern.llm.pii import op9_pii
from quern.llm.sharding import op2_sharding
from quern.llm.simhash import op10_simhash
from quern.llm.toxicity import op4_toxicity
from quern.llm.url_filter import op6_url_filter

QUERIES = {f.__name__: f for f in (op1_fingerprint, op2_sharding, op3_packing, op4_toxicity, op5_exact_dedup, op6_url_filter, op7_lm_score, op8_mixing, op9_pii, op10_simhash)}
ORACLE_SQL = {"op5_exact_dedup": OP5_SQL}
