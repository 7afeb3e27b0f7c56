"""The queries of this package: one a dealt operator, and the pipeline."""

from __future__ import annotations

from quern.llm.embedding_dedup import op2_embedding_dedup
from quern.llm.line_dedup import op10_line_dedup
from quern.llm.mixing import op5_mixing
from quern.llm.oracle import ORACLE_SQL
from quern.llm.packing import op6_best_fit_packing
from quern.llm.pii import op9_pii
from quern.llm.quality_rules import op7_quality_rules
from quern.llm.secrets import op8_secret_scan
from quern.llm.simhash import op3_simhash
from quern.llm.suffix_dedup import op4_suffix_dedup
from quern.llm.url_filter import op1_url_filter

__all__ = ["ORACLE_SQL", "QUERIES"]
QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_embedding_dedup, op3_simhash, op4_suffix_dedup, op5_mixing,
        op6_best_fit_packing, op7_quality_rules, op8_secret_scan, op9_pii, op10_line_dedup,
    )
}
