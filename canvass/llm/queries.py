"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from canvass.llm.collocations import OP12_SQL, op12_phrase_collocations
from canvass.llm.fingerprints import op4_imatch_fingerprints
from canvass.llm.language_model import OP9_ORDER3_SQL, OP9_SQL, op9_stupid_backoff, op9_stupid_backoff_order3
from canvass.llm.licenses import op13_license_scan
from canvass.llm.mixing import op1_temperature_mixing
from canvass.llm.packing import op5_best_fit_packing
from canvass.llm.quality import op3_quality_forest
from canvass.llm.secret_scan import op8_secret_scan
from canvass.llm.similarity_join import op2_ngram_jaccard_join
from canvass.llm.toolchat import OP6_SQL, op6_tool_call_chat
from canvass.llm.toxicity import op10_toxicity_ftrl
from canvass.llm.vector_codes import OP11_SQL, op11_vector_codes
from canvass.llm.warc import OP7_SQL, op7_warc_roundtrip

_ALL = (
    op1_temperature_mixing, op2_ngram_jaccard_join, op3_quality_forest, op4_imatch_fingerprints, op5_best_fit_packing, op6_tool_call_chat,
    op7_warc_roundtrip, op8_secret_scan, op9_stupid_backoff, op9_stupid_backoff_order3, op10_toxicity_ftrl, op11_vector_codes,
    op12_phrase_collocations, op13_license_scan,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {
    "op6_tool_call_chat": OP6_SQL,
    "op7_warc_roundtrip": OP7_SQL,
    "op9_stupid_backoff": OP9_SQL,
    "op9_stupid_backoff_order3": OP9_ORDER3_SQL,
    "op11_vector_codes": OP11_SQL,
    "op12_phrase_collocations": OP12_SQL,
}
