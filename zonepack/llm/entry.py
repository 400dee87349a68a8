"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from zonepack.llm.alignment import op12_alignment
from zonepack.llm.ann import op8_ann
from zonepack.llm.decontaminate import op6_decontaminate
from zonepack.llm.jaccard_join import OP3_SQL, op3_ngram_jaccard
from zonepack.llm.language_id import op1_language_id
from zonepack.llm.odd_sketch import OP13_SQL, op13_minhash
from zonepack.llm.packing import op9_packing
from zonepack.llm.periodic_runs import op11_periodic_runs
from zonepack.llm.pii import op5_pii
from zonepack.llm.quality import op10_quality
from zonepack.llm.token_codec import op7_token_codec
from zonepack.llm.token_count import op2_token_count
from zonepack.llm.url_filter import OP4_SQL, op4_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_language_id, op2_token_count, op3_ngram_jaccard, op4_url_filter, op5_pii,
        op6_decontaminate, op7_token_codec, op8_ann, op9_packing, op10_quality, op11_periodic_runs, op12_alignment,
        op13_minhash,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_jaccard": OP3_SQL, "op4_url_filter": OP4_SQL, "op13_minhash": OP13_SQL}
