"""The queries of this subpackage and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tilework.llm import alignment, collocations, linededup, lmscore, media, mixing, neardup, packing, quality, tokenfile, topk, triejoin, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_stupid_backoff": lmscore.op1_stupid_backoff,
    "op2_near_dedup": neardup.op2_near_dedup,
    "op3_line_dedup": linededup.op3_line_dedup,
    "op4_top_k": topk.op4_top_k,
    "op5_quality": quality.op5_quality,
    "op6_packing": packing.op6_packing,
    "op7_token_files": tokenfile.op7_token_files,
    "op8_url_filter": urls.op8_url_filter,
    "op9_mixing": mixing.op9_mixing,
    "op10_media": media.op10_media,
    "op11_alignment": alignment.op11_alignment,
    "op12_collocations": collocations.op12_collocations,
    "op13_jaccard_join": triejoin.op13_jaccard_join,
}

SQL: dict[str, str] = {
    "op4_top_k": topk.OP4_SQL,
    "op8_url_filter": urls.OP8_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op12_collocations": collocations.OP12_SQL,
    "op13_jaccard_join": triejoin.OP13_SQL,
}
