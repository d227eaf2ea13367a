"""The registered queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from concordat.llm import align, ann, bpe, html, lines, packing, quality, runs, simhash, spans, topk, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": bpe.op1,
        "op2_top_products": topk.op2,
        "op3_url_filter": urls.op3,
        "op4_quality": quality.op4,
        "op5_simhash": simhash.op5,
        "op6_nearest": ann.op6,
        "op7_line_dedup": lines.op7,
        "op8_toxicity": toxicity.op8,
        "op9_main_text": html.op9,
        "op10_packing": packing.op10,
        "op11_periodic_runs": runs.op11,
        "op12_prefix_hashes": spans.op12,
        "op13_token_groups": align.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_top_products": topk.OP2_SQL, "op3_url_filter": urls.OP3_SQL}
