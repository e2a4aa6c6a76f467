"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html, langid, licenses, packing, pii, simhash, toxicity, urlfilter, vptree


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": packing.op1_packing,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_neighbours": vptree.op3_neighbours,
        "op4_langid": langid.op4_langid,
        "op5_html": html.op5_html,
        "op6_pii": pii.op6_pii,
        "op7_urlfilter": urlfilter.op7_urlfilter,
        "op8_simhash": simhash.op8_simhash,
        "op9_licenses": licenses.op9_licenses,
        "op10_toxicity": toxicity.op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": decontaminate.OP2_SQL,
        "op3_neighbours": vptree.OP3_SQL,
        "op7_urlfilter": urlfilter.OP7_SQL,
    }
