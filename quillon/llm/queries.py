"""The queries of the training-data operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op10_topk import ORACLE as op10_oracle
from .op10_topk import op10_topk
from .op11_token_alignment import op11_token_alignment
from .op12_packing import op12_packing
from .op13_fill_in_middle import ORACLE as op13_oracle
from .op13_fill_in_middle import op13_fill_in_middle
from .op1_html_text import op1_html_text
from .op2_near_dedup import op2_near_dedup
from .op3_quality import op3_quality
from .op4_bpe import op4_bpe
from .op5_language_id import op5_language_id
from .op6_pii import op6_pii
from .op7_class_lm import op7_class_lm
from .op8_decontaminate import op8_decontaminate
from .op9_url_filter import op9_url_filter
from .op9_url_filter import oracle as op9_oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_near_dedup": op2_near_dedup,
    "op3_quality": op3_quality,
    "op4_bpe": op4_bpe,
    "op5_language_id": op5_language_id,
    "op6_pii": op6_pii,
    "op7_class_lm": op7_class_lm,
    "op8_decontaminate": op8_decontaminate,
    "op9_url_filter": op9_url_filter,
    "op10_topk": op10_topk,
    "op11_token_alignment": op11_token_alignment,
    "op12_packing": op12_packing,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES: dict[str, str] = {"op9_url_filter": op9_oracle(), "op10_topk": op10_oracle, "op13_fill_in_middle": op13_oracle}
