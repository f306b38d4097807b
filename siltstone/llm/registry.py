"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op13_alignment
from .byte_bpe import op11_byte_bpe
from .chat import OP8_SQL, op8_chat
from .mixing import OP7_SQL, op7_mixing
from .negatives import OP12_SQL, op12_negatives
from .packing import op10_packing
from .pii import op1_pii
from .pq import OP4_SQL, op4_pq
from .simhash import op9_simhash
from .suffixes import OP3_SQL, op3_suffixes
from .telephony import op6_telephony
from .toxicity import op5_toxicity
from .warc import OP2_SQL, op2_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_pii, op2_warc, op3_suffixes, op4_pq, op5_toxicity, op6_telephony, op7_mixing, op8_chat, op9_simhash, op10_packing, op11_byte_bpe, op12_negatives, op13_alignment]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op3_suffixes": OP3_SQL, "op4_pq": OP4_SQL, "op7_mixing": OP7_SQL, "op8_chat": OP8_SQL, "op12_negatives": OP12_SQL}
