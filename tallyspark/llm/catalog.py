"""All corpus queries: importing this module registers them in ``QUERIES`` and ``ORACLES``."""

from . import (op1_quality, op2_bpe, op3_secrets, op4_jaccard, op5_chunks, op6_urls, op7_runindex,  # noqa: F401
               op8_langid, op9_decontam, op10_tokencount, op11_lines, op12_whitening, op13_codes)
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
