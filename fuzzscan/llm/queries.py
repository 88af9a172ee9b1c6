"""Queries of the pipeline operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import mixing, quality
from .bpe import op2_bpe
from .html import op5_html
from .langid import op6_langid
from .lm import op4_lm
from .media import op9_media
from .mixing import op1_mixing
from .quality import op3_quality
from .sharding import op10_sharding
from .simhash import op7_simhash
from .tokenfile import op8_tokenfile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_bpe": op2_bpe,
    "op3_quality": op3_quality,
    "op4_lm": op4_lm,
    "op5_html": op5_html,
    "op6_langid": op6_langid,
    "op7_simhash": op7_simhash,
    "op8_tokenfile": op8_tokenfile,
    "op9_media": op9_media,
    "op10_sharding": op10_sharding,
}

ORACLE_SQL: dict[str, str] = {"op1_mixing": mixing.ORACLE, "op3_quality": quality.ORACLE}
