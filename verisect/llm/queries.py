"""The queries of this package and the SQL that some of them are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verisect.llm.ann import op5_ann
from verisect.llm.filter_audit import OP13_SQL, op13_filter_audit
from verisect.llm.langid import op9_langid
from verisect.llm.merkle import OP12_SQL, op12_merkle
from verisect.llm.mixing import OP7_SQL, op7_mixing
from verisect.llm.pii import op3_pii
from verisect.llm.sentencepiece import op1_sentencepiece
from verisect.llm.sharding import op2_sharding
from verisect.llm.simhash import op6_simhash
from verisect.llm.token_counts import op10_token_counts
from verisect.llm.topk import OP4_SQL, op4_topk
from verisect.llm.urls import OP8_SQL, op8_url_filter
from verisect.llm.warc import OP11_SQL, op11_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_sharding": op2_sharding,
    "op3_pii": op3_pii,
    "op4_topk": op4_topk,
    "op5_ann": op5_ann,
    "op6_simhash": op6_simhash,
    "op7_mixing": op7_mixing,
    "op8_url_filter": op8_url_filter,
    "op9_langid": op9_langid,
    "op10_token_counts": op10_token_counts,
    "op11_warc": op11_warc,
    "op12_merkle": op12_merkle,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {"op4_topk": OP4_SQL, "op7_mixing": OP7_SQL, "op8_url_filter": OP8_SQL, "op11_warc": OP11_SQL, "op12_merkle": OP12_SQL, "op13_filter_audit": OP13_SQL}
