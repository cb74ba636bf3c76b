"""The registered queries on the smallest tables: SQL where there is some, and the contracts' columns."""

import glob
import os
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from verisect.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_sentencepiece": {"doc_id", "ids", "n_tokens", "text_crc32"}, "op2_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}, "op3_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}, "op4_topk": {"query_id", "rank", "vec_id", "score"},
    "op5_ann": {"query_id", "rank", "vec_id", "score"}, "op6_simhash": {"doc_id", "fingerprint", "component_id"}, "op7_mixing": {"doc_id", "size", "source_size", "target", "taken"}, "op8_url_filter": {"page_id", "host", "path", "rule", "verdict"}, "op9_langid": {"doc_id", "held_out", "lang_pred", "score"}, "op10_token_counts": {"source", "lang", "tokenizer", "docs", "tokens"},
    "op11_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"}, "op12_merkle": {"doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"}, "op13_filter_audit": {"part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert COLUMNS[name] <= set(df.columns)
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    key = lambda v: "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    cursor = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    want = sorted(tuple(key(r[names.index(c)]) for c in cols) for r in cursor.fetchall())
    assert sorted(tuple(key(r[c]) for c in cols) for r in df.collect()) == want


def test_token_totals(spark):
    """The rollup against counting what is left, from scratch."""
    import tiktoken

    from verisect.llm import token_counts

    pattern, ranks = token_counts.load_ranks()
    enc = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    again = tiktoken.Encoding("u", pat_str=pattern, mergeable_ranks=token_counts.load_ranks(token_counts.REVISED_RANKS)[1], special_tokens={})
    docs, labels = pq.read_table(f"{SF}/documents.parquet").to_pylist(), pq.read_table(f"{SF}/labels.parquet").to_pylist()
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1}
    low = {r["doc_id"] for r in labels if r["quality"] == 0} - toxic
    want: dict = {}
    for d in docs:
        if d["doc_id"] in toxic:
            continue
        new = d["doc_id"] in low
        text = d["text"] or ""
        k = (d["source"], d["lang"], token_counts.REVISED if new else token_counts.VERSION)
        n, t = want.get(k, (0, 0))
        want[k] = (n + 1, t + len((again if new else enc).encode_ordinary(text)))
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in QUERIES["op10_token_counts"](spark, SF).collect()}
    assert got == want


def test_ann_recall_on_the_table(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    x, ids = np.array(t["embedding"], float), np.array(t["vec_id"])
    got: dict = {}
    for r in QUERIES["op5_ann"](spark, SF).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = set(ids[np.argsort(-s)[:20]])
        hit, total = hit + len(best & got[q]), total + 20
    assert hit / total >= 0.9


def test_langid_held_out(spark):
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    rows = QUERIES["op9_langid"](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95
