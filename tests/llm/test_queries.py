"""The registered queries against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import hashlib

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from oracle import differences
from shopledger.llm import minhash, mixing, quality_rules, secrets
from shopledger.llm.common import table, written
from shopledger.llm.queries import ORACLE, QUERIES, TOKENIZERS

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def connection():
    found = duckdb.connect()
    for name in TABLES:
        found.execute(f"CREATE VIEW {name} AS FROM '{FOLDER}/{name}.parquet'")
    return found


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(name, spark, connection):
    assert differences(QUERIES[name](spark, FOLDER), connection, ORACLE[name])[0] == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_whole_table(name, spark):
    found = QUERIES[name](spark, FOLDER)
    key = found.columns[0]
    of = {"page_id": "pages", "vec_id": "embeddings", "conv_id": "conversations"}.get(key, "documents")
    rows = table(spark, FOLDER, of).select(key)
    ids = lambda df: sorted(r[0] for r in df.select(key).collect())
    assert ids(found) == ids(rows.distinct() if of == "conversations" else rows)


def test_bpe_query_equals_the_library(spark):
    library = Tokenizer.from_file(str(TOKENIZERS / "word_bpe_49k.json"))
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    expected = set()
    for r in table(spark, FOLDER, "documents").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        expected.add((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert {tuple(r) for r in QUERIES["op9_bpe"](spark, FOLDER).collect()} == expected


def test_stages(spark):
    """Each stage's rows follow from its own input by what its operator says."""
    docs = table(spark, FOLDER, "documents")
    stages = [f for _, f in corpus_pipeline.STAGES]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    outs = []
    for stage in stages:
        docs = written(stage(spark, docs, FOLDER), "stage")
        outs.append(docs)
    first, second, third, fourth, last = outs
    raw = table(spark, FOLDER, "documents")
    assert all(d.columns == raw.columns for d in outs[:4])
    judged = quality_rules.judge(raw, table(spark, FOLDER, "labels").where("quality = 1"))
    assert ids(first) == ids(judged.where("kept"))
    assert ids(second) == ids(minhash.near_duplicates(first).where("kept"))
    texts = {r.doc_id: r.text for r in second.collect()}
    for r in third.collect():
        assert r.text == secrets.redacted(texts[r.doc_id], secrets.scan_texts([texts[r.doc_id]])[0]) and r.n_chars == len(r.text)
    copies = {r.doc_id: len(r.shards) for r in mixing.mix(third).collect()}
    assert ids(fourth) == sorted(i for i, n in copies.items() for _ in range(n))
    library = Tokenizer.from_file(str(TOKENIZERS / "word_bpe_49k.json"))
    clean = {r.doc_id: r.text for r in third.collect()}
    rows = last.collect()
    assert sorted(r.doc_id for r in rows) == ids(fourth)
    assert all(r.ids == library.encode(clean[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in rows)
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, FOLDER).collect()) == sorted((r.doc_id, r.ids_sha256) for r in rows)
