"""Registered queries on the given small tables: against their SQL, and the pipeline stage by stage."""

import re

import duckdb
import public_tokenizers as P
import pytest

import __spark_entry__ as E
import corpus_pipeline
from pneuma.llm import bpe, decontaminate, quality_rules, queries, secret_scan, simhash
from pneuma.oracle import compare, duckdb_conn

from .conftest import ODD
from .test_dedup import brute_groups, brute_print
from .test_text import brute_secrets

SF = "/root/testdata/sf0.001"


def test_all_operators_and_the_pipeline_are_registered():
    names = set(E.queries())
    assert set(queries.QUERIES) <= names and "pipeline" in names
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    r = compare(queries.QUERIES[name](spark, SF).toPandas(), duckdb_conn(SF).execute(queries.ORACLE[name]).df())
    assert r["ok"], r


def test_base_columns_of_op4(spark):
    docs = {d: t for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()}
    rows = queries.QUERIES["op4_quality_rules"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == quality_rules.count_text(docs[r.doc_id])[:5]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_op3_on_held_out_documents(spark):
    rows = queries.QUERIES["op3_language_id"](spark, SF).toPandas()
    truth = duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").df()
    m = rows.merge(truth, on="doc_id")
    held = m[m.held_out]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.95


def test_pipeline_against_brute_force(spark):
    import hashlib
    docs = duckdb.sql(f"SELECT * FROM '{SF}/documents.parquet' ORDER BY doc_id").df()
    bench = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    judged = {r.doc_id: r.kept for r in queries.QUERIES["op4_quality_rules"](spark, SF).collect()}
    left = [(d, t) for d, t in zip(docs.doc_id, docs.text) if judged[d]]
    group = brute_groups([brute_print(t) for _, t in left], simhash.MAX_BITS)
    left = [x for i, x in enumerate(left) if group[i] == i]
    found = decontaminate.Matcher(bench, decontaminate.ERROR_RATE, decontaminate.UNIT_WORDS, decontaminate.EXACT_WORDS)
    assert all(not any(decontaminate.normal(b).strip() in decontaminate.normal(t) for _, b in bench) or found.find(t) for _, t in left)
    left = [x for x in left if not found.find(x[1])]
    import tiktoken
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path(bpe.RANKS_FILE)), special_tokens={})
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(rows) == sorted(d for d, _ in left)
    for d, t in left:
        if not brute_secrets(t):
            assert rows[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
            assert rows[d].n_tokens == len(tik.encode_ordinary(t))
        assert rows[d].round_trip


def test_stages_keep_the_columns(spark, make_docs):
    docs = make_docs(ODD + [(i, " ".join(f"word{i}x{j}" for j in range(30))) for i in range(50, 60)], extra=True)
    for items in (docs, docs.limit(0)):
        now = items
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == docs.columns, name
            assert dict(now.dtypes) == dict(docs.dtypes), name
        assert now.count() == (10 if items is docs else 0)
        assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() == now.count()
    assert secret_scan.KINDS[:3] == ["assign", "access", "hex"]
