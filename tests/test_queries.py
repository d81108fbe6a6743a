"""Every registered query that has an oracle equals it on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from paperloom.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted((tuple(r) for r in frame.values.tolist()), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(name, spark, sf_dir, duck):
    got, expected = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_byte_codes_are_those_of_whole_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("doc_id", "lang", "text").collect()
    by_lang = {(r.lang, b) for r in docs for b in r.text.encode()}
    assert 10 in {b for _, b in by_lang} and max(b for _, b in by_lang) > 127
    assert {(r.lang, r.code) for r in QUERIES["used_codes_bytes"](spark, sf_dir).collect()} == by_lang
    assert {(r.file_id, r.code) for r in QUERIES["pdf_used_codes_bytes"](spark, sf_dir).collect()} == {(r.doc_id, b) for r in docs for b in r.text.encode()}
