"""Registered queries against their oracles, and the pipeline against brute force."""

import collections

import pytest

import corpus_pipeline
from weft.catalog.check import difference, oracle_connection
from weft.llm import decontam, pii, queries
from weft.llm.text import table


@pytest.mark.parametrize("key", sorted(queries.ORACLE))
def test_same_rows(spark, sf, key):
    want = oracle_connection(sf).execute(queries.ORACLE[key]).df()
    assert difference(queries.QUERIES[key](spark, sf).toPandas(), want) is None


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))


def test_pipeline(spark, sf):
    con = oracle_connection(sf)
    docs = table(spark, sf, "documents")
    con.execute(f"CREATE OR REPLACE TABLE kept AS SELECT d.* FROM documents d JOIN ({queries.ORACLE['op1_distribution_divergence']}) USING (doc_id) WHERE kept")
    stages = dict(corpus_pipeline.STAGES)
    one = stages["quality_rules"](spark, docs, sf)
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    sql = lambda q: sorted(r[0] for r in con.execute(q).fetchall())
    assert one.columns == docs.columns and ids(one) == sql("SELECT doc_id FROM kept")
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM kept")
    two = stages["near_duplicates"](spark, one.cache(), sf).cache()
    assert ids(two) == sql(f"SELECT doc_id FROM ({queries.ORACLE['op7_parity_sketch_join']}) WHERE n_shingles = 0 OR doc_id = component_id")
    three = stages["decontaminate"](spark, two, sf).cache()
    con.register("two", two.toPandas())
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM two")
    assert ids(three) == sql(f"SELECT doc_id FROM ({queries.ORACLE['op3_positional_index']}) WHERE NOT contaminated") and three.columns == docs.columns
    four = stages["personal_data"](spark, three, sf).cache()
    assert ids(four) == ids(three) and four.columns == docs.columns
    assert not any(pii.rule_spans(r["text"]) for r in four.collect())
    five = stages["pack"](spark, four, sf)
    assert collections.Counter(r["doc_id"] for r in five.where("piece = 0").collect()) == collections.Counter(ids(four))


def test_tokens_keep_other_letters(spark):
    df = spark.createDataFrame([("ÉA1 b-C",)], "text string")
    assert df.select(decontam.tokens(df.text)).first()[0] == ["Éa1", "b", "c"]
