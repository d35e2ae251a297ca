"""The identity of a change set's impact: that of its SQL, exact however many rows there are."""

import hashlib
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from tessera.operators import declarations
from tessera.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def test_change_impact_is_its_sql(spark):
    con = duckdb.connect()
    for name in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    want = con.execute(ORACLE_SQL["change_impact"]).fetchall()
    assert Counter(tuple(r) for r in QUERIES["change_impact"](spark, DATA).select("section", "item").collect()) == Counter(want)


def test_summed_identity_beyond_a_long(spark):
    rows = spark.range(70000).select(F.lit("page").alias("section"), F.col("id").cast("string").alias("item"))
    total = sum(int(hashlib.sha256(f"page\x1f{k}".encode()).hexdigest()[:12], 16) for k in range(70000))
    assert total > 1 << 63
    got = declarations.summed_identity(rows).first().corpus_id
    assert got == "sha256:" + hashlib.sha256(str(total).encode()).hexdigest()
