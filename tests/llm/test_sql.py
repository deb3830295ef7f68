"""Queries that SQL can express, against that SQL, on tables with awkward rows."""

import duckdb
import pytest

from pactlens.llm.catalogue import ORACLES, QUERIES
from tests.llm.test_operators import LONG, prose

SECRET = "Password: 'hunter-2222' TOKEN=short é api-key=no api_key = abc.def_ghi AKIA" + "A1B2C3D4" * 2 + " 🔑 " + "0a1b2c3d" * 4
_BASE = prose(3, 120)
TEXTS = [
    *[(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (None, "no id here"), (6, LONG), (7, "É é"), (8, SECRET), (9, f"{LONG}{SECRET} {SECRET}")],
    *[(10 + n, _BASE) for n in range(3)],
    *[(20 + n, f"{_BASE} {prose(n, 6)}") for n in range(4)],
    (30, "passwd=ſecret1 ſecret=abcdefg toKen=abcdefg toKen=abcdefg"),
    (31, prose(8, 90)),
]
PAGES = [(1, "u", None), (2, "u", ""), (3, None, "x"), (4, "u", "x"), (4, "u", "x"), (5, "u", "é🔑\r\n\r\nWARC/1.1\r\n" * 9000), (6, "u", "x"), (None, "u", "x"), (7, "u", "y" * 50000)]


@pytest.fixture(scope="module", params=["rows", "none"])
def tables(spark, tmp_path_factory, request):
    path = tmp_path_factory.mktemp("sql")
    rows = request.param == "rows"
    docs = [(*t, "aa", "s0", 1) for t in TEXTS] if rows else []
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(PAGES if rows else [], "page_id bigint, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["op2_mix_sources", "op3_near_dedup", "op4_warc", "op6_secrets"])
def test_agrees_with_sql(spark, tables, name):
    db = duckdb.connect()
    for table in ("documents", "pages"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet/*.parquet'")
    got = QUERIES[name](spark, tables)
    columns = ("doc_id", "size", "source_size", "target") if name == "op2_mix_sources" else got.columns
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want))
