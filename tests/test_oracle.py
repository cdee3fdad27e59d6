"""Every query against its SQL on the smallest tables, and the same rows whatever the partitions."""

import glob
import math
import os

import pytest

from tests.conftest import SF
from tessera import catalogue


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(rows):
    value = lambda x: round(x, 6) if isinstance(x, float) and math.isfinite(x) else x
    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_equals_sql(spark, db, name):
    want = db.sql(catalogue.ORACLE[name])
    names = sorted(want.columns)
    df = catalogue.QUERIES[name](spark, SF)
    assert sorted(df.columns) == names
    assert plain(df.select(*names).collect()) == plain([r[want.columns.index(n)] for n in names] for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES.keys() - catalogue.ORACLE.keys()))
def test_rows_without_sql(spark, name):
    """Rows there are, and the same ones from other partitions."""
    rows = []
    for n in ("4", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k" if n == "7" else "128m")
        rows.append(plain(map(tuple, catalogue.QUERIES[name](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert rows[0] and rows[0] == rows[1]


def test_plain_blocks_and_letters(spark):
    """Blocks, sections, letters and programs against other readings of the same rows."""
    import ast
    import hashlib
    import re

    def tables(name, *columns):
        return spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()

    got = {r["page_id"]: r["blocks"] for r in catalogue.QUERIES["html_blocks"](spark, SF).collect()}
    assert got == {i: 1 for i, _ in tables("pages", "page_id", "html")}  # one element, html, with no pre in it
    got = {}
    for r in catalogue.QUERIES["html_sections"](spark, SF).collect():
        if r["tag"] == "section":
            got.setdefault(r["page_id"], []).append(r["title"])
    for i, html in tables("pages", "page_id", "html"):
        titles = [" ".join(re.sub("<[^>]*>", "", t).split()) for t in re.findall(r"<h[1-6][^>]*>(.*?)</h[1-6]>", html or "", re.S)]
        assert [len(t) for t in got.get(i, [])] == [len(__import__("html").unescape(t)) for t in titles if t]
    digests = {r["doc_id"]: r["digest"] for r in catalogue.QUERIES["translit"](spark, SF).collect()}
    plain_texts = [(i, t) for i, t in tables("documents", "doc_id", "text") if t and t.isascii()]
    assert plain_texts and all(digests[i] == hashlib.md5(t.encode()).hexdigest() for i, t in plain_texts)

    def parses(t):
        try:
            return bool(t) and bool(ast.parse(t) or True)
        except (SyntaxError, ValueError):
            return False

    got = {(r["conv_id"], r["turn"]): r["valid"] for r in catalogue.QUERIES["code_screen"](spark, SF).collect()}
    assert got == {(c, k): parses(t) for c, k, t in tables("conversations", "conv_id", "turn", "text")}


@pytest.mark.parametrize("name", ["sequence_packing", "prefix_rollup", "train_val_split", "rank_shards"])
def test_partitions_do_not_matter(spark, name):
    rows = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(plain(map(tuple, catalogue.QUERIES[name](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows[0] == rows[1]
