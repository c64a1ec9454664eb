"""Every query with SQL gives the rows of that SQL at sf 0.001."""

import duckdb
import pytest

import __spark_entry__ as entry
from factweave.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v):
    if v is None or (isinstance(v, float) and v != v):
        return "~"
    return repr(round(float(v), 5)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(map(text, r)) for r in df.select(*cols).collect())
    assert got == sorted(tuple(map(text, r)) for r in duck.sql(f"select {', '.join(cols)} from ({ORACLE[name]})").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rich_post_cases(spark, tmp_path):
    """Posts made to be taken or refused for one reason each: the same rows as the SQL."""
    pad = "word " * 20
    taken = [pad, f"| a | b |\n|---|---|\n| 1 | 2 |\n{pad}", f"$$x$$ and $y$ {pad}", f"<u>x</u> {pad}", f"```md\n{pad}\n```", f"[a](http://b.c/d) https://x.y/z {pad}", f"a\n\n\n\nb {pad}",
             f"  | a | b |\r\n| - | - |\r\n{pad}\n| x | y |\n|:-:|-|", f"<details ><summary>q</summary></details> {pad}", f"<U>x</u> {pad}"]
    refused = [f"| a | b |\n| 1 | 2 |\n{pad}", f"| a | b |\n{pad}", f"| a | b |\n|---|---|\n| 1 |\n{pad}", f"|a|b|c|d|e|f|g|\n|-|-|-|-|-|-|-|\n{pad}", f"$x {pad}", f"<u>x {pad}", f"<b>x</b> {pad}", f"<sub>x</sup> {pad}",
               f"Sorry, no {pad}", None, "", f"\\$ {pad}", "z" * 6001]
    folder = str(tmp_path)
    spark.createDataFrame(list(enumerate(taken + refused)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    got = sorted(map(tuple, QUERIES["rich_post"](spark, folder).select("doc_id", "text").collect()))
    own = duckdb.connect()
    own.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    assert [r[0] for r in got] == list(range(len(taken)))
    assert got == sorted(own.sql(f"select doc_id, text from ({ORACLE['rich_post']})").fetchall())
