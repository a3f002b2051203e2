"""Registered queries against their SQL, and cases with known results."""


import duckdb
import pytest
from pyspark.sql import functions as F

from mailweave.functions import policy, text, xml
from mailweave.operators import threads, trimming
from mailweave.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "customer part orders lineitem events documents pages conversations".split()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = registry.queries()[name](spark, DATA)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = lambda x: sorted(x, key=repr)
    assert rows(tuple(r) for r in got.select(order).collect()) == rows(want.select(*order).fetchall())
    assert got.count()


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_scalars(spark):
    assert one(spark, text.file_name(F.lit("../../etc/pass:wd..pdf"))) == "_._etc_pass_wd.pdf"
    assert one(spark, text.file_name(F.lit("CON.txt"))) == "_CON.txt" and one(spark, text.file_name(F.lit(None).cast("string"))) == "attachment"
    assert one(spark, text.slug(F.lit("Grün & Söhne: Q3!"))) == "grün-söhne-q3" and one(spark, text.slug(F.lit("!!!"))) == "thread"
    assert one(spark, text.size_bytes(F.lit("1,5 MB"))) == 1572864 and one(spark, text.size_bytes(F.lit("x"))) is None
    assert one(spark, text.iso_time(F.lit("Sun, Jun 14, 2026 at 7:51 AM"), "America/New_York")) == "2026-06-14T11:51:00.000Z"
    assert one(spark, text.same_subject(F.lit("!!!"), F.lit("Re: !!!"))) and not one(spark, text.same_subject(F.lit(""), F.lit("")))
    assert one(spark, xml.cdata(F.lit("a]]>b"))) == "<![CDATA[a]]]]><![CDATA[>b]]>"
    assert not one(spark, policy.safe_path(F.lit("gmail-threads/../x"))) and one(spark, policy.safe_path(F.lit("gmail-threads/a/b.pdf")))


def equals_sql(spark, folder, name, table, rows):
    """Whether a query over a written table of ``rows`` gives its SQL's rows; returns them."""
    rows.write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = registry.queries()[name](spark, str(folder))
    want = con.execute(registry.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and want
    return want


def test_sizes_half_way(spark, tmp_path):
    """Sizes exactly between two tenths of MB: the query follows its SQL, the function's default the browser."""
    sizes = [*(k << 18 for k in range(4, 100)), 0, 1023, 1024, 1536, 1048575, 1572864, 10433331, 26214400]
    equals_sql(spark, tmp_path, "size_display", "lineitem", spark.createDataFrame([(k, 1, float(n)) for k, n in enumerate(sizes)], "l_orderkey long, l_linenumber int, l_extendedprice double"))
    assert one(spark, text.size_text(F.lit(5 << 18))) == "1.3 MB" and one(spark, text.size_text(F.lit(5 << 18), ties="even")) == "1.2 MB"


def test_slugs_of_texts(spark, tmp_path):
    """Line breaks between words, device names and long texts: the query follows its SQL, a folder's name does not."""
    texts = ["one\ntwo", "a\tb\x00c\x7fd", "\n", "", None, "aux", "CON", "Ünï\r\nç", "x" * 59 + "\n\nyz", "--a--", "9\n"]
    texts = [t and t.replace("\x00", "\x01") for t in texts]
    got = equals_sql(spark, tmp_path, "subject_slug", "documents", spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert dict(got)[0] == "one-two" and dict(got)[5] == "aux"
    assert one(spark, text.slug(F.lit("one\ntwo"))) == "onetwo" and one(spark, text.slug(F.lit("CON"))) == "_con"


def test_trim_texts_that_open_like_an_intro(spark, tmp_path):
    """Texts whose first word only begins with "On": the history below them goes, as in the SQL."""
    texts = ["Onè auxon.", "Onç aiti eau", "Onéuxle", "Once more", "On Monday", "Plain text  ", "Oné " * 200, None, "", "a\nb"]
    got = equals_sql(spark, tmp_path, "trim_quoted", "conversations", spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "conv_id long, turn int, text string"))
    assert {r[0]: r[2] for r in got}[0] == "Onè auxon."


def test_trim():
    assert trimming.trim("Hi\n\nOn Mon, Kim wrote:\n> old") == ("Hi", True, False)
    assert trimming.trim("Hi\n\nOn Mon, Kim wrote:\n> old\n" + "my answer " * 10 + "end")[1] is False
    assert trimming.trim("[Quoted text hidden]") == ("", True, True)
    assert trimming.trim("See below.\n\nBest regards,\nKim\nCEO") == ("See below.", True, False)
    assert trimming.trim("Ok.\n\nThanks,\nKim\nP.S. call me?")[1] is False
    assert trimming.trim("---- Forwarded message ----\nFrom: a\nSent: b")[1] is False and trimming.trim(None) == ("", False, False)


def test_names_keep_free(spark):
    rows = spark.createDataFrame([("t", i, n) for i, n in enumerate(["a.txt", "a (1).txt", "A.TXT", "a.txt"])], "t string, o int, n string")
    got = [r.target_name for r in threads.distinct_names(rows, "t", "o", "n").orderBy("o").collect()]
    assert got == ["a.txt", "a (1).txt", "A (2).TXT", "a (3).txt"]
