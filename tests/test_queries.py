import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for name in os.listdir(DATA):
        db.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return db


def plain(rows):
    return sorted(tuple(str(round(x, 9)) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, tables, name):
    df, sql = entry.queries()[name](spark, DATA), tables.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(sql.columns)
    columns = sorted(df.columns)
    assert plain(df.select(*columns).collect()) == plain(sql.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.fixture(scope="module")
def many_chapters(spark, tmp_path_factory):
    """One source of so many documents that a chapter's first line number is more than an int holds."""
    folder = str(tmp_path_factory.mktemp("many"))
    spark.range(1, 21_501).selectExpr("id AS doc_id", "'src0' AS source", "'en' AS lang", "concat('one\n two ', id, '\nthree') AS text").write.parquet(f"{folder}/documents.parquet")
    return folder


def test_line_numbers_of_many_chapters(spark, many_chapters):
    rows = entry.queries()["vpl_parse"](spark, many_chapters).where("ch >= 21499").collect()
    want = [(1_000_000_000 + ch * 100_000 + v, "GEN", "gn", ch, v + (ch % 5 == 0 and v == 3), ("one", f"two {ch}", "three")[v - 1]) for ch in (21_499, 21_500) for v in (1, 2, 3)]
    assert sorted(map(tuple, rows)) == want


def test_order_check_of_many_chapters(spark, many_chapters):
    rows = entry.queries()["verse_order_check"](spark, many_chapters).select("code", "ch", "line_no", "v", "expected").collect()
    assert sorted(map(tuple, rows)) == [("GEN", ch, 1_000_000_000 + ch * 100_000 + 3, 4, 3) for ch in range(5, 21_501, 5) if ch % 11]


def test_transcripts_hold_each_sentence_of_both_modes_once(spark):
    from lectern.plans import speech

    rows = speech.transcripts(spark, DATA, speech.DIGITS).collect()
    for mode, misheard in (("said", False), ("machine", True)):
        want = [tuple(r) for r in speech.sentences(spark, DATA, speech.DIGITS, misheard).collect()]
        assert sorted((r["o_orderkey"], r["text"]) for r in rows if mode in r["modes"]) == sorted(want)
    assert len({(r["o_orderkey"], r["text"]) for r in rows}) == len(rows) < 1.25 * len(want)
