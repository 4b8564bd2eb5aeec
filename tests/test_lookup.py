import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lectern import canon
from lectern.functions import numerals
from lectern.functions.text import cleaned, escaped
from lectern.operators import corpus, detect, ingest, lookup, metrics, phrases, resolver, scan, sessions
from lectern.sources import files
from lectern.streaming import session


def cases():
    text = (Path(__file__).parents[1] / "FIXTURES.md").read_text()
    for number, raw, expected in re.findall(r"^\| (\d+) \| `(.*?)` \| (.*?) \|$", text, re.M):
        want = (None,) * 4 if expected == "null" else tuple(None if x == "null" else x for x in expected.split(", "))
        yield int(number), raw.replace("\\u3000", "　"), want


def test_names():
    assert len(canon.BOOKS) == 66 and len(canon.ALIASES) == 369


def test_typed_references(spark):
    rows = list(cases())
    assert len(rows) == 63
    df = lookup.parsed(spark.createDataFrame([(n, raw) for n, raw, _ in rows], "n int, raw string"))
    got = {r["n"]: tuple(None if r[c] is None else str(r[c]) for c in ("abbrev", "ch", "v1", "v2")) for r in df.collect()}
    assert got == {n: want for n, _, want in rows}


@pytest.fixture(scope="module")
def small(spark):
    ko = spark.createDataFrame([("gn", [["k1", "k2"]])], files.SOURCE)
    en = spark.createDataFrame([("gn", [["e1", "e2", "e3"]])], files.SOURCE)
    return corpus.from_records(corpus.merged(ko, en)).cache()


@pytest.mark.parametrize(
    "raw, nums, status, label",
    [
        ("gen 1", [1, 2, 3], "ok", "Genesis 1"), ("gen 1:2", [2], "ok", "Genesis 1:2"), ("gen 1:2-99", [2, 3], "ok", "Genesis 1:2–99"),
        ("gen 1:3-2", [], "not_found", "gn 1:3"), ("gen 1:4", [], "not_found", "gn 1:4"), ("gen 1:0", [1, 2, 3], "ok", "Genesis 1"),
        ("gen 1:0-2", [1, 2], "ok", "Genesis 1"), ("gen 1:1-0", [1], "ok", "Genesis 1:1"), ("gen 0", [], "not_found", "gn 0"), ("gen 2:1", [], "not_found", "gn 2:1"),
        ("ex 1:1", [], "not_found", "ex 1:1"), ("  ", [], "noop", None), ("x", [], "bad_format", None),
    ],
)
def test_resolving(spark, small, raw, nums, status, label):
    refs = spark.createDataFrame([(1, raw)], "k int, raw string")
    assert sorted(r["num"] for r in lookup.verses_of(lookup.parsed(refs), small).collect()) == nums
    assert lookup.with_status(refs, small, "k").first()[2:] == (status, label)


def test_merge_and_script(spark, small, tmp_path):
    ko = spark.createDataFrame([("gn", [["a"]]), ("xx", [["z"]])], files.SOURCE)
    en = spark.createDataFrame([("gn", [["b"], ["c"]])], files.SOURCE)
    records = corpus.merged(ko, en)
    first = records.first()
    assert records.count() == 66 and first["c"] == [[["a"], ["b"]], [[], ["c"]]] and records.where("size(c) = 0").count() == 65
    meta = spark.createDataFrame([("t", ["ko", "en"], {"ko": "K"})], "title string, langs array<string>, names map<string,string>")
    files.write_script(records, meta, str(tmp_path / "s"))
    text = next((tmp_path / "s").glob("*.txt")).read_text()
    assert text.startswith('window.BIBLE_DATA = {\n"meta":{"title":"t"') and text.endswith("]};\n") and len(text.splitlines()) == 70
    back, meta_back = files.read_script(spark, str(tmp_path / "s"))
    assert back.count() == 66 and meta_back.first()["names"] == {"ko": "K"}
    assert files.read_any_script(spark, str(tmp_path / "s")).where("a = 'gn'").first()["c"] == first["c"]


def test_long_books_are_rows_of_parts(spark, tmp_path, monkeypatch):
    """A book of more chapters than a part holds goes through merging, script, combined and separate files in rows of parts, written by several tasks, and comes back whole."""
    monkeypatch.setattr(corpus, "PART", 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ko = [("gn", [[f"k{c}.{v}" for v in range(c % 3)] for c in range(11)]), ("ex", [["a"]] * 4), ("lv", [])]
        en = [("gn", [[f"e{c}"] for c in range(6)]), ("ex", [["b"]] * 9), ("zz", [["n"]])]
        records = corpus.merged(*(spark.createDataFrame(s, files.SOURCE) for s in (ko, en)))
        assert records.agg(F.max(F.size("c"))).first()[0] == 4 and records.where("a = 'gn'").count() == 3 and records.where("a = 'lv' and size(c) = 0").count() == 1
        meta = spark.createDataFrame([("t", ["ko", "en"], {"ko": "K"})], "title string, langs array<string>, names map<string,string>")
        files.write_script(records, meta, str(tmp_path / "s"))
        written = sorted((tmp_path / "s").glob("*.txt"))
        whole = "".join(p.read_text() for p in written)
        import json

        books = json.loads(whole.split("=", 1)[1].rstrip().rstrip(";"))["books"]
        assert len([p for p in written if p.stat().st_size]) > 1 and len(books) == 66 + 2 + 2 and [b.get("at", 1) for b in books if b["a"] == "gn"] == [1, 5, 9]
        want = {("gn", c + 1, v + 1, f"k{c}.{v}" if v < c % 3 else "", f"e{c}" if v < 1 and c < 6 else "") for c in range(11) for v in range(max(c % 3, c < 6))}
        want |= {("ex", c, 1, "a" if c < 5 else "", "b") for c in range(1, 10)}
        plain = lambda rows: {tuple(r) for r in rows.collect()}
        assert plain(corpus.from_records(files.read_script(spark, str(tmp_path / "s"))[0])) == want
        records.drop("ord").write.json(str(tmp_path / "c"))
        assert plain(corpus.from_records(files.build(spark, combined=str(tmp_path / "c"), lines=True)[0])) == want
        for name, rows in (("ko", ko), ("en", en)):
            (tmp_path / f"{name}.json").write_text(json.dumps([{"abbrev": a, "chapters": c} for a, c in rows]))
            corpus.to_chapters(corpus.long_form(spark.createDataFrame(rows, files.SOURCE))).write.json(str(tmp_path / f"{name}_lines"))
        for paths, lines in (({n: str(tmp_path / f"{n}.json") for n in ("ko", "en")}, False), ({n: str(tmp_path / f"{n}_lines") for n in ("ko", "en")}, True)):
            assert plain(corpus.from_records(files.build(spark, **paths, lines=lines)[0])) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_line_sources(spark, tmp_path):
    import zipfile

    (tmp_path / "a").mkdir()
    text = "﻿GEN 1:1 In [the]  ¶ start\nnone\nTOB 1:1 x\nGEN 2:1 b\nGEN 1:2 c\n"
    with zipfile.ZipFile(tmp_path / "a/x.zip", "w") as z:
        z.writestr("note.txt", "no")
        z.writestr("e_vpl.txt", text)
    lines = files.read_lines(spark, str(tmp_path / "a")).drop("path")
    got = sorted(tuple(r) for r in ingest.ingested(lines, whole_canon=False).collect())
    assert got == [("gn", 1, 1, "In the start"), ("gn", 1, 2, "c"), ("gn", 2, 1, "b")]
    with pytest.raises(ValueError, match="missing book Exodus"):
        ingest.ingested(lines)
    bad = spark.createDataFrame([(1, "GEN 1:1 a"), (2, "GEN 1:3 c")], "line_no int, value string")
    with pytest.raises(ValueError, match="GEN 1:3"):
        ingest.ingested(bad)


def test_scanner(spark):
    rows = [("x/nkjv_a.txt", "sig", 2_000_000), ("Nkjv_a.txt", "", 1), ("notes.bak", "", 1), ("a.txt", "sig one, sig two", 1_048_576), ("b.txt", "", 1_048_577), ("data/sample/a.txt", "sig one", 2_000_000), ("u", None, None)]
    texts = spark.createDataFrame(rows, "path string, text string, length long")
    signatures = spark.createDataFrame([("sig one",), ("sig two",)], "signature string")
    found = sorted(tuple(r) for r in scan.violations(texts, signatures).collect())
    want = [("a.txt", "signature", "sig one"), ("a.txt", "signature", "sig two"), ("b.txt", "size", "1048577"), ("data/sample/a.txt", "signature", "sig one"), ("notes.bak", "name", ""), ("u", "size", "unreadable"), ("x/nkjv_a.txt", "name", "")]
    assert found == want
    texts = spark.createDataFrame([("1", "xthe big  house.y"), ("2", "the big house"), ("3", "a big  house"), ("4", None), ("5", "one")], "path string, text string")
    signatures = spark.createDataFrame([("the big  house.",), ("big house",), ("one",), ("",), (None,)], "signature string")
    assert sorted((r[0], r[2]) for r in scan.by_signature(texts, signatures).collect()) == [("1", "the big  house."), ("2", "big house"), ("5", "one")]


@pytest.mark.parametrize("most", [scan.MOST_GRAMS, 10])
def test_signatures_of_any_length_and_script(spark, monkeypatch, most):
    """Against plain search: signatures of one to eighty characters, Korean, pairs of words, characters beyond 16 bits, frequent words, repeats of one character; grams broadcast or joined."""
    import random

    monkeypatch.setattr(scan, "MOST_GRAMS", most)
    rng = random.Random(6)
    words = ["the", "the", "the", "태초에", "하나님이", "a", "\U0001f600b", "light", "aaaa", "x\ny"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(60)] + ["", None, "a" * 3000, "태초에"]
    whole = [t for t in texts if t]
    signatures = ["the the", "하나님이 a", "태초에", "\U0001f600", "\U0001f600b", "a", "zz", "", None, "the", "a" * 80, "the the"]
    for _ in range(120):
        t = rng.choice(whole)
        at = rng.randrange(len(t))
        part = t[at : at + rng.randrange(1, 80)]
        signatures.append(part if rng.random() < 0.7 else part + "q")
    files_ = spark.createDataFrame(list(enumerate(texts)), "path int, text string")
    got = [(r["path"], r["detail"]) for r in scan.by_signature(files_, spark.createDataFrame([(s,) for s in signatures], "signature string")).collect()]
    want = {(i, s) for i, t in enumerate(texts) if t for s in signatures if s and s in t}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500
    none = scan.by_signature(files_, spark.createDataFrame([("",), (None,)], "signature string"))
    assert none.columns == ["path", "kind", "detail"] and none.count() == 0


def test_a_frequent_phrase_is_no_anchor(spark):
    """Of a signature's runs those that few texts hold are joined, though its first words are in every text."""
    texts = spark.createDataFrame([(i, f"in the beginning of the day {i} was and ever will be here") for i in range(50)] + [(50, "in the beginning of the day quartz mining was done")], "path int, text string")
    grams = scan.grams_of(spark.createDataFrame([("in the beginning of the day quartz mining was",)], "signature string"))
    blocks = scan.blocks_of(texts, [16])
    seen = blocks.join(grams.select("gram").distinct(), "gram").groupBy("gram").agg(F.count("*").alias("n"))
    assert seen.agg(F.max("n")).first()[0] == 51
    anchors = scan.anchors_of(grams, seen, [16])
    assert anchors.count() == 16 and blocks.join(anchors, "gram").select("path").distinct().count() == 1


def test_text_functions(spark):
    df = spark.createDataFrame([("a<b & \"c\">", "[x]  ¶y ")], "a string, b string")
    assert df.select(escaped(F.col("a")), cleaned(F.col("b"))).first()[:] == ('a&lt;b &amp; "c"&gt;', "x y")


def test_numerals(spark):
    rows = [(n, numerals.korean(n), numerals.english(n)) for n in range(1, 1000)]
    df = spark.createDataFrame(rows, "n int, ko string, en string")
    assert df.where((numerals.korean_value(F.col("ko")) != F.col("n")) | (numerals.english_value(F.col("en")) != F.col("n"))).count() == 0
    said = spark.createDataFrame([("John three sixteen",), ("Psalm one hundred nineteen verse one hundred five",), ("the twenty third Psalm",)], "t string")
    assert [r[0] for r in said.select(detect.english_numbers(F.col("t"))).collect()] == ["John 3 16", "Psalm 119 verse 105", "the 23 Psalm"]


def test_spoken_forms(spark):
    rows = [("요한복음 삼 장 십육 절", "jo", 3, 16, None), ("시편 백십구 편 백오 절", "ps", 119, 105, None), ("요한복음3장16절", "jo", 3, 16, None), ("로마서 8장", "rm", 8, None, None), ("요한복음 3장 16절부터 18절까지", "jo", 3, 16, 18), ("요한 일서 1:9", "1jo", 1, 9, None), ("John chapter 3 verse 16", "jo", 3, 16, None), ("1 Corinthians 13", "1co", 13, None, None), ("했어요 3", None, None, None, None), ("3장짜리 편지", None, None, None, None)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "k int, text string")
    got = {r["k"]: tuple(r)[1:] for r in detect.detected(df, "k").select("k", "abbrev", "ch", "v1", "v2").collect()}
    assert got == {i: r[1:] for i, r in enumerate(rows) if r[1]}


SPEECH = [
    # text, the references in it as (book, chapter, verse, end)
    ("요한복음 3장 16절", ["jo 3 16"]), ("요한복음 삼 장 십육 절", ["jo 3 16"]), ("시편 백십구 편 백오 절", ["ps 119 105"]), ("요한복음3장16절", ["jo 3 16"]), ("요한복음 3:16", ["jo 3 16"]),
    ("시편 23편", ["ps 23"]), ("시편 23편 1절", ["ps 23 1"]), ("로마서 8장", ["rm 8"]), ("요한복음 3장 16절부터 18절까지", ["jo 3 16 18"]), ("요한복음 3장 16절에서 18절", ["jo 3 16 18"]),
    ("요한복음 3장 16~18절", ["jo 3 16 18"]), ("요한복음 3장 16 내지 18절", ["jo 3 16 18"]), ("요한복음 3장 1절과 3절", ["jo 3 1", "jo 3 3"]), ("요한복음 3장 16, 17절", ["jo 3 16", "jo 3 17"]),
    ("고린도전서 13장", ["1co 13"]), ("고린도 전서 13장", ["1co 13"]), ("요한일서 1장", ["1jo 1"]), ("요한 1서 1장 9절", ["1jo 1 9"]), ("요한 일서 1:9", ["1jo 1 9"]), ("요한복음을 3장", ["jo 3"]), ("로마서에서 8장에", ["rm 8"]),
    ("요한이 말했다", []), ("마가가 말했다", []), ("누가 왔습니까", []), ("3장짜리 편지", []), ("2절기", []), ("했어요 3", []),
    ("John 3:16", ["jo 3 16"]), ("John 3 16", ["jo 3 16"]), ("John three sixteen", ["jo 3 16"]), ("John chapter three verse sixteen", ["jo 3 16"]), ("Psalm one hundred nineteen verse one hundred five", ["ps 119 105"]),
    ("the twenty third Psalm", ["ps 23"]), ("the third chapter of John", ["jo 3"]), ("First Corinthians 13", ["1co 13"]), ("1 Corinthians 13", ["1co 13"]), ("First John 1 9", ["1jo 1 9"]), ("John 1 9", ["jo 1 9"]),
    ("John 3 verses 16 through 18", ["jo 3 16 18"]), ("John 3, 16 to 18", ["jo 3 16 18"]), ("John said", []), ("Mark wrote", []),
    ("요한 3장 16절", ["jo 3 16"]), ("마가 3장", ["mk 3"]), ("누가 3장 1절", ["lk 3 1"]), ("요한복음 3장 16절에서 4장 2절까지", ["jo 3 16 4:2"]), ("요한복음 3장 16절부터 4장 2절까지", ["jo 3 16 4:2"]), ("John 3:16-4:2", ["jo 3 16 4:2"]),
    ("요한복음 3장 16절 17절", ["jo 3 16", "jo 3 17"]), ("요한복음 3장 16절, 4장 2절", ["jo 3 16"]), ("마가 3장짜리 편지", []), ("요한복음 3장 2절기", ["jo 3"]),
    ("John, chapter 3, verse 16", ["jo 3 16"]), ("John, chapter three, verse sixteen", ["jo 3 16"]), ("the third chapter of the book of Romans", ["rm 3"]), ("Luke 2:1, 4 and 6", ["lk 2 1", "lk 2 4", "lk 2 6"]),
    ("John 3 verses 16 and 18", ["jo 3 16", "jo 3 18"]), ("John 3:16, 4:2", ["jo 3 16", "jo 4 2"]), ("John 3:16 and 1 Corinthians 13", ["jo 3 16", "1co 13"]), ("John 3:16, 2 Peter 1:1", ["jo 3 16", "2pe 1 1"]),
    ("John 3 verse 16 through chapter 4 verse 2", ["jo 3 16 4:2"]), ("one hundred and nineteen Psalm", ["ps 119"]), ("Second Kings twenty-two", ["2kgs 22"]), ("Acts 2:38 and Acts 2:38", ["act 2 38", "act 2 38"]),
]


def test_every_spoken_form(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SPEECH)], "k int, text string")
    got = {i: [] for i in range(len(SPEECH))}
    for r in detect.detected(df, "k").orderBy("k", "start", "item").collect():
        got[r["k"]].append(" ".join(str(x) for x in (r["abbrev"], r["ch"], r["v1"], r["ch2"] and f"{r['ch2']}:{r['v2']}" or r["v2"]) if x is not None))
    assert [got[i] for i in range(len(SPEECH))] == [want for _, want in SPEECH]
    both = spark.createDataFrame([(0, "xActs 2:38, Acts 2:38; Acts 2:38")], "k int, text string")
    assert [r["start"] for r in detect.detected(both, "k").orderBy("start").collect()] == [13, 24]


PLACES = [
    # text, what is highlighted in it
    ("오늘은 요한복음 삼 장 십육 절 말씀입니다", "요한복음 삼 장 십육 절"), ("자, 시편  백십구 편 백오 절을", None), ("시편 백십구 편 백오 절을 보면", "시편 백십구 편 백오 절"), ("a，요한복음 3 ： 16 입니다", "요한복음 3 ： 16"),
    ("요한복음 3장 16절 부터 18절 까지 읽겠습니다", "요한복음 3장 16절 부터 18절 까지"), ("then John three sixteen he said", "John three sixteen"), ("twenty two people read Psalm one hundred and nineteen verse one hundred five today", "Psalm one hundred and nineteen verse one hundred five"),
    ("John, chapter three, verse sixteen through eighteen.", "John, chapter three, verse sixteen through eighteen"), ("\x01\x02 First John 1 colon 9!", "First John 1 colon 9"), ("삼 장 이 절 그리고 로마서 팔 장", "로마서 팔 장"),
]


def test_places_in_the_original(spark):
    """Number words, marks and spaces are rewritten before detection; what is found is shown in the text as it was said."""
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PLACES)] + [(99, None)], "k int, text string")
    got = detect.detected(df, "k").where("item = 0").join(df.withColumnRenamed("k", "k2").withColumnRenamed("text", "t"), F.col("k") == F.col("k2"))
    rows = {r["k"]: r for r in got.collect()}
    assert set(rows) == {i for i, (_, want) in enumerate(PLACES) if want}
    for i, r in rows.items():
        assert r["matched"] == PLACES[i][1] == PLACES[i][0][r["start"] - 1 : r["end"]]


def test_maps_of_rewritings_compose(spark):
    """Every character that no step changes is found where it was, through three steps of other lengths, deletions and insertions among them."""
    from lectern.operators import rewrites

    steps = [("b+", lambda x: F.lit("BB")), ("c", lambda x: F.lit("")), ("BBd", lambda x: F.lit("longer"))]
    texts = ["abbbcdXc", "Xbbd", "cccX", "bdbdX", "", "X"]
    state = rewrites.begun(F.col("t"))
    for pattern, new in steps:
        state = rewrites.step(state, pattern, new)
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", "t", state.alias("s"))
    at = F.instr(F.col("s.text"), "X")
    rows = df.select("t", "s.text", rewrites.original(F.col("s.maps"), at).alias("x"), rewrites.original(F.col("s.maps"), F.lit(2)).alias("first"), rewrites.original(F.col("s.maps"), F.lit(3), last=True).alias("last")).collect()
    assert [r["text"] for r in rows] == ["alongerX", "Xlonger", "X", "longerlongerX", "", "X"]
    assert all(r["t"][r["x"] - 1] == "X" for r in rows if "X" in r["t"])
    assert (rows[0]["first"], rows[0]["last"]) == (2, 6)  # the whole change, over what was deleted within it


def test_relative_phrases(spark):
    said = ["17절", "17절 말씀", "다음 절", "그 다음 절", "이어서", "앞 절", "다음 장", "4장으로 넘어가서", "같은 장 20절", "같은 장 뒷부분 20절", "다시 16절로", "verse 17", "next verse", "the following verse", "previous verse", "back to verse 5", "2절기", "3장짜리 편지", "요한복음 3장 16절"]
    want = [("verse", 17), ("verse", 17), ("next", None), ("next", None), ("next", None), ("previous", None), ("next_chapter", None), ("chapter", 4), ("same_chapter", 20), ("same_chapter", 20), ("return", 16), ("verse", 17), ("next", None), ("next", None), ("previous", None), ("return", 5), None, None, None]
    texts = spark.createDataFrame(list(enumerate(said)), "k int, text string")
    got = {r["k"]: (r["kind"], r["n"]) for r in phrases.mentioned(texts, "k").collect()}
    assert [got.get(i) for i in range(len(said))] == want
    catalog = corpus.neighbours(spark.createDataFrame([("jo", 3, v) for v in range(15, 18)] + [("jo", 4, 1)], "abbrev string, ch int, v int"))
    context = spark.createDataFrame([(i, "jo", 3, 17 if i == 2 else 16) for i in range(len(said)) if i != 3], "k int, abbrev string, ch int, v int")
    hits, misses = phrases.resolved(texts, "k", context, catalog)
    found = {r["k"]: (r["to_ch"], r["to_v"], r["rolled_over"], r["confidence"]) for r in hits.collect()}
    assert found[0] == (3, 17, False, 0.6) and found[2] == (4, 1, True, 0.4) and found[5] == (3, 15, False, 0.6) and found[6] == found[7] == (4, 1, False, 0.6)
    assert {r["k"]: r["reason"] for r in misses.collect()} == {3: "no_context", 8: "not_there", 9: "not_there", 15: "not_there"}


def test_build_and_view(spark, tmp_path):
    (tmp_path / "ko.json").write_text('[{"abbrev": "gn", "chapters": [["old"]]}, {"abbrev": "gn", "chapters": [["k"]]}]')
    (tmp_path / "en.json").write_text('[{"abbrev": "gn", "chapters": [["a"], ["b"]]}]')
    (tmp_path / "both.json").write_text('[{"a": "gn", "en": "Genesis", "ko": "K", "c": [[["x"], ["y"]]]}]')
    records, meta = files.build(spark, ko=f"{tmp_path}/ko.json", en=f"{tmp_path}/en.json", en_name="E")
    assert records.first()["c"] == [[["k"], ["a"]], [[], ["b"]]] and meta.first()["names"] == {"ko": files.NAMES["ko"], "en": "E"}
    assert [r["a"] for r in files.build(spark, combined=f"{tmp_path}/both.json", ko="x", en="y")[0].collect()] == ["gn"]
    with pytest.raises(ValueError, match="combined"):
        files.build(spark, ko="only")
    one = spark.createDataFrame([("t", ["en"], {"en": "E"}, True), ("u", ["ko"], {}, None)], files.META_SCHEMA.rsplit(",", 1)[0])
    assert [tuple(r) for r in corpus.view(one).collect()] == [("t", True, "en", "", "E"), ("u", False, "ko", "", "")]
    verses = spark.createDataFrame([("gn", 1, 1, "", "a<b")], "abbrev string, ch int, v int, ko string, en string")
    assert corpus.rendered(verses, ["ko"]).columns == ["abbrev", "ch", "v", "ko_html", "ko_empty"]
    assert lookup.with_status(spark.createDataFrame([(1, "gen 1")], "k int, raw string"), verses, "k", loaded=False).first()["status"] == "loading"
    (tmp_path / "cases.jsonl").write_text('{"input": "요 3:16", "lang": "ko", "expected": "jo 3 16"}\n')
    assert files.read_cases(spark, f"{tmp_path}/cases.jsonl").first()["expected"] == "jo 3 16"
    import zipfile

    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("a.txt", "x")
    with pytest.raises(Exception, match="no member that ends in _vpl.txt"):
        files.read_lines(spark, f"{tmp_path}/none.zip").collect()
    (tmp_path / "plain.txt").write_bytes(b"\xef\xbb\xbfGEN 1:1 a\r\nGEN 1:2 b")
    assert [tuple(r)[1:] for r in files.read_lines(spark, f"{tmp_path}/plain.txt").collect()] == [(1, "GEN 1:1 a"), (2, "GEN 1:2 b")]
    assert files.read_files(spark, f"{tmp_path}/plain.txt").first()["length"] == 23


def test_resolver_gate(spark):
    texts = spark.createDataFrame([(1, "let's read John"), (2, "John 3:16 말씀"), (3, "turn to John 3:16 or Mark 1:1"), (4, "nothing")], "key long, text string")
    rules = detect.detected(texts, "key").select("key", "abbrev", "ch", F.col("v1").alias("v"))
    assert sorted(r["key"] for r in resolver.asked(texts, rules).collect()) == [1, 3]
    catalog = spark.createDataFrame([("jo", 3, 16), ("mk", 1, 1)], "abbrev string, ch int, v int")

    class Guess:
        def resolve(self, segments, context, rule_candidates):
            return segments.select("key", F.lit("jo").alias("abbrev"), F.lit(3).alias("ch"), F.explode(F.array(F.lit(16), F.lit(99))).alias("v"))

    assert resolver.answered(resolver.NullResolver(), texts, rules, catalog).where("source = 'llm'").count() == 0
    got = sorted((r["key"], r["v"], r["source"]) for r in resolver.answered(Guess(), texts, rules, catalog).where("abbrev = 'jo'").collect())
    assert got == [(1, 16, "llm"), (2, 16, "rule"), (3, 16, "rule")]


def test_percentiles_are_exact(spark):
    import random
    import statistics

    rng, rows = random.Random(1), []
    for k in range(4):
        rows += [(k, rng.choice([rng.random(), 0.5, 7.0])) for _ in range((1, 2, 301, 1000)[k])]
    df = spark.createDataFrame([*rows, (9, None)], "k int, x double")
    got = {r["k"]: r for r in metrics.percentiles(df, "k", "x", [0.5, 0.95, 1.0], steps=8).collect()}
    for k in range(4):
        own = sorted(x for i, x in rows if i == k)
        at = 0.95 * (len(own) - 1)
        assert got[k]["n"] == len(own) and got[k]["p0"] == pytest.approx(statistics.median(own)) and got[k]["p2"] == own[-1]
        assert got[k]["p1"] == pytest.approx(own[int(at)] + (at - int(at)) * (own[min(len(own) - 1, int(at) + 1)] - own[int(at)]))
    assert set(got) == set(range(4)) and "| n |" in metrics.report({"Counts": df.agg(F.count("*").alias("n"))})


def test_one_to_one_matching_is_the_largest(spark):
    """Against the largest matching by augmenting paths: crowded times, two sessions, repeated times, nulls; each candidate serves one label."""
    import random

    rng = random.Random(4)
    rows = [[(rng.choice([1, 1, 2]), rng.choice(["a", "b"]), rng.randrange(300), i) for i in range(n)] for n in (70, 90)]
    frame = lambda r: spark.createDataFrame([*r, (None, "a", 5, 900), (1, None, 5, 901)], "session int, ref string, t long, id int").withColumn("ts", F.timestamp_seconds("t"))
    got = metrics.one_to_one(frame(rows[0]), frame(rows[1]), 5).collect()
    near = {a[3]: [b[3] for b in rows[1] if a[:2] == b[:2] and abs(a[2] - b[2]) <= 5] for a in rows[0]}
    taken: dict = {}

    def placed(a, seen):
        for b in near[a]:
            if b not in seen:
                seen.add(b)
                if b not in taken or placed(taken[b], seen):
                    taken[b] = a
                    return True
        return False

    most = sum(placed(a, set()) for a in near)
    pairs = {(r["id"], r["other"]) for r in got if r["side"] == "label" and r["other"] is not None}
    assert len(pairs) == most == len({b for _, b in pairs}) and all(b in near[a] for a, b in pairs) and most > 30
    assert pairs == {(r["other"], r["id"]) for r in got if r["side"] == "candidate" and r["other"] is not None} and len(got) == 164
    score = metrics.scored(spark.createDataFrame(got).withColumn("mode", F.lit("m")), ["mode"]).first()
    assert (score["tp"], score["fn"], score["fp"]) == (most, 72 - most, 92 - most)


def test_throttle_counts_from_the_last_emission(spark):
    rows = [(1, "r", i, t) for i, t in enumerate((0, 20, 40, 55, 75, 1000))]
    df = spark.createDataFrame(rows, "s int, ref string, id int, t long").withColumn("ts", F.timestamp_seconds("t"))
    out = {r["id"]: r["emitted"] for r in sessions.throttled(df, ["s", "ref"], "ts", "id", 30).collect()}
    assert [out[i] for i in range(6)] == [True, False, True, False, True, True]
    gaps = {r["id"]: r["suppressed"] for r in sessions.since_last(df, ["s", "ref"], "ts", "id", 30).collect()}
    assert [gaps[i] for i in range(6)] == [False, True, True, True, True, False]


def test_context_of_one_hot_session_over_several_tasks(spark):
    """A scan over slices equals a plain loop: one session holds most events, displays and clears in any slice, equal times, null sessions."""
    import random

    rng = random.Random(2)
    rows = [(1 if i % 4 else rng.choice([2, 3, None]), i, rng.randrange(400), rng.choice(["show", "clear", "none", "none", "none"])) for i in range(800)]
    df = spark.createDataFrame(rows, "s int, id int, t long, kind string").withColumn("ts", F.timestamp_seconds("t"))
    out = sessions.with_context(df, "s", "ts", "id", F.when(F.col("kind") == "show", F.col("id")), F.col("kind") == "clear", slices=8)
    want, shown = {}, {}
    for s, i, t, kind in sorted(rows, key=lambda r: (r[2], r[1])):
        want[i] = shown.get(s)
        if kind != "none":
            shown[s] = i if kind == "show" else None
    assert {r["id"]: r["context"] for r in out.collect()} == want and out.columns == [*df.columns, "context"]
    parts = sessions.sliced(df.withColumn("at", F.unix_micros("ts")), "at", 8).where("s = 1").groupBy("__slice").count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 150


@pytest.mark.parametrize("chain", [5, 10_000])
def test_throttle_of_one_key_that_holds_all_events(spark, chain):
    """Long chains by doubling pointers, short ones in order: both equal a plain loop; equal times among them."""
    import random

    rng = random.Random(3)
    rows = [(1 if i % 5 else rng.choice([2, None]), i, rng.randrange(3000) if i % 7 else rng.randrange(10**6)) for i in range(600)]
    df = spark.createDataFrame(rows, "s int, id int, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["id"]: r["emitted"] for r in sessions.throttled(df, ["s"], "ts", "id", 30, slices=6, chain=chain).collect()}
    want, last = {}, {}
    for s, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        want[i] = s not in last or t - last[s] >= 30
        if want[i]:
            last[s] = t
    assert got == want and sum(want.values()) > 80


def test_verse_after_the_last_is_the_next_chapters_first(spark):
    verses = spark.createDataFrame([("gn", 1, 1), ("gn", 1, 2), ("gn", 2, 1)], "abbrev string, ch int, v int")
    catalog = corpus.neighbours(verses)
    asked = spark.createDataFrame([("gn", 1, 2, "next", None), ("gn", 1, 1, "previous", None), ("gn", 2, 1, "next", None), (None, None, None, "next", None), ("gn", 2, 1, "previous", None)], "abbrev string, ch int, v int, kind string, n int")
    assert [tuple(r)[-3:] for r in sessions.relative(asked, catalog).collect()] == [(2, 1, True)]


def plain_messages(rows, seconds):
    """What a console and its displays are told of one session's events (event_id, micros, kind, ref, final)."""
    out, shown, listed = [], None, []
    for event_id, at, kind, ref, final in sorted(rows, key=lambda r: (r[1], r[0])):
        if kind == "mention":
            own = [c for c in listed if c[0] == ref and at - c[1] < seconds * 10**6]
            if not own:
                listed = [[ref, at, final, event_id]] + listed[:4]
                out.append((event_id, "candidates", ref, event_id, final, 1))
            elif final and not own[0][2]:
                own[0][2] = True
                out.append((event_id, "candidates", ref, own[0][3], True, listed.index(own[0]) + 1))
        elif kind == "clear":
            shown, listed = None, []
            out.append((event_id, "clear", None, None, None, None))
        else:
            chosen = listed[ref - 1] if kind == "select" and ref <= len(listed) else None
            if (kind == "select" and not chosen) or (kind == "next" and shown is None):
                continue
            shown = chosen[0] if chosen else shown + 1 if kind == "next" else ref
            out += [(event_id, t, shown, chosen and chosen[3], chosen and chosen[2], None) for t in ("context", "show")]
    return out


@pytest.mark.parametrize("splits", [1, 3])
def test_messages_are_those_of_a_plain_replay(spark, tmp_path, splits):
    """Interim and final segments under one id, suppression, selection, next verse, clear; the same in one batch and over restarts."""
    import hashlib
    import random

    rng, rows = random.Random(5), []
    for i in range(600):
        kind = rng.choice(["mention"] * 6 + ["select", "display_ref", "next", "clear"])
        ref = None if kind in ("clear", "next") else rng.randrange(1, 5)
        rows.append((rng.randrange(4), i, (i + 1) * 7 * 10**6, kind, ref, rng.random() < 0.5))
    schema = "session long, event_id long, micros long, kind string, ref long, final boolean"
    for k in range(splits):
        part = rows[k * 600 // splits : (k + 1) * 600 // splits]
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_micros("micros")).drop("micros").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("session long, event_id long, kind string, ref long, final boolean, ts timestamp").parquet(f"{tmp_path}/in")
        got = session.drained(spark, session.messages(stream, 30), f"{tmp_path}/out")
    want = []
    for s in range(4):
        for event_id, kind, ref, first, final, place in plain_messages([r[1:] for r in rows if r[0] == s], 30):
            name = None if first is None else next(hashlib.sha256(f"{s}|{c}|{first}".encode()).hexdigest() for c in [next(r[4] for r in rows if r[1] == first)])
            want.append((s, event_id, kind, ref, name, None if first is None else "confirmed" if final else "tentative", place))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("span, held", [(4096, 100_000), (4, 100_000), (4096, 3), (2, 2)])
def test_one_to_one_matching_across_slices_and_batches(spark, span, held):
    """Runs that end in a slice, go over its edge or are too long to be held give what reading each session and reference in order of time gives."""
    import random

    rng = random.Random(span)
    rows = [[(rng.choice([1, 2]), rng.choice(["a", "b", "c"]), rng.randrange(-900, 1500) if rng.random() < 0.8 else rng.randrange(40), i) for i in range(400)] for _ in range(2)]
    frame = lambda r: spark.createDataFrame([*r, (1, "a", None, 900), (None, None, None, 901)], "session int, ref string, t long, id int").withColumn("ts", F.timestamp_seconds("t"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = metrics.one_to_one(frame(rows[0]), frame(rows[1]), 5, span, held).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    free, pairs = {}, set()
    for t, side, i, s, ref in sorted([(r[2], side, r[3], r[0], r[1]) for side, own in zip(("label", "candidate"), rows) for r in own]):
        mine, other = (free.setdefault((s, ref, x), []) for x in (side, "label" if side == "candidate" else "candidate"))
        other[:] = [o for o in other if t - o[0] <= 5]
        if other:
            j = other.pop(0)[1]
            pairs.add((i, j) if side == "label" else (j, i))
        else:
            mine.append((t, i))
    assert len(got) == 804 and len(pairs) > 100
    assert {(r["id"], r["other"]) for r in got if r["side"] == "label" and r["other"] is not None} == pairs
    assert {(r["other"], r["id"]) for r in got if r["side"] == "candidate" and r["other"] is not None} == pairs
    assert sorted(r["id"] for r in got if r["side"] == "label") == [*range(400), 900, 901]


def test_one_to_one_matching_reads_its_inputs_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    df = spark.range(500).select(F.lit(1).alias("session"), F.lit("a").alias("ref"), F.timestamp_seconds(F.col("id") * 7).alias("ts"), "id")
    df = df.mapInPandas(counted, df.schema)
    assert metrics.one_to_one(df, df).where("other is not null").count() == 1000 and read.value == 1000
