import random
import zlib
from urllib.parse import quote, urlparse

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import fuzzy, web
from ledgerlight.operators import clean, crawl, matching
from ledgerlight.sources import files, pdf, readers, sheets, sinks


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=repr)


# sheets, PDF, databases


def test_workbook(spark, tmp_path):
    df = spark.createDataFrame([(1, "a & <b>", ["x", "y"], None), (2, None, [], " z ")], "n int, `b c` string, l array<string>, d string")
    sinks.workbook(df, f"file://{tmp_path}/w.xlsx", 'My "sheet" & co')
    got = readers.workbook(spark, f"{tmp_path}/w.xlsx")
    assert got.columns == ["n", "b c", "l", "d"]
    assert rows(got) == [("1", "a & <b>", "x; y", None), ("2", None, "", " z ")]
    assert readers.folder(spark, f"{tmp_path}")["w.xlsx"].count() == 2
    with pytest.raises(ValueError, match="Company"):
        readers.companies(spark, f"{tmp_path}/w.xlsx")
    with pytest.raises(ValueError):
        readers.workbook(spark, f"{tmp_path}/w.csv")


def test_workbook_with_shared_texts_and_gaps():
    import io
    import zipfile

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Cover" r:id="a"/><sheet name="schedule a1" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/one.xml"/><Relationship Id="b" Target="/xl/worksheets/two.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Na</t></si><si><r><t>x</t></r><r><t>y</t></r></si></sst>")
        z.writestr("xl/worksheets/one.xml", f"<worksheet {main}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/two.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>7.5</v></c></row><row><c r="B2" t="s"><v>1</v></c></row></sheetData></worksheet>')
    got = list(sheets.rows_of(buffer.getvalue()))
    assert got[0][0] == "Na" and got[0][27] == "7.5" and len(got[0]) == 28 and got[1] == [None, "xy"]


def _pdf(text):
    shown = zlib.compress(b"BT /F1 12 Tf (" + text + b") Tj 0 -14 Td [(se) -20 (cond) -300 (line \\(x\\))] TJ ET")
    return b"%PDF-1.4\n1 0 obj <</Length 9 /Filter /FlateDecode>> stream\n" + shown + b"\nendstream endobj\n%%EOF"


def test_pdf(spark):
    docs = spark.createDataFrame([("a", bytearray(_pdf(b"H\\351llo \\\\"))), ("b", bytearray(b"none")), ("c", None)], "key string, content binary")
    got = {r.key: (r.text, r.error) for r in pdf.texts(docs, "key").collect()}
    assert got["a"] == ("Héllo \\\nsecond line (x)", None)
    assert got["b"][0] is None and "no PDF" in got["b"][1] and got["c"][0] is None
    cache = spark.createDataFrame([("x",)], "url string").select(F.sha1(F.encode("url", "UTF-8")).alias("cache_key"), F.lit("kept").alias("text"))
    both = spark.createDataFrame([("x", None), ("y", bytearray(_pdf(b"new")))], "url string, content binary")
    assert {r.text for r in pdf.cached(both, cache).collect()} == {"kept", "new\nsecond line (x)"}


def test_database_tables(spark):
    url = "jdbc:derby:memory:ledger;create=true"
    df = spark.createDataFrame([(1, "a")], "`The Key` int, v string")
    assert sinks.jdbc_table(df, url, "My Table!") == "my_table"
    sinks.jdbc_table(df, url, "My Table!", "append")
    assert readers.table_rows(spark, "my_table", url=url).count() == 2
    sinks.jdbc_table(df, url, "My Table!", "replace")
    assert rows(readers.jdbc(spark, url, 'select "the_key" + 1 as k from my_table')) == [(2,)]
    with pytest.raises(Exception, match="exists"):
        sinks.jdbc_table(df, url, "My Table!")
    with pytest.raises(ValueError):
        readers.table_rows(spark, "x; drop table y", url=url)


def test_identifiers_and_years():
    assert clean.identifier("_a1") == "_a1" and web.years_list(" 2024, 2025 2026,") == [2024, 2025, 2026] and web.years_list(" ") is None
    for bad in ("1a", "a-b", "", "é"):
        with pytest.raises(ValueError):
            clean.identifier(bad)
    with pytest.raises(ValueError):
        web.years_list("2024 x")


def test_folders(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "manifest.jsonl").write_text("{}\n")
    (tmp_path / "a").mkdir()
    assert readers.sites(spark, f"file:{tmp_path}") == (["b"], ["no manifest: a"])
    assert readers.sites(spark, f"{tmp_path}/none")[0] == [] and files.size(spark, f"{tmp_path}/b") == 3


# URLs and crawls


def test_urls_are_escaped_as_the_library_does(spark):
    urls = ["http://a.b", "http://a.b?x=a b", "HTTP://A.b//c///d é/%41{}|^`\"<>?q=[1]&r=ü#f", "http://a.b/a;b=c,d/(e)*'!$", "/only/path x", "http://a.b/?", "x y"]

    def want(url):
        p = urlparse(url)
        path = p.path or "/"
        while "//" in path:
            path = path.replace("//", "/")
        return p._replace(fragment="", path=quote(path, safe="/%:@!$&'()*+,;=-._~"), query=quote(p.query, safe="=&%:@!$'()*+,;/?-._~")).geturl()

    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r.n for r in df.select(web.normal_url("u").alias("n")).collect()] == [want(u) for u in urls]


def test_crawl_caps(spark):
    edges = spark.createDataFrame([("http://x/a", f"http://x/{k}") for k in ("b", "c", "d.pdf", "e.pdf")] + [("http://x/b", "http://x/f"), ("http://x/d.pdf", "http://x/g"), ("http://x/c", "http://x/a")], "source string, target string")
    starts = spark.createDataFrame([("http://x/a",)], "url string")
    urls = lambda **o: {r.url[9:]: r.depth for r in crawl.reachable(starts, edges, 5, **o).collect()}
    assert urls() == {"a": 0, "b": 1, "c": 1, "d.pdf": 1, "e.pdf": 1, "f": 2}
    assert urls(most_pages=2, most_documents=1) == {"a": 0, "b": 1, "d.pdf": 1}
    assert urls(most_pages=0) == {}


# fuzzy joins against every pair


def _names(r, n):
    words = ["acme", "acmes", "bolt", "bolts", "city", "county", "paving", "pavings", "of", "a", "construction", "constructions", "zzz", "works"]
    out = set()
    while len(out) < n:
        name = " ".join(r.choice(words) for _ in range(r.randrange(1, 4)))
        for _ in range(r.randrange(min(3, len(name)))):
            i = r.randrange(len(name))
            name = name[:i] + r.choice(["", "x", name[i] * 2]) + name[i + 1 :]
        if name.strip():
            out.add(" ".join(name.split()))
    return sorted(out)


@pytest.mark.parametrize("threshold", [70, 90])
def test_fuzzy_blocks_lose_no_pair(spark, threshold):
    r = random.Random(threshold)
    left, right = _names(r, 120), _names(r, 120)
    a = spark.createDataFrame([(x,) for x in left], "lk string")
    b = spark.createDataFrame([(x, i) for i, x in enumerate(right)], "rk string, ord int")
    want = {}
    for x in left:
        score, i = max((int(fuzzy.token_set_ratio(x, y)), -i) for i, y in enumerate(right))
        if score >= threshold:
            want[x] = (right[-i], score)
    got = {x: (y, s) for x, y, s in rows(matching.best_fuzzy(a, b, "lk", "rk", "ord", threshold), "lk", "rk", "score")}
    assert got == want and len(want) > 40


def test_less_complete_against_every_pair(spark):
    r = random.Random(3)
    data = [(i, r.choice([None, "u", "v"]), x) for i, x in enumerate(_names(r, 150))]
    want = set()
    for i, g, x in data:
        for _, h, y in data:
            if g == h and len(y) > len(x) and (y.startswith(x) or int(fuzzy.token_set_ratio(x, y)) >= 94):
                want.add(i)
    df = spark.createDataFrame(data, "row int, g string, name string")
    assert {i for (i,) in rows(matching.less_complete(df, "row", ["g"], "name"))} == want and 20 < len(want) < 140
