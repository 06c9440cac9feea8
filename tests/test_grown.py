"""Names, caches, pages, dictionaries and minutes that tables of more rows bring along."""

from ledgerlight.functions import fuzzy
from ledgerlight.operators import html, matching
from ledgerlight.plans import queries
from ledgerlight.sources import readers, sinks


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=repr)


def _company_names():
    return [f"{a} {b}{c}{d}" for a in ("large", "hot", "blue") for b in ("ring", "bolt", "plate", "gear") for c in ("", *(f" brand {i}" for i in range(1, 19))) for d in ("", " works")]


def test_few_pairs_of_a_large_group_are_scored(monkeypatch):
    names, scored = _company_names(), []
    want = [x for x in names if any(len(y) > len(x) and int(fuzzy.token_set_ratio(x, y)) >= 94 for y in names)]
    monkeypatch.setattr(matching, "token_set_ratio", lambda a, b: scored.append(a) or fuzzy.token_set_ratio(a, b))
    assert matching.near_longer(names, names, 94) == want and 100 < len(want) < len(names)
    assert len(scored) < len(names) ** 2 / 10


def test_large_groups_are_compared_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 40)
    names = _company_names()
    want = {(g, x) for g in "uv" for x in names if any(len(y) > len(x) and (y.startswith(x) or int(fuzzy.token_set_ratio(x, y)) >= 94) for y in names)}
    df = spark.createDataFrame([(f"{g}{i}", g, x) for g in "uv" for i, x in enumerate(names)], "row string, g string, name string")
    found = matching.less_complete(df, "row", ["g"], "name")
    assert set(rows(found.join(df, "row"), "g", "name")) == want


def test_cache_with_repeated_urls(spark):
    pages = spark.createDataFrame([(0, "u"), (1, "u"), (2, "u"), (3, "v"), (4, None), (5, None)], "page_id long, url string")
    cache = pages.filter("page_id % 2 = 0").selectExpr("page_id", "sha1(cast(url as binary)) AS cache_key", "'kept' AS text")
    held, rest = readers.cached_texts(pages, cache, within=("page_id",))
    assert rows(held, "page_id", "url", "text") == [(0, "u", "kept"), (2, "u", "kept"), (4, None, "kept")]
    assert rows(rest, "page_id") == [(1,), (3,), (5,)]
    held, rest = readers.cached_texts(pages, cache)  # one cache for all: each page once
    assert rows(held, "page_id") == [(0,), (1,), (2,), (4,), (5,)] and rows(rest, "page_id") == [(3,)]


def test_references_that_are_cut_off():
    page = "<title>a &amp;&amp; b &amp</title><script>x && y</script><p>&amp;amp; &lt;3 &#65;&#6 &copy 2 &</p>"
    assert html.text_of(page) == "a && b &\nx && y\n& <3 A\x06 © 2 &".replace("\x06", "")
    assert html.text_of(page, closed=True) == "a && b &amp\nx && y\n& <3 A&#6 &copy 2 &"
    assert html.text_of(None, closed=True) == ""


def test_dictionary_of_several_files(spark, tmp_path):
    """The engine reads large files first; places follow the files' names, without gaps."""
    parts = [[("B", "x")], [("A", f"k{i}") for i in range(200)], [("B", 'say "so"'), ("B", "two\nlines"), (None, "no interest"), ("A", "last")]]
    for i, part in enumerate(parts):
        sinks.csv(spark.createDataFrame(part, "interest string, keyword string").coalesce(1), f"{tmp_path}/d/{i}")
    found = readers.interests(spark.newSession(), f"{tmp_path}/d/*").collect()
    flat = [x for part in parts for x in part]
    first = {}
    for place, (interest, _) in enumerate(flat):
        first.setdefault(interest, place)
    assert sorted((r.keyword_ord, r.interest, r.keyword, r.interest_ord) for r in found) == [(i, a, k, first[a]) for i, (a, k) in enumerate(flat)]


def test_votes_in_the_documents_own_lines(spark, tmp_path):
    own = ["x", "File No. 7 Paving\nNoes:\nDee Gray\nEnd of it.", "No Bell", None]
    spark.createDataFrame([(i, t) for i, t in enumerate(own)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.vote_rows_in_documents(spark, str(tmp_path))
    want = [(i, b, n, f"D-{i}", r) for i in range(4) for b, n, r in (("Ayes", "Ann Lee", ""), ("Ayes", "Bo Diaz", ""), ("Noes", "C. Fox", "ADOPTED"))]
    assert rows(found) == sorted(want, key=repr)
