import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import fuzzy, text, web


def value(spark, column, **row):
    names = list(row)
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} string" for n in names)) if names else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("make", "given", "want"),
    [
        (text.collapse, " a \t b  c ", "a b c"),
        (text.collapse, None, ""),
        (text.alnum_key, "O'Brien & Söhne, Inc.", "o brien s hne inc"),
        (text.search_key, "A&B  Co.", "a and b co"),
        (text.company_key, "Acme Holdings, L.L.C., Inc.", "acme holdings l l c"),
        (text.company_key, "Acme Co., LLC", "acme"),
        (text.company_key, "Inc. LLC", ""),
        (text.company_key, "Incline Co", "incline"),
        (text.company_core, "The Acme Group Holdings", "the acme"),
        (text.person_letters, "Ann (cid:3) O'Neil", "ann o neil"),
        (text.person_canonical, "O'Brien, Jr.", "o'brien jr."),
        (text.vote_label, "  Yes  please", "Aye"),
        (text.vote_label, "Nothing", "Nothing"),
        (text.split_names, "Lee (3), Diaz and None, Fox.", ["Lee", "Diaz", "Fox"]),
        (text.split_companies, "Acme, Inc., Bolt , LLC,, Cog", ["Acme, Inc.", "Bolt, LLC", "Cog"]),
        (text.tidy_lines, "a\r\n\n\n\n b\t\tc", "a\n\n b c"),
        (text.name_variants, "Ann Bo Lee", ["Ann Bo Lee", "ann bo lee", "Lee", "Ann Lee", "Lee, Ann"]),
        (web.normal_date, "3/7/2024", "2024-03-07"),
        (web.normal_date, "March 7, 2024", "2024-03-07"),
        (web.normal_date, "2024-03-07T09:00:00Z", "2024-03-07"),
        (web.normal_date, "on 2024-03-07.", "2024-03-07"),
        (web.normal_date, "soon", "soon"),
        (web.date_field, "filed 3/7/2024  1:05 pm x", "3/7/2024 1:05 pm"),
        (web.date_field, "in 1999", "1999"),
        (web.portal_date, "2024-03-07T14:05:00", "3/7/2024 2:05 PM"),
        (web.normal_url, "http://a.b//c//d e?x=1#f", "http://a.b/c/d%20e?x=1"),
        (web.index_id, '{"documentId": " 7 "}', "7"),
        (web.slug, " A b_C! ", "a-b-c"),
        (web.pdf_urls, '<a href="/x.pdf">a</a> <a href="/y">Download</a> http://q/Z.PDF src="/X.PDF"', ["/x.pdf", "/y", "http://q/Z.PDF"]),
    ],
)
def test_text(spark, make, given, want):
    assert value(spark, make(F.col("x")), x=given) == want


def test_years_and_urls(spark):
    assert value(spark, web.years_in("x", 2027), x="a2019b 20201 2030 x2024") == [2019, 2024]
    assert value(spark, web.recent_enough("x", 2020, 2027), x="http://a/none") is True
    assert value(spark, web.document_url("x"), x="http://a/B.PDF?q=1") is True
    assert value(spark, web.document_url("x"), x="http://a/page?f=a.pdf") is False
    assert value(spark, web.joined_url("b", "h"), b="http://a.b/c/d?e", h="f") == "http://a.b/c/f"
    assert value(spark, web.joined_url("b", "h"), b="http://a.b", h="/f") == "http://a.b/f"
    assert value(spark, web.joined_url("b", "h"), b="https://a.b/x", h="//c/d") == "https://c/d"
    keyed = value(spark, web.meeting_key("d", "b", "u"), d="1/2/2024", b="Board", u="http://a/m?ID=5&GUID=x")
    import hashlib

    assert keyed == hashlib.sha1(b"1/2/2024|Board|5|x").hexdigest()[:20]
    assert len(value(spark, web.download_urls("http://p", "x"), x="9")) == 10


def test_hinted_value_ranks_by_name_then_place(spark):
    df = spark.createDataFrame([("", "b", "c"), ("a", "b", "c"), ("", "", "c")], "entity_name string, raw_value string, owner_company string")
    assert [r.v for r in df.select(text.hinted_value(df.columns).alias("v")).collect()] == ["b", "a", ""]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_fuzzy_scores():
    import random

    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randrange(12))) for _ in range(2))
        assert fuzzy.common_subsequence(a, b) == plain_lcs(a, b)
    assert fuzzy.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert int(fuzzy.token_set_ratio("new york mets", "new york meats")) == 96
    assert fuzzy.token_set_ratio("", "a") == 0 and fuzzy.ratio("abcd", "abce") == 75
    assert fuzzy.partial_ratio("abc", "xxabcxx") == 100
    assert fuzzy.weighted_ratio("acme", "acme paving works") == 90


def test_fuzzy_column(spark):
    df = spark.createDataFrame([("a b", "b a"), (None, "x")], "a string, b string")
    assert [r.s for r in df.select(fuzzy.token_set_score(F.col("a"), F.col("b")).alias("s")).collect()] == [100, 0]
