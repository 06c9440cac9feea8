import json

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import awards, clean, crawl, filings, html, matching, phrase, store, votes
from ledgerlight.plans import flows
from ledgerlight.sources import readers, sheets, sinks
from ledgerlight.streaming import incremental


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


# cleaning


def test_titles_and_names():
    assert clean.title(" Name\n of  X ") == "Name of X"
    assert clean.sql_names(["A b", "a-b", "9x", ""]) == ["a_b", "a_b_1", "table_9x", "dataframe"]


def test_sheet(spark):
    df = spark.createDataFrame(
        [
            ("Ann", "Lee", " A@X.org ", "Acme", None, 1, "5"), ("", "Lee", "a@x.org", "Bolt", "n", 2, "5"), ("Ann", "Lee", "a@x.org", "Acme", None, 3, "5"), ("Z", "Z", "A@x.org", "Cog", None, 4, "5"),
            ("Bo", "Diaz", None, "Dow", None, 5, "5"), ("No", "Mail", "  ", "Eel", None, 6, "5"), (None, None, None, None, None, 7, None),
        ],
        "`First  Name` string, `Last Name` string, `Email Address` string, `Name of Business Entity` string, note string, ord int, `Due Date` string",
    )
    got = clean.sheet(df, "ord")
    assert got.columns == ["First Name", "Last Name", "Email Address", "Name of Business Entity", "note", "ord"]
    out = {r["ord"]: tuple(r)[:5] for r in got.collect()}
    # blank addresses go, null ones stay, entities are listed in pairs
    assert out == {1: ("Ann", "Lee", "a@x.org", "Acme; Bolt\nCog", "n"), 5: ("Bo", "Diaz", None, "Dow", None)}
    assert clean.view_columns(titled := clean.titled(df)).columns == ["First Name", "Last Name", "Email Address", "Name of Business Entity"]
    found = clean.search({"s": titled, "t": spark.range(1)}, "LEE")
    assert found.count() == 3 and found.columns[0] == "source"


def test_keep_longest_keeps_first_position_and_nulls_together(spark):
    df = spark.createDataFrame([(None, "a", "x", 1), (None, "a", "xyz", 2), (None, "a", "xyw", 3), ("u", "a", "x", 4)], "url string, c string, s string, o int")
    assert rows(clean.keep_longest(df, ["url", "c"], "s", "o"), "s", "o", "first_seen") == [("x", 4, 4), ("xyz", 2, 1)]


# matching


@pytest.fixture
def names(spark):
    left = spark.createDataFrame([(1, "acme"), (2, "acme paving"), (3, "bolt"), (4, "blot works"), (5, ""), (6, "ac")], "id int, lk string")
    right = spark.createDataFrame([("acme", 0), ("bolt works", 1), ("acme", 2), ("cog", 3), ("b", 4)], "rk string, ord int")
    return left, right


def test_containment_equals_nested_loop(names):
    left, right = names
    want = left.crossJoin(right).filter("lk <> '' and (contains(lk, rk) or contains(rk, lk))")
    assert rows(matching.containment(left, right, "lk", "rk")) == rows(want)


def test_cascade(names):
    left, right = names
    got = rows(matching.cascade(left, right, "id", "lk", "rk", "ord", 80), "id", "match_type", "rk", "ord")
    assert [g for g in got if g[0] == 1] == [(1, "exact", "acme", 0), (1, "exact", "acme", 2)]
    assert {g[1] for g in got if g[0] == 2} == {"partial"} and {g[2] for g in got if g[0] == 3} == {"bolt works", "b"}
    assert not [g for g in got if g[0] == 5]


def test_fuzzy_first_of_equals_wins(spark):
    left = spark.createDataFrame([("abcd",)], "lk string")
    right = spark.createDataFrame([("abcf", 2), ("abce", 1), ("zzzz", 0)], "rk string, ord int")
    assert rows(matching.best_fuzzy(left, right, "lk", "rk", "ord", 75)) == [("abcd", "abce", 75)]
    assert matching.best_fuzzy(left, right, "lk", "rk", "ord", 76).count() == 0


def test_compare(spark):
    people = spark.createDataFrame([(1, "Acme; Bolt\nCog", "A", "", ""), (2, "Cog Inc", "B", "", ""), (3, None, "C", "", "")], "row_id int, entity string, name string, email string, position string")
    companies = spark.createDataFrame([(0, "Cog, LLC", "u1", "p1", "s1"), (1, "Bolt", "u2", "", None), (2, "COG", "u1", "p2", "s2")], "ord int, company string, source_url string, source_path string, snippet string")
    ranked, counts = flows.compare(people, companies)
    got = ranked.collect()
    assert [(r.row_id, r.match_type, r.match_score) for r in got] == [(2, "exact", 100), (1, "partial", None)]
    assert got[0].matched_companies == "Cog, LLC; COG" and got[0].matched_source_urls == "u1" and got[0].matched_source_paths == "p1  ||  p2"
    assert tuple(counts.first()) == (3, 1, 1, 0, 1)


def test_keywords(spark):
    interests = spark.createDataFrame([("Energy", 0, "Solar", 0), ("Energy", 0, "wind", 1), ("Land", 1, "solar", 2)], "interest string, interest_ord int, keyword string, keyword_ord int")
    companies = spark.createDataFrame([("Big Solar Wind",), ("solr",), (" ",), (None,), ("qqqq",)], "company string")
    got = {r.company: (r.interests, r.score) for r in matching.keyword_match(companies, interests, 80).collect()}
    assert got["Big Solar Wind"] == ("Energy; Land", 100) and got["solr"] == ("Energy; Land", 88)
    assert got["qqqq"][0] == "" and len(got) == 3


def test_agenda_is_case_sensitive(spark):
    officials = spark.createDataFrame([("A", [("Acme", "s")]), ("B", [("acme", "s")]), ("C", None)], "name string, interests array<struct<company_name:string,interest_type:string>>")
    items = spark.createDataFrame([("t", "Pay Acme Ltd"), ("n", None)], "title string, description string")
    assert rows(matching.agenda_conflicts(officials, items), "name", "title") == [("A", "t")]


def test_less_complete(spark):
    df = spark.createDataFrame([(1, None, "Acme"), (2, None, "Acme Paving"), (3, "u", "Acme"), (4, None, "Acme Pavinq Co"), (5, None, "Acme, Inc")], "row int, url string, name string")
    assert rows(matching.less_complete(df, "row", ["url"], "name")) == [(1,), (5,)]


# phrases


def test_phrases_equal_contains(spark):
    texts = spark.createDataFrame([(1, "Pay ACME & Sons, now"), (2, "acmeand sons"), (3, "x ab y"), (4, None), (5, "acme and sons acme and sons")], "id int, t string")
    phrases = spark.createDataFrame([("Acme & Sons",), ("acme",), ("ab",), ("sons now",)], "p string")
    assert rows(phrase.occurrences(texts, "id", "t", phrases, "p")) == [(1, "acme"), (1, "acme and sons"), (1, "sons now"), (5, "acme"), (5, "acme and sons")]


def test_votes_meet_holdings(spark):
    items = spark.createDataFrame([("Ann", "", "Lee", "Ann Lee", "Acme", "inv", 1), ("Ann", "", "Lee", "Ann Lee", "ACME", "inv", 2), ("Ann", "", "Lee", "Ann Lee", "Lee Ann", "inv", 3), ("Bo", "", "Lee", "Bo Lee", "Bolt Works", "inv", 4)], "owner_first_name string, owner_middle_name string, owner_last_name string, owner_full_name string, entity_name string, record_type string, ord int")
    found = phrase.entities(items, "ord")
    assert rows(found, "norm_name", "raw_name") == [("acme", "Acme"), ("bolt works", "Bolt Works")]
    cast = spark.createDataFrame([(1, "Lee", "m1", "Pay Acme", "d", "", ""), (2, "Ann Lee", "m1", "Pay Bolt Works", "d", "", ""), (3, "Cy Fox", "m1", "Pay Acme", "d", "", "")], "row_id int, politician_name string, matter_id string, matter_title string, meeting_date string, result string, body string")
    matches = phrase.vote_matches(cast, found)
    # a bare last name meets every owner of that name
    assert rows(matches, "row_id", "norm_name", "confidence") == [(1, "acme", 0.92), (2, "bolt works", 0.92)]
    assert rows(phrase.enriched(cast, matches), "row_id", "matched_companies", "match_count") == [(1, "Acme", 1), (2, "Bolt Works", 1), (3, "", 0)]
    assert phrase.vote_matches(cast, found, least=0.95).count() == 0


# votes


def minutes_rows(spark, text):
    return [tuple(r) for r in votes.vote_rows(spark.createDataFrame([("k", text)], "minutes_cache_key string, text string")).orderBy("pos", "name_pos").select("matter_id", "result", "vote_bucket", "politician_name").collect()]


def test_vote_rows(spark):
    assert minutes_rows(spark, "File No. 24-1 Road\nAyes:\nAnn Lee, Bo\nDiaz; C. Fox\nNoes:\nNone\nAbsent: Dan\nResolution Adopted\nFile #9-9 x\n") == [("24-1", "", "Ayes", "Ann Lee"), ("24-1", "", "Ayes", "Bo Diaz"), ("24-1", "", "Ayes", "C. Fox"), ("24-1", "ADOPTED", "Absent", "Dan")]
    # names on the line of a plural label are lost; a word that begins like a label opens a bucket
    assert minutes_rows(spark, "Ayes: Ann, Bo\nNorton,\nCy") == [("", "", "Noes", "Cy")]
    # "filed" gives a matter, whose result comes too late for the votes before it
    assert minutes_rows(spark, "Aye: Ann\nHEARD AND FILED\nNo: Bo") == [("", "", "Ayes", "Ann"), ("D", "HEARD AND FILED", "Noes", "Bo")]


def test_line_votes(spark):
    df = spark.createDataFrame([(1, "Lee voted aye\nFox said no\nLEE absent")], "k int, t string")
    assert rows(votes.line_votes(df, "k", "t", "Ann Lee"), "vote", "snippet") == [("Absent", "LEE absent"), ("Aye", "Lee voted aye")]


# filings


def test_payloads(spark):
    payload = {
        "coverPage": {"firstName": "Ann", "middleName": "", "lastName": "Lee", "agencyName": "Agency", "position": "Mayor"},
        "a1Investments": [{"name": "Name of Business Entity: Acme ►"}, {"name": "ACME"}, {"name": "Schedule B"}, {"name": " "}],
        "a2Entities": [{"name": "Bolt", "realPropertyNameOrAddress": "", "realPropertyDescription": "12 Elm", "singleSourceNames": ["Cog", "Ann Lee"]}],
        "bProperties": [{"parcelNumberOrAddress": "1 Oak St"}],
        "cIncomes": [{"sourceName": "Dow"}],
    }
    kind = "coverPage struct<firstName:string,middleName:string,lastName:string,agencyName:string,position:string>, a1Investments array<struct<name:string>>, a2Entities array<struct<name:string,realPropertyNameOrAddress:string,realPropertyDescription:string,singleSourceNames:array<string>>>, bProperties array<struct<parcelNumberOrAddress:string>>, cIncomes array<struct<sourceName:string>>"
    df = spark.createDataFrame([("f", payload)], f"form700_cache_key string, payload struct<{kind.replace('coverPage struct', 'coverPage:struct').replace('a1Investments array', 'a1Investments:array').replace('a2Entities array', 'a2Entities:array').replace('bProperties array', 'bProperties:array').replace('cIncomes array', 'cIncomes:array')}>")
    got = filings.sanitized(filings.payload_rows(df)).orderBy("ord").collect()
    assert [(r.record_type, r.entity_name) for r in got] == [("investment", "Acme"), ("business_entity", "Bolt"), ("business_entity_property", "12 Elm"), ("business_entity_source", "Cog"), ("real_property", "1 Oak St"), ("income", "Dow")]
    assert {r.filer_agency_name for r in got} == {""} and {r.filer_position_title for r in got} == {"Mayor"}


def test_search_documents(spark):
    d = '{"indexID":"7","filer":{"lastName":"Lee","firstName":" Ann "},"filingPositions":[{"agency":"A","filingYear":2024}],"filingInfo":{"filedDate":"2024-03-07T14:05:00"}}'
    r = filings.search_documents(spark.createDataFrame([(d,), (d,), ('{"x":1}',)], "document string"), "http://p").collect()
    assert len(r) == 1 and (r[0].filer_full_name, r[0].filed_date, len(r[0].alternate_urls)) == ("Ann Lee", "3/7/2024 2:05 PM", 10)
    assert '"LastName":"Lee"' in r[0].download_request and "MiddleName" not in r[0].download_request


# awards

AGENDA = """4.1 Intro
Award a contract to Bob's Paving, LLC, in an amount of $5
{gap}
4.2 Approve Agreements with Acme Works, Inc. and Bolt & Sons of the North.
{gap}
Agreements with the following firms for design: Cog Design (term), $5,000; Dow Labs $7.50, and Eel Inc to provide x
{gap}
Award a contract to Santa Rosa City Schools, ok.
the lowest responsible bidder was rejected, reject all bids
VOTE: AYES: Lee, Fox
NOES: None
"""


def test_awards(spark):
    text = AGENDA.replace("{gap}", "x" * 400)
    docs = spark.createDataFrame([("d", "sonoma", "document", "/a/1234_A_x_24-05-06_BOS_Agenda.pdf", "u", text)], "doc_key string, site string, source_kind string, source_path string, source_url string, text string")
    got = awards.awards(docs).collect()
    assert {"Bob's Paving, LLC", "Acme Works, Inc", "Cog Design", "Dow Labs", "Eel Inc"} <= {r.company_name for r in got}
    assert all("2024-1234" in r.item_id.replace("| ", "") for r in got) and not any("City" in r.company_name for r in got)
    assert not any(r.has_negative_context for r in got if r.company_name.startswith("Bob"))


def test_company_rules(spark):
    df = spark.createDataFrame([("Advocates",), ("Santa",), ("Inc.",), ("the board of x",), ("Capacity Works",), ("Acme",)], "c string")
    assert [r.v for r in df.select(awards.rejected(F.col("c")).alias("v")).collect()] == [False, True, True, True, True, False]
    df = spark.createDataFrame([("A.B.C. Works and J. Smith",), ("no.Stop",)], "t string")
    assert [r.v for r in df.select(awards.protect(F.col("t")).alias("v")).collect()] == ["A~B~C~ Works and J~ Smith", "no.Stop"]


# HTML and crawl


def test_html(spark):
    pages = spark.createDataFrame([(1, "http://a/b/", '<p>x &amp; y</p><script>z</script><a href="m.pdf"><b>Minutes</b> 1</a><a href="#t">t</a><a href=\'/agenda\'>A</a><a href="m.pdf">again</a>')], "id int, url string, html string")
    assert pages.select(html.html_text("html").alias("t")).first().t == "x & y\nz\nMinutes\n 1\nt\nA\nagain"
    found = html.links(pages, "id", "url", "html")
    assert rows(found, "url", "label") == [("http://a/agenda", "A"), ("http://a/b/m.pdf", "Minutes 1"), ("http://a/b/m.pdf", "again")]
    assert rows(html.vote_links(found, "id"), "url", "kind") == [("http://a/b/m.pdf", "pdf")]
    assert html.meeting_links(found, "id").count() == 2 and html.meeting_links(found, "id", 1).count() == 1


def test_grids(spark):
    grid = '<table><thead><tr><th>Name</th><th>Meeting Date</th><th>Meeting Details</th><th>Minutes</th></tr></thead><tr class="rgRow"><td>Board</td><td>1/2/2024</td><td><a href="d?1">x</a></td><td>none</td></tr><tr><td>skip</td></tr></table>'
    df = spark.createDataFrame([("k", "http://a/", grid)], "key string, url string, html string")
    assert rows(html.meetings(df, "key"), "body", "meeting_date", "meeting_url", "minutes_url") == [("Board", "1/2/2024", "http://a/d?1", None)]
    old = '<tr class="rgAltRow">' + "".join(f"<td>c{i}<a href='l{i}'></a></td>" for i in range(8)) + "</tr><tr class='rgRow'><td>few</td></tr>"
    assert [r["minutes_url"] for r in html.grid_rows(old, "http://a/", positional=True)] == ["http://a/l7"]


def test_chosen_text(spark):
    long = "word " * 60
    df = spark.createDataFrame([(1, 0, "short", None), (1, 1, long, None), (2, 0, "ab", None), (2, 1, "abc", None), (3, 0, None, "e1"), (3, 1, " ", "e2")], "k int, attempt int, text string, error string")
    assert rows(html.chosen_text(df, "k")) == [(1, long, None), (2, "abc", None), (3, None, "e2")]


def test_meetings_feed(spark):
    kind = "title string, date string, documentList array<struct<templateId:int,templateName:string,compileOutputType:int>>"
    a = spark.createDataFrame([("Old", "1/2/2024", [(5, "Minutes", 1), (6, "Agenda", 1)]), ("No year", "soon", [(7, "Agenda", 1)]), ("None", "1/2/2024", [(8, "x", 2)])], kind)
    b = spark.createDataFrame([("New", "1/3/2024", [(6, "Agenda", 1)])], kind)
    got = crawl.meetings(a, b, "http://p", [2024], 2027).collect()
    assert [(r.meeting_template_id, r.label, r.meeting_date) for r in got] == [("6", "New 1/3/2024", "2024-01-03")]


# state


def test_upsert_keeps_first_sight(spark):
    old = spark.createDataFrame([("u1", "k1", "t", 1, 1), ("u2", "k2", "t", 1, 1)], "url string, key string, title string, first_seen_at int, last_seen_at int")
    new = spark.createDataFrame([("u1", "k9", "T"), ("u3", "k3", "n")], "url string, key string, title string")
    assert rows(store.upsert(old, new, "url", F.lit(5), keep=("key", "first_seen_at"))) == [("u1", "k1", "T", 1, 5), ("u2", "k2", "t", 1, 1), ("u3", "k3", "n", 5, 5)]


def test_links_states_and_patches(spark):
    old = spark.createDataFrame([("a", "u", "long one", "")], "company_name string, source_url string, snippet string, source_path string")
    new = spark.createDataFrame([("a", "u", "short", "p"), ("b", "u", " ", None)], "company_name string, source_url string, snippet string, source_path string")
    assert rows(store.merge_links(old, new)) == [("a", "u", "long one", "p"), ("b", "u", "", "")]
    parents = spark.createDataFrame([("k", "discovered", "old", None, None, 0, "2020")], "key string, parse_status string, error_message string, downloaded_at string, parsed_at string, n int, filing_year string")
    done = store.downloaded(parents, spark.createDataFrame([("k",)], "key string"), "key", F.lit("now"))
    done = store.parsed(done, spark.createDataFrame([("k",), ("k",)], "key string"), done.select("key"), "key", "n", F.lit("later"))
    assert rows(done) == [("k", "parsed", "", "now", "later", 2, "2020")]
    assert rows(store.failed(done, spark.createDataFrame([("k", "bad")], "key string, message string"), "key"), "parse_status", "error_message") == [("error", "bad")]
    blank = spark.createDataFrame([("k", "")], "key string, filing_year string")
    assert rows(store.patched(done, blank, "key"), "filing_year") == [("2020",)] and rows(store.patched(done, blank, "key", parity=True), "filing_year") == [("",)]
    assert store.with_columns(blank, {"x": "int", "key": "string"}).columns == ["key", "filing_year", "x"]


# sources, sinks, streaming


def test_files(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.csv").write_text("Email Address,x\na@b,1\n")
    (tmp_path / "s" / "~$a.csv").write_text("")
    assert list(readers.folder(spark, str(tmp_path / "s"))) == ["a.csv"]
    assert sheets.chosen_sheet(["One", "Schedule A-1"]) == "Schedule A-1" and sheets.chosen_sheet(["One"]) == "One"
    with pytest.raises(ValueError):
        sheets.chosen_sheet([])
    (tmp_path / "m.jsonl").write_text('{"url":"u","depth":1}\n\nbroken\n')
    assert readers.manifest(spark, str(tmp_path / "m.jsonl"), strict=False).count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.manifest(spark, str(tmp_path / "m.jsonl")).collect()
    (tmp_path / "i.csv").write_text("interest,keyword\nB,x\nA,y\nB,z\n")
    assert rows(readers.interests(spark, str(tmp_path / "i.csv")).filter("interest_ord = 0"), "keyword") == [("x",), ("z",)]
    (tmp_path / "e.csv").write_text("a;b\n1;2\n")
    assert readers.entity_rows(spark, str(tmp_path / "e.csv")).columns == ["a", "b"]
    (tmp_path / "r.json").write_text('{"d": "{\\"documents\\": [{\\"id\\": 1}, {\\"id\\": 2}]}"}')
    assert readers.search_responses(spark, str(tmp_path / "r.json")).count() == 2
    df = readers.first_available([("db", lambda: spark.table("nowhere")), ("csv", lambda: readers.csv_table(spark, str(tmp_path / "e.csv")))])
    assert df.first().source_type == "csv"
    sinks.csv(spark.createDataFrame([], "a string, b array<string>"), str(tmp_path / "out.csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out.csv")).columns == ["a", "b"]
    lines = [r.value for r in sinks.json_array(spark.createDataFrame([(2,), (None,), (1,)], "a int"), "a").collect()]
    assert json.loads("\n".join(lines)) == [{"a": None}, {"a": 1}, {"a": 2}]
    assert json.loads("\n".join(r.value for r in sinks.json_array(spark.createDataFrame([], "a int"), "a").collect())) == []
    assert flows.statement(spark, "SELECT 1 AS one").first().one == 1


def test_stream_in_two_batches_equals_one(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    entry = lambda url, status, date: f'{{"url":"{url}","kind":"page","status":"{status}","meeting_date":"{date}"}}\n'
    (log / "1.json").write_text(entry("u", "saved", "2024-01-01") + entry("v", "saved", "2024-01-01"))
    first = incremental.latest_status(spark, str(log), str(tmp_path / "two"), str(tmp_path / "c2"))
    assert first.read().count() == 2
    (log / "2.json").write_text(entry("u", "error", "2024-02-01"))
    second = incremental.latest_status(spark, str(log), str(tmp_path / "two"), str(tmp_path / "c2"), 1)
    once = incremental.latest_status(spark, str(log), str(tmp_path / "one"), str(tmp_path / "c1"))
    assert rows(second.read(), "url", "status") == rows(once.read(), "url", "status") == [("u", "error"), ("v", "saved")]


def test_breadth_first_search(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("c", "d")], "source string, target string")
    assert rows(crawl.reachable(spark.createDataFrame([("a",)], "url string"), edges, 1), "url", "depth") == [("a", 0), ("b", 1), ("c", 1)]
    assert rows(crawl.reachable(spark.createDataFrame([("a",)], "url string"), edges, 9), "url", "depth") == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
