import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from ledgerlight.plans import flows
from ledgerlight.sources import feed, platforms, sheets


@pytest.fixture
def portal():
    asked = []

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlparse(self.path).query)
            asked.append(q)
            rows = [{"EventId": i, "EventBodyName": "Board" if i % 2 else "Council", "EventDate": f"{2023 + i % 3}-0{1 + i % 9}-01T00:00:00", "Other": 1} for i in range(20)]
            body = json.dumps(rows).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_feed_is_asked_for_what_is_wanted(spark, portal):
    base, asked = portal
    got = feed.events(spark, base, "Board", 2024).collect()
    want = [i for i in range(20) if i % 2 and i % 3 == 1]
    assert sorted(r.EventId for r in got) == want and [r.EventDate for r in got] == sorted((r.EventDate for r in got), reverse=True)
    assert asked[-1]["$top"] == ["500"] and asked[-1]["$orderby"] == ["EventDate desc"]
    assert asked[-1]["$filter"] == ["EventBodyName eq 'Board' and EventDate ge datetime'2024-01-01T00:00:00' and EventDate lt datetime'2025-01-01T00:00:00'"]


def test_events_command(spark, portal, tmp_path):
    flows.main(["events", portal[0], "--body", "Board", "--years", "2023, 2025", "--out", f"{tmp_path}/e"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/e").count() == len([i for i in range(20) if i % 2 and i % 3 != 1])


def test_platforms(spark):
    pages = spark.createDataFrame([(1, "http://x.legistar.com/Calendar.aspx", "<tr class=rgRow></tr>"), (2, "http://y.org", '<a href="agenda.html">A</a>'), (3, None, None)], "k int, url string, html string")
    assert [r.p for r in pages.select(platforms.detected("url", "html").alias("p")).collect()] == ["legistar", "generic", "generic"]
    assert platforms.meetings(pages, "k")["generic"].count() == 1
    own = platforms.Platform("own", lambda url, page: url.contains("y.org"), platforms.named("generic").meetings, platforms.named("generic").votes)
    platforms.register(own)
    try:
        assert [r.p for r in pages.select(platforms.detected("url", "html").alias("p")).collect()] == ["legistar", "own", "generic"]
    finally:
        platforms._KNOWN.pop("own")
    with pytest.raises(KeyError):
        platforms.named("none")


def test_cycles():
    seen, pauses = [], []

    def run():
        seen.append(1)
        raise ValueError("no")

    with pytest.raises(ValueError):
        flows.cycles(run, live=False)
    assert flows.cycles(run, live=True, minutes=0, pause=pauses.append, most=3) == 3 and pauses == [1, 1] and len(seen) == 4


def test_votes_command(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.txt").write_text("File No. 1-2 Pay Acme Works\nAyes:\nAnn Lee\nNoes:\nNone\nThe resolution was Adopted.\n")
    cover = {"firstName": "Ann", "lastName": "Lee", "agencyName": "City"}
    (tmp_path / "p.jsonl").write_text(json.dumps({"form700_cache_key": "k", "payload": {"coverPage": cover, "a1Investments": [{"name": "Acme Works"}, {"name": "Other"}]}}) + "\n")
    args = ["votes", f"{tmp_path}/m", f"{tmp_path}/p.jsonl", "--out", f"{tmp_path}/out", "--agency", " city ", "--known", f"{tmp_path}/known"]
    flows.main(args)
    rows = spark.read.option("header", True).csv(f"{tmp_path}/out/enriched.csv").collect()
    assert [(r.politician_name, r.matched_companies, r.match_count) for r in rows] == [("Ann Lee", "Acme Works", "1")]
    flows.main(args)
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/enriched.csv").count() == 0
    flows.main([*args, "--reparse"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/enriched.csv").count() == 1


def test_keywords_and_compare_commands(spark, tmp_path):
    sheets.write(spark.createDataFrame([("Big Solar",), ("solr",), ("Acme, Inc.",)], "Company string"), f"{tmp_path}/c.xlsx")
    (tmp_path / "i.csv").write_text("interest,keyword\nEnergy,Solar\n")
    (tmp_path / "people.csv").write_text("Last Name,email,Name of Business Entity\nLee,a@b,ACME\nFox,c@d,none\n")
    flows.main(["keywords", f"{tmp_path}/c.xlsx", f"{tmp_path}/i.csv", "--out", f"{tmp_path}/o.xlsx", "--threshold", "85"])
    got = {r.company: r.interests for r in sheets.read(spark, f"{tmp_path}/o.xlsx").collect()}
    assert got["Big Solar"] == "Energy" and got["solr"] == "Energy" and not got["Acme, Inc."]
    flows.main(["compare", f"{tmp_path}/people.csv", f"{tmp_path}/c.xlsx", "--out", f"{tmp_path}/cmp"])
    rows = spark.read.option("header", True).csv(f"{tmp_path}/cmp").collect()
    assert [(r.name, r.match_type, r.matched_companies) for r in rows] == [("Lee", "exact", "Acme, Inc.")]
