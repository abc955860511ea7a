"""Readers, writers and the streaming ingest."""

import datetime as dt
import json
import urllib.error

import pytest
from pytest_help import D
from tidemark import schema
from tidemark.sources import download, files, sinks
from tidemark.streaming import ingest


def entry(**more):
    return {"end": "2023-12-31", "val": 5, "accn": "a", "fy": 2023, "fp": "FY", "form": "10-K", "filed": "2024-02-01", **more}


def test_company_facts(spark, tmp_path):
    units = {"USD": [entry(start="2023-01-01"), entry(end="no date"), entry(filed=None), {"end": "2023-12-31"}, entry(fy=None)]}
    (tmp_path / "f.json").write_text(json.dumps({"cik": 7, "entityName": "x", "facts": {"us-gaap": {"Revenues": {"label": "r", "description": "d", "units": units}}, "dei": {"Other": {}}}}))
    rows = files.facts(spark, str(tmp_path / "f.json")).collect()
    assert {(r.security_id, r.concept, r.start and str(r.start), r.value, r.fy, r.unit) for r in rows} == {("0000000007", "Revenues", "2023-01-01", 5.0, 2023, "USD"), ("0000000007", "Revenues", None, 5.0, 0, "USD")}


def test_filings(spark, tmp_path):
    def write(n):
        recent = {"accessionNumber": ["1", "2", "3"][:n], "filingDate": ["2024-01-01", "2024-01-02", "2024-01-03"], "form": ["10-K", "8-K", "10-Q/A"]}
        (tmp_path / "s.json").write_text(json.dumps({"cik": "9", "filings": {"recent": recent}}))
        return files.filings(spark, str(tmp_path / "s.json"))

    assert sorted((r.form, r.accession, str(r.filing_date)) for r in write(3).collect()) == [("10-K", "1", "2024-01-01"), ("10-Q/A", "3", "2024-01-03")]
    with pytest.raises(Exception, match="differ in length"):
        write(2).collect()


def test_quotes_estimates_info_and_tickers(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Date,Adj Close,Close,High,Low,Open,Volume\n2024-01-02,1,2,3,1,2,10\n2024-01-03,1,2,3,1,2,10\n2024-01-04,1,2,3,1,2,10\n")
    assert [str(r.Date) for r in files.quotes(spark, str(tmp_path / "p.csv"), D("2024-01-03"), D("2024-01-04")).orderBy("Date").collect()] == ["2024-01-03", "2024-01-04"]
    (tmp_path / "e.csv").write_text("period,avg,low,high,yearAgoEps,numberOfAnalysts\n0q,1.5,1,2,1,12\n+1q,,1,2,1,0\n")
    assert [(r.period, r.avg, r.numberOfAnalysts) for r in files.estimates(spark, str(tmp_path / "e.csv")).collect()] == [("0q", 1.5, 12), ("+1q", None, 0)]
    (tmp_path / "i.json").write_text(json.dumps({"sector": "S", "website": "w", "exchange": "E"}))
    assert tuple(files.info(spark, str(tmp_path / "i.json"), "1").first()) == ("1", "S", None, None, "E")
    (tmp_path / "t.txt").write_text("# list\n\nAAA,0001\n BBB , 0002,x\n")
    assert [tuple(r) for r in files.tickers(spark, str(tmp_path / "t.txt")).collect()] == [("AAA", "0001"), ("BBB", "0002,x")]


def test_known_financials_need_a_reason_for_gaps(spark, tmp_path):
    def write(**more):
        (tmp_path / "k.json").write_text(json.dumps({"anchors": [{"ticker": "A", "cik": "1", "fiscal_year": 2023, "revenue_usd": 5, "net_income_usd": 1, **more}]}))
        return files.known_financials(spark, str(tmp_path / "k.json"))

    assert sorted(r.field for r in write(eps_diluted_skip_reason="split").collect()) == ["net_income", "revenue"]
    with pytest.raises(ValueError):
        write()


class Web:
    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def __call__(self, request, timeout):
        self.asked.append(request)
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return self

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False

    def read(self):
        return b'{"ok": 1}'


def test_downloads_wait_retry_and_name_themselves(tmp_path):
    busy = urllib.error.HTTPError("u", 429, "busy", {}, None)
    down = urllib.error.URLError("down")
    slept, web = [], Web(busy, down, 1, 1)
    client = download.Client("https://example.org", "me me@example.org", 10, opener=web, sleep=slept.append, clock=lambda: 0.0)
    assert client.get_json("a/b.json") == {"ok": 1} and web.asked[0].get_header("User-agent") == "me me@example.org"
    assert 1 in slept and 2 in slept and any(0.09 < s < 0.11 for s in slept)
    assert json.loads(open(client.land("x/y.json", str(tmp_path))).read()) == {"ok": 1}
    gone = urllib.error.HTTPError("u", 404, "gone", {}, None)
    with pytest.raises(urllib.error.HTTPError):
        download.Client("https://example.org", "me", opener=Web(gone), sleep=slept.append).get_json("a")
    with pytest.raises(urllib.error.HTTPError):
        download.Client("https://example.org", "me", retries=1, opener=Web(busy, busy), sleep=slept.append).get_json("a")
    with pytest.raises(ValueError):
        download.Client("https://example.org", " ")
    (tmp_path / "local.json").write_text('{"local": 2}')
    assert download.Client(f"file://{tmp_path}", "me").get_json("local.json") == {"local": 2}


def price(day, **more):
    return {"security_id": "s", "date": D(day), "close": 1.0, **more}


def test_the_warehouse_checks_columns_and_keys(spark, tmp_path):
    house = sinks.Warehouse(spark, str(tmp_path / "w"))
    house.create()
    house.create()
    rows = lambda *r: spark.createDataFrame(list(r), "security_id string, date date, close double")
    assert house.append("prices", rows(("s", D("2024-01-01"), float("nan")), ("s", D("2024-01-02"), 2.0))) == 2
    got = house.read("prices").orderBy("date").collect()
    assert [r.close for r in got] == [None, 2.0] and got[0].volume is None
    assert house.append("prices", rows()) == 0
    for bad in (rows(("s", D("2024-01-02"), 3.0)), rows(("t", D("2024-01-02"), 3.0), ("t", D("2024-01-02"), 4.0)), rows(("u", D("2024-01-02"), 3.0)).withColumnRenamed("close", "colour")):
        with pytest.raises(ValueError):
            house.append("prices", bad)
    house.replace("prices", house.read("prices").where("close = 2"))
    assert house.read("prices").count() == 1
    with pytest.raises(ValueError):
        house.append('x"; --', rows())


def test_matrices_predictions_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1.0)], "security_id string, f double")
    for end in ("parquet", "csv"):
        sinks.write_matrix(rows, str(tmp_path / f"m.{end}"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m.csv")).first().f == "1.0"
    with pytest.raises(ValueError):
        sinks.write_matrix(rows, str(tmp_path / "m.txt"))
    assert spark.read.parquet(sinks.write_predictions(rows, str(tmp_path), "r1")).count() == 1
    assert sinks.write_report(rows, str(tmp_path / "r.json"), n=1)["rows"] == [{"security_id": "s", "f": 1.0}]
    sinks.append_verdict(str(tmp_path / "v.md"), "cluster", -0.0149, "open")
    assert "-0.014900" in (tmp_path / "v.md").read_text()


def test_a_stream_of_facts_ends_where_one_batch_does(spark, tmp_path):
    def facts(*rows):
        return spark.createDataFrame([("s", "Revenues", D(a), D(b), D(f), 2023, fp, form, float(v), "USD") for a, b, f, fp, form, v in rows], ingest.FACTS)

    year = ("2023-01-01", "2023-12-31", "2024-02-01", "FY", "10-K", 400)
    quarters = [("2023-01-01", "2023-03-31", "2023-05-01", "Q1", "10-Q", 80), ("2023-04-01", "2023-06-30", "2023-08-01", "Q2", "10-Q", 100), ("2023-07-01", "2023-09-30", "2023-11-01", "Q3", "10-Q", 110)]
    house = sinks.Warehouse(spark, str(tmp_path / "w"))
    house.create()
    source = str(tmp_path / "in")
    for part in ([year], quarters, [("2023-01-01", "2023-12-31", "2024-08-01", "FY", "10-K/A", 405)]):
        facts(*part).write.mode("append").parquet(source)
        ingest.start(spark, source, house, str(tmp_path / "facts"), str(tmp_path / "cp")).awaitTermination()
    got = sorted((r.period, str(r.accepted_date), r.revenue) for r in house.read("income_statement").collect())
    assert got == [("FY", "2024-02-01", 400.0), ("FY", "2024-08-01", 405.0), ("Q1", "2023-05-01", 80.0), ("Q2", "2023-08-01", 100.0), ("Q3", "2023-11-01", 110.0), ("Q4", "2024-02-01", 110.0), ("Q4", "2024-08-01", 115.0)]


def test_schemas_name_their_keys(spark):
    for name, keys in schema.KEYS.items():
        assert set(keys) <= set(schema.TABLES[name].names) and schema.empty(spark, name).count() == 0
    assert dt.date.today()
