import gzip
import json

import pytest
from pyspark.sql import functions as F

from fareloom.functions import scalars as S
from fareloom.operators import normalize, pages
from fareloom.operators.dedup import dedup_in_page
from fareloom.plans.daily_run import run_daily
from fareloom.schema import RAW_COLUMNS, RAW_QUOTES
from fareloom.sources import captures, registry, tables
from fareloom.sources.metrics import read_metrics
from fareloom.streaming.quotes import append_quotes, stream_quotes

PLAIN = {
    "origin": "DEL", "destination": "BOM", "carrier_code": "6E", "carrier_name": "IndiGo",
    "flight_num": "6E 1", "travel_date": "2026-09-10", "advance_purchase_days": "7",
    "fare_class": "Economy", "base_fare": "", "taxes_and_fees": "", "total_fare": "5000.0",
    "fare_split_estimated": "False", "departure_time": "10:00", "status": "ok",
    "scraped_at": "2026-09-01T02:00:00+05:30", "capture_run": "r1", "source": "airline_direct",
    "source_name": "IndiGo"}


def _write(path, rows, columns=RAW_COLUMNS):
    path.parent.mkdir(parents=True, exist_ok=True)
    lines = [",".join(columns)]
    lines += [",".join({**PLAIN, **row}[c] for c in columns) for row in rows]
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")


@pytest.fixture()
def raw(tmp_path):
    root = tmp_path / "raw"
    _write(root / "2026-09-01" / "indigo_raw_2026-09-01.csv", [
        {}, {"flight_num": "6E 2", "total_fare": "nan", "status": "SOLD_OUT", "fare_class": ""},
        {"flight_num": "6E 3", "departure_time": "N/A"}, {"flight_num": "6E 4", "status": "odd"},
        {"flight_num": "6E 5", "total_fare": "12k", "fare_split_estimated": "perhaps"},
        {"flight_num": "6E 6", "advance_purchase_days": "15.0",
         "scraped_at": "2026-08-31T20:30:00+00:00"}])
    _write(root / "2026-09-02" / "mmt_batch_raw.csv", [{"scraped_at": "2026-09-02T09:00:00+05:30"}],
           RAW_COLUMNS[:16])
    (root / "2026-09-02" / "goibibo_empty.csv").write_text("")
    return root


def test_reading_validating_and_rejecting(spark, raw):
    frame = captures.read_raw_quotes(spark, str(raw))
    checked = normalize.normalize(frame)
    good = normalize.with_derived(normalize.valid_quotes(checked)).orderBy("scraped_at", "flight_num")
    rows = {(r["source_scraper"], r["flight_num"]): r for r in good.collect()}
    assert set(rows) == {("indigo", "6E 1"), ("indigo", "6E 2"), ("indigo", "6E 6"),
                         ("makemytrip", "6E 1")}
    first = rows["indigo", "6E 1"]
    assert (first["fare_class"], first["total_fare"], first["base_fare"]) == ("economy", 5000.0, None)
    assert first["scraped_date"] == "2026-08-31" and first["fare_split_estimated"] is False
    assert rows["indigo", "6E 2"]["status"] == "sold_out"
    assert rows["indigo", "6E 2"]["fare_class"] == "unknown"
    assert rows["indigo", "6E 6"]["advance_purchase_days"] == 15
    agent = rows["makemytrip", "6E 1"]
    assert (agent["source"], agent["source_name"]) == ("ota", "MakeMyTrip")

    rejects = normalize.rejected_rows(checked)
    reasons = {r["error"]: r["n_rows"] for r in normalize.rejection_reasons(rejects).collect()}
    assert reasons == {"departure_time: required": 1, "status: unrecognized": 1,
                       "total_fare: not a number; fare_split_estimated: not a boolean": 1}
    assert '"total_fare":"12k"' in " ".join(r["raw_row"] for r in rejects.collect())
    unread = captures.file_rejects(spark, str(raw)).collect()
    assert [r["source_file"].rsplit("/", 1)[1] for r in unread] == ["goibibo_empty.csv"]


def test_quoted_fields_and_odd_files(spark, tmp_path):
    name = 'Indi ""X"" Go, Ltd'
    _write(tmp_path / "a" / "indigo_1.csv", [{"carrier_name": f'"{name}"'}, {"carrier_name": '"two\nlines"', "flight_num": "6E 2"}])
    _write(tmp_path / "b" / "indigo_2.csv", [])  # a header only
    (tmp_path / "b" / "indigo_3.csv").write_text("")
    whole = gzip.compress(("origin\n" + "\n".join(f"D{i}" for i in range(50_000))).encode())
    (tmp_path / "b" / "indigo_4.csv.gz").write_bytes(whole[:len(whole) // 2])
    frame = captures.read_raw_quotes(spark, str(tmp_path))
    assert {(r["carrier_name"], r["flight_num"]) for r in frame.collect()} == {
        ('Indi "X" Go, Ltd', "6E 1"), ("two\nlines", "6E 2")}
    rejects = [r["source_file"].rsplit("/", 1)[1] for r in captures.file_rejects(spark, str(tmp_path)).collect()]
    assert rejects == ["indigo_3.csv"]
    names = spark.createDataFrame([(str(tmp_path / "a" / "indigo_1.csv"), "e", "r")], "source_file string, error string, raw_row string")
    assert captures.without_rejected_files(frame, names).count() == 0


def test_csv_append_reads_back(spark, tmp_path):
    frame = spark.createDataFrame(
        [tuple({**PLAIN, "carrier_name": t}[c] for c in RAW_COLUMNS) for t in ('a "b", c', "x\ny", "")], RAW_QUOTES)
    for part in (frame.limit(1), frame.subtract(frame.limit(1))):
        tables.append_csv(part, str(tmp_path / "out"))
    back = captures.csv_reader(spark.read).csv(str(tmp_path / "out"))
    assert {r["carrier_name"] for r in back.collect()} == {'a "b", c', "x\ny", None} or {
        r["carrier_name"] for r in back.collect()} == {'a "b", c', "x\ny", ""}


def test_saved_pages(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "p.html").write_text("<b>1\n2</b>")
    row = captures.read_pages(spark, str(tmp_path)).first()
    assert row["html"] == "<b>1\n2</b>" and row["page_path"].endswith("/d/p.html")


def test_single_day_scan(spark, raw):
    assert captures.read_raw_quotes(spark, str(raw), "2026-09-02").count() == 1


@pytest.mark.parametrize("name, scraper", [
    ("/a/IndiGo_raw_x.csv", "indigo"), ("mmt_20.csv", "makemytrip"),
    ("newsite_raw_2026.csv", "newsite"), ("newsite_2026-09.csv", "newsite")])
def test_scraper_names(spark, name, scraper):
    row = spark.range(1).select(S.scraper_from_path(F.lit(name)).alias("s")).first()
    assert row["s"] == scraper


def test_replacing_days_touches_no_other_day(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "day string, n int")
    tables.replace_days(frame, path, "day")
    for _ in range(2):
        tables.replace_days(frame.where("n = 3").withColumn("n", F.lit(9)), path, "day")
    assert sorted(r["n"] for r in tables.read_table(spark, path).collect()) == [1, 2, 9]


def test_stream_gives_what_the_batch_gives(spark, raw, tmp_path):
    # one file per batch, the last one with the oldest captures; its quote is in the file twice
    _write(raw / "2026-09-03" / "indigo_late.csv", [{"scraped_at": "2026-01-01T00:00:00+05:30", "capture_run": "r0"}] * 2)
    rows = stream_quotes(spark, str(raw), files_per_batch=1)
    store = str(tmp_path / "t")
    keys = ["source_scraper", "flight_num", "scraped_at", "total_fare", "status"]

    def stored():
        return sorted(map(str, tables.read_table(spark, f"{store}/quotes").select(keys).collect()))

    append_quotes(rows, store, str(tmp_path / "c")).awaitTermination(240)
    checked = normalize.normalize(captures.read_raw_quotes(spark, str(raw)))
    batch = normalize.with_derived(normalize.valid_quotes(checked))
    assert stored() == sorted(map(str, batch.select(keys).collect()))
    rejects = spark.read.parquet(f"{store}/stream_rejects")
    assert rejects.count() == normalize.rejected_rows(checked).count()
    append_quotes(rows, store, str(tmp_path / "again")).awaitTermination(240)  # all batches once more
    assert len(stored()) == batch.count()


def test_daily_run_and_rerun(spark, raw, tmp_path):
    root = tmp_path / "selectors"
    root.mkdir()
    (root / "indigo.json").write_text(json.dumps({
        "site": "indigo", "pending_review": {"x": {"value": "p"}},
        "selectors": {"fare": {"value": "s", "last_verified_at": "2026-08-30T00:00:00"}}}, indent=1))
    store = str(tmp_path / "store")
    args = dict(registry_root=str(root), now="2026-09-02T00:00:00+05:30", skip_forecast=False)
    run_daily(spark, str(raw), store, run_id="one", **args)
    out = run_daily(spark, str(raw), store, run_id="two", **args)
    assert out["quotes"].count() == 4 and out["rejects"].count() == 4
    assert [r["composite_fare_index"] for r in out["index"].orderBy("date").collect()] == [100.0] * 2
    assert out["excluded"].count() == 1 and out["forecast"].count() == 0
    flags = {r["source_scraper"]: r["quality_flags"] for r in out["flagged"].collect()}
    assert flags == {"indigo": [], "makemytrip": ["stale_selector"]}
    metrics = read_metrics(spark, f"{store}/metrics").where("run_id = 'two'")
    assert {r["stage"] for r in metrics.collect()} == {
        "quotes", "scored", "flagged", "anomalies", "index", "excluded", "forecast"}
    health = registry.selector_health(registry.read_registries(spark, str(root))).first()
    assert (health["active_selectors"], health["pending_selectors"]) == (1, 1)


def test_healing_log(spark, tmp_path):
    events = [{"timestamp": f"2026-09-0{d}T10:00:00+05:30", "site": "a", "target_field": "f",
               "success": ok, "selector": s} for d, ok, s in ((1, True, "x"), (2, True, "y"),
                                                             (3, False, "z"))]
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join(map(json.dumps, events)))
    log = registry.read_healing_log(spark, str(path))
    row = registry.healing_summary(log).first()
    assert (row["attempts"], row["success_pct"], row["latest_selector"]) == (3, 66.7, "y")
    assert [r["selector"] for r in registry.recent_events(log, 2).collect()] == ["z", "y"]


def _pages(spark, html, **more):
    row = {"page_id": "p", "origin": "DEL", "destination": "BLR", "travel_date": "2026-09-15",
           "advance_purchase_days": 7, "scraped_at": "2026-09-01T00:00:00+05:30",
           "capture_run": "r", "html": html, "page_text": html, **more}
    return spark.createDataFrame([row])


def test_cards_of_the_airline_layout(spark):
    card = ('<ai-pb-flight-card>\n<div class="ai-pb-flight-id">AI {}</div>'
            '<div class="ai-pb-departure-time">07:00</div><div class="ai-pb-price">₹{}</div>'
            '</ai-pb-flight-card>')
    html = "<body>" + "".join(card.format(n, p) for n, p in (
        (805, "5,432"), (807, "6,200"), (506, "7,800"), (508, "8,500"))) + "</body>"
    quotes, _ = pages.extract_cards(_pages(spark, html))
    rows = quotes.orderBy("total_fare").collect()
    assert [r["total_fare"] for r in rows] == [5432.0, 6200.0, 7800.0, 8500.0]
    assert {(r["carrier_name"], r["departure_time"], r["status"]) for r in rows} == {
        ("Air India", "07:00", "ok")}


def test_in_page_duplicates(spark):
    rows = [("a", 0, "parse_error"), ("a", 1, "ok"), ("a", 2, "ok"), ("b", 0, "parse_error"),
            ("b", 1, "parse_error")]
    cards = spark.createDataFrame(rows, "k string, position int, status string")
    assert sorted((r["k"], r["position"]) for r in dedup_in_page(cards, ["k"]).collect()) == [
        ("a", 1), ("b", 1)]


def test_lines_without_fares_say_why(spark):
    for text, status in (("SG 123\nnothing", "parse_error"), ("hello", "no_flights"),
                         ("No flights available\nSG 1234", "no_flights")):
        row = pages.extract_lines(_pages(spark, text)).first()
        assert (row["status"], row["flight_num"], row["total_fare"]) == (status, "unknown", None)


@pytest.mark.parametrize("n, text, reason", [(3, "₹5,000", "ok"), (0, "", "too_few"),
                                             (25, "₹1", "too_many"), (4, "6E 2034", "text_differs")])
def test_extraction_health(spark, n, text, reason):
    rules = {"total_fare": (r"<b>(.*?)</b>", r"₹[\d,]+|INR\s*[\d,]+")}
    row = pages.extraction_health(_pages(spark, f"<b>{text}</b>" * n), rules).first()
    assert (row["match_count"], row["reason"], row["is_valid"]) == (n, reason, reason == "ok")


@pytest.mark.parametrize("filler", [0, 1, 3000])
def test_a_card_is_found_at_any_page_size(spark, filler):
    card = "<li><div>10:30 nice</div><div>₹5,000</div></li>"
    rest = "<p>filler</p>" * filler
    html = "<script>var x = '<div>10:30 ₹1</div>';</script><div>" + rest + card + rest + "<!-- note --></div>"
    pieces, whole = _pages(spark, html).select(pages.card_pieces(F.col("html")), pages.clean_html(F.col("html"))).first()
    assert pieces == [card] and whole == f"<div>{rest}{card}{rest}</div>"


def test_nested_elements_and_single_quotes(spark):
    html = ("<ai-pb-flight-card><div class='ai-pb-flight-id'><b>AI</b> <i>101</i></div>"
            '<div class="ai-pb-price"><span>₹</span><span>5,432</span></div></ai-pb-flight-card>')
    row = pages.extract_cards(_pages(spark, html))[0].first()
    assert (row["flight_num"], row["total_fare"], row["status"]) == ("AI101", 5432.0, "ok")
    html = ('<div class="flex w-full"><div class="w-full flex"><div class="w-full x flex">QP1234</div><div>06:30DEL</div>'
            '<div>Non-stop</div><div>08:45BLR</div><b>₹4,000</b></div></div>')
    rows = pages.extract_inline(_pages(spark, html))[0].collect()
    assert [(r["flight_num"], r["total_fare"]) for r in rows] == [("QP1234", 4000.0)]


def test_lines_have_no_bounds_of_their_own(spark):
    far = "\n".join(["SG 101"] + ["x"] * 40 + ["₹1,000", "₹2,000", "₹3,000", "₹4,000", "06:10"] + ["y"] * 30 + ["SG 102", "₹5,000"])
    rows = pages.extract_lines(_pages(spark, far)).orderBy("total_fare").collect()
    assert [(r["flight_num"], r["departure_time"], r["total_fare"]) for r in rows] == [
        ("SG 101", "N/A", k * 1000.0) for k in range(1, 5)] + [("SG 102", "06:10", 5000.0)]
    narrow = pages.extract_lines(_pages(spark, far), lines_before=12, lines_after=25, most_fares=3).collect()
    assert [(r["departure_time"], r["total_fare"]) for r in narrow] == [("N/A", 5000.0)]


def test_page_reader_is_linear_and_keeps_nesting():
    import re
    import time

    from fareloom.functions.markup import Page, innermost
    began = time.monotonic()
    for piece in ("<!--", "<script ", "<style>", "<", "<div><p>"):
        assert Page(piece * (1_000_000 // len(piece))).elements is not None
    assert time.monotonic() - began < 30
    page = Page("<div class='a x'>1<p>2<div class=\"a\">3<br>4</p></div>5</div><span ID=k data-x='class=a'>6</span><!-- <b> --><b>7")
    found = [(e.tag, e.classes, page.text(e), page.source(e)) for e in page.elements]
    # the closing p ends the inner div too, so the first closing div is the outer one's
    assert found[0][:3] == ("div", "a x", "1234") and found[0][3].endswith("4</p></div>")
    assert [e[0] for e in found] == ["div", "p", "div", "br", "span", "b"]
    assert found[2][2] == "34" and found[5][2] == "7" and found[4][1] == "" and page.elements[4].attribute("id") == "k"
    assert [page.text(e) for e in innermost([e for e in page.elements if e.has_class(re.compile("a"))])] == ["34"]


def test_pieces_together_are_the_page_in_both_ways_of_cutting():
    import random

    from fareloom.functions import markup
    bits = ["<div class='a x'>", "</div>", "<p>", "text &amp; more", "<br>", '<img src="a>b">', "<span id=k />", "</span >", "<", "<b",
            "'", '"', "₹ 1", "<a:b c>", "<i x='>'>", "<!-- c -->", "<script>1<2</script >", "<style a='</style x'>"]
    rng, plain = random.Random(3), 0
    for _ in range(3000):
        html = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        pieces = markup._pieces(html)
        assert "".join(pieces) == html
        if markup._plain_pieces(html) is not None:
            plain += 1
            assert pieces == markup._PIECE.findall(html)
    assert plain > 300


def test_one_pass_over_the_tags_finds_what_the_page_reader_finds():
    import random

    from fareloom.functions import markup
    bits = ["<div class='a x'>", "<div class=a>", "</div>", "<p class='y'>", "</p>", "text &amp; more", "<br class='y'>", '<img src="a>b" class="y">',
            "<span id=k />", "<span class='y' />", "<b>", "</b >", " ₹ 1 ", "<DIV CLASS='a'>", "<a:b c>", "<i x='>'>", "<!-- <b> -->", "<", "</i>"]

    def asked(tag, classes, raw):
        return (tag, classes) if tag == "div" or "y" in classes else None
    rng, kinds, nested = random.Random(5), {}, 0
    for n in range(4000):
        html = "".join(rng.choice(bits[:-3] if n % 2 else bits) for _ in range(rng.randint(0, 20)))
        page, found = markup.Page(html), markup.Found(html, kinds, asked)
        wanted = [e for e in page.elements if asked(e.tag, e.classes, e.raw)]
        assert [h[0] for h in found.hits] == [(e.tag, e.classes) for e in wanted]
        assert [found.text(h) for h in found.hits] == [page.text(e) for e in wanted]
        assert [found.text(h, " ") for h in found.hits] == [page.text(e, " ") for e in wanted]
        for e, h in zip(wanted, found.hits):
            inside = [x for x in wanted if e.first <= x.first - 1 < e.last]
            assert [(x.tag, x.classes) for x in inside] == [x[0] for x in found.hits[h[3]:h[4]]]
            nested += len(inside)
    assert nested > 1000


def _page_tables(spark, folder, n=400):
    """A small star schema whose line items differ in part, with one order per ten lines."""
    tables = {
        "region": (5, "CAST(id AS INT) AS r_regionkey, element_at(array('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'), "
                      "CAST(id + 1 AS INT)) AS r_name"),
        "nation": (5, "CAST(id AS INT) AS n_nationkey, 'n' AS n_name, CAST(id AS INT) AS n_regionkey"),
        "customer": (10, "id AS c_custkey, 'c' AS c_name, CAST(id % 5 AS INT) AS c_nationkey, 0D AS c_acctbal, 'AUTO' AS c_mktsegment"),
        "supplier": (10, "id AS s_suppkey, 's' AS s_name, CAST(id % 5 AS INT) AS s_nationkey, 0D AS s_acctbal"),
        "orders": (n // 10, "id AS o_orderkey, id % 10 AS o_custkey, 'F' AS o_orderstatus, 1D AS o_totalprice, "
                            "TIMESTAMP_NTZ '2001-02-03 00:00:00' AS o_orderdate, '5-LOW' AS o_orderpriority"),
        "lineitem": (n, f"id % {n // 10} AS l_orderkey, id AS l_partkey, id % 10 AS l_suppkey, CAST(id % 7 + 1 AS INT) AS l_linenumber, "
                        "10D AS l_quantity, 1000D + id AS l_extendedprice, 0D AS l_discount, 0D AS l_tax, 'N' AS l_returnflag, "
                        "'O' AS l_linestatus, TIMESTAMP_NTZ '2001-03-04 00:00:00' AS l_shipdate")}
    for name, (rows, columns) in tables.items():
        spark.range(rows).selectExpr(f"struct({columns}) AS row").select("row.*").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def _plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


def test_placeholders_read_each_page_once(spark, tmp_path):
    from fareloom.catalog.queries import QUERIES
    shown = QUERIES["placeholder_quotes"](spark, _page_tables(spark, tmp_path))
    assert "ArrowEvalPython" not in _plan_of(shown)  # the pages' quotes are stored, and were parsed for that once
    rows = shown.collect()
    found = {i for i in range(400) if i % 10 and i % 4}
    assert len(rows) == 400
    assert sorted(r.flight_num for r in rows if r.status == "ok") == sorted(f"QP{i}" for i in found)
    assert sum((r.flight_num, r.status, r.total_fare) == ("unknown", "no_flights_or_timeout", None) for r in rows) == 400 - len(found)


def test_agent_cards_store_what_their_pages_are_made_from(spark, tmp_path):
    from fareloom.catalog.queries import _STAGES, QUERIES
    folder = _page_tables(spark, tmp_path)
    cards = QUERIES["agent_cards"](spark, folder)
    stored = [set(df.columns) for key, df in _STAGES.items() if key[1] == folder]
    assert len(stored) == 1 and not stored[0] & {"carrier_name", "flight_num", "total_fare", "source", "source_file"}
    rows = {r.flight_num: r for r in cards.collect()}
    assert set(rows) == {f"QP {i}" for i in range(400)}
    fares = {i: 1000.0 + i if i % 2 == 0 and i else 2000.0 if i % 3 == 0 else None for i in range(400)}
    assert {i: rows[f"QP {i}"].total_fare for i in range(400)} == fares


def test_lines_of_a_large_capture_file_are_read_in_parts(spark, tmp_path):
    rows = "origin,destination\r\n" + "DEL,BOM\r\n" * 3000
    marked = "﻿" + rows
    for name, text in (("whole", rows), ("open_end", rows + "x"), ("marked", marked), ("marked_open", marked + "x"), ("blank", "\n")):
        (tmp_path / f"indigo_{name}.csv").write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        lines = captures.text_lines(spark.read.format("text")).load(str(tmp_path / "indigo_whole.csv"))
        assert lines.rdd.getNumPartitions() > 5 and lines.count() == 3001
        assert captures.file_rejects(spark, str(tmp_path)).collect() == []
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / ".indigo_whole.csv.crc").write_bytes(b"crc\x00\x00\x00\x02\x00" + b"\x01" * 4 * 53)  # no part of the text fits its checksum
    assert [r["source_file"].rsplit("/", 1)[1] for r in captures.file_rejects(spark, str(tmp_path)).collect()] == ["indigo_whole.csv"]
