"""Quote tables derived from an order / line-item star schema.

Lets every operator run on generated business data: a line item becomes a fare quote, the
customer's and the supplier's regions become the route.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, prepare

BASKET_WEIGHTS = {
    "ASIA-EUROPE": 0.25, "ASIA-AMERICA": 0.20, "EUROPE-AMERICA": 0.18,
    "ASIA-AFRICA": 0.12, "AMERICA-AFRICA": 0.10, "MIDDLE EAST-ASIA": 0.15,
}
BASKET_WEIGHTS_V2 = {
    "ASIA-EUROPE": 0.25, "ASIA-AMERICA": 0.20, "EUROPE-AMERICA": 0.15,
    "ASIA-AFRICA": 0.10, "AMERICA-AFRICA": 0.10, "MIDDLE EAST-ASIA": 0.10,
}
BASKET = list(BASKET_WEIGHTS)
ROW_ID = ["order_key", "line_number", "part_key", "supp_key", "price"]
LINES_PER_TASK = 1_000_000  # that a task sorts for the join at most, about: even with all columns they fit its memory


# Layouts of the tables, so that planning a query reads no file footers.
LAYOUTS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
              "props string",
    "pages": "page_id long, url string, html string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the schema; times without a zone are taken as UTC."""
    prepare(spark)
    frame = spark.read.schema(LAYOUTS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")
    zoneless = [n for n, kind in frame.dtypes if kind == "timestamp_ntz"]
    return frame.withColumns({n: F.col(n).cast("timestamp") for n in zoneless})


def _regions(spark: SparkSession, folder: str, prefix: str, name: str) -> DataFrame:
    nations = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.select(F.col("n_nationkey").alias(f"{prefix}_nationkey"),
                          F.col("r_name").alias(name))


def tasks_of(lines: DataFrame) -> int:
    """Tasks for a shuffle of ``lines``: the shuffle partitions, or more where a task had too many lines."""
    partitions = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(partitions, -(-lines.count() // LINES_PER_TASK))


def fare_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """One quote per line item.

    What follows from the line item alone is worked out before the join, and orders meet their customers first,
    so the line items move once and only with the columns that the reader wants.  The suppliers' regions are
    written out: their size is known then, and where it is small the line items need no second shuffle.
    """
    origin = (table(spark, folder, "customer")
              .join(_regions(spark, folder, "c", "origin"), "c_nationkey"))
    destination = materialise(
        table(spark, folder, "supplier").join(_regions(spark, folder, "s", "destination"), "s_nationkey")
        .select("s_suppkey", "destination"), "destinations")
    orders = (table(spark, folder, "orders").withColumn("capture_month", F.trunc("o_orderdate", "month"))
              .join(origin, F.col("o_custkey") == F.col("c_custkey")))
    number, part, price = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_extendedprice")
    horizon = (F.when(number.isin(1, 6), 1).when(number.isin(2, 7), 7).when(number == 3, 15)
               .when(number == 4, 30).otherwise(45))
    status = (F.when(F.col("l_quantity") <= 2, F.lit("parse_error"))
              .when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"),
                    F.lit("sold_out")).otherwise(F.lit("ok")))
    fare = F.when((status == "ok") & (F.col("l_quantity") != 3),
                  F.when(part % 97 == 0, price * 6).otherwise(price))
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "l_extendedprice",
        F.trunc("l_shipdate", "month").alias("travel_month"), horizon.alias("advance_purchase_days"), status.alias("status"), fare.alias("total_fare"),
        F.when(F.col("l_quantity") > 45, F.lit("business")).otherwise(F.lit("economy")).alias("fare_class"))
    # dealt out by the key of the first join: a small or badly split file still feeds all tasks, and a large
    # table takes as many as it needs, so that no sort spills
    joined = (lines.repartition(tasks_of(lines), "l_orderkey")
              .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
              .join(destination, F.col("l_suppkey") == F.col("s_suppkey")))
    source = F.when(F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW"),
                    F.lit("ota")).otherwise(F.lit("airline_direct"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    stamp = F.when(part % 7 == 0, F.concat(day, F.lit("T20:30:00+00:00"))).otherwise(
        F.concat(day, F.lit("T02:30:00+05:30")))
    return joined.select(
        F.col("l_orderkey").alias("order_key"), number.alias("line_number"),
        part.alias("part_key"), F.col("l_suppkey").alias("supp_key"), price.alias("price"),
        "origin", "destination", F.concat("origin", F.lit("-"), "destination").alias("route"),
        F.col("c_mktsegment").alias("carrier_code"),
        F.initcap("c_mktsegment").alias("carrier_name"),
        F.concat(F.substring("c_mktsegment", 1, 2), F.lit(" "), (part % 40).cast("string"))
        .alias("flight_num"),
        F.date_format("travel_month", "yyyy-MM-dd").alias("travel_date"),
        "advance_purchase_days", "fare_class", "total_fare", (part % 7 == 0).alias("fare_split_estimated"), "status",
        F.when(F.col("status") == "parse_error", F.when(part % 2 == 0, F.lit("error"))
               .otherwise(F.lit("parse_error"))).otherwise(F.upper("status")).alias("raw_status"),
        stamp.alias("scraped_at"), F.col("o_orderdate").alias("scraped_ts"), day.alias("capture_day"),
        F.date_format("capture_month", "yyyy-MM-dd").alias("scraped_date"),
        F.concat(F.lit("RUN_"), "o_orderstatus").alias("capture_run"), source.alias("source"),
        F.lower("o_orderpriority").alias("source_name"),
        F.col("o_orderpriority").alias("source_scraper"),
        F.concat(F.lit("raw/"), day, F.lit("/"), "o_orderpriority", F.lit("_raw.csv"))
        .alias("source_file"),
        F.when(part % 11 == 0, F.lit("llm_fallback")).otherwise(F.lit("regex_parser"))
        .alias("data_source_method"))


def raw_captures(q: DataFrame) -> DataFrame:
    """The quotes as capture text again, with the blemishes real captures have."""
    part, text = F.col("part_key"), F.col("price").cast("decimal(18,2)").cast("string")
    return q.select(
        *ROW_ID, F.when(part % 53 != 0, F.col("origin")).alias("origin"), "destination",
        "carrier_code", "carrier_name", F.concat(F.lit("  "), "flight_num").alias("flight_num"),
        "travel_date",
        F.when(part % 31 == 0, F.lit("soon")).when(
            part % 3 == 0, F.concat(F.col("advance_purchase_days").cast("string"), F.lit(".0")))
        .otherwise(F.col("advance_purchase_days").cast("string")).alias("advance_purchase_days"),
        F.when(part % 5 == 0, F.concat(F.lit(" "), F.upper("fare_class"))).otherwise(
            F.col("fare_class")).alias("fare_class"),
        F.lit(None).cast("string").alias("base_fare"),
        F.when(part % 4 == 0, F.lit(" NaT ")).otherwise(F.lit("0")).alias("taxes_and_fees"),
        F.when(part % 37 == 0, F.lit("n.a.")).when(part % 13 == 0, F.lit("None"))
        .when(part % 17 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), text))
        .alias("total_fare"),
        F.when(part % 41 == 0, F.lit("maybe")).when(part % 6 == 0, F.lit("Yes")).when(
            part % 6 == 1, F.lit("FALSE")).when(part % 6 == 2, F.lit("1")).when(
            part % 6 == 3, F.lit("")).otherwise(F.lit("t")).alias("fare_split_estimated"),
        F.lit("10:30").alias("departure_time"),
        F.when(part % 43 == 0, F.lit("weird")).when(part % 8 == 0, F.lit("Blocked")).when(
            part % 8 == 1, F.lit("NO_CARDS_FOUND")).when(part % 8 == 2, F.lit("Timeout"))
        .when(part % 8 == 3, F.lit(" OK ")).otherwise(F.col("raw_status")).alias("status"),
        "scraped_at", "capture_run",
        F.when(part % 2 == 0, F.lit("nan")).otherwise(F.col("source")).alias("source"),
        F.when(part % 3 == 0, F.lit("")).otherwise(F.col("source_name")).alias("source_name"),
        F.when(part % 9 == 0, F.lit("goibibo")).when(part % 9 == 1, F.lit("air_india")).when(
            part % 9 == 2, F.lit("trip_finder")).otherwise(F.lit("spicejet"))
        .alias("source_scraper"), "source_file")


def event_series(spark: SparkSession, folder: str) -> DataFrame:
    """Daily mean value per event type, as a series to forecast."""
    daily = (table(spark, folder, "events")
             .groupBy(F.date_format("ts", "yyyy-MM-dd").alias("ds"),
                      F.col("event_type").alias("target"))
             .agg(F.avg("value").alias("y")))
    share = daily.groupBy("ds").agg((F.count(F.lit(1)) / F.lit(5.0)).alias("completeness"))
    return daily.join(share, "ds")


def selector_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Selector verifications per source: one selector per order status."""
    orders = table(spark, folder, "orders")
    place = F.substring("site", 1, 1).cast("int")
    newest = (orders.groupBy(F.col("o_orderpriority").alias("site"),
                             F.col("o_orderstatus").alias("field"))
              .agg(F.max("o_orderdate").alias("_last")))
    verified = F.col("_last") - F.make_dt_interval(days=4 * place)
    return newest.select("site", "field", F.concat(
        F.date_format(verified, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
        .alias("last_verified_at"), F.lit(True).alias("active"))


_SEARCH = ["page_id", "origin", "destination", "travel_date", "advance_purchase_days",
           "scraped_at", "capture_run"]
SEARCHED = [*ROW_ID, *_SEARCH[1:]]  # columns of the quotes that searches are made from


def _searches(q: DataFrame) -> DataFrame:
    """One search per line item, between two three-letter airports."""
    codes = F.create_map(*[F.lit(v) for pair in (
        ("AFRICA", "AFR"), ("AMERICA", "AME"), ("ASIA", "ASI"), ("EUROPE", "EUR"),
        ("MIDDLE EAST", "MEA")) for v in pair])
    page = F.concat_ws("-", *[F.col(c).cast("string") for c in ROW_ID[:4]],
                       F.col("price").cast("decimal(18,2)").cast("string"))
    rupees = F.floor("price").cast("long")
    return q.select(page.alias("page_id"), codes[F.col("origin")].alias("origin"),
                    codes[F.col("destination")].alias("destination"), "travel_date",
                    "advance_purchase_days", "scraped_at", "capture_run", "part_key",
                    F.concat(F.lit("₹"), F.floor(rupees / 1000).cast("string"), F.lit(","),
                             F.lpad((rupees % 1000).cast("string"), 3, "0")).alias("price_text"))


def card_pages(quotes: DataFrame) -> DataFrame:
    """Pages with two tagged flight cards each; some lack a price or show another airport."""
    s, part = _searches(quotes), F.col("part_key")
    arrival = F.when(part % 10 == 0, F.lit("XXX")).otherwise(F.col("destination"))
    operator = F.when(part % 4 == 0, F.lit("Air India Express")).otherwise(F.lit("Air India"))
    price = F.when(part % 6 == 0, F.lit("")).otherwise(
        F.concat(F.lit("<div class='ai-pb-price'><span><i>₹</i></span><span>"), F.substring("price_text", 2, 99),
                 F.lit("</span></div>")))

    def card(number: Column) -> Column:
        return F.concat(
            F.lit('<ai-pb-flight-card><br><div class="x ai-pb-flight-id"><b> AI '), number,
            F.lit('</b><img src="a>b"></div><span class="ai-pb-departure-city-code">'), F.col("origin"),
            F.lit('</span><span class="ai-pb-arrival-city-code">'), arrival,
            F.lit('</span><i class="ai-pb-operated-by-info">'), operator,
            F.lit('</i><b class="ai-pb-departure-time">07:00</b>'), price,
            F.lit("</ai-pb-flight-card>"))

    html = F.concat(F.lit("<html><body>"), card(part.cast("string")),
                    card((part + 1).cast("string")), F.lit("</body></html>"))
    return s.select(*_SEARCH, html.alias("html"))


def agent_pages(quotes: DataFrame) -> DataFrame:
    """Pages of an agent: the same flight three times, not always with a usable price."""
    s, part = _searches(quotes), F.col("part_key")

    def card(price: Column) -> Column:
        return F.concat(
            F.lit('<div class="a listingCard"><div><p class="airlineName"><span>Akasa Air</span></p>'
                  "<p class='flightCode'>qp "), part.cast("string"),
            F.lit('</p></div><p class="deptTime"><span>09:15</span></p><p class="y">'), price, F.lit("</p></div>"))

    cheap, dear = F.lit("₹ 999"), F.col("price_text")
    html = F.concat(card(cheap), card(F.when(part % 2 == 0, dear).otherwise(F.lit("soon"))),
                    card(F.when(part % 3 == 0, F.lit("₹2,000")).otherwise(F.lit("n/a"))))
    return s.select(*_SEARCH, html.alias("html"))


def line_pages(quotes: DataFrame) -> DataFrame:
    """Pages as plain lines: two flights, or a notice that there are none."""
    s, part = _searches(quotes), F.col("part_key")
    lines = F.concat_ws(
        "\n", F.lit("Results"), F.lit("06:10"), F.lit("08:20"),
        F.concat(F.lit(" SG - "), F.lpad((part % 900 + 100).cast("string"), 3, "0")),
        F.lit("Saver"), "price_text", F.lit("Flexi"), F.lit("₹"), F.lit("7,800"), "price_text",
        F.lit("19:45"), F.lit("SG 77"), F.when(part % 3 == 0, F.lit("₹8,500")).otherwise(
            F.lit("₹120")))
    text = F.when(part % 12 == 0, F.lit("Sorry\nUnfortunately SG 100 is gone\n₹900")).when(
        part % 12 == 1, F.lit("SG 100\nno price")).when(
        part % 12 == 2, F.lit("Nothing here")).otherwise(lines)
    return s.select(*_SEARCH, text.alias("page_text"))


def inline_pages(quotes: DataFrame) -> DataFrame:
    """Pages whose cards read as one run of text, direct and with a stop."""
    s, part = _searches(quotes), F.col("part_key")
    arrival = F.when(part % 10 == 0, F.lit("XXX")).otherwise(F.col("destination"))
    stops = F.when(part % 4 == 0, F.lit("1 stop")).otherwise(F.lit("Non-stop"))
    html = F.concat(
        F.lit("<div class='z'><div class='flex p w-full'><div class='w-full flex'></div><b>QP"), part.cast("string"),
        F.lit("</b><i>06:30</i>"), F.col("origin"), F.lit("<i>"), stops,
        F.lit("</i><i>08:45</i>"), arrival, F.lit("<b>"), F.col("price_text"),
        F.lit("</b></div></div>"))
    return s.select(*_SEARCH, html.alias("html"))


def chip_pages(quotes: DataFrame) -> DataFrame:
    """Pages of an airline with fare chips: two cabins, sold out, hidden chips, or no price at all."""
    s, part = _searches(quotes), F.col("part_key")
    arrival = F.when(part % 10 == 0, F.lit("XXX")).otherwise(F.col("destination"))

    def chip(cabin: str, price) -> Column:
        return F.concat(F.lit(f"<div><div><span class='x fare-category-chip'>{cabin}</span></div>"
                              "<div class='selected-fare__fare-price'><i>₹</i>"), price, F.lit("</div></div>"))

    digits = F.regexp_replace("price_text", "[₹]", "")
    body = (F.when(part % 5 == 0, F.lit("<p>Sold Out</p>"))
            .when(part % 5 == 1, F.concat(F.lit("<div class='selected-fare__fare-price'>"), digits, F.lit("</div>")))
            .when(part % 5 == 2, F.lit("<p>soon</p>"))
            .otherwise(F.concat(chip("Saver", digits), chip("Stretch", F.lit("20,500")))))
    html = F.concat(
        F.lit('<div data-journey-key="k" class="srp__search-result-list__item"><div class="details-wrapper__flight-departure">'
              '<div class="time">06:05</div><p>'), "origin", F.lit('</p></div><div class="details-wrapper__flight-arrival"><p>'),
        arrival, F.lit("</p></div><p>6E "), F.lpad((part % 900 + 100).cast("string"), 3, "0"), F.lit("</p>"), body, F.lit("</div>"))
    return s.select(*_SEARCH, html.alias("html"))


def second_agent_pages(quotes: DataFrame) -> DataFrame:
    """Pages of another agent: cards known by their id, names and prices under other classes."""
    s, part = _searches(quotes), F.col("part_key")
    html = F.concat(
        F.lit('<div id="listing-card-0"><b class="boldFont">Vistara</b><div class="code"><span>uk '), part.cast("string"),
        F.lit('</span></div><div class="price-note">from</div><p class="price">Rs <b>'), F.regexp_replace("price_text", "[₹]", ""),
        F.lit("</b></p></div>"))
    return s.select(*_SEARCH, html.alias("html"))


def priced_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The given pages with a fare card put into each, between filler that grows with the page id."""
    number = F.col("page_id").cast("long")
    card = F.concat(F.lit("<div class='c'><div>10:30 to 12:45</div><div>₹"), (number % 9000 + 1000).cast("string"), F.lit("</div></div>"))
    filler = F.repeat(F.lit("<p>filler</p>"), (number % 40 * 60).cast("int"))
    return table(spark, folder, "pages").select("page_id", F.concat(
        F.coalesce("html", F.lit("")), F.lit("<div>"), filler, card, filler, F.lit("</div>")).alias("html"))
