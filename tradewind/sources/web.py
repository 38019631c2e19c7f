"""Web sessions, hits and product hits, from nested sessions or from the event table.

All web jobs take one of three flat shapes:

* sessions - one row per visit (totals, traffic source, place);
* hits     - one row per hit with its session's keys;
* products - one row per product of a hit.

Nested input is flattened by `explode`. The event table is already flat, so its shapes are derived
without ever gathering a visit's hits into one row.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.skew import join_keyed
from .files import table

DAY_ZERO = "2024-01-01"

CHANNELS = ["organic", "cpc", "cpm", "referral", "affiliate", "(none)"]
CAMPAIGNS = ["(not set)", "Campaign A", "Campaign B", "Campaign C"]
CONTEXT = ["channel", "campaign", "continent", "sub_continent", "country", "region"]
KEYS = ["full_visitor_id", "visit_id", "date"]
TOTALS = [
    "visit_number", "visit_start_time", "hit_count", "pageviews", "time_on_site", "bounces", "new_visits",
    "transactions", "transaction_revenue", "total_transaction_revenue", "session_quality",
]

# --- nested input --------------------------------------------------------------

_SESSION_FIELDS = {
    "full_visitor_id": "fullVisitorId",
    "visit_id": "visitId",
    "date": "date",
    "channel": "trafficSource.medium",
    "campaign": "trafficSource.campaign",
    "continent": "geoNetwork.continent",
    "sub_continent": "geoNetwork.subContinent",
    "country": "geoNetwork.country",
    "region": "geoNetwork.region",
    "visit_number": "visitNumber",
    "visit_start_time": "visitStartTime",
    "hit_count": "totals.hits",
    "pageviews": "totals.pageviews",
    "time_on_site": "totals.timeOnSite",
    "bounces": "totals.bounces",
    "new_visits": "totals.newVisits",
    "transactions": "totals.transactions",
    "transaction_revenue": "totals.transactionRevenue",
    "total_transaction_revenue": "totals.totalTransactionRevenue",
    "session_quality": "totals.sessionQualityDim",
}


_PRODUCT_FIELDS = {
    "category": "v2ProductCategory",
    "product_quantity": "productQuantity",
    "product_revenue": "productRevenue",
    "product_price": "productPrice",
    "is_impression": "isImpression",
    "is_click": "isClick",
}


def flat_sessions(nested: DataFrame) -> DataFrame:
    """One row per visit. A visit folded into several rows has its totals on each; the first one counts."""
    if "part" in nested.columns:
        nested = nested.where(F.coalesce("part", F.lit(0)) == 0)
    return nested.select(*[F.col(path).alias(name) for name, path in _SESSION_FIELDS.items()])


def flat_hits(nested: DataFrame) -> DataFrame:
    """One row per hit; visits without hits vanish. Session totals get a `session_` prefix."""
    names = {name: f"session_{name}" if name in TOTALS else name for name in _SESSION_FIELDS}
    session = [F.col(path).alias(names[name]) for name, path in _SESSION_FIELDS.items()]
    return nested.select(*session, F.explode("hits").alias("hit")).select(
        *names.values(),
        F.col("hit.eCommerceAction.action_type").alias("action"),
        F.col("hit.transaction.transactionId").alias("transaction_id"),
        F.col("hit.transaction.transactionRevenue").alias("transaction_revenue"),
        F.col("hit.product").alias("product"),
    )


def flat_products(hits: DataFrame) -> DataFrame:
    """One row per product of a hit, with the product fields that were read.

    Hits without products vanish.
    """
    kept = [c for c in hits.columns if c != "product"]
    present = hits.schema["product"].dataType.elementType.names
    fields = [F.col(f"p.{path}").alias(name) for name, path in _PRODUCT_FIELDS.items() if path in present]
    return hits.select(*kept, F.explode("product").alias("p")).select(*kept, *fields)


# --- event table ----------------------------------------------------------------


def _day_column(day: str):
    return F.lit(f"{day[:4]}-{day[4:6]}-{day[6:]}").cast("date")


def _events(spark: SparkSession, folder: str, first_day: str | None, last_day: str | None) -> DataFrame:
    """Events of the date range; the bounds are on the raw timestamp, so the scan can skip. None leaves a side open."""
    events = table(spark, folder, "events")
    if first_day is not None:
        events = events.where(F.col("ts") >= _day_column(first_day).cast("timestamp_ntz"))
    if last_day is not None:
        events = events.where(F.col("ts") < F.date_add(_day_column(last_day), 1).cast("timestamp_ntz"))
    day = F.datediff(F.to_date("ts"), F.lit(DAY_ZERO).cast("date")).cast("bigint")
    return events.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        day.alias("day"),
        F.round(F.col("value") * 1e6).cast("bigint").alias("micros"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
    )


def _with_keys(rows: DataFrame) -> DataFrame:
    """Visitor, visit and date of a (user_id, day): a visitor is a user within a block of days."""
    user, day = F.col("user_id"), F.col("day")
    # Days before the first one are negative.
    block = F.floor(day / (user % 10 + 1))
    date = F.date_add(F.lit(DAY_ZERO).cast("date"), day.cast("int"))
    return rows.withColumns(
        {
            "full_visitor_id": F.concat(user.cast("string"), F.lit("-"), block.cast("string")),
            "visit_id": day * 10 + user % 10,
            "date": F.date_format(date, "yyyyMMdd"),
        }
    )


def _pick(names: list[str], position):
    return F.get(F.array(*[F.lit(name) for name in names]), position.cast("int"))


def _with_context(rows: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    # Nations and regions are fixed lists of 25 and 5 rows.
    region = table(spark, folder, "region")
    place = table(spark, folder, "nation").join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    half = (F.col("n_nationkey") % 2).cast("string")
    place = place.select(
        F.col("n_nationkey").cast("bigint").alias("place_key"),
        F.col("r_name").alias("continent"),
        F.concat("r_name", F.lit("-"), half).alias("sub_continent"),
        F.col("n_name").alias("country"),
    )
    joined = rows.join(F.broadcast(place), F.col("user_id") % 25 == F.col("place_key")).drop("place_key")
    return joined.withColumns(
        {
            "channel": _pick(CHANNELS, F.col("user_id") % 6),
            "campaign": _pick(CAMPAIGNS, F.pmod(F.col("user_id") + F.col("day"), F.lit(4))),
            "region": F.concat("country", F.lit("-"), (F.col("user_id") % 3).cast("string")),
        }
    )


def event_hits(
    spark: SparkSession,
    folder: str,
    first_day: str | None = None,
    last_day: str | None = None,
    session_totals: bool = False,
) -> DataFrame:
    """Hits of the event table, of all days unless the caller bounds them (`yyyyMMdd`, both included).

    Session totals cost a join, so they come only on request.
    """
    events = _events(spark, folder, first_day, last_day)
    kind = F.col("event_type")
    action = (
        F.when(kind == "click", "1")
        .when(kind == "view", "2")
        .when(kind == "purchase", "6")
        .when(kind == "error", "0")
        .when(F.col("k") < 34, "3")
        .when(F.col("k") < 50, "4")
        .otherwise("5")
    )
    bought = kind == "purchase"
    hits = _with_context(_with_keys(events), spark, folder).select(
        *KEYS,
        *CONTEXT,
        "user_id",
        "day",
        "event_type",
        "event_id",
        "k",
        action.alias("action"),
        F.when(bought, F.concat(F.lit("T"), F.col("event_id").cast("string"))).alias("transaction_id"),
        F.when(bought, F.col("micros")).alias("transaction_revenue"),
    )
    if session_totals:
        sessions = event_sessions(spark, folder, first_day, last_day)
        totals = sessions.select("user_id", "day", *[F.col(c).alias(f"session_{c}") for c in TOTALS])
        count = _events(spark, folder, first_day, last_day).agg(F.count("*")).scalar()
        hits = join_keyed(hits, totals, ["user_id", "day"], "session_hit_count", count, ["event_id"])
    return hits


def event_products(
    hits: DataFrame, spark: SparkSession, folder: str, catalog: bool = True, all_hits: bool = False
) -> DataFrame:
    """Products of the hits; `catalog=False` leaves out category and price, and the join for them.

    With `all_hits`, a hit without a product is a row without a `position`.
    """
    second = F.col("k") % 3 == 0
    positions = F.when(second, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    sold = F.col("event_type") != "error"
    if all_hits:
        rows = hits.withColumn("position", F.explode_outer(F.when(sold, positions)))
    else:
        # Errors carry no product. Drop them before the explode, where the scan can use the filter.
        rows = hits.where(sold).withColumn("position", F.explode(positions))
    items = F.when(second, 2).otherwise(1)
    rows = rows.withColumns(
        {
            "product_quantity": (F.lit(1) + F.col("k") % 5).cast("bigint"),
            "product_revenue": F.floor(F.col("transaction_revenue") / items),
            "is_impression": F.col("action") == "2",
            "is_click": F.col("action") == "1",
        }
    )
    if not catalog:
        return rows
    parts = table(spark, folder, "part")
    count = parts.agg(F.count("*")).scalar()
    part_no = (F.col("event_id") * 7 + F.col("position") * 13) % count
    parts = parts.select(
        "p_partkey",
        F.concat(F.lit("Home/"), F.col("p_type"), F.lit("/"), F.col("p_brand"), F.lit("/")).alias("part_path"),
        F.round(F.col("p_retailprice") * 1e6).cast("bigint").alias("product_price"),
    )
    kind = "left" if all_hits else "inner"
    joined = rows.withColumn("part_no", part_no).join(parts, F.col("part_no") == F.col("p_partkey"), kind)
    fixed = ["(not set)", "Home/", "Drinkware", "${escCatTitle}", "Wearables/Men's T-Shirts"]
    fixed.append("Home/Office/Writing Instruments/")
    digit = F.col("k") % 10
    category = F.when(digit < len(fixed), _pick(fixed, digit)).otherwise(F.col("part_path"))
    return joined.withColumn("category", category).drop("part_path", "p_partkey")


def event_sessions(
    spark: SparkSession, folder: str, first_day: str | None = None, last_day: str | None = None
) -> DataFrame:
    """One session per user and day, of all days unless the caller bounds them.

    Visit numbers count from the visitor's first visit in the table, whatever the first day.
    Totals are plain aggregates with map-side partials. The window that numbers a visitor's visits
    sees one row per day; Catalyst drops it from the plan of a job that does not use the numbers.
    """
    events = _events(spark, folder, None, last_day)
    seen = F.col("event_type").isin("view", "click")
    bought = F.col("event_type") == "purchase"
    sessions = events.groupBy("user_id", "day").agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count("*").alias("hit_count"),
        F.count_if(seen).alias("seen"),
        F.count_if(bought).alias("bought"),
        F.sum(F.when(bought, F.col("micros"))).alias("revenue"),
    )
    sessions = _with_keys(sessions)
    visits = Window.partitionBy("full_visitor_id").orderBy("day")
    number = F.row_number().over(visits).cast("bigint")
    sessions = sessions.withColumn("visit_number", number)
    if first_day is not None:
        sessions = sessions.where(F.col("date") >= first_day)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return _with_context(sessions, spark, folder).select(
        *KEYS,
        *CONTEXT,
        "user_id",
        "day",
        "visit_number",
        F.timestamp_diff("SECOND", epoch, F.col("first_ts")).alias("visit_start_time"),
        "hit_count",
        F.nullif("seen", F.lit(0)).cast("bigint").alias("pageviews"),
        F.nullif(F.timestamp_diff("SECOND", F.col("first_ts"), F.col("last_ts")), F.lit(0)).alias("time_on_site"),
        F.when(F.col("hit_count") == 1, 1).cast("bigint").alias("bounces"),
        F.when(F.col("visit_number") == 1, 1).cast("bigint").alias("new_visits"),
        F.nullif("bought", F.lit(0)).cast("bigint").alias("transactions"),
        F.col("revenue").alias("transaction_revenue"),
        F.col("revenue").alias("total_transaction_revenue"),
        F.when(F.col("seen") > 0, F.least(F.lit(100), F.col("hit_count") * 10)).cast("bigint").alias("session_quality"),
    )


# --- folding into nested sessions -------------------------------------------------

# Hits in one nested row, about; a visit with more of them is folded into several rows.
HITS_A_ROW = 500


def fold_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Nested sessions of the event table: hits in the row of their visit, products in their hit.

    A row holds about `HITS_A_ROW` hits: a longer visit is dealt by hash to `part`s, each with the totals of the
    visit, so that no task gathers a visit of any length. (Part 0 would be empty with a chance below 1e-100.)
    """
    hits = event_hits(spark, folder, session_totals=True)
    rows = event_products(hits, spark, folder, all_hits=True)
    parts = F.ceil(F.col("session_hit_count") / HITS_A_ROW)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("event_id"), parts).cast("int"))
    # One shuffle for both groupings.
    visit = ["user_id", "day", "part"]
    product = F.struct("position", *[F.col(name).alias(path) for name, path in _PRODUCT_FIELDS.items()])
    listed = F.sort_array(F.collect_list(F.when(F.col("position").isNotNull(), product)))
    session = [*KEYS, *CONTEXT, *[f"session_{name}" for name in TOTALS]]
    by_hit = rows.repartition(*visit).groupBy(*visit, "event_id").agg(
        F.any_value(F.struct("action", "transaction_id", "transaction_revenue")).alias("of"),
        F.any_value(F.struct(*session)).alias("s"),
        F.transform(listed, lambda p: p.dropFields("position")).alias("product"),
    )
    paid = F.struct(
        F.col("of.transaction_id").alias("transactionId"), F.col("of.transaction_revenue").alias("transactionRevenue")
    )
    hit = F.struct(
        "event_id",
        F.struct(F.col("of.action").alias("action_type")).alias("eCommerceAction"),
        F.when(F.col("of.transaction_id").isNotNull(), paid).alias("transaction"),
        "product",
    )
    by_visit = by_hit.groupBy(*visit).agg(F.any_value("s").alias("s"), F.sort_array(F.collect_list(hit)).alias("hits"))

    def fields(struct):
        names = {path.split(".")[1]: name for name, path in _SESSION_FIELDS.items() if path.startswith(f"{struct}.")}
        return F.struct(
            *[F.col(f"s.{'session_' * (name in TOTALS)}{name}").alias(path) for path, name in names.items()]
        ).alias(struct)

    return by_visit.select(
        F.col("s.full_visitor_id").alias("fullVisitorId"),
        F.col("s.visit_id").alias("visitId"),
        F.col("s.session_visit_number").alias("visitNumber"),
        F.col("s.date").alias("date"),
        F.col("s.session_visit_start_time").alias("visitStartTime"),
        fields("totals"),
        fields("trafficSource"),
        fields("geoNetwork"),
        F.transform("hits", lambda h: h.dropFields("event_id")).alias("hits"),
        "part",
    )
