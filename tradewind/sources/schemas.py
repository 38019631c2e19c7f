"""Explicit schemas of the inputs, so that no read has to infer one."""

from pyspark.sql import types as T


def _fields(names: list[str], kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(name, kind) for name in names]


PRODUCT_HIT = T.StructType(
    [
        T.StructField("v2ProductCategory", T.StringType()),
        T.StructField("productQuantity", T.LongType()),
        T.StructField("productRevenue", T.LongType()),
        T.StructField("productPrice", T.LongType()),
        T.StructField("isImpression", T.BooleanType()),
        T.StructField("isClick", T.BooleanType()),
    ]
)

TRANSACTION = T.StructType(
    [
        T.StructField("transactionId", T.StringType()),
        T.StructField("transactionRevenue", T.LongType()),
    ]
)


def web_session(product_fields: list[str] | None = None) -> T.StructType:
    """One row per visit, hits nested in the row and products nested in the hits.

    Spark does not prune the fields of an array inside an array that it unnests: naming the product
    fields here keeps the others from being read.
    """
    product = T.StructType([f for f in PRODUCT_HIT if product_fields is None or f.name in product_fields])
    hit = T.StructType(
        [
            T.StructField("eCommerceAction", T.StructType(_fields(["action_type"], T.StringType()))),
            T.StructField("transaction", TRANSACTION),
            T.StructField("product", T.ArrayType(product)),
        ]
    )
    return T.StructType([*_VISIT, T.StructField("hits", T.ArrayType(hit))])


_VISIT = [
    T.StructField("fullVisitorId", T.StringType()),
    T.StructField("visitId", T.LongType()),
    T.StructField("visitNumber", T.LongType()),
    T.StructField("date", T.StringType()),
    T.StructField("visitStartTime", T.LongType()),
    T.StructField(
        "totals",
        T.StructType(
            _fields(
                [
                    "hits", "pageviews", "timeOnSite", "bounces", "newVisits", "transactions",
                    "transactionRevenue", "totalTransactionRevenue", "sessionQualityDim",
                ],
                T.LongType(),
            )
        ),
    ),
    T.StructField("trafficSource", T.StructType(_fields(["medium", "campaign"], T.StringType()))),
    T.StructField(
        "geoNetwork",
        T.StructType(_fields(["continent", "subContinent", "country", "region"], T.StringType())),
    ),
]

WEB_SESSION = web_session()

# Raw invoice lines; the timestamp is kept as text until the reader parses it.
RETAIL_CSV = T.StructType(
    [
        T.StructField("InvoiceNo", T.StringType()),
        T.StructField("StockCode", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Quantity", T.LongType()),
        T.StructField("InvoiceDate", T.StringType()),
        T.StructField("UnitPrice", T.DoubleType()),
        T.StructField("CustomerID", T.DoubleType()),
        T.StructField("Country", T.StringType()),
    ]
)

# Visit, hit and product in one flat row, money in millionths.
BEHAVIOR_CSV = T.StructType(
    [
        T.StructField("users", T.StringType()),
        T.StructField("visit_number", T.LongType()),
        T.StructField("visit_id", T.LongType()),
        T.StructField("date", T.StringType()),
        T.StructField("start_time", T.LongType()),
        T.StructField("action", T.StringType()),
        T.StructField("transaction_id", T.StringType()),
        *_fields(
            [
                "transaction_revenue", "num_hits", "pageviews", "time_on_site", "session_quality", "totals_revenue",
                "transactions", "price",
            ],
            T.LongType(),
        ),
        *_fields(["product_category", "medium", "continent", "subcontinent", "country", "region"], T.StringType()),
    ]
)

# Product listings arrive as formatted text throughout.
LISTING_CSV = T.StructType(
    _fields(
        [
            "product_id", "product_name", "category", "discounted_price", "actual_price",
            "discount_percentage", "rating", "rating_count", "about_product", "user_id",
            "user_name", "review_id", "review_title", "review_content", "img_link", "product_link",
        ],
        T.StringType(),
    )
)
