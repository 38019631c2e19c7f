"""Lookup tables, word lists and constants that results depend on."""

# --- product categories ------------------------------------------------------

# Placeholders a tracker leaves in a category path when the page had no category.
CATEGORY_PLACEHOLDERS = ["${escCatTitle}", "${productitem.product.origCatName}", "(not set)"]

# Whole cleaned paths that stand for another path.
CATEGORY_ALIASES = {
    "Apparel//Men's-T-Shirts": "Apparel/Men's/Men's-T-Shirts",
    "Backpacks": "Bags/Backpacks",
    "Bottles": "Accessories/Drinkware/Water Bottles and Tumblers",
    "Drinkware/Bottles": "Accessories/Drinkware/Water Bottles and Tumblers",
    "Drinkware": "Accessories/Drinkware",
    "Drinkware/Mugs and Cups": "Accessories/Drinkware/Mugs and Cups",
    "Drinkware/Water Bottles and Tumblers": "Accessories/Drinkware/Water Bottles and Tumblers",
    "Electronics/Accessories/Drinkware": "Accessories/Drinkware",
    "Drinkware/Mugs": "Accessories/Drinkware/Mugs and Cups",
    "Mugs": "Accessories/Drinkware/Mugs and Cups",
    "Clearance Sale": "Sale/Clearance",
    "Spring Sale!": "Sale/Spring",
    "Fun": "Accessories/Fun",
    "Fruit Games": "Accessories/Fun",
    "Lifestyle/Fun": "Accessories/Fun",
    "Men's-Outerwear": "Apparel/Men's/Men's-Outerwear",
    "Men's/Men's-Performance Wear": "Apparel/Men's/Men's-Performance Wear",
    "Mens Outerwear": "Apparel/Men's/Men's-Outerwear",
    "More Bags": "Bags/More Bags",
    "Notebooks & Journals": "Office/Notebooks & Journals",
    "Office/Office Other": "Office/Other",
    "Office/Writing Instruments": "Office/Writing",
    "Shop by Brand": "Brands",
    "Shop by Brand/Google": "Brands/Google",
    "Shop by Brand/Waze": "Brands/Waze",
    "Shop by Brand/YouTube": "Brands/YouTube",
    "Shop by Brand/Android": "Brands/Android",
    "Google": "Brands/Google",
    "Housewares": "Accessories/Housewares",
    "Headgear": "Apparel/Headgear",
    "Headwear": "Apparel/Headwear",
    "Home": "",
    "Tumblers": "Accessories/Drinkware/Water Bottles and Tumblers",
    "Waze": "Brands/Waze",
    "Wearables": "Apparel",
    "Wearables/Men's T-Shirts": "Apparel/Men's/Men's-T-Shirts",
    "Writing": "Office/Writing",
    "YouTube": "Brands/Youtube",
    "Android": "Brands/Android",
}

# Funnel categories, first match wins: (label, substrings, exact names).
FUNNEL_CATEGORIES = [
    ("Office", ["Office"], ["Notebooks & Journals", "Writing"]),
    ("Apparel", ["Apparel", "Wearables", "Men"], []),
    ("Bags", ["Bags"], ["Backpacks", "More Bags"]),
    ("Brands", ["Brand"], ["Apple", "YouTube", "Waze", "Google"]),
    (
        "Accessories",
        ["Drinkware", "Fun"],
        ["Mugs", "Fruit Games", "Housewares", "Headgear", "Headwear", "Tumblers"],
    ),
    ("Lifestyle", ["Lifestyle"], []),
    ("Electronics", ["Electronics"], []),
    (
        "Unavailable",
        [],
        ["Home", "${escCatTitle}", "(not set)", "${productitem.product.origCatName}"],
    ),
    ("Sale", ["Sale"], []),
]

# Main categories folded into "Other" by the product funnel.
FUNNEL_MERGED_CATEGORIES = ["Brands", "Limited Supply", "Sale", "Kids", "Unavailable", "Other"]

# Labels a top-n report always counts as "Other".
UNRANKED_CATEGORIES = ["Unavailable", "Other"]

# Categories whose regional split is reported, in display order.
REGIONAL_CATEGORIES = ["Apparel", "Office", "Accessories", "Bags", "Electronics"]

# --- web actions -------------------------------------------------------------

ACTION_LABELS = {
    "1": "Click through of product lists",
    "2": "Product detail views",
    "5": "Check out",
    "6": "Completed purchase",
}
ACTIONS_OUTSIDE_FUNNEL = ["0", "3", "4"]
PURCHASE_ACTION = "6"

# --- price sensitivity: (label, lower bound, upper bound), both bounds inclusive,
# --- first match wins; the first tier excludes its upper bound.

SENSITIVITY_FIVE = [
    ("Price-Sensitive", None, 10),
    ("Semi Price-Sensitive", 10, 20),
    ("Medium Price-Sensitive", 20, 50),
    ("Semi-Low Price-Sensitive", 50, 100),
    ("Low-Sensitivity", None, None),
]
SENSITIVITY_THREE = [
    ("Very Price-Sensitive", None, 20),
    ("Medium Price-Sensitive", 20, 100),
    ("Non Price-Sensitive", None, None),
]

# --- channel costs -----------------------------------------------------------

# Twelve months of search tools, social media budget and performance tracking.
ORGANIC_YEARLY_COST = 12 * (3000 + 3000 + 1000)

COST_PER_CLICK = {
    "Accessories": 2.92,
    "Apparel": 2.92,
    "Bags": 2.50,
    "Brands": 3.00,
    "Electronics": 10.76,
    "Gift Cards": 1.76,
    "Kids": 1.50,
    "Lifestyle": 2.50,
    "Limited Supply": 1.76,
    "Office": 3.00,
    "Other": 2.80,
    "Sale": 2.50,
}
COMMISSION = {
    "Apparel": 0.10,
    "Accessories": 0.10,
    "Office": 0.06,
    "Electronics": 0.03,
}
COMMISSION_OTHERWISE = 0.05

# --- retail ------------------------------------------------------------------

COUNTRY_ALIASES = {"EIRE": "Ireland", "RSA": "South Africa"}
GENERIC_COUNTRY_CUSTOMERS = [15108]
BAD_DEBT_PRICES = [-11062.06]
NON_PRODUCT_STOCK_CODES = ["AMAZONFEE", "B", "BANK CHARGES", "CRUK", "S", "PADS"]
FAULTY_INVOICES = ["540699", "564761", "564762"]
POSTAGE_STOCK_CODES = {"DOT": "POST"}
POSTAGE_DESCRIPTIONS = {"DOTCOM POSTAGE": "POSTAGE"}

OUTLIER_DESCRIPTIONS = ["POSTAGE", "Manual", "Carriage"]
OUTLIER_QUANTITIES = [-80995, 80995, -74215, 74215]
LOYALTY_OUTLIER_QUANTITIES = [3114]

NORTHERN_COUNTRIES = [
    "United Kingdom", "France", "Netherlands", "Germany", "Norway", "Ireland",
    "Switzerland", "Spain", "Poland", "Portugal", "Italy", "Belgium", "Lithuania",
    "Japan", "Iceland", "Channel Islands", "Denmark", "Cyprus", "Sweden", "Austria",
    "Israel", "Finland", "Bahrain", "Greece", "Hong Kong", "Czech Republic", "Canada",
    "USA", "Malta",
]
SOUTHERN_COUNTRIES = ["Australia", "Brazil", "South Africa"]
EQUATOR_COUNTRIES = ["Singapore", "Lebanon", "United Arab Emirates", "Saudi Arabia"]

COLD_KEYWORDS = ["WOOLLY", "WARMER", "HOT", "COSY", "CHRISTMAS", "GINGERBREAD"]
OUTDOOR_KEYWORDS = ["PICNIC", "GARDEN", "JAM", "POLKADOT", "TEA", "EASTER"]

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# --- stock: (velocity tier, gap lines an item must exceed, stockout days) ------

STOCKOUT_RULES = [("High", 60, 5), ("Medium", 48, 10), ("Low", 24, 15)]

ORDER_COST = 50
HOLDING_COST = 2
SERVICE_LEVEL_FACTOR = 1.65
LEAD_TIME_WEEKS = 2

# --- pricing -----------------------------------------------------------------

# Price step by demand (rows) and competition (columns).
PRICE_STEPS = {
    "High": {"High": -0.05, "Medium": 0.05, "Low": 0.10},
    "Medium": {"High": 0.0, "Medium": 0.03, "Low": 0.05},
    "Low": {"High": -0.10, "Medium": -0.05, "Low": 0.0},
}
PRICE_CAP = 1.2
