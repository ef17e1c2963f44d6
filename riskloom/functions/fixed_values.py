"""Values fixed by the data sources; results depend on them as written."""

# Company trading status codes.
MARKET_STATUSES = ["ACTV", "PRNA", "ACQU", "DLST", "MERG", "LIQU", "RCNA", "HAAI"]

# Credit event type codes.
EVENT_TYPE_NAMES = {
    110: "Bankruptcy Filing",
    208: "Delisting",
    301: "Default Corp Action",
}

# Commodity sheet: text looked for in a column heading -> column of macro_commodities.
# The order is the order of preference.
COMMODITY_SERIES = [
    ("WTI Crude", "wti_crude"),
    ("Brent Crude", "brent_crude"),
    ("Gasoline", "gasoline"),
    ("Heating Oil", "heating_oil"),
    ("Gasoil", "gasoil"),
    ("Natural Gas", "natural_gas"),
    ("Aluminum", "aluminum"),
    ("Copper", "copper"),
    ("Lead", "lead"),
    ("Nickel", "nickel"),
    ("Zinc", "zinc"),
    ("Gold", "gold"),
    ("Silver", "silver"),
    ("Wheat", "wheat"),
    ("Corn", "corn"),
    ("Soybeans", "soybeans"),
    ("Cotton", "cotton"),
    ("Sugar", "sugar"),
    ("Coffee", "coffee"),
    ("Cocoa", "cocoa"),
    ("Kansas Financial Stress Index", "kansas_financial_stress"),
    ("Iron Ore", "iron_ore"),
    ("Coal", "coal"),
    ("Palm Oil", "palm_oil"),
    ("Rubber", "rubber"),
]

# US macro sheet: text looked for in a value heading -> column of macro_us.
US_MACRO_SERIES = [
    ("gsci", "sp_gsci"),
    ("s&p 500", "sp500"),
    ("sp500", "sp500"),
    ("nasdaq", "nasdaq"),
    ("vix", "vix"),
    ("gdp", "gdp"),
    ("unemployment", "unemployment"),
    ("cpi", "cpi"),
    ("ppi", "ppi"),
    ("exchange rate", "effective_exchange_rate"),
    ("interbank", "interbank_3m"),
    ("house price", "house_price_index"),
    ("current account", "current_account"),
]

# FX sheet: the pair looked for in the description row is also the column of macro_fx.
FX_PAIRS = [
    "audusd", "usdcny", "usdhkd", "usdinr", "usdidr", "usdjpy", "usdmyr", "usdphp",
    "usdsgd", "usdkrw", "usdtwd", "usdthb", "eurusd", "gbpusd", "usdchf", "usdzar",
    "usdnok", "usdsek", "usdbrl", "usdmxn", "usdcad",
]

# Yield sheet: normalised heading -> column of macro_bond_yields.
YIELD_COLUMNS = {
    "us_generic_govt_1_month_yield": "us_1m",
    "us_generic_govt_3_month_yield": "us_3m",
    "us_generic_govt_6_month_yield": "us_6m",
    "us_generic_govt_12_month_yield": "us_1y",
    "us_generic_govt_2_year_yield": "us_2y",
    "us_generic_govt_3_year_yield": "us_3y",
    "us_generic_govt_5_year_yield": "us_5y",
    "us_generic_govt_7_year_yield": "us_7y",
    "us_generic_govt_10_year_yield": "us_10y",
    "us_generic_govt_30_year_yield": "us_30y",
}

# Measures of the monthly risk panel, in file order.
PANEL_MEASURES = [
    "stk_index", "st_int", "m2b", "sigma", "dtd_median", "dtd_median_i", "dtd",
    "liquidity_r", "ni2ta", "size", "liquidity_fin",
]

# Headings of the panel file; the heading DTDmedian occurs twice.
PANEL_HEADINGS = [
    "Company_Number", "year", "month", "StkIndx", "STInt", "m2b", "sigma", "DTDmedian",
    "DTDmedian", "dtd", "liquidity_r", "ni2ta", "size", "liquidity_fin",
]

# Words a read-only query may not contain, in the order they are reported.
FORBIDDEN_WORDS = [
    "INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "TRUNCATE", "GRANT",
    "REVOKE", "EXEC", "EXECUTE", "INTO OUTFILE", "INTO DUMPFILE", "LOAD_FILE",
]

# Longest text each column may hold.
MAX_LENGTHS = {
    "industry_mapping": {
        "industry_sector": 50, "industry_group": 100, "industry_subgroup": 100,
    },
    "companies": {
        "id_bb_unique": 30, "ticker": 30, "company_name": 200, "country_name": 100,
        "security_type": 50, "market_status": 10, "prime_exchange": 50, "domicile": 100,
        "id_isin": 20, "id_cusip": 15,
    },
    "credit_events": {"action_name": 100},
}
