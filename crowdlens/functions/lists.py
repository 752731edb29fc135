"""Dimension data: prose words that look like symbols, delisted symbols, instruments of themes and foreign names.

The theme keywords and the themes' tickers are longer than a table should be, so they are parameters of their operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Capital words that are prose unless written as cashtags.
BARE_PROSE_STOP = tuple(
    dict.fromkeys(
        """ABOUT AFTER AGAIN ALSO BACK BEEN BEFORE BEING BEST BOTH CALL CAME CASE COME CORP COST DAYS DOES DONE DOWN DRUG EACH EDIT
        ELSE EVEN EVER FEEL FIND FIRST FIVE FOUR FROM FULL GAIN GAVE GIVE GOOD GONE HARD HALF HAVE HELP HERE HIGH HOLD HOUR HOPE INTO
        JUST KEEP KEPT KNOW LAST LEFT LIFE LIKE LINE LONG LOOK LOSS LOW LOVE LUCK MADE MAKE MANY MEAN MORE MOST MUCH MUST MOVE NEAR
        NEED NEXT NICE ONCE ONLY OPEN OVER PART PICK PLAY POST PUT READ REAL RIGHT SAID SAME SEEN SELL SHOW SOME SUCH TAKE TALK TELL
        THAN THAT THEM THEN THEY THIS TIME TOLD TOOK TURN VERY WAIT WANT WELL WENT WERE WHAT WHEN WILL WITH WORD WORK YEAR YOUR ZERO
        AREA BASE CARE CASH DATA FACT FAST FLOW FORM FREE FUND GAME GROW HEAD HOME IDEA INFO KIND LIST LIVE MAIN MIND NAME NEWS NOTE
        PLAN POINT RATE REST RULE SAFE SIDE SURE TEAM TRUE TYPE USED WAYS WEEK
        AWAY EASY EDGE GOLD HODL HUGE LOAN MEME MOON PUMP RIDE SAVE SEEM SIZE TEST TLDR""".split()
    )
)
# Symbols that the present directories no longer list.
DELISTED_TICKERS = tuple("BBBY WISH EXPR NAKD SPRT ATER MULN RDBX CTRM GNUS CLVS SDC APRN FSR".split())
# The instrument that stands for a theme; crypto, cannabis and small_caps have none.
THEME_ETFS = {
    "semiconductors": "SMH", "memory": "SMH", "ai": "IYW", "datacenters": "VPN", "ai_megacap": "QQQ", "gold_metals": "GLD",
    "energy": "XLE", "ev_clean_energy": "LIT", "uranium_nuclear": "URA", "defense_aerospace": "ITA", "europe_defense": "ITA",
    "short_squeeze": "ARKK", "meme_stocks": "ARKK", "biotech_pharma": "XBI", "rates_bonds": "TLT", "real_estate": "XLRE",
    "cloud_saas": "IGV", "china_geopolitics": "KWEB", "financials": "XLF", "consumer_retail": "XLY", "cybersecurity": "CIBR",
    "fintech_payments": "XLF", "gaming_esports": "SOCL", "travel_airlines": "JETS", "housing_builders": "ITB",
    "robotics_automation": "XLI", "space": "ITA", "quantum_computing": "IYW", "weight_loss_glp1": "XLV", "solar": "LIT",
    "agriculture_food": "XLP", "shipping_logistics": "IYT", "utilities_power": "XLU", "media_streaming": "XLC",
    "infrastructure": "XLI", "japan": "1622 JT",
}
# A theme's instruments in order of preference where the first has no prices.
THEME_FALLBACKS = {
    "semiconductors": ["SMH", "SOXX"], "memory": ["SMH", "SOXX"], "ai": ["IYW", "QQQ", "XLK"], "datacenters": ["VPN", "IYW"],
    "ai_megacap": ["QQQ", "XLK"], "gold_metals": ["GLD", "GDX", "SLV", "SIL", "COPX"], "energy": ["XLE", "XOP", "OIH", "USO", "UNG"],
    "ev_clean_energy": ["LIT", "XLY"], "defense_aerospace": ["ITA", "XLI"], "europe_defense": ["ITA"], "biotech_pharma": ["XBI", "XLV"],
    "rates_bonds": ["TLT", "LQD", "HYG", "TIP"], "real_estate": ["XLRE", "ITB"], "cloud_saas": ["IGV", "IYW"],
    "china_geopolitics": ["KWEB", "FXI", "ASHR", "CQQQ"], "financials": ["XLF", "KBE"], "fintech_payments": ["XLF", "IGV"],
    "gaming_esports": ["SOCL", "IYW"], "housing_builders": ["ITB", "XLB"], "robotics_automation": ["XLI", "IYW", "ARKK"],
    "space": ["ITA"], "quantum_computing": ["IYW", "QQQ"], "weight_loss_glp1": ["XLV", "XBI"], "solar": ["LIT", "XLU"],
    "agriculture_food": ["XLP", "XLB"], "media_streaming": ["XLC", "SOCL"], "infrastructure": ["XLI", "XLB"],
}
# The listed receipt that prices a foreign company.
INTERNATIONAL_ADRS = {
    "Fanuc": "FANUY", "Yaskawa": "YASKY", "Keyence": "KYCCY", "THK": "THKLY", "Nabtesco": "NCTKY", "SKF": "SKFRY",
    "Tokyo Electron": "TOELY", "Advantest": "ATEYY", "Lasertec": "LSRCY", "Disco Corp": "DSCSY", "SUMCO": "SUOPY",
    "Rheinmetall": "RNMBY", "BAE Systems": "BAESY", "Thales": "THLLY", "Saab": "SAABY", "Leonardo": "FINMY", "Airbus": "EADSY",
    "BYD": "BYDDY", "Softbank": "SFTBY",
}


def anchors(spark: SparkSession) -> DataFrame:
    """(name, candidates): a theme's instruments in order, ready for `prices.first_priced`."""
    rows = [(theme, list(dict.fromkeys([first, *THEME_FALLBACKS.get(theme, [])]))) for theme, first in THEME_ETFS.items()]
    return spark.createDataFrame(rows, "name string, candidates array<string>")


def universe(listed: DataFrame) -> DataFrame:
    """S11, SO2: the listed symbols (ticker) and the delisted ones, each once."""
    return listed.select("ticker").union(listed.sparkSession.createDataFrame([(t,) for t in DELISTED_TICKERS], "ticker string")).distinct()
