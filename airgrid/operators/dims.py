"""Small dimension tables.  Call signs are a parameter: pass a larger table where one is at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Logo folder and file suffix of each supported country.
COUNTRIES = {"USA": ("united-states", "-us"), "CAN": ("canada", "-ca"), "GBR": ("united-kingdom", "-uk")}
LOGO_BASE = "https://raw.githubusercontent.com/tv-logo/tv-logos/main/countries"
LOCAL_DIR = "us-local/"

# Short forms of affiliates' full names.
AFFILIATE_ALIASES = {
    "home box office": "hbo",
    "national broadcasting company": "nbc",
    "american broadcasting company": "abc",
    "cbs television network": "cbs-logo-white",
    "fox entertainment": "fox",
    "fox broadcasting": "fox",
    "fox broadcasting company": "fox",
    "turner network television": "tnt",
    "entertainment and sports programming network": "espn",
    "cable news network": "cnn",
    "the weather channel": "weather-channel",
    "comedy central": "comedy-central",
    "cartoon network": "cartoon-network",
    "animal planet": "animal-planet",
    "public broadcasting service": "pbs",
    "cable-satellite public affairs network": "c-span-1",
    "turner classic movies": "tcm",
    "american movie classics": "amc",
    "freeform": "freeform",
    "fx networks": "fx",
    "investigation discovery": "investigation-discovery",
    "oprah winfrey network": "oprah-winfrey-network",
    "a and e": "a-and-e",
    "a&e": "a-and-e",
}

# Networks with local stations.
NETWORK_SLUGS = {
    "abc": "abc",
    "american broadcasting company": "abc",
    "cbs": "cbs",
    "cbs television network": "cbs",
    "nbc": "nbc",
    "national broadcasting company": "nbc",
    "fox": "fox",
    "fox broadcasting": "fox",
    "fox broadcasting company": "fox",
    "fox entertainment": "fox",
    "the cw": "cw",
    "cw": "cw",
    "pbs": "pbs",
    "public broadcasting service": "pbs",
    "telemundo": "telemundo",
    "univision": "univision",
    "unimas": "unimas",
    "my network tv": "my-network-tv",
}

# Networks that begin compound call signs, in order.
KNOWN_PREFIXES = [
    "espn", "fox", "hbo", "cnn", "tbs", "tnt", "usa", "amc", "bet", "bravo", "mtv",
    "nick", "syfy", "tlc", "vh1", "food", "hgtv", "lifetime", "oxygen", "showtime", "starz",
]

# A starting set of call signs; the full table is a parameter.
CALLSIGN_SLUGS = {
    "aetv": "a-and-e",
    "apl": "animal-planet",
    "history": "history-channel",
    "dsc": "discovery-channel",
    "id": "investigation-discovery",
    "disn": "disney-channel",
    "bbca": "bbc-america",
    "fnc": "fox-news",
    "golf": "nbc-golf",
    "mlbn": "mlb-network",
    "nbatv": "nba-tv",
    "nflnet": "nfl-network",
    "toon": "cartoon-network",
    "toonp": "cartoon-network",
    "max": "cinemax",
    "cinehp": "cinemax-hits",
    "cineh": "cinemax-hits",
    "comedy": "comedy-central",
    "food": "food-network",
    "cspan": "c-span-1",
    "freefrm": "freeform",
    "hall": "hallmark-channel",
    "life": "lifetime",
    "own": "oprah-winfrey-network",
    "sho": "showtime",
    "stz": "starz",
    "up": "up-tv",
    "weath": "weather-channel",
    "hbo2": "hbo",
}

CALLSIGN_SCHEMA = "callsign string, slug string"


def callsigns(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``callsign, slug``: from a CSV file with a header in any store Spark reads, or the starting set."""
    if path:
        return spark.read.csv(path, schema=CALLSIGN_SCHEMA, header=True)
    return spark.createDataFrame(list(CALLSIGN_SLUGS.items()), CALLSIGN_SCHEMA)
