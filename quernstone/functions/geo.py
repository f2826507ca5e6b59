"""Region and country words as tables, and their resolution as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ISO-3166 alpha-2 codes of regions, by name.
REGIONS = {
    "europe": [
        "at", "be", "bg", "hr", "cy", "cz", "dk", "ee", "fi", "fr", "de", "gr", "hu", "ie", "it", "lv", "lt", "lu", "mt",
        "nl", "pl", "pt", "ro", "sk", "si", "es", "se", "gb", "uk", "ch", "no", "is", "li", "mc", "sm", "ad", "va", "rs",
        "ba", "me", "mk", "al", "md", "ua", "by", "ru", "tr", "ge", "am", "az", "xk",
    ],
    "european": [
        "at", "be", "bg", "hr", "cy", "cz", "dk", "ee", "fi", "fr", "de", "gr", "hu", "ie", "it", "lv", "lt", "lu", "mt",
        "nl", "pl", "pt", "ro", "sk", "si", "es", "se", "gb", "uk", "ch", "no", "is", "li", "mc", "sm", "ad", "va", "rs",
        "ba", "me", "mk", "al", "md", "ua", "by", "ru", "tr", "ge", "am", "az", "xk",
    ],
    "european union": [
        "at", "be", "bg", "hr", "cy", "cz", "dk", "ee", "fi", "fr", "de", "gr", "hu", "ie", "it", "lv", "lt", "lu", "mt",
        "nl", "pl", "pt", "ro", "sk", "si", "es", "se",
    ],
    "eu": [
        "at", "be", "bg", "hr", "cy", "cz", "dk", "ee", "fi", "fr", "de", "gr", "hu", "ie", "it", "lv", "lt", "lu", "mt",
        "nl", "pl", "pt", "ro", "sk", "si", "es", "se",
    ],
    "eea": [
        "at", "be", "bg", "hr", "cy", "cz", "dk", "ee", "fi", "fr", "de", "gr", "hu", "ie", "it", "lv", "lt", "lu", "mt",
        "nl", "pl", "pt", "ro", "sk", "si", "es", "se", "no", "is", "li",
    ],
    "western europe": ["fr", "de", "nl", "be", "lu", "at", "ch", "gb", "ie", "es", "pt", "it"],
    "eastern europe": ["pl", "cz", "sk", "hu", "ro", "bg", "hr", "si", "ee", "lv", "lt", "ua", "md", "rs"],
    "northern europe": ["se", "no", "dk", "fi", "is", "ee", "lv", "lt", "gb", "ie"],
    "southern europe": ["es", "pt", "it", "gr", "hr", "si", "mt", "cy"],
    "central europe": ["de", "at", "ch", "pl", "cz", "sk", "hu", "si"],
    "scandinavia": ["se", "no", "dk"],
    "scandinavian": ["se", "no", "dk"],
    "nordics": ["se", "no", "dk", "fi", "is"],
    "nordic": ["se", "no", "dk", "fi", "is"],
    "nordic countries": ["se", "no", "dk", "fi", "is"],
    "dach": ["de", "at", "ch"],
    "benelux": ["be", "nl", "lu"],
    "iberia": ["es", "pt"],
    "iberian peninsula": ["es", "pt"],
    "baltics": ["ee", "lv", "lt"],
    "baltic states": ["ee", "lv", "lt"],
    "british isles": ["gb", "ie"],
    "north america": ["us", "ca", "mx"],
    "latin america": ["mx", "br", "ar", "cl", "co", "pe", "uy", "ve", "ec", "bo", "py", "cr", "pa"],
    "south america": ["br", "ar", "cl", "co", "pe", "uy", "ve", "ec", "bo", "py"],
    "apac": ["cn", "jp", "kr", "in", "au", "nz", "sg", "my", "th", "id", "ph", "vn", "tw", "hk", "bd", "pk", "lk"],
    "asia pacific": ["cn", "jp", "kr", "in", "au", "nz", "sg", "my", "th", "id", "ph", "vn", "tw", "hk", "bd", "pk", "lk"],
    "asia-pacific": ["cn", "jp", "kr", "in", "au", "nz", "sg", "my", "th", "id", "ph", "vn", "tw", "hk", "bd", "pk", "lk"],
    "southeast asia": ["sg", "my", "th", "id", "ph", "vn", "kh", "la", "mm", "bn"],
    "middle east": ["ae", "sa", "qa", "kw", "bh", "om", "jo", "lb", "il", "iq", "ir", "ye", "sy"],
    "mena": ["ae", "sa", "qa", "kw", "bh", "om", "eg", "ma", "tn", "dz", "jo", "lb", "il", "iq", "ir"],
    "gcc": ["ae", "sa", "qa", "kw", "bh", "om"],
    "africa": [
        "za", "ng", "ke", "eg", "ma", "gh", "tz", "ug", "et", "dz", "tn", "sn", "ci", "cm", "zm", "zw", "rw", "mz", "ao",
    ],
    "oceania": ["au", "nz", "fj", "pg"],
    "global": [],
    "worldwide": [],
    "anywhere": [],
}
# Country names and their codes.
COUNTRIES = {
    "afghanistan": "af", "albania": "al", "algeria": "dz", "andorra": "ad", "angola": "ao", "argentina": "ar",
    "armenia": "am", "australia": "au", "austria": "at", "azerbaijan": "az", "bahrain": "bh", "bangladesh": "bd",
    "belarus": "by", "belgium": "be", "bolivia": "bo", "bosnia": "ba", "bosnia and herzegovina": "ba", "brazil": "br",
    "brunei": "bn", "bulgaria": "bg", "cambodia": "kh", "cameroon": "cm", "canada": "ca", "chile": "cl", "china": "cn",
    "colombia": "co", "costa rica": "cr", "croatia": "hr", "cyprus": "cy", "czech republic": "cz", "czechia": "cz",
    "denmark": "dk", "ecuador": "ec", "egypt": "eg", "estonia": "ee", "ethiopia": "et", "finland": "fi", "france": "fr",
    "georgia": "ge", "germany": "de", "ghana": "gh", "greece": "gr", "hong kong": "hk", "hungary": "hu", "iceland": "is",
    "india": "in", "indonesia": "id", "iran": "ir", "iraq": "iq", "ireland": "ie", "israel": "il", "italy": "it",
    "ivory coast": "ci", "japan": "jp", "jordan": "jo", "kazakhstan": "kz", "kenya": "ke", "kuwait": "kw", "latvia": "lv",
    "lebanon": "lb", "liechtenstein": "li", "lithuania": "lt", "luxembourg": "lu", "malaysia": "my", "malta": "mt",
    "mexico": "mx", "moldova": "md", "monaco": "mc", "montenegro": "me", "morocco": "ma", "mozambique": "mz",
    "myanmar": "mm", "netherlands": "nl", "holland": "nl", "new zealand": "nz", "nigeria": "ng", "north macedonia": "mk",
    "macedonia": "mk", "norway": "no", "oman": "om", "pakistan": "pk", "panama": "pa", "papua new guinea": "pg",
    "paraguay": "py", "peru": "pe", "philippines": "ph", "poland": "pl", "portugal": "pt", "qatar": "qa", "romania": "ro",
    "russia": "ru", "russian federation": "ru", "rwanda": "rw", "san marino": "sm", "saudi arabia": "sa", "senegal": "sn",
    "serbia": "rs", "singapore": "sg", "slovakia": "sk", "slovenia": "si", "south africa": "za", "south korea": "kr",
    "korea": "kr", "spain": "es", "sri lanka": "lk", "sweden": "se", "switzerland": "ch", "syria": "sy", "taiwan": "tw",
    "tanzania": "tz", "thailand": "th", "tunisia": "tn", "turkey": "tr", "uganda": "ug", "ukraine": "ua",
    "united arab emirates": "ae", "uae": "ae", "united kingdom": "gb", "uk": "gb", "britain": "gb", "great britain": "gb",
    "england": "gb", "scotland": "gb", "wales": "gb", "northern ireland": "gb", "united states": "us",
    "united states of america": "us", "usa": "us", "us": "us", "america": "us", "uruguay": "uy", "uzbekistan": "uz",
    "venezuela": "ve", "vietnam": "vn", "yemen": "ye", "zambia": "zm", "zimbabwe": "zw",
}
# Codes in use that are not canonical, and the alpha-3 codes that are understood.
RECODED = {"uk": "gb", "el": "gr"}
ALPHA3 = {"usa": "us", "gbr": "gb", "deu": "de", "fra": "fr", "che": "ch", "swe": "se", "nor": "no", "dnk": "dk", "fin": "fi", "rou": "ro", "esp": "es", "ita": "it", "nld": "nl", "chn": "cn", "jpn": "jp"}


def region_rows() -> list[tuple[str, list[str]]]:
    return [(name, sorted(codes)) for name, codes in REGIONS.items()]


def country_rows() -> list[tuple[str, str]]:
    return list(COUNTRIES.items())


def recoded(code: Column) -> Column:
    out = code
    for old, new in RECODED.items():
        out = F.when(code == old, F.lit(new)).otherwise(out)
    return out


def normalise_code(c: Column) -> Column:
    """Two-letter codes in lower case and canonical form; anything else is null."""
    code = F.lower(F.trim(c))
    return F.when(F.length(code) == 2, recoded(code))


def _names(spark: SparkSession) -> DataFrame:
    """name -> codes; a region's name goes before a country's, and both before an alpha-3 code."""
    rows = {name: [code] for name, code in ALPHA3.items()} | {name: [code] for name, code in country_rows()} | dict(region_rows())
    return spark.createDataFrame([(k, v) for k, v in rows.items()], "name string, codes array<string>")


def resolve(tokens: DataFrame, token_col: str = "token") -> DataFrame:
    """tokens with resolved codes (array<string>): regions, then country names, then any two letters, then alpha-3 codes.

    Unknown tokens get an empty array: they must not narrow a search to nothing.
    """
    cleaned = F.trim(F.regexp_replace(F.lower(F.trim(F.col(token_col))), r"[^a-z\s-]", ""))
    names = F.broadcast(_names(tokens.sparkSession))
    joined = tokens.withColumn("_clean", cleaned).join(names, F.col("_clean") == F.col("name"), "left")
    pair = F.when(F.length("_clean") == 2, F.array(recoded(F.col("_clean")))).otherwise(F.array().cast("array<string>"))
    return joined.withColumn("resolved", F.array_sort(F.coalesce("codes", pair))).drop("_clean", "name", "codes")


def scan_text(queries: DataFrame, key: str, text_col: str) -> DataFrame:
    """key, phrase, codes: the longest place name of three or more letters in the text; of equally long ones the first listed.

    The table of phrases is a constant of the code, so it is broadcast. Rows without a place keep null and an empty array.
    """
    phrases: dict[str, list[str]] = dict(region_rows())
    for name, code in country_rows():
        phrases.setdefault(name, [code])
    rows = [(name, codes, k) for k, (name, codes) in enumerate(phrases.items()) if len(name) > 2]
    table = F.broadcast(queries.sparkSession.createDataFrame(rows, "phrase string, codes array<string>, place int"))
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^a-z\s]", " "), F.lit(" "))
    met = queries.select(key, low.alias("_low")).join(table, F.col("_low").contains(F.concat(F.lit(" "), F.col("phrase"), F.lit(" "))), "left")
    best = F.max_by(F.struct("phrase", "codes"), F.struct(F.length("phrase"), -F.col("place")))
    return met.groupBy(key).agg(best.alias("_best")).select(key, F.col("_best.phrase").alias("phrase"), F.coalesce(F.col("_best.codes"), F.array().cast("array<string>")).alias("codes"))
