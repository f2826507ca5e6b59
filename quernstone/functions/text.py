"""Tokens, documents, cards and other renderings of a profile."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no search terms (fixed values).
STOPWORDS = (
    "a an and are as at be by for from has have in is it its of on or that the to was were will with company companies business "
    "businesses service services provide provides providing solution solutions product products"
).split()


def tokenize(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9 of two or more characters that are no stopwords; other letters split tokens."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS))


def present(c: Column) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(c, F.lit(""))


def display_name(name: Column, website: Column, id_col: Column) -> Column:
    return F.coalesce(present(name), present(website), F.concat(F.lit("company-"), id_col.cast("string")))


def location(town: Column, region: Column, country: Column) -> Column:
    joined = F.concat_ws(", ", present(town), present(region), F.upper(present(country)))
    return F.coalesce(present(joined), F.lit("unknown location"))


def labelled_code(code: Column, order: str = "label (code)") -> Column:
    label, number = F.coalesce(code["label"], F.lit("")), code["code"]
    return F.concat(label, F.lit(" ("), number, F.lit(")")) if order == "label (code)" else F.concat(number, F.lit(" "), label)


def listed(prefix: str, items: Column, most: int, separator: str) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(prefix), F.array_join(F.slice(items, 1, most), separator)))


def company_document() -> Column:
    """The searchable text of a row of the companies schema; absent parts vanish, the location stands last."""
    also = F.array_join(F.transform("secondary_codes", lambda c: F.concat(F.lit("Also: "), labelled_code(c))), "\n")
    return F.concat_ws(
        "\n",
        present(F.col("operational_name")),
        F.when(F.col("primary_code").isNotNull(), F.concat(F.lit("Industry: "), labelled_code(F.col("primary_code")))),
        present(also),
        listed("Provides: ", F.col("core_offerings"), 12, "; "),
        listed("Serves: ", F.col("target_markets"), 10, ", "),
        listed("Model: ", F.col("business_model"), 8, ", "),
        present(F.col("description")),
        F.concat(F.lit("Location: "), location(F.col("town"), F.col("region_name"), F.col("country_code"))),
    )


def shortened(text: Column, most: int) -> Column:
    cut = F.regexp_replace(F.substring(text, 1, most), " [^ ]*$", "")
    return F.when(F.length(text) > most, F.concat(cut, F.lit("..."))).otherwise(text)


def company_card(description_chars: int = 460) -> Column:
    """The record that an adjudicator reads; absent scalars print as unknown."""
    known = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    public = F.when(F.col("is_public"), "True").when(~F.col("is_public"), "False").otherwise("unknown")
    figures = F.concat(
        F.lit("Employees: "), known(F.col("employee_count")),
        F.lit(" | Revenue USD: "), F.coalesce(F.format_number("revenue", 0), F.lit("unknown")),
        F.lit(" | Founded: "), known(F.col("year_founded")),
        F.lit(" | Public: "), public,
    )
    codes = F.array_join(F.transform("secondary_codes", lambda c: labelled_code(c, "code label")), "; ")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Name: "), display_name(F.col("operational_name"), F.col("website"), F.col("org_id"))),
        F.concat(F.lit("Location: "), location(F.col("town"), F.col("region_name"), F.col("country_code"))),
        F.when(F.col("primary_code").isNotNull(), F.concat(F.lit("NAICS: "), labelled_code(F.col("primary_code"), "code label"))),
        F.when(F.size("secondary_codes") > 0, F.concat(F.lit("Secondary NAICS: "), codes)),
        figures,
        listed("Business model: ", F.col("business_model"), 6, ", "),
        listed("Core offerings: ", F.col("core_offerings"), 8, "; "),
        listed("Target markets: ", F.col("target_markets"), 8, ", "),
        F.when(F.col("description") != "", F.concat(F.lit("Description: "), shortened(F.col("description"), description_chars))),
    )


def describe_range(low: Column, high: Column) -> Column:
    """a-b, >=a, <=b or any; whole numbers print without a fraction."""
    show = lambda c: F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))
    both = F.concat(show(low), F.lit("-"), show(high))
    return F.when(low.isNotNull() & high.isNotNull(), both).when(low.isNotNull(), F.concat(F.lit(">="), show(low))).when(high.isNotNull(), F.concat(F.lit("<="), show(high))).otherwise(F.lit("any"))
