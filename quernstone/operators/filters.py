"""Three-valued constraints: null is unknown, and unknown neither passes nor fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.config import Config

#: Constraint -> (company column, spec columns).
RANGES = {"employee_count": "employees", "revenue": "revenue", "year_founded": "founded"}
CONSTRAINTS = ("country", "employee_count", "revenue", "year_founded", "is_public")


#: Specs of one run at most: they meet every company, and are broadcast.
MOST_SPECS = 10_000


def stated(specs: DataFrame) -> DataFrame:
    """specs as a broadcast side, after a check of their number."""
    if specs.limit(MOST_SPECS + 1).count() > MOST_SPECS:
        raise ValueError(f"a run answers at most {MOST_SPECS} requests; deal them into several")
    return F.broadcast(specs)


def in_range(value: Column, low: Column, high: Column) -> Column:
    """Inclusive; an open end always holds; a null value is unknown."""
    return F.when(value.isNotNull(), F.coalesce(value >= low, F.lit(True)) & F.coalesce(value <= high, F.lit(True)))


def is_set(name: str) -> Column:
    if name == "country":
        return F.size("countries") > 0
    if name == "is_public":
        return F.col("want_public").isNotNull()
    return F.col(f"{RANGES[name]}_min").isNotNull() | F.col(f"{RANGES[name]}_max").isNotNull()


def outcome(name: str) -> Column:
    """true, false or null (unknown, or not asked for)."""
    if name == "country":
        value = F.array_contains("countries", F.col("country_code"))
    elif name == "is_public":
        value = F.col("is_public") == F.col("want_public")
    else:
        value = in_range(F.col(name), F.col(f"{RANGES[name]}_min"), F.col(f"{RANGES[name]}_max"))
    return F.when(is_set(name), value)


def tri(c: Column, asked: Column) -> Column:
    return F.when(asked, F.when(c, "PASS").when(~c, "FAIL").otherwise("UNKNOWN"))


def apply_filters(companies: DataFrame, specs: DataFrame) -> DataFrame:
    """Every (query_id, org_id) with PASS, FAIL or UNKNOWN per constraint that the query sets, else null.

    Specs are the queries of one run: a stated set, given by the caller, of checked size.
    """
    met = companies.crossJoin(stated(specs))
    return met.select("query_id", "org_id", *[tri(outcome(c), is_set(c)).alias(c) for c in CONSTRAINTS])


def survivors(companies: DataFrame, specs: DataFrame) -> DataFrame:
    """Rows without a failed constraint, with all columns of both sides and unknown (names of unknown constraints)."""
    held = [F.coalesce(outcome(c), F.lit(True)) for c in CONSTRAINTS]
    unknown = F.array_compact(F.array(*[F.when(is_set(c) & outcome(c).isNull(), F.lit(c)) for c in CONSTRAINTS]))
    joined = companies.crossJoin(stated(specs))
    for h in held:
        joined = joined.where(h)
    return joined.withColumn("unknown", unknown)


def tally(companies: DataFrame, specs: DataFrame) -> DataFrame:
    """Failures per query and constraint; a row may count in several."""
    fails = apply_filters(companies, specs)
    return fails.groupBy("query_id").agg(*[F.count_if(F.col(c) == "FAIL").alias(f"{c}_failed") for c in CONSTRAINTS])


def soften(specs: DataFrame) -> DataFrame:
    """specs without numeric ranges; places and ownership stay."""
    return specs.withColumns({f"{r}_{end}": F.lit(None).cast("double") for r in RANGES.values() for end in ("min", "max")})


def survivors_relaxed(companies: DataFrame, specs: DataFrame, config: Config = Config()) -> DataFrame:
    """Survivors; of a query with fewer than config.relax_below and a numeric range, those of the softened query if they are more.

    Both sets come from one pass: a softened query's survivors hold the strict ones, and counts per query choose. Unknowns are
    those of the query that was used. relaxed tells which.
    """
    numeric = F.lit(False)
    for r in RANGES:
        numeric = numeric | is_set(r)
    soft_held = F.coalesce(outcome("country"), F.lit(True)) & F.coalesce(outcome("is_public"), F.lit(True))
    strict = F.lit(True)
    for r in RANGES:
        strict = strict & F.coalesce(outcome(r), F.lit(True))
    name = lambda c: F.when(is_set(c) & outcome(c).isNull(), F.lit(c))
    soft_unknown = F.array_compact(F.array(*[name(c) for c in ("country", "is_public")]))
    all_unknown = F.array_compact(F.array(*[name(c) for c in CONSTRAINTS]))
    rows = companies.crossJoin(stated(specs)).where(soft_held).withColumn("_strict", strict).withColumn("_numeric", numeric)
    counts = rows.groupBy("query_id").agg(F.count_if("_strict").alias("_n"), F.count(F.lit(1)).alias("_m"), F.first("_numeric").alias("_any"))
    relax = counts.select("query_id", (F.col("_any") & (F.col("_n") < config.relax_below) & (F.col("_m") > F.col("_n"))).alias("relaxed"))
    kept = rows.join(F.broadcast(relax), "query_id").where(F.col("_strict") | F.col("relaxed"))
    return kept.withColumn("unknown", F.when(F.col("relaxed"), soft_unknown).otherwise(all_unknown)).drop("_strict", "_numeric")


def has_hard_constraints() -> Column:
    out = F.lit(False)
    for c in CONSTRAINTS:
        out = out | is_set(c)
    return out
