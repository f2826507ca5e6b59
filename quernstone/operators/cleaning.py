"""Raw profiles to the companies schema, and merging of duplicates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quernstone.functions import coerce, geo
from quernstone.plans.scratch import written

SCALARS = ("operational_name", "website", "year_founded", "country_code", "region_name", "town", "employee_count", "revenue", "primary_code", "description", "is_public")
#: The fields that completeness counts.
PRESENT = ("year_founded", "country_code", "employee_count", "revenue", "primary_code", "description", "is_public", "business_model", "core_offerings")
#: Rows of a group that is folded by an aggregate; longer groups are folded row by row.
FOLDED = 1000
LISTS = ("secondary_codes", "business_model", "target_markets", "core_offerings")


def parse_profiles(raw: DataFrame) -> DataFrame:
    """Rows of sources.profiles.read_profiles (all fields as strings) in the companies schema; raw and pos stay."""
    address = coerce.as_address(coerce.json_like(F.col("address")))
    empty = lambda c: F.nullif(c, F.lit(""))
    one_code = F.element_at(coerce.as_codes(coerce.json_like(F.col("primary_naics"))), 1)
    return raw.select(
        F.col("pos").alias("org_id"),
        empty(F.col("operational_name")).alias("operational_name"),
        empty(F.col("website")).alias("website"),
        coerce.as_long(F.col("year_founded")).alias("year_founded"),
        geo.normalise_code(address["country_code"]).alias("country_code"),
        empty(address["region_name"]).alias("region_name"),
        empty(address["town"]).alias("town"),
        coerce.as_long(F.col("employee_count")).alias("employee_count"),
        coerce.as_double(F.col("revenue")).alias("revenue"),
        F.when(F.size(coerce.as_codes(coerce.json_like(F.col("primary_naics")))) > 0, one_code).alias("primary_code"),
        coerce.as_codes(coerce.json_like(F.col("secondary_naics"))).alias("secondary_codes"),
        F.coalesce(F.trim("description"), F.lit("")).alias("description"),
        *[coerce.as_texts(F.col(c)).alias(c) for c in ("business_model", "target_markets", "core_offerings")],
        coerce.as_boolean(F.col("is_public")).alias("is_public"),
        "raw",
    )


def dedupe_key(website: Column, name: Column, country: Column) -> Column:
    """web:host, else name:name|country, else null (a row that matches no other)."""
    host = F.regexp_replace(F.lower(F.trim(website)), r"^www\.", "")
    plain = F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))
    return F.when(host != "", F.concat(F.lit("web:"), host)).when(plain != "", F.concat(F.lit("name:"), plain, F.lit("|"), F.coalesce(country, F.lit("?"))))


def _missing(c: Column, kind: str) -> Column:
    return c.isNull() | (F.size(c) == 0) if kind.startswith("array") else c.isNull() | (c == "") if kind == "string" else c.isNull()


def _present(row: Column, kinds: dict[str, str]) -> Column:
    names = [c for c in PRESENT if c in kinds]
    return sum(((~_missing(row[c], kinds[c])).cast("int") for c in names), F.lit(0))


def dedupe(companies: DataFrame, id_col: str = "org_id") -> DataFrame:
    """One row per key, at the place of its first row, folded in order of id: the more complete row survives (the earlier at a
    tie) and takes what it lacks from the other; false and 0 are never overwritten. Rows without a key all stay.

    Keys are counted first, by themselves: single rows, nearly all of them, are not shuffled with their texts. Groups of up to
    FOLDED rows are folded by an aggregate; longer ones, however long, row by row along sorted partitions. Ids become dense.
    """
    kinds = dict(companies.dtypes)
    fields = [c for c in (*SCALARS, *LISTS) if c in kinds]
    rest = [c for c in companies.columns if c not in fields and c != id_col]
    key = dedupe_key(F.col("website"), F.col("operational_name"), F.col("country_code"))
    keyed = companies.withColumn("_key", key)
    counts = keyed.select("_key").where("_key IS NOT NULL").groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    counts = written(counts, "keys")
    single = keyed.join(counts, "_key", "left_anti").select(*companies.columns, F.lit(0).alias("merged"))
    several = keyed.join(counts, "_key")
    row = F.struct(F.col(id_col), *fields, *rest)
    grouped = several.where(F.col("_n") <= FOLDED).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("_pos"), row.alias("_row")))).alias("_rows"))

    def fold(old: Column, new: Column) -> Column:
        keeps = _present(old, kinds) >= _present(new, kinds)
        pick = lambda c: F.when(keeps, old[c]).otherwise(new[c])
        filled = [F.when(_missing(pick(c), kinds[c]), F.when(keeps, new[c]).otherwise(old[c])).otherwise(pick(c)).alias(c) for c in fields]
        # A blank that nothing fills stays as it was.
        filled = [F.coalesce(f, pick(c)).alias(c) for f, c in zip(filled, fields)]
        return F.struct(old[id_col].alias(id_col), *filled, *[pick(c).alias(c) for c in rest])

    start = F.element_at("_rows", 1)["_row"]
    merged = F.aggregate(F.slice("_rows", 2, F.size("_rows")), start, lambda acc, x: fold(acc, x["_row"]))
    folded = grouped.select(merged.alias("_m"), (F.size("_rows") - 1).alias("merged")).select("_m.*", "merged").select(*companies.columns, "merged")
    out = single.unionByName(folded)
    if counts.where(F.col("_n") > FOLDED).limit(1).count():
        out = out.unionByName(_fold_rows(several.where(F.col("_n") > FOLDED), companies, id_col, fields, kinds))
    return out


def _fold_rows(rows: DataFrame, companies: DataFrame, id_col: str, fields: list[str], kinds: dict[str, str]) -> DataFrame:
    """The same fold for long groups: a task holds one merged row at a time."""
    schema = T.StructType([*companies.schema.fields, T.StructField("merged", T.IntegerType())])
    counted = [c for c in PRESENT if c in kinds]

    def missing(value, kind: str) -> bool:
        return value is None or (kind.startswith("array") and not len(value)) or (kind == "string" and value == "")

    def run(batches):
        held, key, extra, target = None, None, 0, to_arrow_schema(schema)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                k = r.pop("_key")
                if k != key:
                    if held is not None:
                        out.append(held | {"merged": extra})
                    held, key, extra = r, k, 0
                    continue
                extra += 1
                present = lambda x: sum(not missing(x[c], kinds[c]) for c in counted)
                kept, other = (held, r) if present(held) >= present(r) else (r, held)
                filled = {c: other[c] if missing(kept[c], kinds[c]) and not missing(other[c], kinds[c]) else kept[c] for c in fields}
                held = kept | filled | {id_col: held[id_col]}
            yield pa.RecordBatch.from_pylist(out, target)
        if held is not None:
            yield pa.RecordBatch.from_pylist([held | {"merged": extra}], target)

    ordered = rows.select("_key", *companies.columns).repartition("_key").sortWithinPartitions("_key", id_col)
    return ordered.mapInArrow(run, schema)


def dense_ids(companies: DataFrame, id_col: str = "org_id", spread: int = 1 << 16) -> DataFrame:
    """Ids replaced by 0, 1, 2 ... in their order, by counting ranges of ids first: no task sees all rows."""
    from quernstone.functions.windows import running_sum

    marked = companies.withColumn("_range", F.floor(F.col(id_col) / F.lit(spread))).withColumn("_one", F.lit(1)).withColumn("_all", F.lit(0))
    return running_sum(marked, ["_all"], "_range", [id_col], "_one", "_dense").withColumn(id_col, F.col("_dense")).drop("_range", "_one", "_all", "_dense")


def dataset_summary(companies: DataFrame) -> DataFrame:
    """n, presence shares and mean completeness, in one pass."""
    share = lambda c: F.avg(F.col(c).isNotNull().cast("int"))
    return companies.agg(
        F.count(F.lit(1)).alias("n"),
        share("employee_count").alias("has_employee_count"),
        share("revenue").alias("has_revenue"),
        share("year_founded").alias("has_year_founded"),
        F.avg((F.size("secondary_codes") > 0).cast("int")).alias("has_secondary_codes"),
        F.avg(coerce.completeness()).alias("mean_completeness"),
    )


def country_histogram(companies: DataFrame) -> DataFrame:
    return companies.where("country_code IS NOT NULL").groupBy("country_code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "country_code")


def pairs_of_duplicates(companies: DataFrame, id_col: str = "org_id") -> DataFrame:
    """key, first and second id of groups of exactly two."""
    key = dedupe_key(F.col("website"), F.col("operational_name"), F.col("country_code"))
    groups = companies.select(key.alias("key"), id_col).where("key IS NOT NULL").groupBy("key")
    return groups.agg(F.min(id_col).alias("first_id"), F.max(id_col).alias("second_id"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")
