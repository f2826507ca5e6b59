"""A companies table derived from the test tables, and the specs that the registered queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.coerce import CODE

#: query_id, complexity, keywords, countries, employees, revenue, founded, want_public, prefixes, vec_id, role statement, ideal
#: profile (fixed values). s07 leaves so few rows that its ranges are relaxed; no row of s08 is accepted, so it falls back.
SPECS = (
    ("s01", "STRUCTURED", "tion thing ering", "nation_3 nation_7 nation_11 nation_19", (None, None), (None, None), (None, None), None, "3112 3125", 11, "mills ering grain", "A mill and the things of it"),
    ("s02", "STRUCTURED", "ther ingly", "", (1000, None), (None, None), (None, None), True, "", 23, "", ""),
    ("s03", "SEMANTIC", "mente para los", "nation_0 nation_1 nation_2 nation_3 nation_4 nation_5 nation_6 nation_7 nation_8", (None, 4000), (None, None), (None, None), None, "32 3261", 37, "", "para mente"),
    ("s04", "REASONING", "with from this", "", (None, None), (None, None), (None, None), None, "", 41, "the role that is with this", ""),
    ("s05", "SEMANTIC", "und der ein", "", (None, 2000), (100000, None), (1970, 2015), None, "311 31 3", 53, "", ""),
    ("s06", "REASONING", "le les eau ment", "nation_12", (4990, None), (400000, None), (2020, None), False, "33", 67, "", ""),
    ("s07", "STRUCTURED", "thing with", "nation_5", (4990, 4995), (450000, None), (2021, 2022), True, "31", 79, "", ""),
    ("s08", "SEMANTIC", "zzqx", "nation_2 nation_4", (None, None), (None, None), (None, None), None, "", 83, "", ""),
)
SPEC_SCHEMA = "query_id string, complexity string, keywords array<string>, role_statement string, ideal_profile string, countries array<string>, employees_min double, employees_max double, revenue_min double, revenue_max double, founded_min double, founded_max double, want_public boolean, prefixes array<string>, vec_id long"


def specs(spark: SparkSession) -> DataFrame:
    number = lambda x: None if x is None else float(x)
    rows = [(q, c, kw.split(), role, ideal, co.split(), *map(number, (*e, *r, *f)), p, pre.split(), v) for q, c, kw, co, e, r, f, p, pre, v, role, ideal in SPECS]
    return spark.createDataFrame(rows, SPEC_SCHEMA)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer, in the companies schema, with holes by arithmetic on the key."""
    k = F.col("c_custkey")
    spent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("_spent"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("c_custkey"), "text")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.join(texts, "c_custkey", "left").join(spent, "c_custkey", "left")
    host = F.concat(F.when(k % 4 == 0, "www.").otherwise(""), F.lit("org"), F.when(k % 22 == 21, k - 1).otherwise(k).cast("string"), F.lit(".example"))
    code = lambda x: F.struct(x.cast("string").alias("code"), F.lit("sector").alias("label"), F.lit(None).cast("double").alias("share"))
    extra = [F.when(k % 4 > i, code(F.lit(311111) + (k * 37 + 4001 * (i + 1)) % 22000)) for i in range(3)]
    return rows.select(
        k.alias("org_id"),
        F.when(k % 25 != 7, F.col("c_name")).alias("operational_name"),
        F.when(k % 10 != 9, host).alias("website"),
        F.when(k % 100 >= 27, 1950 + (k * 31) % 75).alias("year_founded"),
        F.when(k % 40 != 3, F.lower("n_name")).alias("country_code"),
        F.lower("r_name").alias("region_name"),
        F.lit(None).cast("string").alias("town"),
        F.when(k % 50 >= 19, (k * 7919) % 5000).alias("employee_count"),
        F.when(k % 50 < 41, F.col("_spent")).alias("revenue"),
        code(F.lit(311111) + (k * 37) % 22000).alias("primary_code"),
        F.coalesce(F.array_compact(F.array(*extra)), F.array().cast(f"array<{CODE.simpleString()}>")).alias("secondary_codes"),
        F.coalesce("text", F.lit("")).alias("description"),
        F.when(k % 3 == 0, F.array(F.lit("retail"), F.lit("b2b"))).otherwise(F.array().cast("array<string>")).alias("business_model"),
        F.when(k % 2 == 0, F.array(F.lower("c_mktsegment"))).otherwise(F.array().cast("array<string>")).alias("target_markets"),
        F.when(k % 5 < 3, F.array(F.lit("goods"), F.concat(F.lit("line"), (k % 7).cast("string")))).otherwise(F.array().cast("array<string>")).alias("core_offerings"),
        F.when(k % 5 != 4, k % 3 == 0).alias("is_public"),
    )


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """companies with an embedding, by org_id modulo the number of vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    n = vectors.count()
    return companies(spark, sf_dir).withColumn("_v", F.col("org_id") % n).join(vectors.select(F.col("vec_id").alias("_v"), "embedding"), "_v").drop("_v")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs(spark).select("query_id", "vec_id").join(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")), "vec_id").select("query_id", "vector")


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded relevance of every query alike, from labels: 2 * quality + 1 - toxic."""
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("org_id")).agg(F.max(2 * F.col("quality") + 1 - F.col("toxic")).alias("grade"))
    return labels.crossJoin(F.broadcast(specs(spark).select("query_id"))).select("query_id", "org_id", "grade")
