"""Evaluation suites: nested JSON to flat cases, and their rules as a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import NavigationError
from lodestone.operators.metrics import KINDS

_PLACES = "array<struct<path:string,heading:string>>"
SUITE = (
    "version int, "
    f"cases array<struct<id:string,query:string,expected:{_PLACES}>>, "
    f"intents array<struct<id:string,expected:{_PLACES},"
    "probes:array<struct<id:string,kind:string,terms:array<string>>>>>"
)
PRODUCT_SUITE = (
    "version int, thresholds map<string,double>, "
    "cases array<struct<id:string,category:string,query:string,query_parts:array<string>,"
    f"path:string,expected:{_PLACES}>>"
)

#: Broken rules that an error spells out; it counts the others.
SHOWN = 20


def read_suite(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUITE).json(path, multiLine=True)


def read_product_suite(spark: SparkSession, path: str) -> DataFrame:
    """One row per case: ``case_id, category, query, …`` and the thresholds."""
    suite = spark.read.schema(PRODUCT_SUITE).json(path, multiLine=True)
    cases = suite.select("thresholds", F.explode("cases").alias("c")).select("thresholds", "c.*")
    return cases.withColumnRenamed("id", "case_id")


def flat_cases(suites: DataFrame) -> DataFrame:
    """``case_id, intent_id, kind, terms, query, expected`` of either version."""
    legacy = (
        suites.filter(F.col("version") == 1)
        .select(F.explode("cases").alias("c"))
        .select(
            F.col("c.id").alias("case_id"),
            F.col("c.id").alias("intent_id"),
            F.lit("legacy").alias("kind"),
            F.array("c.query").alias("terms"),
            F.col("c.query").alias("query"),
            F.col("c.expected").alias("expected"),
        )
    )
    probes = (
        suites.filter(F.col("version") == 2)
        .select(F.explode("intents").alias("i"))
        .select("i", F.explode("i.probes").alias("p"))
        .select(
            F.concat_ws("/", "i.id", "p.id").alias("case_id"),
            F.col("i.id").alias("intent_id"),
            F.col("p.kind").alias("kind"),
            F.transform("p.terms", lambda term: F.trim(term)).alias("terms"),
            F.array_join(F.transform("p.terms", lambda term: F.trim(term)), " ").alias("query"),
            F.col("i.expected").alias("expected"),
        )
    )
    return legacy.unionByName(probes)


def suite_problems(suites: DataFrame) -> DataFrame:
    """Broken rules of a probe suite as ``intent_id, problem`` rows."""
    intents = suites.filter(F.col("version") == 2).select(F.explode("intents").alias("i"))
    kinds = F.array_distinct(F.col("i.probes.kind"))
    ids = F.col("i.probes.id")
    single = F.filter("i.probes", lambda p: p["kind"] == KINDS[0])
    rules = F.array_compact(
        F.array(
            F.when(F.size("i.probes") != len(KINDS), "an intent needs three probes"),
            F.when(
                ~F.forall(F.array(*[F.lit(k) for k in KINDS]), lambda k: F.array_contains(kinds, k)),
                "an intent needs one probe of each kind",
            ),
            F.when(F.size(F.array_distinct(ids)) != F.size(ids), "probe ids must be unique"),
            F.when(
                F.exists(single, lambda p: F.size(p["terms"]) != 1),
                "a single-term probe must contain one term",
            ),
            F.when(F.coalesce(F.size("i.expected"), F.lit(0)) < 1, "an intent needs a location"),
        )
    )
    broken = intents.select(F.col("i.id").alias("intent_id"), F.explode(rules).alias("problem"))
    repeated = (
        intents.groupBy(F.col("i.id").alias("intent_id"))
        .count()
        .filter("count > 1")
        .select("intent_id", F.lit("intent ids must be unique").alias("problem"))
    )
    return broken.unionByName(repeated)


def checked_cases(suites: DataFrame) -> DataFrame:
    broken = suite_problems(suites)
    total = broken.count()
    if total:
        first = broken.orderBy("intent_id", "problem").limit(SHOWN).collect()
        listed = "; ".join(f"{row.intent_id}: {row.problem}" for row in first)
        listed += f"; and {total - SHOWN} more" if total > SHOWN else ""
        raise NavigationError("INVALID_CONFIG", listed)
    return flat_cases(suites)
