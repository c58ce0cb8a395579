"""Categories and severities of errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sheaf.functions import words as w


def category(kind: Column, message: Column) -> Column:
    """By exception type; unknown and processing errors, and network errors that name a database, by message."""
    base = F.lit("unknown")
    for cat, names in w.ERROR_TYPES.items():
        base = F.when(kind.isin(*names), cat).otherwise(base)
    said = F.lower(message)
    by_message = F.lit(None).cast("string")
    for cat, parts in reversed(w.ERROR_MESSAGES.items()):
        by_message = F.when(said.rlike("|".join(parts)), cat).otherwise(by_message)
    database = said.rlike("|".join(w.ERROR_MESSAGES["database"]))
    return F.when(base.isin("unknown", "processing"), F.coalesce(by_message, base)).when((base == "network") & database, "database").otherwise(base)


def severity(cat: Column, kind: Column, message: Column) -> Column:
    said = F.lower(message)
    return (
        F.when(kind == "MemoryError", "critical").when((cat == "database") & said.contains("connection"), "critical").when((cat == "resource") & (kind == "PermissionError"), "critical")
        .when(cat.isin("authentication", "configuration"), "high").when(said.rlike("critical|fatal"), "high").when(cat.isin("processing", "telegram"), "medium")
        .when(cat == "network", F.when(said.rlike("timeout|timed out"), "low").otherwise("medium")).otherwise("low")
    )


def classified(events: DataFrame) -> DataFrame:
    e = events.withColumn("category", category(F.col("exception_type"), F.col("message")))
    return e.withColumn("severity", severity(F.col("category"), F.col("exception_type"), F.col("message")))


_base = "CASE " + " ".join(f"WHEN exception_type IN ({', '.join(repr(n) for n in names)}) THEN '{c}'" for c, names in w.ERROR_TYPES.items()) + " ELSE 'unknown' END"
_said = "CASE " + " ".join(f"WHEN regexp_matches(lower(message), '{'|'.join(p)}') THEN '{c}'" for c, p in w.ERROR_MESSAGES.items()) + " END"
CLASSIFIED = f"""cl0 AS (SELECT *, {_base} AS base, {_said} AS said FROM error_events),
cl1 AS (SELECT *, CASE WHEN base IN ('unknown', 'processing') THEN coalesce(said, base) WHEN base = 'network' AND regexp_matches(lower(message), '{"|".join(w.ERROR_MESSAGES["database"])}') THEN 'database' ELSE base END AS category FROM cl0),
cls AS (SELECT *, CASE WHEN exception_type = 'MemoryError' THEN 'critical' WHEN category = 'database' AND contains(lower(message), 'connection') THEN 'critical' WHEN category IN ('authentication', 'configuration') THEN 'high'
  WHEN regexp_matches(lower(message), 'critical|fatal') THEN 'high' WHEN category IN ('processing', 'telegram') THEN 'medium' WHEN category = 'network' THEN CASE WHEN regexp_matches(lower(message), 'timeout|timed out') THEN 'low' ELSE 'medium' END
  ELSE 'low' END AS severity FROM cl1)"""
