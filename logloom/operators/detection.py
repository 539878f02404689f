"""Detection rules over canonical events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: alert levels by severity, and of the failed login, malware, block and brute-force rules
SEVERITY_LEVEL = {3: 3, 4: 7, 5: 12, 6: 12}
FAILED_LOGIN_LEVEL, MALWARE_LEVEL, BLOCK_LEVEL, BRUTE_FORCE_LEVEL = 5, 10, 4, 10


def alert_level(class_uid: Column, severity_id: Column, status: Column, disposition: Column) -> Column:
    """Highest level among the rules an event satisfies; 0 when it satisfies none."""
    by_severity = F.when(severity_id == 3, 3).when(severity_id == 4, 7).when(severity_id.isin(5, 6), 12)
    failed = F.when((class_uid == 3002) & (status == "Failure"), FAILED_LOGIN_LEVEL)
    malware = F.when((class_uid == 2004) & disposition.isin("Quarantined", "Blocked", "Detected"), MALWARE_LEVEL)
    block = F.when(disposition == "Blocked", BLOCK_LEVEL)
    return F.greatest(F.lit(0), by_severity, failed, malware, block)


def brute_force(logins: DataFrame, host: str = "host", ts: str = "ts", window_s: int = 120, least: int = 8) -> DataFrame:
    """Failed logins (one row each) -> moments where a host reached `least` of them within the window, with the count.

    Equal moments of a host are counted first. Time is cut into slices of one window length; each slice sees the one
    before it as context, so a host that is under attack all the time is still spread over many tasks.
    """
    us = window_s * 1_000_000
    points = logins.groupBy(F.col(host).alias("host"), F.unix_micros(F.col(ts)).alias("at_us")).agg(F.count("*").alias("n"))
    own = F.floor(F.col("at_us") / us)
    seen = points.select("host", "at_us", "n", own.alias("own"), F.explode(F.array(own, own + 1)).alias("slice"))
    span = Window.partitionBy("host", "slice").orderBy("at_us").rangeBetween(-us, 0)
    counted = seen.withColumn("failures", F.sum("n").over(span)).filter("slice = own")
    return counted.filter(F.col("failures") >= least).select("host", F.timestamp_micros("at_us").alias("ts"), "failures")
