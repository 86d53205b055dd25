"""GPS positions, in batch and as a stream: JSON reports, track segments, latest positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

REPORT = "class string, device string, mode int, time timestamp, lat double, lon double, alt double, track double, speed double, climb double, epx double, epy double, epv double"


def reports(lines: DataFrame) -> DataFrame:
    """Position reports from lines (value) of JSON; altitude counts in mode 3 only, accuracy is the worse of two axes.
    Works on static and on streaming frames."""
    fix = F.from_json("value", REPORT).alias("r")
    rows = lines.select(fix).select("r.*").where("class = 'TPV'")
    return rows.select(
        "device", F.col("time").alias("ts"), "lat", "lon", F.when(F.col("mode") == 3, F.col("alt")).alias("alt"), "track", "speed",
        F.greatest("epx", "epy").alias("accuracy"),
    )


def read_socket(spark: SparkSession, host: str = "localhost", port: int = 2947) -> DataFrame:
    return reports(spark.readStream.format("socket").option("host", host).option("port", port).load())


def track_segments(fixes: DataFrame, gap_seconds: int) -> DataFrame:
    """fixes (device, ts, valid, fix) with the number of their segment: an invalid fix or a gap ends one. Invalid
    fixes are dropped. Times count in whole seconds, rounded (halves to even). Batch form."""
    along = W.partitionBy("device").orderBy("ts", "fix")
    whole = lambda ts: F.rint(F.unix_micros(ts.cast("timestamp")) / 1e6).cast("long")
    late = whole(F.col("ts")) - whole(F.lag("ts").over(along)) > gap_seconds
    broken = F.coalesce(late, F.lit(False)) | ~F.coalesce(F.lag("valid").over(along), F.lit(True))
    numbered = fixes.withColumn("new", broken.cast("int")).withColumn("segment", F.sum("new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.where("valid").drop("new")


def stream_segments(fixes: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Segments of a stream of valid fixes: session windows per device, closed by a gap, with late fixes up to `late`."""
    return (
        fixes.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("span"), "device")
        .agg(F.count("*").alias("fixes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        .select("device", "first_ts", "last_ts", "fixes")
    )


def latest(fixes: DataFrame) -> DataFrame:
    """The last known value of each attribute by device: fields that a fix lacks keep their last value."""
    columns = [c for c in fixes.columns if c not in ("device", "ts")]
    # Of equal times the greater value counts, so that the result doesn't depend on the order of rows.
    known = [F.max(F.when(F.col(c).isNotNull(), F.struct("ts", c)))[c].alias(c) for c in columns]
    return fixes.groupBy("device").agg(F.max("ts").alias("ts"), *known)


STATE = "device string, ts timestamp, lat double, lon double, alt double, track double, speed double, accuracy double"


def stream_latest(fixes: DataFrame) -> DataFrame:
    """The last known values of each device as a stream, in append mode: each batch of fixes gives one row with the values
    after it. Fields that a fix lacks keep their value; a fix older than the state only fills what is still null."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    names = [part.split()[0] for part in STATE.split(", ")][1:]

    def update(key, batches, state):
        held = dict(zip(names, state.get)) if state.exists else dict.fromkeys(names)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for r in rows.to_dict("records"):
            newer = held["ts"] is None or r["ts"] >= held["ts"]
            for c in names:
                if not pd.isna(r[c]) and (newer or held[c] is None):
                    held[c] = r[c]
        state.update(tuple(held[c] for c in names))
        yield pd.DataFrame([{"device": key[0], **held}])

    own = ", ".join(STATE.split(", ")[1:])
    asked = fixes.select("device", *names)
    return asked.groupBy("device").applyInPandasWithState(update, STATE, own, "append", GroupStateTimeout.NoTimeout)


def follow(positions: DataFrame, answer, path: str, checkpoint: str, seconds: int = 300):
    """Run a stream of positions: each batch goes through `answer`, a function of static frames such as nearest edges or
    routes, and its rows are appended to the log at path. A batch that is run again replaces its own part of the log."""

    def run(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return positions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds")
