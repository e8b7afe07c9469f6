"""Client profiles over session history, and how a session differs from its client's past."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window, functions as F

from packetloom.functions.timing import floor_time, seconds_between, width_us
from packetloom.operators.slices import DEFAULT_SLICE, gap_sessions, merge_back, previous_value
from packetloom.schema import PACKET_ORDER
from packetloom.session import settled

HISTORY = 50
_DAY = 86_400.0

# A client has at most one session per run, so a slice of 30 days is a small group.
SESSION_SLICE = "30 days"


def client_sessions(df: DataFrame, run: str = "1 day") -> DataFrame:
    """One row per source and run: what its first packet says, and totals."""
    place = F.struct(*PACKET_ORDER)
    head = F.struct("timestamp", "frame_no", F.col("http_request_uri").alias("uri"), F.col("http_user_agent").alias("user_agent"))
    return (
        df.where(F.col("src_ip").isNotNull())
        .groupBy(F.col("src_ip").alias("client_ip"), floor_time(F.col("timestamp"), run).alias("run_start"))
        .agg(F.min_by(head, place).alias("head"), F.sum("frame_len").alias("total_bytes"), F.count(F.lit(1)).alias("packets"))
        .select("client_ip", "run_start", "head.*", "total_bytes", "packets")
    )


def _first_use(sessions: DataFrame, value: str, out: str, ttl_us: int | None) -> DataFrame:
    """The sessions in which a client used a value first, or for the first time since it was forgotten, named by the session."""
    place = F.struct("timestamp", "frame_no")
    used = sessions.where(F.col(value).isNotNull() & (F.col(value) != ""))
    if ttl_us is not None:
        us = F.unix_micros("timestamp")
        again = previous_value(used, ["client_ip", value], us, "__used")
        fresh = again.where(F.col("__used").isNull() | (us - F.col("__used") >= ttl_us))
        return fresh.select("client_ip", "timestamp", "frame_no").distinct().withColumn(out, F.lit(1))
    firsts = used.groupBy("client_ip", value).agg(F.min(place).alias("p"))
    return firsts.select("client_ip", "p.timestamp", "p.frame_no").distinct().withColumn(out, F.lit(1))


def compare_with_history(
    sessions: DataFrame, as_of: datetime | None = None, width: str | int = SESSION_SLICE, ttl: str | int | None = None,
) -> DataFrame:
    """New-value and first-session flags, and days since the client was first and last seen.

    Each session is compared with what came before it. Days count up to the session itself, or up to ``as_of``;
    they are 0 when there is no past. First uses are joined by session, so a busy client stays spread out. With ``ttl``, a value that
    was not used for so long is new again, and a client that was silent for so long has no past.
    """
    session_id, client, columns = ["client_ip", "timestamp", "frame_no"], ["client_ip"], sessions.columns
    ttl_us = None if ttl is None else width_us(ttl)
    if ttl_us is not None:
        # Every step below reads the numbered sessions, so they are written once.
        sessions, client = settled(gap_sessions(sessions, client, ttl_us, "__life")), [*client, "__life"]
    out = previous_value(sessions, client, F.col("timestamp"), "__last")
    first_seen = sessions.groupBy(*client).agg(F.min("timestamp").alias("__first"))
    out = merge_back(out, first_seen, client, width, source=sessions)
    flags = {"uri": "is_new_uri_for_ip", "user_agent": "is_new_user_agent_for_ip"}
    for value, name in flags.items():
        out = out.join(_first_use(sessions, value, name, ttl_us), session_id, "left")
    now = F.col("timestamp") if as_of is None else F.lit(as_of)
    has_past = F.col("__last").isNotNull()
    return out.withColumns({
        **{name: F.coalesce(name, F.lit(0)) for name in flags.values()},
        "is_first_session_for_ip": F.when(has_past, 0).otherwise(1),
        "days_since_first_seen": F.when(has_past, seconds_between(now, F.col("__first")) / _DAY).otherwise(0.0),
        "days_since_last_seen": F.when(has_past, seconds_between(now, F.col("__last")) / _DAY).otherwise(0.0),
    }).select(*columns, *flags.values(), "is_first_session_for_ip", "days_since_first_seen", "days_since_last_seen")


def profile_totals(sessions: DataFrame) -> DataFrame:
    """One row per client. Sets are kept as rows of ``profile_values``; here only their sizes."""
    return sessions.groupBy("client_ip").agg(
        F.count(F.lit(1)).alias("session_count"), F.sum("total_bytes").alias("total_bytes"),
        F.max("total_bytes").alias("max_bytes_observed"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        F.count_distinct("uri").alias("uri_count"), F.count_distinct("user_agent").alias("user_agent_count"),
    ).withColumn("avg_bytes_per_session", F.col("total_bytes") / F.col("session_count"))


def profile_values(sessions: DataFrame) -> DataFrame:
    """The sets of a profile as rows: client, kind, value, when first and last used, in how many sessions."""
    kinds = ("uri", "user_agent")
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in kinds])
    return (
        sessions.select("client_ip", "timestamp", F.explode(pairs).alias("kv"))
        .where(F.col("kv.value").isNotNull())
        .groupBy("client_ip", "kv.kind", "kv.value")
        .agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count(F.lit(1)).alias("sessions"))
    )


def merge_totals(old: DataFrame, new: DataFrame) -> DataFrame:
    """Add the totals of a new run to the stored ones; sizes of sets come from the merged values."""
    return old.unionByName(new, allowMissingColumns=True).groupBy("client_ip").agg(
        F.sum("session_count").alias("session_count"), F.sum("total_bytes").alias("total_bytes"),
        F.max("max_bytes_observed").alias("max_bytes_observed"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    ).withColumn("avg_bytes_per_session", F.col("total_bytes") / F.col("session_count"))


def merge_values(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).groupBy("client_ip", "kind", "value").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("sessions").alias("sessions")
    )


def recent_sessions(sessions: DataFrame, keep: int = HISTORY) -> DataFrame:
    """The last ``keep`` sessions of each client; the rank filter also runs before the shuffle."""
    newest = Window.partitionBy("client_ip").orderBy(F.desc("timestamp"), F.desc("frame_no"))
    return sessions.withColumn("age_rank", F.row_number().over(newest)).where(F.col("age_rank") <= keep)


def hour_histogram(sessions: DataFrame) -> DataFrame:
    """Share of each hour of the day in a client's sessions; at most 24 rows per client."""
    hours = sessions.groupBy("client_ip", F.hour("timestamp").alias("hour_of_day")).agg(F.count(F.lit(1)).alias("sessions"))
    total = F.sum("sessions").over(Window.partitionBy("client_ip"))
    return hours.withColumn("share", F.col("sessions") / total)


def with_unusual_hour(sessions: DataFrame, below: float = 0.05, width: str | int = SESSION_SLICE) -> DataFrame:
    """``is_unusual_hour_for_ip``: the session's hour holds less than ``below`` of the client's sessions."""
    marked = sessions.withColumn("hour_of_day", F.hour("timestamp"))
    out = merge_back(marked, hour_histogram(sessions).drop("sessions"), ["client_ip", "hour_of_day"], width)
    return out.withColumn("is_unusual_hour_for_ip", F.when(F.col("share") < below, 1).otherwise(0)).drop("share")
