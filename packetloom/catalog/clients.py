"""Queries for enrichment, profiles, sequences and application detectors."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from packetloom.catalog.base import SLICE, STEPS, packets, query
from packetloom.catalog.scalar import ip_number
from packetloom.operators import detectors, enrich, host, profile, sequence
from packetloom.operators.slices import gap_sessions

# A small network table: overlapping blocks, one wider than a /16 (fixed values).
_NETWORKS = [
    ("10.0.0.0/8", "Intranet", "XX", "Hub", 1.5, 2.5, 64512, "Private"),
    ("10.0.0.1/32", "Intranet", "XX", "Core", 1.25, 2.25, 64513, "Core"),
    ("93.184.216.0/24", "United States", "US", "Norwell", 42.15, -70.82, 15133, "Edge"),
    ("93.184.216.2/31", "United States", "US", "Boston", 42.36, -71.05, 15134, "Edge two"),
    ("172.19.102.0/27", "Lab", "LB", "Rack", 0.5, 0.25, 64600, "Lab"),
]
_GEO = "country country_iso city latitude longitude asn asn_org".split()
_GEO_OUT = "country:s country_iso:s city:s latitude:f longitude:f asn asn_org:s"


def _networks(spark):
    rows = spark.createDataFrame(_NETWORKS, "network string, country string, country_iso string, city string, latitude double, longitude double, asn long, asn_org string")
    return enrich.networks_from_cidr(rows)


STEPS["networks"] = (
    f"SELECT *, {ip_number('base')} AS a, {ip_number('base')} + CAST(power(2, 32 - bits) AS BIGINT) - 1 AS b FROM ("
    "SELECT *, split_part(network, '/', 1) AS base, CAST(split_part(network, '/', 2) AS INT) AS bits FROM (VALUES "
    + ", ".join(str(r) for r in _NETWORKS) + ") AS t(network, country, country_iso, city, latitude, longitude, asn, asn_org))"
)
STEPS["ips"] = "SELECT src_ip AS ip FROM packets UNION SELECT dst_ip FROM packets"
STEPS["located"] = f"""SELECT ip, (a IS NOT NULL)::INT AS found, {', '.join(_GEO)} FROM (
    SELECT * FROM ips LEFT JOIN networks ON {ip_number('ip')} BETWEEN a AND b)
    QUALIFY row_number() OVER (PARTITION BY ip ORDER BY b - a) = 1"""
_GEO_STEPS = "packets networks ips located"


@query("enrich_unique_ips", "ip:s", "SELECT ip FROM ips", "packets ips")
def _(spark, sf):
    return enrich.unique_ips(packets(spark, sf))


@query("enrich_locate", f"ip:s found {_GEO_OUT}", "SELECT * FROM located", _GEO_STEPS)
def _(spark, sf):
    return enrich.locate(enrich.unique_ips(packets(spark, sf)), _networks(spark))


# IPv6 networks of the same attributes; the third group of an address tells which of them hold it.
_NETWORKS_V6 = [
    ("2001:db8::/32", "Doc", "DC", "Wide", 1.0, 1.5, 64700, "Wide", 0, 65535), ("2001:db8:1::/48", "Doc", "DC", "One", 2.0, 2.5, 64701, "One", 1, 1),
    ("2001:db8:2::/47", "Doc", "DC", "Pair", 3.0, 3.5, 64702, "Pair", 2, 3),
]
_V6_IP = "'2001:' || CASE frame_no % 7 WHEN 6 THEN 'db9' ELSE 'db8' END || ':' || cast(frame_no % 5 AS string) || '::' || cast(frame_no % 40 AS string)"
STEPS["networks6"] = "SELECT * FROM (VALUES " + ", ".join(str(r) for r in _NETWORKS_V6) + (
    ") AS t(network, country, country_iso, city, latitude, longitude, asn, asn_org, low, high)"
)
STEPS["ips6"] = f"SELECT DISTINCT {_V6_IP.replace('AS string', 'AS VARCHAR')} AS ip FROM packets"
STEPS["located6"] = f"""SELECT ip, (low IS NOT NULL)::INT AS found, {', '.join(_GEO)} FROM (SELECT * FROM ips6 LEFT JOIN networks6
    ON split_part(ip, ':', 2) = 'db8' AND CAST(split_part(ip, ':', 3) AS INT) BETWEEN low AND high)
    QUALIFY row_number() OVER (PARTITION BY ip ORDER BY high - low) = 1"""


@query("enrich_locate_both", f"ip:s found {_GEO_OUT}", "SELECT * FROM located UNION ALL SELECT * FROM located6", _GEO_STEPS + " networks6 ips6 located6")
def _(spark, sf):
    rows = packets(spark, sf)
    kinds = "network string, country string, country_iso string, city string, latitude double, longitude double, asn long, asn_org string"
    both = enrich.networks_from_cidr(spark.createDataFrame(_NETWORKS + [r[:8] for r in _NETWORKS_V6], kinds))
    return enrich.locate(enrich.unique_ips(rows).union(rows.select(F.expr(_V6_IP).alias("ip")).distinct()), both)


@query(
    "enrich_attach", "frame_no src_ip:s dst_ip:s src_country:s src_city:s src_asn dst_country:s dst_city:s dst_latitude:f dst_asn_org:s",
    """SELECT p.frame_no, p.src_ip, p.dst_ip, s.country AS src_country, s.city AS src_city, s.asn AS src_asn, d.country AS dst_country,
       d.city AS dst_city, d.latitude AS dst_latitude, d.asn_org AS dst_asn_org
       FROM packets p LEFT JOIN located s ON p.src_ip = s.ip LEFT JOIN located d ON p.dst_ip = d.ip""", _GEO_STEPS,
)
def _(spark, sf):
    df = packets(spark, sf)
    return enrich.attach(df, enrich.locate(enrich.unique_ips(df), _networks(spark)), SLICE)


# A cache fed by every packet: answers without an address expire after a day, the others stay.
_NOW = datetime(2024, 1, 30, 12)
STEPS["cached"] = """SELECT key, value FROM (SELECT src_ip AS key, frame_len AS value, timestamp AS written_at,
    CASE WHEN frame_no % 2 = 0 THEN timestamp + INTERVAL 1 DAY END AS expiry FROM packets
    QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY timestamp DESC) = 1)
    WHERE expiry IS NULL OR expiry >= TIMESTAMP '2024-01-30 12:00:00'"""


def _cache(df):
    ttl = F.when(F.col("frame_no") % 2 == 0, enrich.NOT_FOUND_TTL_SECONDS)
    entries = df.select(F.col("src_ip").alias("ip"), "frame_len", "frame_no", "timestamp")
    return enrich.cache_current(enrich.cache_entries(entries, F.col("timestamp"), ttl), _NOW)


@query("cache_current", "key:s value", "SELECT * FROM cached", "packets cached")
def _(spark, sf):
    return _cache(packets(spark, sf)).withColumn("value", F.get_json_object("value", "$.frame_len"))


@query(
    "cache_hits_and_misses", "ip:s hit",
    "SELECT ip, (ip IN (SELECT key FROM cached))::INT AS hit FROM ips", "packets ips cached",
)
def _(spark, sf):
    df = packets(spark, sf)
    ips, current = enrich.unique_ips(df), _cache(df)
    hits = enrich.cache_hits(ips, current).withColumn("hit", F.lit(1))
    return hits.unionByName(enrich.cache_misses(ips, current).withColumn("hit", F.lit(0)))


# ---- profiles ----

STEPS["csessions"] = """SELECT src_ip AS client_ip, date_trunc('day', timestamp) AS run_start, min(timestamp) AS timestamp,
    first(frame_no ORDER BY timestamp, frame_no) AS frame_no, first(http_request_uri ORDER BY timestamp, frame_no) AS uri,
    first(http_user_agent ORDER BY timestamp, frame_no) AS user_agent, sum(frame_len) AS total_bytes, count(*) AS packets
  FROM packets GROUP BY ALL"""
STEPS["compared"] = """SELECT *, (n = 1)::INT AS is_first_session_for_ip,
    (coalesce(uri, '') <> '' AND row_number() OVER (PARTITION BY client_ip, uri ORDER BY timestamp, frame_no) = 1)::INT AS is_new_uri_for_ip,
    (coalesce(user_agent, '') <> '' AND row_number() OVER (PARTITION BY client_ip, user_agent ORDER BY timestamp, frame_no) = 1)::INT AS is_new_user_agent_for_ip,
    CASE WHEN n = 1 THEN 0 ELSE (epoch_us(timestamp) - epoch_us(first_time)) / 1e6 / 86400.0 END AS days_since_first_seen,
    CASE WHEN n = 1 THEN 0 ELSE (epoch_us(timestamp) - epoch_us(last_time)) / 1e6 / 86400.0 END AS days_since_last_seen
  FROM (SELECT *, row_number() OVER w AS n, min(timestamp) OVER (PARTITION BY client_ip) AS first_time, lag(timestamp) OVER w AS last_time
        FROM csessions WINDOW w AS (PARTITION BY client_ip ORDER BY timestamp, frame_no))"""
_C = "packets csessions"


def client_sessions(spark, sf):
    return profile.client_sessions(packets(spark, sf))


@query(
    "profile_client_sessions", "client_ip:s run_start:t timestamp:t frame_no uri:s user_agent:s total_bytes packets",
    "SELECT * FROM csessions", _C,
)
def _(spark, sf):
    return client_sessions(spark, sf)


@query(
    "profile_new_flags", "client_ip:s frame_no is_new_uri_for_ip is_new_user_agent_for_ip is_first_session_for_ip",
    "SELECT * FROM compared", _C + " compared",
)
def _(spark, sf):
    return profile.compare_with_history(client_sessions(spark, sf))


@query(
    "profile_days_seen", "client_ip:s frame_no days_since_first_seen:f days_since_last_seen:f", "SELECT * FROM compared", _C + " compared",
)
def _(spark, sf):
    return profile.compare_with_history(client_sessions(spark, sf))


_TTL = 3 * 86_400_000_000


@query(
    "profile_expiring", "client_ip:s frame_no is_first_session_for_ip is_new_uri_for_ip days_since_first_seen:f",
    f"""SELECT *, fresh AS is_first_session_for_ip,
         (coalesce(uri, '') <> '' AND coalesce(epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY client_ip, uri ORDER BY timestamp, frame_no) >= {_TTL}, true))::INT AS is_new_uri_for_ip,
         CASE WHEN fresh = 1 THEN 0 ELSE (epoch_us(timestamp) - epoch_us(min(timestamp) OVER (PARTITION BY client_ip, life))) / 1e6 / 86400.0 END AS days_since_first_seen
       FROM (SELECT *, sum(fresh) OVER (PARTITION BY client_ip ORDER BY timestamp, frame_no) AS life FROM (
         SELECT *, CASE WHEN epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY client_ip ORDER BY timestamp, frame_no) < {_TTL} THEN 0 ELSE 1 END AS fresh
         FROM csessions))""",
    _C,
)
def _(spark, sf):
    return profile.compare_with_history(client_sessions(spark, sf), ttl="3 days")


@query(
    "profile_days_seen_as_of", "client_ip:s frame_no days_since_first_seen:f days_since_last_seen:f",
    """SELECT client_ip, frame_no, CASE WHEN n = 1 THEN 0 ELSE (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(first_time)) / 1e6 / 86400.0 END AS days_since_first_seen,
       CASE WHEN n = 1 THEN 0 ELSE (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last_time)) / 1e6 / 86400.0 END AS days_since_last_seen FROM compared""",
    _C + " compared",
)
def _(spark, sf):
    return profile.compare_with_history(client_sessions(spark, sf), datetime(2024, 2, 1))


STEPS["totals"] = """SELECT client_ip, count(*) AS session_count, sum(total_bytes) AS total_bytes, max(total_bytes) AS max_bytes_observed,
    min(timestamp) AS first_seen, max(timestamp) AS last_seen, count(DISTINCT uri) AS uri_count,
    count(DISTINCT user_agent) AS user_agent_count, sum(total_bytes) / count(*) AS avg_bytes_per_session FROM csessions GROUP BY client_ip"""
STEPS["pvalues"] = """SELECT client_ip, kind, value, min(timestamp) AS first_seen, max(timestamp) AS last_seen, count(*) AS sessions FROM (
    SELECT client_ip, timestamp, 'uri' AS kind, uri AS value FROM csessions UNION ALL
    SELECT client_ip, timestamp, 'user_agent', user_agent FROM csessions) WHERE value IS NOT NULL GROUP BY ALL"""
_TOTALS = "client_ip:s session_count total_bytes max_bytes_observed first_seen:t last_seen:t avg_bytes_per_session:f"


@query("profile_snapshot", _TOTALS + " uri_count user_agent_count", "SELECT * FROM totals", _C + " totals")
def _(spark, sf):
    return profile.profile_totals(client_sessions(spark, sf))


@query("profile_values", "client_ip:s kind:s value:s first_seen:t last_seen:t sessions", "SELECT * FROM pvalues", _C + " pvalues")
def _(spark, sf):
    return profile.profile_values(client_sessions(spark, sf))


@query("profile_merge_totals", _TOTALS, "SELECT * FROM totals", _C + " totals")
def _(spark, sf):
    s = client_sessions(spark, sf)
    early = F.col("run_start") < F.lit(datetime(2024, 1, 15))
    return profile.merge_totals(profile.profile_totals(s.where(early)), profile.profile_totals(s.where(~early)))


@query("profile_merge_values", "client_ip:s kind:s value:s first_seen:t last_seen:t sessions", "SELECT * FROM pvalues", _C + " pvalues")
def _(spark, sf):
    s = client_sessions(spark, sf)
    early = F.col("run_start") < F.lit(datetime(2024, 1, 15))
    return profile.merge_values(profile.profile_values(s.where(early)), profile.profile_values(s.where(~early)))


@query(
    "profile_recent_sessions", "client_ip:s frame_no age_rank",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_ip ORDER BY timestamp DESC, frame_no DESC) AS age_rank FROM csessions) WHERE age_rank <= 5", _C,
)
def _(spark, sf):
    return profile.recent_sessions(client_sessions(spark, sf), 5)


@query(
    "profile_hour_histogram", "client_ip:s hour_of_day sessions share:f",
    """SELECT client_ip, hour(timestamp) AS hour_of_day, count(*) AS sessions,
       count(*) / sum(count(*)) OVER (PARTITION BY client_ip) AS share FROM csessions GROUP BY client_ip, hour(timestamp)""", _C,
)
def _(spark, sf):
    return profile.hour_histogram(client_sessions(spark, sf))


@query(
    "profile_unusual_hour", "client_ip:s frame_no is_unusual_hour_for_ip",
    """SELECT client_ip, frame_no, (count(*) OVER (PARTITION BY client_ip, hour(timestamp)) / count(*) OVER (PARTITION BY client_ip) < 0.1)::INT
       AS is_unusual_hour_for_ip FROM csessions""", _C,
)
def _(spark, sf):
    return profile.with_unusual_hour(client_sessions(spark, sf), 0.1)


# ---- activity bursts ----

STEPS["bursts"] = """SELECT *, sum(starts) OVER (PARTITION BY src_ip ORDER BY timestamp, frame_no) AS session_no FROM (
    SELECT *, (coalesce(epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY src_ip ORDER BY timestamp, frame_no), 1e18)
      >= 21600000000)::INT AS starts FROM packets)"""


@query(
    "session_gap_bursts", "src_ip:s session_no packets first_time:t last_time:t",
    "SELECT src_ip, session_no, count(*) AS packets, min(timestamp) AS first_time, max(timestamp) AS last_time FROM bursts GROUP BY ALL",
    "packets bursts",
)
def _(spark, sf):
    return gap_sessions(packets(spark, sf), ["src_ip"], "6 hours").groupBy("src_ip", "session_no").agg(
        F.count(F.lit(1)).alias("packets"), F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time")
    )


@query(
    "session_gap_window", "src_ip:s burst_start:t burst_end:t packets bytes",
    """SELECT src_ip, min(timestamp) AS burst_start, max(timestamp) + INTERVAL 6 HOUR AS burst_end, count(*) AS packets,
       sum(frame_len) AS bytes FROM bursts GROUP BY src_ip, session_no""", "packets bursts",
)
def _(spark, sf):
    return host.activity_bursts(packets(spark, sf), "6 hours")


# ---- sequences ----

@query(
    "sequence_behaviour", "client_ip:s frame_no steps is_ready first_bytes:f last_bytes:f sum_packets:f",
    """SELECT client_ip, frame_no, count(*) OVER w AS steps, (count(*) OVER w = 5)::INT AS is_ready,
       first_value(total_bytes) OVER w AS first_bytes, total_bytes AS last_bytes, sum(packets) OVER w AS sum_packets
       FROM csessions WINDOW w AS (PARTITION BY client_ip ORDER BY timestamp, frame_no ROWS 4 PRECEDING)""", _C,
)
def _(spark, sf):
    seq = sequence.behaviour_sequences(client_sessions(spark, sf), "client_ip", ["total_bytes", "packets"], 5, chunk=8)
    return seq.select(
        "client_ip", "frame_no", F.size("sequence").alias("steps"), "is_ready", F.col("sequence")[0][0].alias("first_bytes"),
        F.element_at("sequence", -1)[0].alias("last_bytes"),
        F.aggregate("sequence", F.lit(0.0), lambda acc, v: acc + v[1]).alias("sum_packets"),
    )


@query(
    "sequence_training_windows", "window_id steps first_len:f last_len:f sum_len:f",
    """SELECT window_id, count(*) AS steps, first(frame_len ORDER BY i) AS first_len, last(frame_len ORDER BY i) AS last_len, sum(frame_len) AS sum_len
       FROM (SELECT frame_len, row_number() OVER (ORDER BY timestamp, frame_no) - 1 AS i FROM packets),
            (SELECT w AS window_id, greatest(1, n // 10) AS stride, n FROM (SELECT count(*) AS n FROM packets), range(30) AS r(w))
       WHERE i BETWEEN window_id * stride AND window_id * stride + 49 AND window_id * stride + 50 <= n GROUP BY window_id""",
)
def _(spark, sf):
    windows = sequence.training_windows(packets(spark, sf), ["frame_len", "ip_len"], 50)
    return windows.select(
        "window_id", F.size("sequence").alias("steps"), F.col("sequence")[0][0].alias("first_len"),
        F.element_at("sequence", -1)[0].alias("last_len"), F.aggregate("sequence", F.lit(0.0), lambda acc, v: acc + v[0]).alias("sum_len"),
    )


# ---- detectors ----

@query(
    "detect_brute_force", "client_ip:s uri:s window_start:t responses client_errors",
    """SELECT client_ip, uri, time_bucket(INTERVAL 1 DAY, timestamp, TIMESTAMP '1970-01-01') AS window_start, count(*) AS responses,
       count(*) FILTER (http_response_code BETWEEN 400 AND 499) AS client_errors FROM (
         SELECT *, last_value(http_request_uri IGNORE NULLS) OVER (PARTITION BY talk_key ORDER BY timestamp, frame_no ROWS UNBOUNDED PRECEDING) AS uri
         FROM (SELECT timestamp, frame_no, http_response_code, http_request_uri,
                 CASE WHEN http_request_uri IS NOT NULL THEN src_ip ELSE dst_ip END AS client_ip,
                 CASE WHEN http_request_uri IS NOT NULL THEN src_ip || ':' || src_port || '-' || dst_ip || ':' || dst_port
                      ELSE dst_ip || ':' || dst_port || '-' || src_ip || ':' || src_port END AS talk_key
               FROM packets WHERE http_request_uri IS NOT NULL OR http_response_code IS NOT NULL))
       WHERE http_response_code IS NOT NULL AND uri IS NOT NULL GROUP BY ALL""",
)
def _(spark, sf):
    return detectors.brute_force(packets(spark, sf), "1 day")


@query(
    "detect_dns_tunnel", "src_ip:s domain:s window_start:t queries distinct_names mean_name_length:f max_name_length txt_or_cname",
    """SELECT src_ip, array_to_string(list_slice(string_split(dns_qry_name, '.'), -2, -1), '.') AS domain,
       time_bucket(INTERVAL 1 DAY, timestamp, TIMESTAMP '1970-01-01') AS window_start, count(*) AS queries,
       count(DISTINCT dns_qry_name) AS distinct_names, avg(length(dns_qry_name)) AS mean_name_length, max(length(dns_qry_name)) AS max_name_length,
       count(*) FILTER (dns_qry_type IN (5, 16)) AS txt_or_cname FROM packets WHERE dns_qry_name IS NOT NULL GROUP BY ALL""",
)
def _(spark, sf):
    return detectors.dns_tunnel_indicators(packets(spark, sf), "1 day")


@query(
    "detect_dns_type_mix", "src_ip:s dns_qry_type queries",
    "SELECT src_ip, dns_qry_type, count(*) AS queries FROM packets WHERE dns_qry_type IS NOT NULL GROUP BY ALL",
)
def _(spark, sf):
    return detectors.dns_type_mix(packets(spark, sf))


@query(
    "upkeep_retention", "frame_no timestamp:t",
    "SELECT * FROM packets WHERE timestamp >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 7 DAY",
)
def _(spark, sf):
    return detectors.retained(packets(spark, sf), _NOW, 7)


@query(
    "upkeep_incremental_pull", "frame_no timestamp:t",
    """SELECT * FROM packets WHERE timestamp > TIMESTAMP '2024-01-20' - INTERVAL 1 DAY
       AND frame_no NOT IN (SELECT frame_no FROM packets WHERE timestamp <= TIMESTAMP '2024-01-20' AND frame_no % 3 <> 0)""",
)
def _(spark, sf):
    df = packets(spark, sf)
    seen = df.where((F.col("timestamp") <= F.lit(datetime(2024, 1, 20))) & (F.col("frame_no") % 3 != 0))
    return detectors.incremental(df, datetime(2024, 1, 20), 86_400, seen, ["frame_no"])
