"""Queries for cleaning, reports and score comparison."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from packetloom.catalog.base import SLICE, STEPS, WINDOW, packets, query
from packetloom.catalog.clients import client_sessions
from packetloom.catalog.flows import FLOW_STEPS, HOST_STEPS
from packetloom.catalog.scalar import dirty
from packetloom.operators import clean, compare, flow, host, profile, quality, report

# Numbers with gaps, infinities and a constant.
STEPS["numbers"] = """SELECT frame_no, frame_len, tcp_seq, tcp_flags AS tcp_flag_field, http_response_code AS code_count,
    CASE WHEN frame_no % 50 = 0 THEN CAST('infinity' AS DOUBLE) ELSE CAST(frame_len AS DOUBLE) * 1.5 END AS byte_rate,
    CASE WHEN frame_no % 11 = 0 THEN NULL ELSE CAST(ip_len AS DOUBLE) * 0.25 END AS pkts_per_sec, 7 AS constant_feat FROM packets"""
_N = "packets numbers"
_COLS = ["frame_no", "frame_len", "tcp_seq", "tcp_flag_field", "code_count", "byte_rate", "pkts_per_sec", "constant_feat"]
_OUT = " ".join(c if c == "frame_no" else f"{c}:f" for c in _COLS)
_FINITE = "CASE WHEN isinf({0}) THEN NULL ELSE {0} END"


def numbers(spark, sf):
    no = F.col("frame_no")
    return packets(spark, sf).select(
        "frame_no", "frame_len", "tcp_seq", F.col("tcp_flags").alias("tcp_flag_field"), F.col("http_response_code").alias("code_count"),
        F.when(no % 50 == 0, float("inf")).otherwise(F.col("frame_len") * 1.5).alias("byte_rate"),
        F.when(no % 11 != 0, F.col("ip_len") * 0.25).alias("pkts_per_sec"), F.lit(7).alias("constant_feat"),
    )


@query(
    "clean_prepare_time", "frame_no timestamp:t",
    "SELECT frame_no, CASE WHEN frame_no % 10 <> 0 THEN timestamp END AS timestamp FROM packets",
)
def _(spark, sf):
    text = F.when(F.col("frame_no") % 10 == 0, "not a time").otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return clean.prepare_time(packets(spark, sf).withColumn("timestamp", text))


@query(
    "clean_numeric_only", "column_name:s missing",
    "SELECT * FROM (VALUES " + ", ".join(f"('{c}')" for c in ("frame_no", "src_port", "dst_port", "frame_len", "ip_len", "tcp_flags",
    "tcp_seq", "tcp_ack", "dns_qry_type", "dns_an_count", "http_response_code")) + ") t(column_name), LATERAL (SELECT CASE column_name "
    + " ".join(f"WHEN '{c}' THEN (SELECT count(*) FROM packets WHERE {c} IS NULL)" for c in ("tcp_flags", "tcp_seq", "tcp_ack", "dns_qry_type", "dns_an_count", "http_response_code"))
    + " ELSE 0 END AS missing)",
)
def _(spark, sf):
    return clean.missing_profile(clean.numeric_only(packets(spark, sf)))


_ZERO = {c: f"coalesce({_FINITE.format(c) if c == 'byte_rate' else c}, 0)" for c in _COLS}
STEPS["filled"] = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in _ZERO.items()) + " FROM numbers"


@query("clean_fill_zero", _OUT, "SELECT * FROM filled", _N + " filled")
def _(spark, sf):
    return clean.fill_zero(numbers(spark, sf))


@query("clean_training_numeric", _OUT, "SELECT * FROM filled", _N + " filled")
def _(spark, sf):
    return clean.fill_zero(clean.numeric_only(numbers(spark, sf)))


@query(
    "clean_clip_outliers", _OUT,
    """SELECT * REPLACE (least(byte_rate, (SELECT quantile_cont(byte_rate, 0.99) FROM filled)) AS byte_rate,
       least(pkts_per_sec, (SELECT quantile_cont(pkts_per_sec, 0.99) FROM filled)) AS pkts_per_sec) FROM filled""",
    _N + " filled",
)
def _(spark, sf):
    return clean.clean_features(numbers(spark, sf))


def _imputed(zeros: str, finite: bool) -> str:
    def cell(c: str) -> str:
        source = _FINITE.format(c) if finite and c == "byte_rate" else c
        fill = "0" if c in zeros.split() else f"(SELECT median({source}) FROM numbers)"
        return f"coalesce({source}, {fill}) AS {c}"

    return "SELECT " + ", ".join(cell(c) for c in _COLS) + " FROM numbers"


STEPS["imputed"] = _imputed("tcp_flag_field code_count", True)


@query("clean_impute_counts_or_median", _OUT, "SELECT * FROM imputed", _N + " imputed")
def _(spark, sf):
    return clean.impute_counts_or_median(numbers(spark, sf))


@query("clean_impute_tcp_or_median", " ".join(c for c in _OUT.split() if c != "byte_rate:f"), _imputed("tcp_seq tcp_flag_field", False), _N)
def _(spark, sf):
    return clean.impute_tcp_or_median(numbers(spark, sf).drop("byte_rate"))


@query(
    "clean_drop_constant", "frame_no kept:s",
    f"SELECT frame_no, '{','.join(c for c in _COLS if c != 'constant_feat')}' AS kept FROM numbers", _N,
)
def _(spark, sf):
    out = clean.drop_constant(clean.finite_only(numbers(spark, sf)))
    return out.select("frame_no", F.lit(",".join(out.columns)).alias("kept"))


@query(
    "clean_align_features", "frame_no byte_rate:f tcp_seq:f absent_feature:f",
    f"SELECT frame_no, {_ZERO['byte_rate']} AS byte_rate, coalesce(tcp_seq, 0) AS tcp_seq, 0 AS absent_feature FROM numbers", _N,
)
def _(spark, sf):
    return clean.align_features(numbers(spark, sf), ["byte_rate", "tcp_seq", "absent_feature"])


@query(
    "clean_missing_profile", "column_name:s missing missing_pct:f",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, (count(*) - count({c})) / count(*) * 100.0 AS missing_pct FROM numbers" for c in _COLS),
    _N,
)
def _(spark, sf):
    return clean.missing_profile(numbers(spark, sf))


@query(
    "clean_report", "metric:s value:s",
    f"""SELECT unnest(['rows_before', 'columns_before', 'rows_after', 'columns_after', 'removed_columns', 'kept_columns',
          'infinite_values', 'missing_before', 'missing_after']) AS metric,
        unnest([n::VARCHAR, '8', n::VARCHAR, '7', 'constant_feat', '{','.join(_COLS[:-1])}', infs::VARCHAR, gaps::VARCHAR, '0']) AS value
        FROM (SELECT count(*) AS n, count(*) FILTER (isinf(byte_rate)) AS infs,
              {' + '.join(f'count(*) - count({c})' for c in _COLS)} AS gaps FROM numbers)""",
    _N,
)
def _(spark, sf):
    return clean.cleaning_report(numbers(spark, sf))


@query(
    "clean_describe", "column_name:s count mean:f std:f min:f q25:f q50:f q75:f max:f",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min,
            quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, max({c}) AS max FROM packets"""
        for c in ("frame_len", "tcp_seq", "tcp_flags", "dst_port")
    ),
)
def _(spark, sf):
    return clean.describe(packets(spark, sf), ["frame_len", "tcp_seq", "tcp_flags", "dst_port"])


_FEATURES = ["frame_len", "ip_len", "src_port", "dst_port", "tcp_seq", "dns_qry_type"]


@query(
    "clean_feature_variances", "feature:s variance:g",
    " UNION ALL ".join(f"SELECT '{c}' AS feature, var_samp({c}) AS variance FROM packets" for c in _FEATURES),
)
def _(spark, sf):
    return clean.feature_variances(packets(spark, sf), _FEATURES)


@query(
    "clean_feature_correlations", "a:s b:s correlation:f",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS correlation FROM packets"
        for i, a in enumerate(_FEATURES[:5]) for b in _FEATURES[i + 1:5]
    ),
)
def _(spark, sf):
    return clean.feature_correlations(packets(spark, sf), _FEATURES[:5])


@query(
    "clean_selected_features", "feature:s",
    """SELECT unnest(['frame_len', 'src_port', 'tcp_seq'] ||
       CASE WHEN (SELECT abs(corr(src_port, dst_port)) FROM packets) > 0.95 THEN [] ELSE ['dst_port'] END) AS feature""",
)
def _(spark, sf):
    kept = clean.select_features(packets(spark, sf), _FEATURES)
    return spark.createDataFrame([(c,) for c in kept], "feature string")


# ---- reports ----

@query("report_detection_sessions", "src_ip:s records", "SELECT src_ip, count(*) AS records FROM packets GROUP BY src_ip")
def _(spark, sf):
    return report.detection_sessions(packets(spark, sf))


@query(
    "report_first_rows", "src_ip:s frame_no timestamp:t protocol:s dns_qry_name:s",
    "SELECT * FROM packets QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY timestamp, frame_no) = 1",
)
def _(spark, sf):
    return report.first_rows(packets(spark, sf))


@query("report_protocols", "protocol:s count", "SELECT protocol, count(*) AS count FROM packets GROUP BY protocol")
def _(spark, sf):
    return report.protocol_counts(packets(spark, sf))


# Client sessions with a made score from their totals, so that both engines see the same numbers.
STEPS["scored"] = """SELECT *, CASE WHEN score >= 0.9 THEN -1 ELSE 1 END AS anomaly FROM (
    SELECT *, (total_bytes % 1009) / 1009.0 AS score, (total_bytes % 97) / 97.0 AS seq_score,
      (row_number() OVER (PARTITION BY client_ip ORDER BY timestamp, frame_no) >= 5)::INT AS is_ready FROM compared)"""
SCORED_STEPS = "packets csessions compared scored"


def scored(spark, sf):
    sessions = profile.compare_with_history(client_sessions(spark, sf))
    out = sessions.withColumns({
        "score": (F.col("total_bytes") % 1009) / 1009.0, "seq_score": (F.col("total_bytes") % 97) / 97.0,
    })
    return out.withColumn("anomaly", F.when(F.col("score") >= 0.9, -1).otherwise(1))


@query(
    "report_header", "total_samples anomalies anomaly_ratio:f first_time:t last_time:t",
    """SELECT count(*) AS total_samples, count(*) FILTER (anomaly = -1) AS anomalies, count(*) FILTER (anomaly = -1) / count(*) AS anomaly_ratio,
       min(timestamp) AS first_time, max(timestamp) AS last_time FROM scored""", SCORED_STEPS,
)
def _(spark, sf):
    return report.report_header(scored(spark, sf), F.col("anomaly") == -1)


_FEATURED = f"{FLOW_STEPS} named src_hosts dst_hosts"
STEPS["featured"] = """SELECT p.*, flow_duration_seconds, flow_bytes_per_sec, src_host_pkt_count_win, dst_host_pkt_count_win FROM named p
    JOIN (SELECT src_ip, dst_ip, src_port, dst_port, protocol, flow_duration_seconds, flow_bytes_per_sec FROM flows) USING (src_ip, dst_ip, src_port, dst_port, protocol)
    JOIN (SELECT src_ip, time_window, src_host_pkt_count_win FROM src_hosts) USING (src_ip, time_window)
    JOIN (SELECT dst_ip, time_window, dst_host_pkt_count_win FROM dst_hosts) USING (dst_ip, time_window)"""
_FEATURED_STEPS = _FEATURED + " featured"


def featured(spark, sf):
    return host.with_host_features(flow.with_flow_features(packets(spark, sf), SLICE), WINDOW, SLICE)


def with_hosts(spark, sf):
    return host.with_host_features(packets(spark, sf), WINDOW, SLICE)


@query(
    "report_explanation", "reason:s applies",
    """SELECT 'short_flow' AS reason, bool_or(flow_duration_seconds < 1e-6)::INT AS applies FROM featured UNION ALL
       SELECT 'fast_bytes', (max(flow_bytes_per_sec) > 1e9)::INT FROM featured UNION ALL
       SELECT 'many_packets', (max(src_host_pkt_count_win) > 100)::INT FROM featured""", _FEATURED_STEPS,
)
def _(spark, sf):
    return report.anomaly_explanation(featured(spark, sf))


@query(
    "report_run_summary", "stage:s metric:s value",
    """SELECT 'ingestion' AS stage, unnest(['files_found', 'packets_read', 'packets_filtered', 'packets_processed']) AS metric,
         unnest([count(DISTINCT file_path), count(*), count(*) - count(*) FILTER (ok), count(*) FILTER (ok)]) AS value
       FROM (SELECT *, src_ip <> '10.0.0.300' AND dst_port <= 65535 AND frame_len BETWEEN 64 AND 1500 AS ok FROM dirty)
       UNION ALL SELECT 'sessionization', unnest(['records_before_aggregation', 'unique_sessions']), unnest([count(*), count(DISTINCT src_ip)])
       FROM dirty WHERE src_ip <> '10.0.0.300' AND dst_port <= 65535 AND frame_len BETWEEN 64 AND 1500
       UNION ALL SELECT 'detection', unnest(['sessions_processed', 'sessions_skipped', 'anomalies_detected']),
         unnest([count(*), 0, count(*) FILTER (anomaly = -1)]) FROM scored""",
    SCORED_STEPS + " dirty",
)
def _(spark, sf):
    rows = dirty(spark, sf)
    valid, _rejected = quality.validate(rows, 64, 1500)
    return report.run_summary(quality.ingest_counters(rows, 64, 1500), valid, scored(spark, sf))


for _side in ("src", "dst"):

    @query(
        f"report_top_hosts_{_side}", "ip:s activity",
        f"SELECT {_side}_ip AS ip, sum({_side}_host_pkt_count_win) AS activity FROM featured GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
        _FEATURED_STEPS,
    )
    def _(spark, sf, side=_side):
        return report.top_hosts(with_hosts(spark, sf), side)


STEPS["both_sides"] = """SELECT ip, a + b AS activity FROM (SELECT src_ip AS ip, sum(src_host_pkt_count_win) AS a FROM featured GROUP BY 1)
    JOIN (SELECT dst_ip AS ip, sum(dst_host_pkt_count_win) AS b FROM featured GROUP BY 1) USING (ip)"""
STEPS["localhost"] = "SELECT ip FROM both_sides ORDER BY activity DESC, ip LIMIT 1"
_LOCAL_STEPS = _FEATURED_STEPS + " both_sides localhost"


@query("report_bidirectional_hosts", "ip:s activity", "SELECT * FROM both_sides", _LOCAL_STEPS)
def _(spark, sf):
    return report.bidirectional_hosts(with_hosts(spark, sf))


@query("report_local_host", "ip:s", "SELECT ip FROM localhost", _LOCAL_STEPS)
def _(spark, sf):
    return report.local_host(with_hosts(spark, sf))


@query("report_main_host", "src_ip:s records", "SELECT src_ip, count(*) AS records FROM packets GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def _(spark, sf):
    return report.main_host(packets(spark, sf))


@query(
    "report_host_protocols", "ip:s protocol:s count percentage:f",
    """SELECT ip, protocol, count(*) AS count, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY ip) AS percentage
       FROM packets JOIN localhost ON ip = src_ip OR ip = dst_ip GROUP BY ip, protocol""", _LOCAL_STEPS,
)
def _(spark, sf):
    return report.host_protocols(packets(spark, sf), report.local_host(with_hosts(spark, sf)))


for _side, _other in (("src", "dst"), ("dst", "src")):

    @query(
        f"report_top_peers_{_side}", "host:s peer:s interactions protocols:s rank",
        f"""SELECT *, row_number() OVER (PARTITION BY host ORDER BY interactions DESC, peer) AS rank FROM (
              SELECT {_side}_ip AS host, {_other}_ip AS peer, count(*) AS interactions, string_agg(DISTINCT protocol, ', ' ORDER BY protocol) AS protocols
              FROM packets GROUP BY ALL) QUALIFY rank <= 5""",
    )
    def _(spark, sf, side=_side):
        df = packets(spark, sf)
        return report.top_peers(df, df.select(F.col(f"{side}_ip").alias("ip")).distinct(), side)


@query(
    "report_peer_protocols", "src_ip:s dst_ip:s protocols:s",
    "SELECT src_ip, dst_ip, string_agg(DISTINCT protocol, ', ' ORDER BY protocol) AS protocols FROM packets GROUP BY ALL",
)
def _(spark, sf):
    return report.peer_protocols(packets(spark, sf))


@query(
    "report_top_edges", "src_ip:s dst_ip:s count src_label:s dst_label:s",
    """SELECT src_ip, dst_ip, count(*) AS count, src_ip || ' (host)' AS src_label, 'host-' || dst_ip AS dst_label FROM packets
       WHERE src_ip = (SELECT src_ip FROM packets GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) GROUP BY ALL ORDER BY count DESC, dst_ip LIMIT 10""",
)
def _(spark, sf):
    named = packets(spark, sf).withColumns({
        "src_hostname": F.concat(F.lit("host-"), "src_ip"), "dst_hostname": F.concat(F.lit("host-"), "dst_ip"),
    })
    return report.top_edges(named)


@query(
    "report_top_anomalies", "client_ip:s frame_no score:f",
    "SELECT * FROM scored WHERE anomaly = -1 ORDER BY score DESC, client_ip, frame_no LIMIT 100", SCORED_STEPS,
)
def _(spark, sf):
    return report.anomalies_to_show(scored(spark, sf))


@query(
    "report_anomaly_details",
    "client_ip:s frame_no score:f profile_session_count profile_total_bytes profile_uris:s profile_user_agents:s highlight_uri highlight_user_agent",
    """SELECT s.client_ip, s.frame_no, s.score, t.session_count AS profile_session_count, t.total_bytes AS profile_total_bytes,
       coalesce(u.text, 'None') AS profile_uris, coalesce(a.text, 'None') AS profile_user_agents,
       (is_new_uri_for_ip = 1)::INT AS highlight_uri, (is_new_user_agent_for_ip = 1)::INT AS highlight_user_agent
       FROM scored s JOIN totals t USING (client_ip)
       LEFT JOIN (SELECT client_ip, CASE WHEN length(x) > 100 THEN x[1:100] || '...' ELSE x END AS text FROM
         (SELECT client_ip, string_agg(value, ', ' ORDER BY value) AS x FROM pvalues WHERE kind = 'uri' GROUP BY 1)) u USING (client_ip)
       LEFT JOIN (SELECT client_ip, CASE WHEN length(x) > 100 THEN x[1:100] || '...' ELSE x END AS text FROM
         (SELECT client_ip, string_agg(value, ', ' ORDER BY value) AS x FROM pvalues WHERE kind = 'user_agent' GROUP BY 1)) a USING (client_ip)
       WHERE anomaly = -1""",
    SCORED_STEPS + " totals pvalues",
)
def _(spark, sf):
    rows, sessions = scored(spark, sf), client_sessions(spark, sf)
    return report.anomaly_details(rows.where("anomaly = -1"), profile.profile_totals(sessions), profile.profile_values(sessions))


@query(
    "report_distinct_rtt_rows", "src_ip:s dst_ip:s protocol:s",
    "SELECT DISTINCT src_ip, dst_ip, protocol FROM packets",
)
def _(spark, sf):
    return packets(spark, sf).dropDuplicates(["src_ip", "dst_ip", "protocol"])


# ---- scores ----

@query(
    "score_metrics",
    "n_samples contamination:f threshold:f num_anomalies estimated_contamination:f anomaly_score_mean:f anomaly_score_std:f "
    "anomaly_score_min:f anomaly_score_max:f anomaly_score_p25:f anomaly_score_median:f anomaly_score_p75:f anomaly_score_range:f",
    """SELECT count(*) AS n_samples, 0.1 AS contamination, any_value(t) AS threshold, count(*) FILTER (score <= t) AS num_anomalies,
       count(*) FILTER (score <= t) / count(*) AS estimated_contamination, avg(score) AS anomaly_score_mean, stddev_pop(score) AS anomaly_score_std,
       min(score) AS anomaly_score_min, max(score) AS anomaly_score_max, quantile_cont(score, 0.25) AS anomaly_score_p25,
       median(score) AS anomaly_score_median, quantile_cont(score, 0.75) AS anomaly_score_p75, max(score) - min(score) AS anomaly_score_range
       FROM scored, (SELECT score AS t FROM scored QUALIFY row_number() OVER (ORDER BY score) = (SELECT floor((count(*) - 1) * 0.1)::BIGINT + 1 FROM scored))""",
    SCORED_STEPS,
)
def _(spark, sf):
    return compare.score_metrics(scored(spark, sf))


@query(
    "score_labels", "client_ip:s frame_no label",
    "SELECT client_ip, frame_no, CASE WHEN score <= 0.25 THEN -1 ELSE 1 END AS label FROM scored", SCORED_STEPS,
)
def _(spark, sf):
    return scored(spark, sf).withColumn("label", compare.label_by_threshold("score", 0.25))


@query("score_normalized", "client_ip:s frame_no value:f", "SELECT client_ip, frame_no, 0.5 - score AS value FROM scored", SCORED_STEPS)
def _(spark, sf):
    return scored(spark, sf).withColumn("value", compare.normalized_score(F.col("score")))


@query(
    "score_feature_difference", "feature:s side:s",
    """SELECT DISTINCT protocol AS feature, 'unexpected' AS side FROM packets WHERE protocol NOT IN ('TCP', 'QUIC') UNION ALL
       SELECT 'QUIC', 'missing'""",
)
def _(spark, sf):
    have = packets(spark, sf).select(F.col("protocol").alias("feature")).distinct()
    return compare.name_difference(have, spark.createDataFrame([("TCP",), ("QUIC",)], "feature string"))


@query(
    "score_drift", "bin old_share:f new_share:f psi:f",
    """SELECT *, (new_share - old_share) * ln(new_share / old_share) AS psi FROM (
         SELECT bin, greatest(sum(o) / sum(sum(o)) OVER (), 1e-6) AS old_share, greatest(sum(1 - o) / sum(sum(1 - o)) OVER (), 1e-6) AS new_share
         FROM (SELECT least(floor(score / 0.1), 9) AS bin, (run_start < TIMESTAMP '2024-01-15')::INT AS o FROM scored) GROUP BY bin)""",
    SCORED_STEPS,
)
def _(spark, sf):
    rows = scored(spark, sf)
    early = F.col("run_start") < F.lit(datetime(2024, 1, 15))
    return compare.drift(rows.where(early), rows.where(~early), 0.0, 1.0)
