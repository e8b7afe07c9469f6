"""Per-packet features: one projection per protocol, all native expressions except the payload bytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from packetloom.functions.entropy import char_entropy, hex_payload_stats
from packetloom.functions.net import is_private_ip
from packetloom.operators.guard import has_columns

EPS = 1e-6

TCP_FLAG_BITS = ("fin", "syn", "rst", "psh", "ack", "urg")

# Fixed values.
COMMON_PORTS = (21, 22, 23, 25, 53, 80, 110, 143, 443, 993, 995)
HTTP_METHODS = ("GET", "POST", "HEAD", "PUT", "DELETE")
SUSPICIOUS_TLDS = ("tk", "ml", "ga", "cf")
SUSPICIOUS_SQL = (
    "union select", "drop table", "xp_cmdshell", "--", ";", "insert into", "update set", "delete from",
)
VULNERABLE_SSH = ("OpenSSH_7.4",)


def flag(condition: Column) -> Column:
    """0/1 with NULL as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def parse_tcp_flags(df: DataFrame, column: str = "tcp_flags") -> Column:
    """Flags as an int: numbers as they are, '0x..' text as hex, everything else 0."""
    c = F.col(column)
    if dict(df.dtypes)[column] == "string":
        c = F.when(c.rlike("^0x[0-9a-fA-F]+$"), F.conv(F.substring(c, 3, 16), 16, 10))
    return F.coalesce(c.try_cast("int"), F.lit(0))


def packet_features(df: DataFrame) -> DataFrame:
    if not has_columns(df, ["tcp_flags"], "packet_features"):
        return df
    bits = parse_tcp_flags(df)
    return df.withColumns(
        {f"tcp_flag_{name}": F.shiftright(bits, i).bitwiseAND(1) for i, name in enumerate(TCP_FLAG_BITS)}
    )


def anomaly_features(df: DataFrame, tcp_only: bool = False) -> DataFrame:
    """Scan and flood flags. A NULL flag field counts as 0, hence as a null scan, unless ``tcp_only``."""
    columns: dict[str, Column] = {}
    if "tcp_flags" in df.columns:
        bits = parse_tcp_flags(df)
        null_scan = bits == 0
        if tcp_only:
            null_scan = null_scan & F.col("tcp_flags").isNotNull()
        columns["tcp_flags_null_scan"] = flag(null_scan)
        columns["tcp_flags_xmas_scan"] = flag(bits.bitwiseAND(0x29) == 0x29)
        columns["tcp_flags_syn_flood"] = flag(bits.bitwiseAND(0x02) == 0x02)
    if "dns_qry_name" in df.columns:
        tlds = "|".join(SUSPICIOUS_TLDS)
        columns["dns_suspicious_tld"] = flag(F.col("dns_qry_name").rlike(rf"(?i)\.({tlds})$"))
    return df.withColumns(columns) if columns else df


def dns_features(df: DataFrame) -> DataFrame:
    if not has_columns(df, ["dns_qry_name", "dns_qry_type", "dns_an_count", "dns_response_ip"], "dns_features"):
        return df
    answers = F.when(F.col("dns_response_ip").isNull(), 0).otherwise(F.size(F.split("dns_response_ip", ",")))
    return df.withColumns({
        "dns_qry_name_len": F.coalesce(F.length("dns_qry_name"), F.lit(0)),
        "dns_qry_name_entropy": char_entropy(F.col("dns_qry_name")),
        "dns_response_ip_to_query_ratio": answers / (F.col("dns_an_count").try_cast("double") + F.lit(EPS)),
    })


def dga_features(df: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Machine-made domain score: entropy without the last label, plus the share of digits."""
    if not has_columns(df, ["dns_qry_name"], "dga_features"):
        return df
    name = F.col("dns_qry_name")
    labels = F.split(name, r"\.")
    stem = F.when(F.size(labels) > 1, F.array_join(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), "."))
    entropy = char_entropy(F.coalesce(stem, name))
    digits = F.length(F.regexp_replace(name, "[^0-9]", ""))
    ratio = F.when(F.length(name) > 0, digits / F.length(name)).otherwise(0.0)
    return (
        df.withColumns({"dga_domain_entropy": entropy, "dga_numeric_ratio": ratio})
        .withColumn("dga_score", F.col("dga_domain_entropy") / 4.0 + F.col("dga_numeric_ratio") * 2.0)
        .withColumn("is_dga_domain", flag(F.col("dga_score") > threshold))
    )


def http_features(df: DataFrame, methods: Sequence[str] = HTTP_METHODS) -> DataFrame:
    wanted = ["http_request_method", "http_request_uri", "http_host", "http_user_agent", "http_response_code"]
    if not has_columns(df, wanted, "http_features", any_of=True):
        return df
    columns: dict[str, Column] = {}
    if "http_request_uri" in df.columns:
        columns["http_uri_length"] = F.coalesce(F.length("http_request_uri"), F.lit(0))
        columns["http_uri_entropy"] = char_entropy(F.col("http_request_uri"))
    if "http_request_method" in df.columns:
        for method in methods:
            columns[f"http_method_{method.lower()}"] = flag(F.col("http_request_method") == method)
    if "http_response_code" in df.columns:
        code = F.coalesce(F.col("http_response_code").try_cast("double"), F.lit(0.0))
        for low, name in ((200, "success"), (300, "redirect"), (400, "client_error"), (500, "server_error")):
            columns[f"http_rsp_{name}"] = flag((code >= low) & (code < low + 100))
    return df.withColumns(columns) if columns else df


def sql_features(df: DataFrame, keywords: Sequence[str] = SUSPICIOUS_SQL) -> DataFrame:
    """Length, entropy and suspicious words (one case-insensitive pattern) of SQL text; NULL gives 0."""
    if not has_columns(df, ["sql_query"], "sql_features"):
        return df
    return df.withColumns({
        "sql_query_length": F.coalesce(F.length("sql_query"), F.lit(0)),
        "sql_query_entropy": char_entropy(F.col("sql_query")),
        "sql_contains_suspicious_keywords": flag(F.col("sql_query").rlike("(?i)" + "|".join(keywords))),
    })


def ssh_features(df: DataFrame, vulnerable: Sequence[str] = VULNERABLE_SSH) -> DataFrame:
    """Version tests. The texts are patterns, so the dot in '2.0' matches any character."""
    if not has_columns(df, ["ssh_protocol", "ssh_server_version", "ssh_client_version"], "ssh_features", any_of=True):
        return df
    columns: dict[str, Column] = {}
    if "ssh_protocol" in df.columns:
        columns["ssh_is_v2"] = flag(F.col("ssh_protocol").rlike("2.0"))
    if "ssh_server_version" in df.columns:
        columns["ssh_server_is_potentially_vulnerable"] = flag(F.col("ssh_server_version").rlike("|".join(vulnerable)))
    return df.withColumns(columns)


def tls_features(df: DataFrame) -> DataFrame:
    if not has_columns(df, ["tls_ja3"], "tls_features"):
        return df
    if dict(df.dtypes)["tls_ja3"] == "string":
        return df
    return df.withColumn("tls_ja3", F.coalesce(F.col("tls_ja3").cast("string"), F.lit("")))


def payload_features(df: DataFrame) -> DataFrame:
    """Entropy and printable share of the payload bytes.

    A packet carries hundreds of bytes, where per-element lambdas are far slower than one numpy pass
    over the Arrow batch, so this is the one feature that leaves the JVM.
    """
    if not has_columns(df, ["payload"], "payload_features"):
        return df
    return (
        df.withColumn("__payload", hex_payload_stats(F.col("payload")))
        .withColumns({
            "payload_entropy": F.col("__payload.entropy"),
            "payload_printable_char_ratio": F.col("__payload.printable"),
        })
        .drop("__payload")
    )


def security_features(df: DataFrame) -> DataFrame:
    if not has_columns(df, ["dst_port", "src_ip", "dst_ip", "frame_len"], "security_features"):
        return df
    return df.withColumns({
        "is_common_port": flag(F.col("dst_port").isin(*COMMON_PORTS)),
        "is_high_port": flag(F.col("dst_port") > 1024),
        "src_is_private": flag(is_private_ip("src_ip")),
        "dst_is_private": flag(is_private_ip("dst_ip")),
        "is_jumbo_frame": flag(F.col("frame_len") > 1500),
        "is_tiny_packet": flag(F.col("frame_len") < 64),
    })


def calendar_features(df: DataFrame) -> DataFrame:
    """Hour, weekday (Monday 0) and office hours 9..17 (17:59 included), in UTC."""
    if not has_columns(df, ["timestamp"], "calendar_features"):
        return df
    return df.withColumns({
        "hour_of_day": F.hour("timestamp"),
        "day_of_week": F.weekday("timestamp"),
        "is_business_hours": flag(F.hour("timestamp").between(9, 17)),
    })


def ja3_string(
    handshake_type: Column, version: Column, ciphers: Column, extensions: Column, curves: Column, formats: Column
) -> Column:
    """``version,ciphers,extensions,curves,formats`` of a client hello; inner commas become dashes."""
    lists = [F.regexp_replace(F.coalesce(c, F.lit("")), ",", "-") for c in (ciphers, extensions, curves, formats)]
    return F.when((handshake_type == "1") & version.isNotNull(), F.concat_ws(",", version, *lists))


def http_header_count(request_block: Column, response_block: Column) -> Column:
    """Lines of the request header block, else of the response block, else 0."""
    block = F.coalesce(F.nullif(request_block, F.lit("")), F.nullif(response_block, F.lit("")))
    return F.when(block.isNull(), 0).otherwise(F.size(F.split(block, "\n")))
