"""The full feature pipeline over packets."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from packetloom.functions.net import LOCAL_NETWORKS, session_key
from packetloom.operators import clean, enrich, flow, host, rtt, session
from packetloom.operators.scalar import calendar_features
from packetloom.operators.slices import DEFAULT_SLICE, merge_back
from packetloom.plans.registry import group_steps, scalar_steps
from packetloom.schema import FLOW_KEY
from packetloom.session import settled

# Texts that only feed per-packet features; dropped before rows are shuffled.
BULKY = ("payload", "http_cookie", "http_authorization", "http_referer")


@dataclass
class FeatureOptions:
    steps: Sequence[str] | None = None
    slice_width: str = DEFAULT_SLICE
    host_window: str = host.DEFAULT_WINDOW
    rtt_timeout: str = "60 seconds"
    local_networks: Sequence[str] = LOCAL_NETWORKS
    trailing: dict[str, str] = field(default_factory=lambda: {"packets_in_1s_window": "1 second"})
    clip_quantile: float = clean.CLIP_QUANTILE
    # Each takes the distinct addresses and returns a table keyed by ``ip``.
    enrichers: Sequence[Callable[[DataFrame], DataFrame]] = ()
    quality_control: bool = True


def build_features(df: DataFrame, options: FeatureOptions | None = None) -> DataFrame:
    """Every packet with its packet, flow, session, RTT, host and time features.

    The per-packet features are written once as a narrow table; all groupings read only the columns they need from it.
    Flow, session and RTT statistics meet in the small flow table and reach the packets in one join on
    (5-tuple, slice). With sessions on, packets without a complete 5-tuple are dropped.
    """
    o = options or FeatureOptions()
    groups = group_steps(o.steps)
    df = clean.prepare_time(df)
    for enricher in o.enrichers:
        df = enrich.attach(df, enricher(enrich.unique_ips(df)), o.slice_width)
    for step in scalar_steps(o.steps):
        df = step(df)
    if "temporal" in groups:
        df = calendar_features(df)
    df = df.drop(*BULKY)
    if groups:
        df = _with_group_features(settled(df), groups, o)
    if not o.quality_control:
        return df
    # The caps need their own pass over the finished rows, so those are written once as well.
    return clean.clip_outliers(settled(clean.fill_zero(df)), o.clip_quantile)


def _with_group_features(base: DataFrame, groups: set[str], o: FeatureOptions) -> DataFrame:
    if "rtt" in groups and set(rtt.REQUIRED) <= set(base.columns):
        # Acknowledgements are matched once; everything after reads the written column.
        base = settled(rtt.with_ack_rtt(base, o.rtt_timeout))
    out = base
    if "host" in groups:
        out = host.with_host_features(out, o.host_window, o.slice_width, source=base)
    if "session" in groups:
        out, base = (session.with_session_key(d, o.local_networks) for d in (out, base))
    if groups & {"flow", "session", "rtt"}:
        out = _with_flow_level(out, base, groups, o)
    if "temporal" in groups:
        out = host.with_pair_gaps(out, source=base)
        out = host.trailing_counts(out, o.trailing, source=base)
    return out


def _with_flow_level(df: DataFrame, base: DataFrame, groups: set[str], o: FeatureOptions) -> DataFrame:
    flows = flow.flow_table(base)
    with_rtt = "rtt" in groups and "rtt_ack_ms" in base.columns
    if with_rtt:
        # At most one row per flow.
        shakes = settled(rtt.handshake_rtt(base, o.rtt_timeout, o.local_networks))
        stats = rtt.rtt_stats_of(base, shakes, o.slice_width)
        flows = rtt.with_flow_key(flows).join(stats, "flow_key", "left").join(shakes, "flow_key", "left").drop("flow_key")
    if "session" in groups:
        sessions = session.session_table(base, o.local_networks)
        flows = flows.withColumn("session_key", session_key()).join(sessions, "session_key").drop("session_key")
    out = merge_back(df, flows, FLOW_KEY, o.slice_width, source=base)
    if with_rtt:
        out = out.withColumn("rtt_combined_ms", rtt.mean_of_present(F.col("rtt_ms"), F.col("rtt_ack_ms")))
    return out
