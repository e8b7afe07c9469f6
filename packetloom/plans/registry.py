"""Named feature steps in dependency order; users add their own."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from packetloom.operators import scalar

Transform = Callable[[DataFrame], DataFrame]

# Per-packet steps, in an order that satisfies every dependency.
SCALAR_STEPS: dict[str, Transform] = {
    "packet": scalar.packet_features,
    "http": scalar.http_features,
    "dns": scalar.dns_features,
    "dga": scalar.dga_features,
    "tls": scalar.tls_features,
    "ssh": scalar.ssh_features,
    "sql": scalar.sql_features,
    "payload": scalar.payload_features,
    "network_security": scalar.security_features,
    "protocol_anomaly": scalar.anomaly_features,
}
GROUP_STEPS = ("flow", "rtt", "session", "host", "temporal")

_added: dict[str, Transform] = {}


def register(name: str, step: Transform) -> None:
    """Add a step that runs after the built-in per-packet steps."""
    if name in SCALAR_STEPS or name in GROUP_STEPS:
        raise ValueError(f"{name} is a built-in step")
    _added[name] = step


def scalar_steps(enabled: Iterable[str] | None = None) -> list[Transform]:
    steps = {**SCALAR_STEPS, **_added}
    if enabled is None:
        return list(steps.values())
    wanted = set(enabled)
    unknown = wanted - set(steps) - set(GROUP_STEPS)
    if unknown:
        raise ValueError(f"unknown steps: {sorted(unknown)}")
    return [fn for name, fn in steps.items() if name in wanted]


def group_steps(enabled: Iterable[str] | None = None) -> set[str]:
    return set(GROUP_STEPS) if enabled is None else set(GROUP_STEPS) & set(enabled)


