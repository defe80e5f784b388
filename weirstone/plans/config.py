"""Configuration files: TOML with ${NAME} and ${NAME:-default} filled in from the environment."""

from __future__ import annotations

import os
import re
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from weirstone.errors import ConfigurationError
from weirstone.sources.registry import Registry
from weirstone.streaming.runner import CONTINUOUS, INTERVAL, ONE_SHOT, STREAM

#: Defaults of a cluster's timing and of the status page.
LEASE_MS, ELECTION_MS, HEARTBEAT_MS, SNAPSHOT_ENTRIES, BIND = 30_000, 1_500, 300, 10_000, "0.0.0.0:8080"


def substituted(text: str, env: Mapping[str, str] | None = None) -> str:
    """The text with its placeholders filled in."""
    env = os.environ if env is None else env
    out, at = [], 0
    while (begin := text.find("${", at)) >= 0:
        end = text.find("}", begin)
        if end < 0:
            raise ConfigurationError("a ${ without its }")
        name, dash, default = text[begin + 2 : end].partition(":-")
        if name not in env and not dash:
            raise ConfigurationError(f"{name} isn't set and has no default")
        out += [text[at:begin], env.get(name, default)]
        at = end + 1
    return "".join([*out, text[at:]])


@dataclass(frozen=True)
class Endpoint:
    """A declared source (component: where its rows go) or sink (component: whose rows it gets)."""

    name: str
    kind: str
    component: str
    options: dict[str, Any]


@dataclass(frozen=True)
class ServiceConfig:
    node_id: int
    node_name: str
    data_dir: str
    mode: str = "standalone"
    run_mode: str = CONTINUOUS
    interval_ms: int = 0
    program: str = ""
    program_config: dict[str, str] = field(default_factory=dict)
    program_sha3: str | None = None
    sources: tuple[Endpoint, ...] = ()
    sinks: tuple[Endpoint, ...] = ()
    peers: tuple[tuple[int, str], ...] = ()
    bootstrap: bool = False
    lease_ttl_ms: int = LEASE_MS
    election_timeout_ms: int = ELECTION_MS
    heartbeat_interval_ms: int = HEARTBEAT_MS
    snapshot_log_interval: int = SNAPSHOT_ENTRIES
    http_bind: str = BIND
    http_disabled: bool = False
    log_format: str = "pretty"
    log_level: str = "info"

    def validate(self) -> None:
        """Raises on the first rule that is broken."""
        if not self.data_dir:
            raise ConfigurationError("node.data_dir is empty")
        if self.mode not in ("standalone", "cluster"):
            raise ConfigurationError(f"unknown mode {self.mode!r}")
        if self.run_mode not in (CONTINUOUS, ONE_SHOT, INTERVAL, STREAM):
            raise ConfigurationError(f"unknown run mode {self.run_mode!r}")
        if self.run_mode == INTERVAL and self.interval_ms <= 0:
            raise ConfigurationError("interval mode needs interval_ms")
        if self.mode == "cluster":
            ids = [i for i, _ in self.peers]
            if not ids:
                raise ConfigurationError("a cluster needs peers")
            if len(set(ids)) < len(ids):
                raise ConfigurationError("two peers have the same id")
            if self.node_id not in ids:
                raise ConfigurationError(f"node {self.node_id} isn't among the peers")
            if self.lease_ttl_ms < 3 * self.election_timeout_ms:
                raise ConfigurationError("lease_ttl_ms must be three times election_timeout_ms or more")
            if self.sources:
                raise ConfigurationError("a cluster takes no declared sources")
        streaming = self.mode == "standalone" and self.run_mode == STREAM
        if streaming and len(self.sources) != 1:
            raise ConfigurationError("stream mode needs exactly one source")
        if not streaming and any(s.kind == "tcp" for s in self.sources):
            raise ConfigurationError("a tcp source never ends; it needs standalone stream mode")
        if not self.http_disabled and not re.fullmatch(r"(\d{1,3}(\.\d{1,3}){3}|\[[0-9a-fA-F:]+\]):\d{1,5}", self.http_bind):
            raise ConfigurationError(f"{self.http_bind} is no address and port")

    def check_components(self, components: set[str]) -> None:
        """Sources and sinks must name components of the program, and every component needs none."""
        for what, ends in (("source", self.sources), ("sink", self.sinks)):
            for e in ends:
                if e.component not in components:
                    raise ConfigurationError(f"{what} {e.name}: the program has no component {e.component!r}")

    def endpoints(self, registry: Registry) -> tuple[list[tuple[str, Any]], list[tuple[str, Any]]]:
        return [(s.component, registry.source(s.kind, s.options)) for s in self.sources], [(s.component, registry.sink(s.kind, s.options)) for s in self.sinks]


def _flag(value: Any) -> bool:
    if isinstance(value, bool):
        return value
    if isinstance(value, str) and value.lower() in ("true", "false"):
        return value.lower() == "true"
    raise ConfigurationError(f"{value!r} is neither true nor false")


def parse(text: str, env: Mapping[str, str] | None = None) -> ServiceConfig:
    try:
        raw = tomllib.loads(substituted(text, env))
    except tomllib.TOMLDecodeError as e:
        raise ConfigurationError(f"no valid TOML: {e}") from e
    try:
        node, run, http, seen = raw["node"], raw.get("run_mode", {}), raw.get("http", {}), raw.get("observability", {})
        program = raw.get("pipeline", {}).get("wasm") or raw.get("pipeline", {}).get("python") or {}
        ends = {
            what: tuple(Endpoint(x["name"], x["type"], x[component], x.get("config", {})) for x in raw.get(what, []))
            for what, component in (("sources", "target_component"), ("sinks", "source_component"))
        }
        config = ServiceConfig(
            int(node["id"]), node.get("name", ""), str(node.get("data_dir", "")), raw.get("mode", "standalone"),
            run.get("kind", CONTINUOUS), int(run.get("interval_ms", 0)),
            program.get("module", ""), dict(program.get("config", {})), program.get("sha3_256"),
            ends["sources"], ends["sinks"], tuple((int(p["id"]), p["addr"]) for p in raw.get("peers", [])), _flag(raw.get("bootstrap", False)),
            int(raw.get("lease_ttl_ms", LEASE_MS)), int(raw.get("election_timeout_ms", ELECTION_MS)), int(raw.get("heartbeat_interval_ms", HEARTBEAT_MS)), int(raw.get("snapshot_log_interval", SNAPSHOT_ENTRIES)),
            http.get("bind", BIND), _flag(http.get("disabled", False)), seen.get("log_format", "pretty"), seen.get("log_level", "info"),
        )
    except (KeyError, TypeError, ValueError) as e:
        raise ConfigurationError(f"missing or unusable entry: {e}") from e
    config.validate()
    return config


def load(path: str | Path, env: Mapping[str, str] | None = None) -> ServiceConfig:
    try:
        text = Path(path).read_text()
    except OSError as e:
        raise ConfigurationError(f"{path} can't be read: {e}") from e
    return parse(text, env)
