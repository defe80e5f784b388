"""Command line: validate a configuration, serve it, run a registered query, or show what there is.

    python -m weirstone validate CONFIG
    python -m weirstone serve CONFIG
    python -m weirstone status ADDRESS        (host:port of a served configuration's page)
    python -m weirstone query NAME FOLDER
    python -m weirstone list
"""

from __future__ import annotations

import argparse
import contextlib
import hashlib
import importlib.util
import sys
import urllib.request
from pathlib import Path
from types import ModuleType

from pyspark.sql import SparkSession

from weirstone.errors import ConfigurationError, EngineError
from weirstone.plans import config as configuration
from weirstone.plans.pipeline import Pipeline
from weirstone.sources.registry import Registry
from weirstone.streaming import runner
from weirstone.streaming.status import StatusPage


def program(conf: configuration.ServiceConfig) -> ModuleType:
    """The Python module that a configuration names; it has build(spark, config) -> Pipeline, and perhaps register(registry)."""
    path = Path(conf.program)
    if not path.is_file():
        raise ConfigurationError(f"no module {conf.program!r}")
    if conf.program_sha3 and hashlib.sha3_256(path.read_bytes()).hexdigest() != conf.program_sha3.lower():
        raise ConfigurationError(f"{path} has another SHA3-256 digest than the configuration says")
    spec = importlib.util.spec_from_file_location(path.stem, path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def serve(conf: configuration.ServiceConfig, spark: SparkSession) -> runner.Counters:
    registry = Registry()
    module = program(conf)
    if hasattr(module, "register"):
        module.register(registry)
    pipeline: Pipeline = module.build(spark, conf.program_config)
    conf.check_components(set(pipeline.workspace.components))
    counters = runner.Counters()
    page = contextlib.nullcontext() if conf.http_disabled else contextlib.closing(StatusPage(counters, conf.node_name, conf.http_bind))
    with page:
        return _run(conf, spark, registry, pipeline, counters)


def _run(conf: configuration.ServiceConfig, spark: SparkSession, registry: Registry, pipeline: Pipeline, counters: runner.Counters) -> runner.Counters:
    sources, sinks = conf.endpoints(registry)
    for component, sink in sinks:
        pipeline.add_sink(component, sink.write)
    if conf.run_mode == runner.STREAM:
        component, source = sources[0]
        pipeline.add_source(component, lambda ws: ws[component])
        runner.stream(pipeline, source.stream(spark), f"{conf.data_dir}/checkpoint", counters).awaitTermination()
        return counters
    for component, source in sources:
        pipeline.add_source(component, lambda ws, s=source: s.read(ws.spark))
    pipeline.validate()
    return runner.Driver(pipeline, conf.run_mode, conf.interval_ms, counters).run()


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weirstone", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("validate", "serve"):
        commands.add_parser(name).add_argument("config")
    commands.add_parser("status").add_argument("address")
    query = commands.add_parser("query")
    query.add_argument("name")
    query.add_argument("folder")
    commands.add_parser("list")
    own = parser.parse_args(args)
    try:
        if own.command == "validate":
            conf = configuration.load(own.config)
            conf.endpoints(Registry())
            print(f"{own.config}: valid, {conf.mode}, {conf.run_mode}, {len(conf.sources)} sources, {len(conf.sinks)} sinks")
        elif own.command == "status":
            with urllib.request.urlopen(f"http://{own.address}/status", timeout=10) as answer:
                print(answer.read().decode())
        elif own.command == "serve":
            print(serve(configuration.load(own.config), SparkSession.builder.appName("weirstone").getOrCreate()))
        else:
            from weirstone.plans import catalog

            if own.command == "list":
                print("\n".join(catalog.QUERIES))
            elif own.name not in catalog.QUERIES:
                raise ConfigurationError(f"no query {own.name!r}")
            else:
                catalog.QUERIES[own.name](SparkSession.builder.appName("weirstone").getOrCreate(), own.folder).show(50, truncate=False)
    except (EngineError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
