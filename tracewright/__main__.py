"""python -m tracewright analyze LOGS OUT | threads LOGS | label STORE LABELS | eval STORE | detectors | config-show | version"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracewright import __version__, config


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tracewright")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("analyze", help="read logs and write sessions, findings, incidents and distributions")
    run.add_argument("logs")
    run.add_argument("out")
    run.add_argument("--format", default="parquet", choices=("parquet", "json", "csv"))
    run.add_argument("--since")
    run.add_argument("--until")
    run.add_argument("--model", action="append", default=[])
    run.add_argument("--disable", action="append", default=[])
    run.add_argument("--config", help="a TOML file with settings")
    run.add_argument("--fail-on", choices=("info", "low", "medium", "high"))
    shown = commands.add_parser("config-show", help="print the settings in force")
    shown.add_argument("--config")
    commands.add_parser("version", help="print the version")
    commands.add_parser("detectors", help="list the rules with their severities and knobs")
    label = commands.add_parser("label", help="append labels (JSON lines) to a store that pins each root to its split")
    label.add_argument("store")
    label.add_argument("labels")
    evaluate = commands.add_parser("eval", help="agreement and shares of yes in a label store")
    evaluate.add_argument("store")
    threads = commands.add_parser("threads", help="list the sessions of logs")
    threads.add_argument("logs")
    args = parser.parse_args(argv)

    if args.command == "version":
        print(__version__)
        return 0
    if args.command == "config-show":
        print(json.dumps(config.load(args.config), indent=1))
        return 0
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    from tracewright.operators import analysis, detectors, labels
    from tracewright.sources import decoders, jsonl, sinks

    stored = "root string, split string, object_id string, feature_id string, annotator string, value double"
    if args.command == "label":
        sinks.append_labels(spark.read.schema(stored).json(args.labels), args.store)
        return 0
    if args.command == "eval":
        labels.eval_store(spark.read.schema(stored).json(args.store)).orderBy("feature_id", "split").show(1000, False)
        return 0
    if args.command == "detectors":
        for d in detectors.REGISTRY.values():
            print(d.id, d.severity, d.kind, d.knobs or "")
        return 0
    events = decoders.trace_events(spark, args.logs)
    if args.command == "threads":
        links = decoders.thread_links(decoders.decode(jsonl.records(spark, args.logs)))
        events.groupBy("session_id").count().join(links, F.col("session_id") == F.col("child"), "left").drop("child").orderBy("session_id").show(1000, False)
        return 0
    settings = config.load(args.config)
    chosen = settings["detectors"]
    found = analysis.analyze(
        analysis.in_range(events, args.since, args.until, tuple(args.model)), config.knobs_of(settings), chosen["severity"], set(chosen["enabled"]) or None,
        frozenset([*args.disable, *chosen["disabled"]]),
    )
    for name, frame in found.items():
        frame.write.mode("errorifexists").format(args.format).save(f"{args.out}/{name}")
    return int(bool(args.fail_on) and sinks.fails(found["findings"], args.fail_on))


if __name__ == "__main__":
    raise SystemExit(main())
