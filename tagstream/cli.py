"""A thin command line: decode, validate, count, summarise, redact and browse.

    python -m tagstream.cli decode FILE... [--override 4.2] [--delimiter '|'] [--dictionary FILE.xml]
    python -m tagstream.cli validate|counts|summary FILE...
    python -m tagstream.cli redact FILE... [--folder DIR]
    python -m tagstream.cli info | messages KEY | tree KEY NAME | tags KEY
    python -m tagstream.cli capture PATH [--port N] [--strict]

`-` stands for standard input. Rows are printed as they come from the executors, partition by partition.
"""

from __future__ import annotations

import argparse
import sys
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagstream.functions import fields as fx
from tagstream.operators import enrich, extract, lifecycle, reassembly, redact, validate
from tagstream.session import make_session
from tagstream.sources import capture, logs
from tagstream.sources.dictionary import Registry


def options(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tagstream")
    p.add_argument("command", choices=["decode", "validate", "counts", "summary", "redact", "info", "messages", "tree", "tags", "capture"])
    p.add_argument("arguments", nargs="*")
    p.add_argument("--override")
    p.add_argument("--delimiter", default="|")
    p.add_argument("--dictionary", action="append", default=[])
    p.add_argument("--folder")
    p.add_argument("--port", type=int)
    p.add_argument("--strict", action="store_true")
    p.add_argument("--master", default="local[*]")
    return p.parse_args(argv)


def _paths(arguments: list[str]) -> tuple[list[str], list[str]]:
    """Paths to read, standard input spooled to a file; and those that can't be read."""
    paths = []
    for a in arguments or ["-"]:
        if a == "-":
            with tempfile.NamedTemporaryFile("wb", suffix=".log", delete=False) as f:
                f.write(sys.stdin.buffer.read())
            a = f.name
        paths.append(a)
    missing = logs.missing_paths(paths)
    return [p for p in paths if p not in missing], missing


def _rows(df: DataFrame) -> Iterator[str]:
    for r in df.toLocalIterator():
        yield "\t".join("" if v is None else str(v) for v in r)


def run(o: argparse.Namespace) -> Iterator[str]:
    """The lines to print; the last is the exit code behind a NUL when it isn't 0."""
    spark = make_session(o.master)
    registry = Registry()
    for path in o.dictionary:
        with open(path, encoding="utf-8") as f:
            registry.add_xml(f.read())
    bad = 0
    if o.command == "info":
        counts = registry.table(spark, "message").groupBy("dict_key").agg(F.countDistinct("name").alias("messages"))
        fields = registry.table(spark, "field").groupBy("dict_key").agg(F.countDistinct("tag").alias("fields"))
        yield from _rows(fields.join(counts, "dict_key", "left").orderBy("dict_key"))
    elif o.command == "messages":
        m = registry.table(spark, "message", [o.arguments[0]]).withColumn("is_admin", F.col("category") == "admin")
        yield from _rows(enrich.with_bucket(m).orderBy("bucket_order", "msg_type").select("bucket", "msg_type", "name"))
    elif o.command == "tree":
        tree = registry.table(spark, "tree", [o.arguments[0]]).where(F.col("root") == o.arguments[1]).orderBy("path")
        yield from _rows(tree.select(F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("name")), "tag", "required"))
    elif o.command == "tags":
        yield from _rows(registry.table(spark, "field", [o.arguments[0]]).orderBy("tag").select("tag", "name", "type"))
    elif o.command == "capture":
        packets = capture.read_packets(spark, o.arguments[0], o.port)
        found = reassembly.reassemble(packets)
        if o.strict:
            reassembly.require_lossless(packets, found)
        yield from _rows(reassembly.capture_lines(found).select("line"))
    else:
        paths, missing = _paths(o.arguments)
        for p in missing:
            print(f"can't read {p}", file=sys.stderr)
            bad = 1
        if paths:
            yield from _logs(o, spark, registry, paths)
    for w in registry.warnings:
        print(w, file=sys.stderr)
    if bad:
        yield f"\0{bad}"


def _logs(o: argparse.Namespace, spark, registry: Registry, paths: list[str]) -> Iterator[str]:
    lines = logs.read_logs(spark, paths)
    found = extract.with_fields(extract.number_messages(extract.extract_messages(lines)))
    if o.command == "redact":
        plan = redact.plan_copies(paths, o.folder)
        clean = redact.redact_lines(lines, redact.redact_messages(found, registry))
        by_source = {r["source"]: r["source"].removeprefix("file://") for r in lines.select("source").distinct().collect()}
        redact.write_copies(clean, {uri: plan[p] for uri, p in by_source.items() if p in plan})
        yield from plan.values()
        return
    m = enrich.with_message_type(enrich.resolve(found, registry, o.override), registry)
    if o.command == "decode":
        text = enrich.render_messages(m, registry).join(m.select("seq", fx.shown(F.col("raw"), fx.parse_delimiter(o.delimiter)).alias("raw")), "seq").orderBy("seq")
        yield from _rows(text.select(F.concat_ws("\n", "raw", "text")))
    elif o.command == "validate":
        yield from _rows(validate.reasons(validate.violations(m, registry)).join(m.select("seq", "source", "line_no"), "seq").orderBy("seq").select("source", "line_no", "reason"))
    elif o.command == "counts":
        yield from _rows(enrich.count_report(enrich.count_messages(enrich.with_bucket(m))).select("bucket", "msg_type", "name", "n"))
    else:
        yield from _rows(lifecycle.summary_rows(lifecycle.report_order(lifecycle.order_records(lifecycle.resolve_identity(lifecycle.events(m, registry))))))


def main(argv: list[str] | None = None) -> int:
    code = 0
    for line in run(options(argv)):
        if line.startswith("\0"):
            code = int(line[1:])
        else:
            print(line)
    return code


if __name__ == "__main__":
    sys.exit(main())
