"""``python -m loomtrace parse|render``: scripts to fact tables and documents, fact tables to Markdown."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from loomtrace.operators import audit, links, publish
from loomtrace.plans.facts import Facts, analyze
from loomtrace.session import SETTINGS
from loomtrace.sources import metadata, scripts


def _arguments(argv: list[str]) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="loomtrace", description=__doc__)
    jobs = top.add_subparsers(dest="job", required=True)
    p = jobs.add_parser("parse", help="analyze scripts")
    given = p.add_mutually_exclusive_group(required=True)
    given.add_argument("--sql-file", help="one .sql file, or a folder of them")
    given.add_argument("--task-file", help="one task export (JSON)")
    given.add_argument("--input-dir", help="a folder of task exports")
    p.add_argument("--schema", action="append", default=[], help="column metadata: CSV, TSV, JSON or a folder of JSON; the first that has a table counts")
    p.add_argument("--out", help="folder for fact tables and documents", required=True)
    p.add_argument("--target-metadata", action="append", default=[], help="target exports (JSON file or folder): the newest of each table counts")
    p.add_argument("--sanitize-nul", action="store_true", help="remove NUL bytes from CSV metadata instead of failing; the files are told in metadata_problems")
    p.add_argument("--pretty", action="store_true", help="documents with line breaks instead of compact ones")
    p.add_argument("--first-write-only", action="store_true", help="report, as warnings, the writes of each script after its first")
    p.add_argument("--markdown", action="store_true", help="write mapping and warning documents as well")
    p.add_argument("--quality", choices=["permissive", "balanced", "strict"], default="permissive")
    p.add_argument("--fail-on-unsupported", action="store_true")
    p.add_argument("--fail-on-gaps", action="store_true")
    p.add_argument("--fail-on-recovered", action="store_true")
    p.add_argument("--fail-on-binding-fallback", action="store_true")
    r = jobs.add_parser("render", help="write Markdown from fact tables")
    r.add_argument("--facts", help="a folder that parse wrote", required=True)
    r.add_argument("--out", help="folder for the documents", required=True)
    return top.parse_args(argv)


def _markdown(facts: Facts, folder: str) -> None:
    publish.mapping_markdown(facts).write.mode("overwrite").parquet(f"{folder}/mapping")
    publish.warnings_markdown(facts).write.mode("overwrite").parquet(f"{folder}/warnings")


def _metadata(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    """Merged column metadata; conflicts and unreadable files are written beside the facts."""
    read = [metadata.read_csv(spark, p, "remove" if a.sanitize_nul else "error") if p.lower().endswith((".csv", ".tsv", ".txt")) else metadata.read_json(spark, p) for p in a.schema]
    told = [metadata.problems(spark, a.schema).select("file", "problem")] if a.schema else []
    for p in a.target_metadata:
        columns, bad = metadata.read_targets(spark, p)
        read.append(columns.drop("is_partition"))
        told.append(bad)
    if not read:
        return None
    columns, conflicts = metadata.merge(read)
    conflicts.write.mode("overwrite").json(f"{a.out}/metadata_conflicts")
    for bad in told[1:]:
        told[0] = told[0].union(bad)
    told[0].write.mode("overwrite").json(f"{a.out}/metadata_problems")
    n = conflicts.count()
    if n:
        print(f"loomtrace: {n} tables have metadata that differs between sources; see metadata_conflicts", file=sys.stderr)
    return columns


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: the quality gate failed (everything is written all the same); 2: nothing could be read."""
    a = _arguments(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.config(map=SETTINGS).getOrCreate()
    if a.job == "render":
        _markdown(Facts.read(spark, a.facts), a.out)
        return 0
    try:
        source = scripts.sql_files(spark, a.sql_file) if a.sql_file else scripts.readable(spark, a.task_file or a.input_dir)
        if not a.sql_file or not a.sql_file.lower().endswith(".sql"):
            root = a.sql_file or a.input_dir
            if root and not scripts.collisions(source).isEmpty():  # equal names in several folders
                source = scripts.mirrored(source, os.path.abspath(root))
        twice = scripts.collisions(source).first()
        if twice:
            raise scripts.EmptySource(f"task {twice.task} comes from several files: {', '.join(twice.files)}")
        # scripts are parsed where the session lives; they arrive one at a time
        known = _metadata(spark, a)
        schema = metadata.as_schema(known) if known is not None else {}
        facts = analyze(spark, ((r.task, r.sql) for r in source.orderBy("task").toLocalIterator()), schema)
    except (scripts.EmptySource, metadata.MetadataFileError) as e:
        print(f"loomtrace: {e}", file=sys.stderr)
        return 2
    publish.write(facts, a.out, known, not a.pretty)
    if "upstream" in source.columns:
        scripts.task_dependencies(source).write.mode("overwrite").parquet(f"{a.out}/task_dependencies")
    if a.first_write_only:
        links.first_writes(facts)[1].write.mode("overwrite").parquet(f"{a.out}/dropped_writes")
    if a.markdown:
        _markdown(facts, a.out)
    columns = spark.createDataFrame([(t, i, c) for t, cs in schema.items() for i, c in enumerate(cs)], "relation string, ordinal int, column string")
    bad = not audit.quality_gate(facts, a.quality, columns).filter("not passed").isEmpty()
    bad |= a.fail_on_unsupported and not facts.statements.filter("model_status in ('unsupported', 'failed')").isEmpty()
    bad |= a.fail_on_recovered and not facts.statements.filter("syntax_status = 'recovered'").isEmpty()
    bad |= a.fail_on_gaps and not audit.gaps(facts).isEmpty()
    bad |= a.fail_on_binding_fallback and not audit.target_binding(facts, columns).filter("status = 'fallback'").isEmpty()
    return int(bad)


if __name__ == "__main__":
    sys.exit(main())
