"""Command line: files to documents of other formats, a file for each.

    python -m palimpsest --to markdown html --out file:///out /archive/*.WS
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import emit, settings
from palimpsest.sources.files import read_paths, write_documents


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="palimpsest", description=__doc__)
    p.add_argument("files", nargs="+")
    p.add_argument("--to", nargs="+", choices=sorted(emit.formats()), help="rtf, or pdf in printed mode, if not given")
    p.add_argument("--out", required=True, help="URI of a folder")
    p.add_argument("--mode", choices=settings.OPTIONS["mode"], default="modern")
    p.add_argument("--variant", choices=[v for v in settings.OPTIONS["variant"] if v], help="overrules what the bytes look like")
    p.add_argument("--notes", nargs="*", choices=emit.NOTE_KINDS, default=list(emit.DEFAULT_NOTES))
    p.add_argument("--note-refs", choices=settings.OPTIONS["note_refs"], default="word")
    p.add_argument("--page-settings", type=settings.page_settings, default={}, help="a preset, or mt=1in,po=8,size=a4")
    p.add_argument("--toc", action="store_true")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    """Zero if every file was converted; what wasn't is said on standard error."""
    a = arguments(argv)
    spark = SparkSession.builder.appName("palimpsest").getOrCreate()
    to = tuple(a.to or [settings.checked_options({"mode": a.mode})["to"]])
    held = read_paths(spark, a.files)
    made = emit.convert_many(held, to, a.mode, variant=a.variant, notes=tuple(a.notes), note_refs=a.note_refs, page=a.page_settings, toc=a.toc)
    made = held.select("doc_id", "path", F.col("error").alias("missing")).join(made, "doc_id").withColumn("error", F.coalesce("missing", "error"))
    made = made.persist()
    for name in to:
        write_documents(made.select("path", F.col(f"`{name}`").alias("output")), a.out, emit.formats()[name]).write.format("noop").mode("overwrite").save()
    wrong = made.where("error is not null").select("path", "error.kind", "error.message")
    for row in wrong.toLocalIterator():
        print(f"{row['path']}: {row['kind']}: {row['message']}", file=sys.stderr)
    return int(not wrong.isEmpty())


if __name__ == "__main__":
    sys.exit(main())
