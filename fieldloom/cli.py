"""Command line: query fields, list engines and sources."""

from __future__ import annotations

import argparse
import sys

from fieldloom.sources.registries import ENGINES, SOURCES


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fieldloom", description="Field-boundary analytics on Spark")
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query", help="fields that meet an area, of a label and year")
    q.add_argument("--study-area", required=True, help="xmin,ymin,xmax,ymax, WKT, GeoJSON text or a GeoJSON file")
    q.add_argument("--source", required=True, help="Parquet dataset of fields")
    q.add_argument("--output", required=True)
    q.add_argument("--year", type=int)
    q.add_argument("--label", default="field")
    q.add_argument("--columns")
    q.add_argument("--max-features", type=int)
    q.add_argument("--no-clip", action="store_true")
    q.add_argument("--no-dedup", action="store_true")
    sub.add_parser("list-engines", help="engines and their approach")
    sub.add_parser("list-sources", help="imagery sources and their resolution")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "list-engines":
        for name, approach, gpu in ENGINES:
            print(f"{name}\t{approach}\t{'GPU' if gpu else 'CPU'}")
        return 0
    if a.command == "list-sources":
        for name, resolution, bands, _ in SOURCES:
            print(f"{name}\t{resolution or '-'} m\t{bands or '-'} bands")
        return 0
    from pyspark.sql import SparkSession

    from fieldloom.query import query_polygons
    from fieldloom.sources.vector import write_vector

    spark = SparkSession.builder.appName("fieldloom").getOrCreate()
    where = a.study_area
    if where.count(",") == 3 and not where.lstrip().startswith("{"):
        where = [float(x) for x in where.split(",")]
    try:
        found = query_polygons(
            spark, where, a.source, year=a.year, label=a.label, columns=a.columns, clip=not a.no_clip, deduplicate=not a.no_dedup, max_features=a.max_features
        )
        write_vector(found, a.output)
    except (ValueError, FileNotFoundError, TypeError) as e:
        print(f"fieldloom: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
