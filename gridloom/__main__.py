"""python -m gridloom merge|plan|inventory|results|overviews|structure|window ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from gridloom.plans import jobs


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gridloom", description="Merges aligned GeoTIFFs on Spark.")
    actions = parser.add_subparsers(dest="action", required=True)
    merge = actions.add_parser("merge", help="merge into verified blocks")
    merge.add_argument("input")
    merge.add_argument("output")
    merge.add_argument("--overlap", choices=("first", "last", "error"), default="error")
    merge.add_argument("--compression", default="deflate")
    merge.add_argument("--predictor", type=int, default=1)
    merge.add_argument("--level", type=int, help="of the compression")
    merge.add_argument("--nodata", type=float)
    merge.add_argument("--overviews", choices=("none", "nearest", "average"), default="none", help="inside the blocks")
    merge.add_argument("--edge", type=int, default=512, help="samples of a stored tile's side")
    merge.add_argument("--block-tiles", type=int, default=16, help="stored tiles of a block's side")
    merge.add_argument("--resume", action="store_true", help="keep finished blocks and write only the rest")
    plan = actions.add_parser("plan", help="show the outputs of about so many pixels")
    plan.add_argument("input")
    plan.add_argument("pixels", type=int)
    for name, said in (("inventory", "show the headers of the files"), ("results", "show what an earlier job left, if it is on one grid"), ("structure", "show what keeps files from being cloud optimised")):
        actions.add_parser(name, help=said).add_argument("input")
    levels = actions.add_parser("overviews", help="write overviews beside the files")
    levels.add_argument("input")
    levels.add_argument("--resampling", choices=("nearest", "average"), default="average")
    levels.add_argument("--min-size", type=int, default=256)
    levels.add_argument("--compression", default="deflate")
    window = actions.add_parser("window", help="show the stored tiles that meet a box of coordinates")
    window.add_argument("input")
    window.add_argument("box", type=float, nargs=4, metavar=("WEST", "SOUTH", "EAST", "NORTH"))
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("gridloom").getOrCreate()
    if a.action == "merge":
        made = jobs.merge(
            spark, a.input, a.output, a.overlap, edge=a.edge, block_tiles=a.block_tiles, compression=a.compression, predictor=a.predictor, level=a.level, nodata=a.nodata, overviews=a.overviews, resume=a.resume
        )
    elif a.action == "plan":
        made = jobs.plan(spark, a.input, a.pixels)
    elif a.action == "overviews":
        made = jobs.external_overviews(spark, a.input, a.resampling, a.min_size, compression=a.compression)
    elif a.action == "window":
        made = jobs.window(spark, a.input, jobs.footprints(spark, a.input), tuple(a.box)).select("path", "band", "x", "y", "w", "h")
    elif a.action == "structure":
        made = jobs.structure(spark, a.input)
    else:
        made = {"inventory": jobs.inventory, "results": jobs.results}[a.action](spark, a.input).orderBy("ord")
    made.show(1000, truncate=False)


if __name__ == "__main__":
    main()
