"""Overviews beside rasters: files .ovr, written as streams of tiles that other tasks have made.

Rows (path, role, level, band, ty, tx, size, data) of a file come sorted. First those of role 0 with the facts of the file as JSON, then those of
role 1 with the size of each stored tile, from which the writer knows where everything goes, then those of role 2 with the tiles themselves, the smallest level
first. So a writer holds the sizes of a file's tiles and one tile, whatever the raster's size.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from gridloom.sources.files import opened
from gridloom.sources.geotiff import CODECS, layout

ROWS = "path string, role int, level int, band int, ty long, tx long, size long, data binary"
#: What may lie beside a raster and describe overviews that no longer hold. Fixed values.
SIDECARS = (".ovr", ".msk.ovr", ".rrd", ".aux")


def across(facts: dict, level: int) -> tuple[int, int]:
    """How many tiles a level has each way."""
    return tuple(-(-(-(-facts[k] // (1 << level))) // facts["edge"]) for k in ("width", "height"))


def place(facts: dict, level: int, band: int, ty: int, tx: int) -> int:
    """Where a tile stands among those of its directory; masks (band 0) have one of their own."""
    wide, high = across(facts, level)
    return ((band - 1 if band else 0) * high + ty) * wide + tx


class _File:
    """One file in the making: sizes first, then tiles in the order in which they are stored."""

    def __init__(self, facts: dict):
        self.facts, self.levels, self.masked = facts, facts["levels"], facts["masked"]
        tiles = [across(facts, k + 1) for k in range(self.levels)]
        self.counts = [[0] * (w * h * facts["bands"]) for w, h in tiles] + ([[0] * (w * h) for w, h in tiles] if self.masked else [])

    def directory(self, level: int, band: int) -> int:
        return level - 1 + (0 if band else self.levels)

    def head(self) -> bytes:
        f = self.facts

        def tags(k: int, word: str, offsets: list[int]) -> list[tuple]:
            level, mask = k % self.levels + 1, k >= self.levels
            bits, bands, kind = (1, 1, 1) if mask else (f["bits"], f["bands"], f["kind"])
            made = [
                (254, "I", [5 if mask else 1]), (256, "I", [-(-f["width"] // (1 << level))]), (257, "I", [-(-f["height"] // (1 << level))]), (258, "H", [bits] * bands), (259, "H", [CODECS["deflate" if mask else f["codec"]]]),
                (262, "H", [4 if mask else 1]), (277, "H", [bands]), (284, "H", [2]), (317, "H", [1 if mask else f["predictor"]]), (322, "I", [f["edge"]]), (323, "I", [f["edge"]]), (324, word, offsets), (325, "I", self.counts[k]),
                (339, "H", [kind] * bands),
            ]
            if bands > 1:
                made.append((338, "H", [0] * (bands - 1)))
            if f["nodata"] is not None and not mask:
                made.append((42113, "s", [f["nodata"].encode() + b"\0"]))
            return made

        return layout(tags, self.counts)[0]


class _Made(WriterCommitMessage):
    def __init__(self, files):
        self.files = files


class OverviewWriter(DataSourceWriter):
    """Each file .ovr replaces what lay beside its raster when all are whole; if the job fails nothing has changed."""

    def __init__(self, options):
        self.job = uuid.uuid4().hex

    def write(self, iterator):
        made, out, file, path, begun = [], None, None, None, False
        try:
            for row in iterator:
                if row.path != path:
                    if out is not None:
                        out.close()
                    path, file, begun = row.path, _File(json.loads(row.data)), False
                    store, name = opened(path)
                    out = store.open_output_stream(f"{name}.ovr.{self.job}")
                    made.append(path)
                elif row.role == 1:
                    file.counts[file.directory(row.level, row.band)][place(file.facts, row.level, row.band, row.ty, row.tx)] = row.size
                else:
                    if not begun:
                        out.write(file.head())
                        begun = True
                    out.write(row.data)
        finally:
            if out is not None:
                out.close()
        return _Made(made)

    def commit(self, messages):
        for path in (p for m in messages if m for p in m.files):
            store, name = opened(path)
            for suffix in SIDECARS:
                if store.get_file_info(name + suffix).is_file:
                    store.delete_file(name + suffix)
            store.move(f"{name}.ovr.{self.job}", f"{name}.ovr")

    def abort(self, messages):
        for path in (p for m in messages if m for p in m.files):
            store, name = opened(path)
            if store.get_file_info(f"{name}.ovr.{self.job}").is_file:
                store.delete_file(f"{name}.ovr.{self.job}")


class OverviewDataSource(DataSource):
    @classmethod
    def name(cls):
        return "overviews"

    def schema(self):
        return ROWS

    def writer(self, schema, overwrite):
        return OverviewWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OverviewDataSource)
