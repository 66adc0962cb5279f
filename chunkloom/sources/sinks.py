"""Sinks: rows of paths and bytes to files, config records to text, chunks back to containers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from chunkloom.functions import bytes as B
from chunkloom.functions import records
from chunkloom.sources import container, files

FILES = "file string, rel_path string, content binary, error string"


class BlobSource(DataSource):
    """``df.write.format("blobs").save(folder)``: writes rows (rel_path, content) as files below a mounted folder.

    A file is written under another name and moved when whole, so a task that runs again does no harm.
    """

    @classmethod
    def name(cls) -> str:
        return "blobs"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return BlobWriter(self.options["path"], schema.names)


class BlobWriter(DataSourceWriter):
    def __init__(self, folder: str, names: list[str]):
        self.folder, self.at = folder.removeprefix("file:"), (names.index("rel_path"), names.index("content"))

    def write(self, rows: Iterator) -> WriterCommitMessage:
        import os
        import uuid

        root = os.path.realpath(self.folder)
        for row in rows:
            path, content = (row[i] for i in self.at)
            full = os.path.realpath(os.path.join(root, path))
            if content is None or not full.startswith(root + os.sep):
                continue  # errors have no content; no path leads out of the folder
            os.makedirs(os.path.dirname(full), exist_ok=True)
            part = f"{full}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as f:
                f.write(bytes(content))
            os.replace(part, full)
        return WriterCommitMessage()


def write_blobs(outputs: DataFrame, folder: str) -> None:
    """Writes outputs, each row as the file it names. Paths begin with the whole path of the input file, so no two
    inputs share one; if two rows have one path all the same, nothing is written. Contents aren't shuffled."""
    spark = outputs.sparkSession
    rows = outputs.where("content is not null").select("rel_path", "content")
    twice = rows.groupBy("rel_path").count().where("count > 1").select("rel_path").limit(3).collect()
    if twice:
        raise ValueError(f"several outputs have one path: {', '.join(r.rel_path for r in twice)}")
    spark.dataSource.register(BlobSource)
    rows.write.format("blobs").mode("append").save(folder)


def config_text(configs: DataFrame) -> DataFrame:
    """(file, rel_path, content, error): a line of name, tab and value for each field that the record has."""
    d = F.col("data")
    s = lambda at: B.signed(d, at, 2)
    u = lambda at, n=2: B.unsigned(d, at, n)
    colour = lambda v: F.format_string("0x%06X", v.bitwiseAND(F.lit(0xFFFFFF)))
    system = F.array(*[F.lit(r << 16 | g << 8 | b) for r, g, b in records.builtin_palette(-1)])
    late = F.coalesce(u(36), F.lit(0)) >= 0x208
    has = u(56).isNotNull()
    fields = {
        "stage_width": s(10) - s(6),
        "stage_height": s(8) - s(4),
        "stage_left": F.when(s(4).isNotNull(), s(6)),
        "stage_top": F.when(s(6).isNotNull(), s(4)),
        "stage_right": s(10),
        "stage_bottom": F.when(s(10).isNotNull(), s(8)),
        "background_color": colour(s(28)),
        "stage_color": F.when(late, colour(u(26))).otherwise(colour(s(26))),
        "stage_color_rgb": F.when(late, colour(F.when(u(26, 1) != 0, F.shiftleft(u(27, 1), 16) + u(18)).otherwise(F.get(system, u(27, 1).cast("int"))))),
        "tempo": u(54),
        "min_member": u(12),
        "max_member": u(14),
        "default_palette": F.when(u(78).isNotNull(), F.concat_ws(":", s(76), s(78))),
        "director_version": F.when(has, u(36)),
        "movie_version": F.when(has, u(2)),
        "platform": s(56),
    }
    lines = F.array_compact(F.array(*[F.concat(F.lit(f"{k}\t"), v.cast("string"), F.lit("\n")) for k, v in fields.items()]))
    first = configs.groupBy("file").agg(F.min_by("data", "ordinal").alias("data"))
    path = F.concat(F.col("file"), F.lit("/movie.txt"))
    return first.select("file", path.alias("rel_path"), F.encode(F.array_join(lines, ""), "UTF-8").alias("content"), F.lit(None).cast("string").alias("error"))


def containers(chunks: DataFrame, packed: bool = True) -> DataFrame:
    """(file, content): each file's chunks written as one container again, compressed or plain frames."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["ordinal", "res_id", "tag", "data", "offset", "path"]).to_pylist(), key=lambda r: r["ordinal"])
        if packed:
            own = [(r["res_id"], r["tag"].encode("latin-1"), r["data"], r["offset"] == -1) for r in rows]
            content = container.write_packed(own)
        else:
            own = [container.Chunk(r["tag"].encode("latin-1"), r["data"], path=tuple(map(int, r["path"].split(".")))) for r in rows]
            content = container.write_tree(own)
        return pa.table({"file": [key[0].as_py()], "content": pa.array([content], pa.binary())})

    return chunks.where("data is not null").groupBy("file").applyInArrow(run, "file string, content binary")


def files_again(scanned: DataFrame, how: str = "plain") -> DataFrame:
    """(file, rel_path, content, error) of scanned files: ``plain`` frames of what was compressed, others as they are;
    or each ``rewritten`` in its own layout. A file that can't be is a row with its error."""
    make = {"plain": container.plain, "rewritten": container.rewritten}[how]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for name, content in zip(x.column(0).to_pylist(), x.column(1), strict=True):
                try:
                    row = (name, name, make(content.as_py()), None)
                except ValueError as e:
                    row = (name, name, None, f"{type(e).__name__}: {e}")
                yield files.arrow_rows([row], FILES)

    return scanned.select("file", "content").mapInArrow(run, FILES)
