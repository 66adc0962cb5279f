"""The directory job: files in, decoded members out, as rows (file, rel_path, content) and as tables.

Chunks are written once, partitioned by tag, and read again by the steps that need a tag; nothing decodes a file twice.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.functions import fonts, pixels, text
from chunkloom.operators import resolve
from chunkloom.sources import files, sinks

FOLDERS = {"bitmap": "bitmaps", "picture": "bitmaps", "sound": "sounds", "script": "scripts", "text": "texts", "button": "texts", "palette": "palettes", "shape": "shapes", "font": "fonts"}
#: Kinds as names of files have them; all others are "member".
NAMED = {"picture": "bitmap", "button": "text"} | {k: k for k in FOLDERS if k not in ("picture", "button")}
OUTPUT = "file string, rel_path string, content binary, error string"


class Project:
    """Tables of a folder of files. ``chunks`` is cut from the scan by writing it to ``work``, by tag."""

    def __init__(self, spark: SparkSession, folder: str, work: str, glob: str = files.EXTENSIONS, only: str | None = None):
        """``only`` names one file, relative to the folder."""
        scanned = files.scan(spark, folder, glob)
        made = files.chunks(scanned if only is None else scanned.where(F.col("file") == only))
        # a tag may hold any bytes, and a file's name part of a path only some
        made = made.withColumn("by", F.regexp_replace(F.coalesce("tag", F.lit("none")), "[^A-Za-z0-9]", "_"))
        made.write.mode("overwrite").partitionBy("by").parquet(work)
        self.chunks = spark.read.schema(made.schema).parquet(work)
        self.links, self.members = files.links(self.of("KEY*")), files.members(self.of("CASt"))
        self.configs, self.palettes = files.configs(self.of("DRCF", "VWCF")), files.palettes(self.of("CLUT"))
        self.numbers = resolve.numbered(files.member_list(self.of("CAS*")), self.configs)
        self.parts = resolve.parts(self.links.where("error is null"))
        self.named = resolve.with_numbers(self.members.where("error is null"), self.numbers)

    def of(self, *tags: str) -> DataFrame:
        """The chunks of some tags; other partitions aren't read."""
        return self.chunks.where(F.col("by").isin(*[re.sub("[^A-Za-z0-9]", "_", t) for t in tags]) & F.col("tag").isin(*tags))

    # --- bitmaps ---

    def pixels(self) -> DataFrame:
        """Bitmaps with their records and data, linked or within the member. Without a flag for it a bitmap has no
        palette id of its own and takes 1."""
        info = files.bitmaps(self.of("CASt")).where("error is null").drop("error", "pos", "ordinal")
        blobs = self.of("BITD").groupBy("file", F.col("res_id").alias("child")).agg(F.min_by("data", "ordinal").alias("data"))
        ours = info.join(resolve.of_part(self.parts, "bitmap", "child"), ["file", "res_id"], "left").join(blobs, ["file", "child"], "left")
        ours = ours.withColumn("data", F.coalesce("inline", "data")).where("data is not null and width > 0 and height > 0")
        own = F.when(F.col("inline").isNull() & ~F.col("has_palette"), 1).otherwise(F.col("palette_id"))
        return ours.withColumn("stored_id", F.col("palette_id")).withColumn("palette_id", own).drop("inline")

    def histograms(self) -> DataFrame:
        """Counts of raw codes by palette, of bitmaps that name a palette by number.

        A bitmap that can't be decoded has no codes to count; ``images`` has a row with its error.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            for x in batches:
                rows = []
                for i in range(x.num_rows):
                    file, palette, w, h, bpp, pitch, data = (c[i].as_py() for c in x.columns)
                    try:
                        codes = pixels.indices(data, w, h, bpp, pitch or pixels.row_bytes(w, bpp))
                    except (ValueError, zlib.error):
                        continue
                    rows.append((file, palette, np.bincount(codes.ravel(), minlength=256).tolist()))
                yield files.arrow_rows(rows, "file string, palette_id int, bins array<long>")

        use = self.pixels().withColumn("palette_id", F.col("stored_id")).where("palette_id > 0 and bpp in (1, 2, 4, 8)")
        codes = use.select("file", "palette_id", "width", "height", "bpp", "pitch", "data").mapInArrow(run, "file string, palette_id int, bins array<long>")
        return resolve.histograms(codes)

    def coloured(self) -> DataFrame:
        """Bitmaps with colours: exact probes, else the closest table of the file (step 5), else the system's (6)."""
        exact = resolve.colours(self.pixels(), self.numbers, self.parts, self.palettes, self.members)
        lost = exact.where("colors is null and palette_id > 0").select("file", "palette_id").distinct()
        hist = self.histograms().join(lost, ["file", "palette_id"], "left_semi")
        near = resolve.closest(hist, self.palettes).withColumnRenamed("colors", "near")
        out = exact.join(near, ["file", "palette_id"], "left")
        step = F.when(F.col("colors").isNotNull(), F.col("step")).when(F.col("near").isNotNull(), 5).otherwise(6)
        return out.withColumn("step", step).withColumn("colors", F.coalesce("colors", "near", resolve.built_in(-1))).drop("near")

    def report(self) -> DataFrame:
        """How each bitmap's palette was found, and how it looks: share of near-black colours, distinct 12-bit ones."""
        dark = F.size(F.filter("colors", lambda c: (c["r"] < 24) & (c["g"] < 24) & (c["b"] < 24))) / F.size("colors")
        kinds = F.size(F.array_distinct(F.transform("colors", lambda c: F.shiftright(c["r"], 4) * 256 + F.shiftright(c["g"], 4) * 16 + F.shiftright(c["b"], 4))))
        out = self.coloured().select("file", "res_id", "palette_id", "step", dark.alias("dark"), kinds.alias("kinds"))
        return out.withColumn("suspect", (F.col("dark") > 0.6) | (F.col("kinds") <= 1))

    # --- outputs ---

    def _named(self, df: DataFrame) -> DataFrame:
        """Adds ``base``: the file's whole path as a folder, folder of the kind, number, kind and name."""
        who = self.named.groupBy("file", "res_id").agg(F.min_by(F.struct("number", "kind", "name"), "ordinal").alias("who"))
        folder = F.element_at(F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv]), F.col("who.kind"))
        name = text.member_name(F.coalesce("who.name", F.concat(F.lit("member_"), F.col("res_id").cast("string"))))
        kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in NAMED.items() for x in kv]), F.col("who.kind")), F.lit("member"))
        own = F.concat_ws("/", F.col("file"), F.coalesce(folder, F.lit("other")), text.padded(F.col("who.number"), kind, name))
        return df.join(who, ["file", "res_id"]).withColumn("base", own)

    def images(self) -> DataFrame:
        version = self.configs.groupBy("file").agg(F.min_by("version", "ordinal").alias("version"))
        rows = self._named(self.coloured()).join(version, "file", "left")
        rows = rows.select("file", "base", "width", "height", "bpp", "pitch", "data", "colors", F.coalesce("version", F.lit(0)).cast("int").alias("version"), "reg_x", "reg_y")
        return rows.mapInArrow(_draw, OUTPUT)

    def texts(self) -> DataFrame:
        found = resolve.texts(self.members.where("error is null"), self.parts, files.texts(self.of("STXT"))).where("text is not null")
        return _out(self._named(found), ".txt", F.encode(text.unix_lines(F.col("text")), "UTF-8"))

    def sounds(self) -> DataFrame:
        found = resolve.sounds(self.members.where("error is null"), self.parts, self.of(*resolve.SOUND_TAGS))
        return self._named(found).select("file", "base", "tag", "data").mapInArrow(_play, OUTPUT)

    def colour_tables(self) -> DataFrame:
        table = self.palettes.where("error is null").select("file", F.col("res_id").alias("clut"), "colors")
        ours = self.members.where("kind = 'palette'").select("file", "res_id").join(resolve.of_part(self.parts, "palette", "clut"), ["file", "res_id"])
        lines = F.transform("colors", lambda c: F.concat_ws(" ", c["r"], c["g"], c["b"]))
        body = F.concat(F.lit("JASC-PAL\n0100\n"), F.size("colors").cast("string"), F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n"))
        return _out(self._named(ours.join(table, ["file", "clut"])), ".pal", F.encode(body, "UTF-8"))

    def shapes(self) -> DataFrame:
        """Shapes as text; one whose record is too short as the member's own bytes."""
        s = files.shapes(self.of("CASt")).where("error is null")
        hexed = lambda c: F.when(F.col(c) == 0, "0").otherwise(F.concat(F.lit("0x"), F.lower(F.hex(c))))
        yes = lambda c: F.when(F.col(c), "yes").otherwise("no")
        fields = {"shapeType": F.col("shape"), "regX": F.col("reg_x"), "regY": F.col("reg_y"), "width": F.col("width"), "height": F.col("height"), "color": hexed("color"), "backColor": hexed("back"), "fillType": F.col("fill"), "lineThickness": F.col("thickness"), "lineDirection": F.col("direction"), "filled": yes("filled"), "outlineInvisible": yes("outline_invisible")}
        body = F.concat(*[F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit("\n")) for k, v in fields.items()])
        rest = self.members.where("kind = 'shape' and error is null").select("file", "res_id", "raw").join(s, ["file", "res_id"], "left_anti")
        return _out(self._named(s), ".txt", F.encode(body, "UTF-8")).unionByName(_out(self._named(rest), ".bin", F.col("raw")))

    def scripts(self, listed: bool = True) -> DataFrame:
        """Scripts as text, and their instructions listed."""
        from chunkloom.operators import scripts

        return scripts.written(self, listed)

    def movies(self) -> DataFrame:
        """Config of each file as lines of name and value; what a short record lacks is left out."""
        return sinks.config_text(self.of("DRCF"))

    def casts(self) -> DataFrame:
        """Library tables; files without one get a row for each of their own lists."""
        listed = files.libraries(self.of("MCsL")).where("error is null").select("file", "id", "name", "path", "min_member", "max_member", "member_count")
        lists = files.member_list(self.of("CAS*")).groupBy("file", "list_no").agg(F.count_if(F.col("member_res") != 0).alias("n"), F.count("*").alias("slots"))
        first = self.configs.groupBy("file").agg(F.min_by("min_member", "ordinal").alias("low"))
        own = lists.join(first, "file", "left").withColumn("low", F.coalesce("low", F.lit(1)))
        place = F.row_number().over(Window.partitionBy("file").orderBy("list_no"))
        own = own.select("file", place.alias("id"), F.lit("Internal").alias("name"), F.lit("").alias("path"), F.col("low").alias("min_member"), (F.col("low") + F.col("slots") - 1).alias("max_member"), F.col("n").alias("member_count"))
        from chunkloom.operators.links import else_rows

        return else_rows(listed, own, ["file"])

    def linked_casts(self) -> DataFrame:
        """(file, pos, path): paths of libraries in other files, each once, where it is named first."""
        listed = files.libraries(self.of("MCsL")).where("error is null and path <> ''")
        return listed.groupBy("file", "path").agg(F.min(F.struct("ordinal", "pos")).alias("at")).select("file", F.row_number().over(Window.partitionBy("file").orderBy("at")).alias("pos"), "path")

    def cast_lists(self) -> DataFrame:
        """casts.txt and linked_casts.txt of each file that has them."""
        line = F.concat(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("id", "name", "path", "min_member", "max_member", "member_count")]), F.lit("\n"))
        own = self._lines(self.casts().select("file", F.col("id").alias("pos"), line.alias("line")), "casts.txt")
        return own.unionByName(self._lines(self.linked_casts().select("file", "pos", F.concat("path", F.lit("\n")).alias("line")), "linked_casts.txt"))

    @staticmethod
    def _lines(rows: DataFrame, name: str) -> DataFrame:
        """A text of a file's lines in order; there are at most as many as a file has libraries."""
        body = F.array_join(F.array_sort(F.collect_list(F.struct("pos", "line")))["line"], "")
        path = F.concat(F.col("file"), F.lit(f"/{name}"))
        return rows.groupBy("file").agg(F.encode(body, "UTF-8").alias("content")).select("file", path.alias("rel_path"), "content", F.lit(None).cast("string").alias("error"))

    def fonts(self) -> DataFrame:
        """Font members: the linked payload, else the member's own bytes."""
        blobs = self.of("XMED").groupBy("file", F.col("res_id").alias("child")).agg(F.min_by("data", "ordinal").alias("data"))
        ours = self.members.where("kind = 'font' and error is null").select("file", "res_id", "raw")
        linked = ours.join(resolve.of_part(self.parts, "font", "child"), ["file", "res_id"], "left").join(blobs, ["file", "child"], "left")
        return _out(self._named(linked.select("file", "res_id", F.coalesce("data", "raw").alias("data"))), ".bin", F.col("data"))

    def movie_fonts(self) -> DataFrame:
        """Font payloads linked to members of other kinds, each once, numbered by the first member that names it."""
        others = self.members.where("kind <> 'font' and error is null").select("file", "res_id", "ordinal")
        first = others.join(resolve.of_part(self.parts, "font", "child"), ["file", "res_id"]).groupBy("file", "child").agg(F.min("ordinal").alias("ordinal"))
        blobs = self.of("XMED").where(F.substring("data", 1, 4) == F.lit(fonts.MAGIC)).groupBy("file", F.col("res_id").alias("child")).agg(F.min_by("data", "ordinal").alias("data"))
        schema = "file string, child long, ordinal int, name string, data binary"
        read = first.join(blobs, ["file", "child"]).select("file", "child", "ordinal", "data").mapInArrow(_font_names, schema)
        number = F.row_number().over(Window.partitionBy("file").orderBy("ordinal", "child"))
        named = F.when(F.col("name") != "", text.member_name(F.col("name"))).otherwise(F.concat(F.lit("font_"), F.col("child").cast("string")))
        base = F.concat_ws("/", F.col("file"), F.lit("fonts"), text.padded(number, named))
        return _out(read.withColumn("base", base), ".pfr", F.col("data"))

    def font_names(self) -> DataFrame:
        """fonts.txt of each file: its font map."""
        rows = files.font_map(self.of("Fmap")).where("error is null")
        line = F.concat(F.concat_ws("\t", F.col("font_id").cast("string"), F.col("platform").cast("string"), "font_name"), F.lit("\n"))
        return self._lines(rows.select("file", F.struct("ordinal", "pos").alias("pos"), line.alias("line")), "fonts.txt")

    def script_kinds(self) -> DataFrame:
        """(file, script_res, kind): of a script, the member it is linked to, else the first that names it, else its own."""
        from chunkloom.operators import scripts

        return scripts.kinds(self)

    def inspect(self, limit: int = 50) -> dict[str, DataFrame]:
        """What a look at the files shows, by part; lists are cut to ``limit`` rows as this is for reading."""
        tags = self.chunks.where("tag is not null").groupBy("file", "tag").agg(F.count("*").alias("n"), F.sum(F.length("data")).alias("bytes"))
        tree = self.chunks.where("tag is not null").select("file", F.concat(F.repeat(F.lit("  "), F.size(F.split("path", r"\.")) - 1), "tag").alias("node"), "res_id", "declared").orderBy("file", "ordinal")
        parts = {"tags": tags.orderBy("file", "tag"), "links": self.links, "members": self.named.select("file", "number", "kind", "name"), "texts": files.texts(self.of("STXT")).select("file", "res_id", F.substring("text", 1, 80).alias("text"))}
        parts |= {"sounds": files.sounds(self.of(*resolve.SOUND_TAGS)), "bitmaps": files.bitmaps(self.of("CASt")), "map": files.memory_map(self.of("mmap")), "names": files.script_names(self.of("Lnam")), "config": self.configs}
        return {"tree": tree} | {name: df.limit(limit) for name, df in parts.items()}

    def numbered(self) -> DataFrame:
        """(file, number, res_id, clut): members by number, and the colour table that each is linked to."""
        return self.numbers.join(resolve.of_part(self.parts, "palette", "clut"), ["file", "res_id"], "left").select("file", "number", "res_id", "clut")

    def records_of(self, *names: str) -> DataFrame:
        """(file, res_id, name, hex): the specific bytes of the members of some names."""
        return self.members.where(F.col("name").isin(*names)).select("file", "res_id", "name", F.lower(F.hex("spec")).alias("hex"))

    def without_palette(self) -> DataFrame:
        """(file, n): how many bitmaps of more than one bit name no palette."""
        found = files.bitmaps(self.of("CASt")).where("error is null and palette_id = 0 and bpp > 1")
        return found.groupBy("file").agg(F.count("*").alias("n"))

    def outputs(self, listed: bool = True) -> DataFrame:
        """All files to write; listings of instructions only if ``listed``."""
        parts = [self.images(), self.texts(), self.sounds(), self.colour_tables(), self.shapes(), self.scripts(listed), self.movies(), self.cast_lists(), self.fonts(), self.movie_fonts(), self.font_names()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def outcome(self) -> DataFrame:
        """One row: files that failed, that were left out, that went well, and all."""
        state = self.chunks.where("ordinal = 0").select(F.when(F.col("tag").isNotNull(), "ok").when(F.col("error").startswith("skip"), "skip").otherwise("fail").alias("state"))
        return state.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("fail", "skip", "ok")], F.count("*").alias("files"))


def _out(df: DataFrame, extension: str, content) -> DataFrame:
    return df.select("file", F.concat("base", F.lit(extension)).alias("rel_path"), content.alias("content"), F.lit(None).cast("string").alias("error"))


def _draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PNG, with indices where there are eight bits and a palette, else RGBA; its palette and registration point."""
    for x in batches:
        for i in range(x.num_rows):
            file, base, w, h, bpp, pitch, data, colors, version, reg_x, reg_y = (c[i].as_py() for c in x.columns)
            table, rows = [(c["r"], c["g"], c["b"]) for c in colors], []
            pitch = pitch or pixels.row_bytes(w, bpp)
            try:
                if bpp == 8:
                    image = pixels.png(w, h, pixels.indices(data, w, h, 8, pitch).tobytes(), table)
                else:
                    image = pixels.png(w, h, pixels.rgba(data, w, h, bpp, pitch, table, version).tobytes())
                rows.append((file, f"{base}.png", image, None))
                if bpp < 32:
                    rows.append((file, f"{base}.pal", pixels.palette_text(table).encode(), None))
                rows.append((file, f"{base}.regpoint", f"regX={reg_x}\nregY={reg_y}\n".encode(), None))
            except (ValueError, zlib.error) as e:
                rows.append((file, f"{base}.png", None, f"{type(e).__name__}: {e}"))
            yield files.arrow_rows(rows, OUTPUT)


def _play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from chunkloom.functions import records

    for x in batches:
        for file, base, tag, data in zip(*(c.to_pylist() for c in x.columns), strict=True):
            try:
                head = records.sound(tag.encode("latin-1"), data)
                extension, content = pixels.sound_file(tag.encode("latin-1"), data, head)
                row = (file, f"{base}.{extension}", content, None)
            except ValueError as e:
                row = (file, base, None, f"{type(e).__name__}: {e}")
            yield files.arrow_rows([row], OUTPUT)


def _font_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The name that a font program gives itself; what is no font program has no row."""
    for x in batches:
        rows = []
        for file, child, ordinal, data in zip(*(c.to_pylist() for c in x.columns), strict=True):
            font = fonts.program(data)
            if font:
                rows.append((file, child, ordinal, font.metrics.name, data))
        yield files.arrow_rows(rows, "file string, child long, ordinal int, name string, data binary")
