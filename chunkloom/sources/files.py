"""Files to tables: a scan of a folder, and the tables of chunks and of what they hold.

A file is the unit of parallelism: it is read, told apart and decoded in one task, without a shuffle. Errors are data:
a file or chunk that can't be decoded gives a row with its error, and the job goes on.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions import bytes as B
from chunkloom.functions import records
from chunkloom.sources import container

#: File name extensions, in any case.
EXTENSIONS = "*.{[cC][cC][tT],[dD][cC][rR],[cC][sS][tT]}"
#: Content of the chunks that one task's batch may hold.
BATCH_BYTES = 32 << 20


def scan(spark: SparkSession, folder: str, glob: str = EXTENSIONS) -> DataFrame:
    """(file, length, content) of all matching files below ``folder``; file is the path below it."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return relative(df, folder).select("file", "length", "content")


def stream(spark: SparkSession, folder: str, glob: str = EXTENSIONS) -> DataFrame:
    """The same of files as they arrive; decoding below works on it as on a batch."""
    from chunkloom.streaming import files

    return files.arriving(spark, folder, glob)


def relative(df: DataFrame, folder: str) -> DataFrame:
    tail = folder.rstrip("/").split("://")[-1].split("/", 1)[-1] if "://" in folder else folder.strip("/")
    at = F.locate(f"/{tail}/", "path")
    return df.withColumn("file", F.when(at > 0, F.substring("path", at + F.lit(len(tail) + 2), F.length("path"))).otherwise(F.col("path")))


def sniffed(files: DataFrame) -> DataFrame:
    """Adds magic, codec class and whether the file is a stub of HTML, as native expressions."""
    head, codec = F.substring("content", 1, 4), F.substring("content", 9, 4)
    both = lambda tags: [F.lit(x) for t in tags for x in (t, t[::-1])]
    kind = F.when(F.length("content") < 12, "unknown").when(codec.isin(*both(container.PACKED)), "packed").when(codec.isin(*both(container.MAPPED)), "map").otherwise("unknown")
    stub = F.instr(F.decode(F.substring("content", 1, 15), "ISO-8859-1"), "<!DOCTYPE") > 0
    return files.withColumn("magic", F.decode(head, "ISO-8859-1")).withColumn("packed", head == F.lit(b"XFIR")).withColumn("codec", kind).withColumn("stub", stub)


CHUNKS = "file string, ordinal int, path string, tag string, res_id long, offset long, declared long, is_list boolean, layout string, version long, data binary, error string"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}


def _parts(text: str, at: str) -> list[str]:
    """Splits at a character outside brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == at and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


def _arrow(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1].strip()))
    if kind.startswith("struct<"):
        return pa.struct([(n.strip(), _arrow(k.strip())) for n, k in (f.split(":", 1) for f in _parts(kind[7:-1], ","))])
    return _ARROW[kind]


@lru_cache
def arrow_schema(schema: str) -> pa.Schema:
    """A schema as Spark writes it, of simple types, arrays and structs. Tasks need it, which have no session."""
    return pa.schema([(n, _arrow(k.strip())) for n, k in (f.split(" ", 1) for f in _parts(schema, ","))])


def arrow_rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows of tuples as a batch."""
    want = arrow_schema(schema)
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in want]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, want, strict=True)], schema=want)


def chunks(files: DataFrame) -> DataFrame:
    """All chunks of all files, in order within a file; a file that can't be read gives one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for name, content in zip(x.column(0).to_pylist(), x.column(1), strict=True):
                rows, held = [], 0
                for row in _file_rows(name, content.as_py()):
                    rows.append(row)
                    held += len(row[10] or b"")
                    if held > BATCH_BYTES:
                        yield arrow_rows(rows, CHUNKS)
                        rows, held = [], 0
                yield arrow_rows(rows, CHUNKS)

    return files.select("file", "content").mapInArrow(run, CHUNKS)


def _file_rows(name: str, content: bytes) -> Iterator[tuple]:
    none = (None,) * 8
    if b"<!DOCTYPE" in content[:15]:
        yield (name, 0, None, *none, "skip: a stub of HTML")
        return
    try:
        f = container.decode(content)
    except container.Broken as e:
        yield (name, 0, None, *none, f"{e.kind}: {e}")
        return
    version = f.header.version if f.header else None
    members = 0
    for i, c in enumerate(f.chunks):
        path = ".".join(map(str, c.path)) if c.path else str(i)
        if c.tag == b"CASt" and len(c.path) in (0, 2):
            c.res_id = members if c.res_id is None else c.res_id  # plain frames have no ids; a member's is its place
            members += 1
        yield (name, i, path, c.tag.decode("latin-1"), c.res_id, c.offset, c.declared, c.is_list, f.layout, version, c.data, c.error)


def decoded(of: DataFrame, tags: tuple[str, ...], schema: str, rows: Callable[[str, bytes], list[tuple]]) -> DataFrame:
    """Rows that ``rows(tag, data)`` makes of each chunk with one of ``tags``, after file, ordinal, res_id and pos.

    A chunk that can't be decoded gives one row of nulls with its error.
    """
    full = f"file string, ordinal int, res_id long, pos int, {schema}, error string"
    width = len(arrow_schema(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out = []
            for i in range(x.num_rows):
                name, ordinal, res_id, tag, data = (c[i].as_py() for c in x.columns)
                try:
                    made = [(*r, None) for r in rows(tag, data)]
                except (ValueError, IndexError, struct.error) as e:
                    made = [((None,) * width) + (f"{type(e).__name__}: {e}",)]
                out += [(name, ordinal, res_id, k, *r) for k, r in enumerate(made)]
            yield arrow_rows(out, full)

    picked = of.where(F.col("tag").isin(*tags) & F.col("data").isNotNull()).select("file", "ordinal", "res_id", "tag", "data")
    return picked.mapInArrow(run, full)


def links(of: DataFrame) -> DataFrame:
    """Link rows: child, parent, tag, layout."""

    def rows(tag: str, data: bytes) -> list[tuple]:
        layout, found = records.links(data)
        return [(child, parent, t.decode("latin-1"), layout) for child, parent, t in found]

    return decoded(of, ("KEY*",), "child long, parent long, link_tag string, layout string", rows)


def member_list(of: DataFrame) -> DataFrame:
    """(file, list_no, pos, member_res) of lists of members, natively; 0 is an empty slot."""
    lists = of.where("tag = 'CAS*' and data is not null")
    return lists.select("file", F.col("ordinal").alias("list_no"), F.posexplode(B.numbers(F.col("data"), 4)).alias("pos", "member_res"))


def members(of: DataFrame) -> DataFrame:
    """Members: kind, its code, layout, name, script id, info and specific bytes, embedded tags."""
    def rows(tag: str, data: bytes) -> list[tuple]:
        m = records.member(data)
        return [(m["kind"], m["kind_code"], m["layout"], records.member_name(m["info"]), records.script_id(m["info"]), m["info"], m["spec"], m["child_tags"], data)]

    return decoded(of, ("CASt",), "kind string, kind_code int, layout string, name string, script_id long, info binary, spec binary, child_tags array<string>, raw binary", rows)


def libraries(of: DataFrame) -> DataFrame:
    schema = "id int, name string, path string, min_member long, max_member long, member_count long"
    return decoded(of, ("MCsL",), schema, lambda _, data: [tuple(r.values()) for r in records.libraries(data)])


def palettes(of: DataFrame) -> DataFrame:
    return decoded(of, ("CLUT",), "colors array<struct<r: int, g: int, b: int>>", lambda _, data: [([dict(zip("rgb", c, strict=True)) for c in records.palette(data)],)])


def texts(of: DataFrame, roman: bool = False) -> DataFrame:
    run = "start long, height int, ascent int, font_id int, slant int, size int, r int, g int, b int"
    schema = f"text string, runs array<struct<{', '.join(x.replace(' ', ': ') for x in run.split(', '))}>>"
    return decoded(of, ("STXT",), schema, lambda _, data: [tuple(records.styled_text(data, roman=roman).values())])


def sounds(of: DataFrame) -> DataFrame:
    schema = "format string, data_size long, sample_rate long, sample_size int, channels int, looping boolean, loop_start long, loop_end long, start int"
    return decoded(of, ("snd ", "SND ", "ediM"), schema, lambda tag, data: [tuple(records.sound(tag.encode("latin-1"), data).values())])


def bitmaps(of: DataFrame) -> DataFrame:
    """Bitmap records of members, by member; old members have their pixels with them, ``inline``."""
    def rows(tag: str, data: bytes) -> list[tuple]:
        m = records.member(data)
        if m["kind"] not in ("bitmap", "picture"):
            return []
        if m["old"]:
            found = records.inline_bitmap(data)
            return [(*found[0].values(), found[1])] if found else []
        return [(*records.bitmap_info(m["spec"]).values(), None)]

    return decoded(of, ("CASt",), "width int, height int, bpp int, pitch int, palette_id int, has_palette boolean, reg_x int, reg_y int, inline binary", rows)


def shapes(of: DataFrame) -> DataFrame:
    def rows(tag: str, data: bytes) -> list[tuple]:
        m = records.member(data)
        made = records.shape(data if m["old"] else m["spec"]) if m["kind"] == "shape" else None
        return [tuple(made.values())] if made else []

    schema = "shape string, reg_y int, reg_x int, height int, width int, color int, back int, fill int, thickness int, direction int, filled boolean, outline_invisible boolean"
    return decoded(of, ("CASt",), schema, rows)


def script_contexts(of: DataFrame) -> DataFrame:
    return decoded(of, ("LctX", "Lctx"), "section_id long, flags int", lambda _, data: records.script_context(data))


def script_names(of: DataFrame) -> DataFrame:
    return decoded(of, ("Lnam",), "name string", lambda _, data: [(n,) for n in records.script_names(data)])


def memory_map(of: DataFrame) -> DataFrame:
    rows = lambda _, data: [(t.decode("latin-1"), a, n) for t, a, n in container.listing(data)]
    return decoded(of, ("mmap",), "entry_tag string, address long, length long", rows)


def font_map(of: DataFrame) -> DataFrame:
    return decoded(of, ("Fmap",), "font_id int, platform int, font_name string", lambda _, data: records.font_map(data))


def configs(of: DataFrame) -> DataFrame:
    """One row per config chunk, natively: version, the first member number, stage rectangle and colour."""
    d = F.col("data")
    own = of.where("tag in ('DRCF', 'VWCF') and data is not null")
    rect = F.struct(*[B.signed(d, 4 + 2 * i, 2).alias(n) for i, n in enumerate(("top", "left", "bottom", "right"))])
    return own.select("file", "ordinal", B.unsigned(d, 36, 2).alias("version"), F.coalesce(B.unsigned(d, 12, 2), F.lit(1)).alias("min_member"), B.unsigned(d, 14, 2).alias("max_member"), rect.alias("stage"))
