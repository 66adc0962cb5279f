"""Scripts of files: their members linked to bytecode and names, written as text and listings."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions import bytecode
from chunkloom.functions import bytes as B
from chunkloom.operators import resolve

OUTPUT = "file string, rel_path string, content binary, error string"


def instructions(of: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """One row per instruction: script, handler and its name id, place, operation, code and argument.

    Scripts of files that have none of ``contexts`` (a file column) have the narrower rows of handlers.
    """
    from chunkloom.sources import files

    def listed(scripts: DataFrame, wide: bool) -> DataFrame:
        def rows(tag: str, data: bytes) -> list[tuple]:
            s = bytecode.script(data, wide)
            return [(k, h.name_id, x.at, x.op, x.raw, x.arg) for k, h in enumerate(s.handlers) for x in h.code]

        return files.decoded(scripts, ("Lscr",), "handler int, name_id int, pc int, op string, raw_op int, arg long", rows)

    if contexts is None:
        return listed(of, True)
    having = contexts.select("file").distinct()
    return listed(of.join(having, "file", "left_semi"), True).unionByName(listed(of.join(having, "file", "left_anti"), False))


def literals(of: DataFrame) -> DataFrame:
    """One row per literal: its kind and its value as the type it has."""
    from chunkloom.sources import files

    def rows(tag: str, data: bytes) -> list[tuple]:
        pick = lambda v, kind: v if isinstance(v, kind) else None
        return [(k, pick(v, int), pick(v, float), pick(v, str), pick(v, bytes)) for k, v in bytecode.script(data).literals]

    return files.decoded(of, ("Lscr",), "kind int, int_value long, float_value double, string_value string, bytes_value binary", rows)


def kinds(project) -> DataFrame:
    """(file, script_res, kind): the kind of the member a script is linked to, else of the first member that names it
    by script id, else of the script itself."""
    from chunkloom.sources import files

    def rows(tag: str, data: bytes) -> list[tuple]:
        return [(bytecode.script(data).kind,)]

    own = files.decoded(project.of("Lscr"), ("Lscr",), "kind string", rows).where("error is null")
    own = own.groupBy("file", F.col("res_id").alias("script_res")).agg(F.min_by("kind", "ordinal").alias("own"))
    member = project.members.where("error is null").withColumn("as", _kind_of(F.col("spec")))
    by_link = project.links.where("link_tag = 'Lscr' and error is null").select("file", F.col("child").alias("script_res"), F.col("parent").alias("res_id"), F.struct("ordinal", "pos").alias("at"))
    by_link = by_link.join(member.select("file", "res_id", "as"), ["file", "res_id"]).groupBy("file", "script_res").agg(F.min_by("as", "at").alias("linked"))
    by_id = resolve.scripts(project.members.where("error is null"), files.script_contexts(project.of("LctX", "Lctx")).where("error is null"))
    by_id = by_id.join(member.select("file", "res_id", "ordinal", "as"), ["file", "res_id"]).groupBy("file", "script_res").agg(F.min_by("as", "ordinal").alias("named"))
    out = own.join(by_link, ["file", "script_res"], "left").join(by_id, ["file", "script_res"], "left")
    return out.select("file", "script_res", F.coalesce("linked", "named", "own").alias("kind"))


def _kind_of(spec):
    """The kind that a script member's own record tells; null where it has none."""
    code = B.unsigned(spec, 0, 2)
    return F.element_at(F.create_map(*[F.lit(x) for kv in bytecode.TYPES.items() for x in kv]), code.cast("int"))


def linked(project) -> DataFrame:
    """(file, res_id, base, script data, names, version) of members with a script; data is null if it isn't there."""
    from chunkloom.sources import files

    found = resolve.scripts(project.members.where("error is null"), files.script_contexts(project.of("LctX", "Lctx")).where("error is null"))
    codes = project.of("Lscr").groupBy("file", F.col("res_id").alias("script_res")).agg(F.min_by("data", "ordinal").alias("data"))
    first = Window.partitionBy("file")
    names = files.script_names(project.of("Lnam")).where("error is null").withColumn("first", F.min("ordinal").over(first)).where("ordinal = first")
    names = names.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", "name")))["name"].alias("names"))  # a file's table
    version = project.configs.groupBy("file").agg(F.min_by("version", "ordinal").alias("version"))
    out = found.join(codes, ["file", "script_res"], "left").join(names, "file", "left").join(version, "file", "left")
    return project._named(out)


def written(project, listed: bool = True) -> DataFrame:
    """Each script as text (.ls) and, if ``listed``, as a listing (.lasm)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from chunkloom.sources import files

        for x in batches:
            rows = []
            for file, base, data, names, version, name, kind in zip(*(c.to_pylist() for c in x.columns), strict=True):
                try:
                    if data is None:
                        raise ValueError("no script chunk")
                    s = bytecode.script(data)
                    head = f"-- Cast member: {name or ''}\n-- Type: {kind or s.kind}\n\n"
                    rows.append((file, f"{base}.ls", (head + bytecode.text_of(s, names or [], version or 0)).encode(), None))
                    if listed:
                        rows.append((file, f"{base}.lasm", bytecode.listing(s, names or []).encode(), None))
                except (ValueError, struct.error) as e:
                    rows.append((file, f"{base}.ls", None, f"{type(e).__name__}: {e}"))
            yield files.arrow_rows(rows, OUTPUT)

    found = linked(project).join(kinds(project), ["file", "script_res"], "left")
    return found.select("file", "base", "data", "names", F.col("version").cast("int"), "who.name", "kind").mapInArrow(run, OUTPUT)
