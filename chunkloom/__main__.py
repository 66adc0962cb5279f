"""Command line: ``python -m chunkloom INPUT OUTPUT``, of one file or of a folder of files."""

from __future__ import annotations

import argparse
import os
import re
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.operators.written import folder as shared_folder
from chunkloom.plans import ship
from chunkloom.plans.project import Project
from chunkloom.sources import files, sinks

ROWS = 50  # of a list that is shown


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="chunkloom", description="Decodes containers of tagged chunks and writes their members as files.")
    p.add_argument("input", help="a file, or a folder searched with all below it")
    p.add_argument("output", help="folder for the files written")
    p.add_argument("-m", "--memory", action="store_true", help="show the whole memory map")
    p.add_argument("-t", "--tree", action="store_true", help="show the chunks and stop")
    p.add_argument("-o", "--out", metavar="FOLDER", help="also write inputs as plain frames there")
    p.add_argument("--palettes", action="store_true", help="show how the palettes of bitmaps were found")
    p.add_argument("-c", "--compress-out", metavar="FOLDER", help="write inputs again in their own layout there, and stop")
    p.add_argument("-j", "--threads", type=int, default=1, help="threads, where no master is set")
    p.add_argument("--lasm", action="store_true", help="also write listings of instructions")
    return p.parse_args(given)


def _show(title: str, df: DataFrame, rows: int = ROWS) -> None:
    print(f"=== {title} ===")
    df.show(rows, truncate=False)


def main(given: list[str] | None = None) -> int:
    a = arguments(given)
    if not os.path.exists(a.input):
        print(f"Error: file not found: {a.input}")
        return 1
    own = SparkSession.getActiveSession() is None
    master = f"local[{max(1, a.threads)}]"
    builder = SparkSession.builder.appName("chunkloom")
    spark = (builder if os.environ.get("MASTER") or "spark.master" in os.environ.get("PYSPARK_SUBMIT_ARGS", "") else builder.master(master)).getOrCreate() if own else SparkSession.getActiveSession()
    ship.ship(spark, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    try:
        return _run(spark, a)
    finally:
        if own:
            spark.stop()


def _run(spark: SparkSession, a: argparse.Namespace) -> int:
    top, glob = os.path.abspath(a.input), files.EXTENSIONS
    single = os.path.isfile(top)
    if single:
        top, name = os.path.split(top)
        glob = re.sub(r"([\\*?\[\]{},])", r"\\\1", name)
    scanned = files.scan(spark, top, glob)
    if single:
        scanned = scanned.where(F.col("file") == name)  # the search goes below the folder, too
        _show("file", files.sniffed(scanned).select("file", "length", "packed", "codec"))
    for where, how in ((a.out, "plain"), (a.compress_out, "rewritten")):
        if where:
            again = sinks.files_again(scanned, how)
            failed = again.where("error is not null").select("file", "error")
            sinks.write_blobs(again, os.path.abspath(where))
            if failed.limit(1).count():
                _show(f"not {how}", failed)
                if single:
                    return 1
    if a.compress_out:
        return 0
    work = f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}"
    try:
        project = Project(spark, top, work, glob, only=name if single else None)
        seen = project.inspect(1 << 30 if a.memory else ROWS)
        if single or a.tree:
            _show("tree", seen.pop("tree"), 1 << 20)
        if not a.tree:
            for title, df in (seen if single else {}).items():
                _show(title, df, 1 << 20 if a.memory and title == "map" else ROWS)
            if a.palettes:
                _show("palettes", project.report(), 1 << 20)
            sinks.write_blobs(project.outputs(a.lasm), os.path.abspath(a.output))
        got = project.outcome().first()
        print(f"ok={got.ok} skip={got.skip} fail={got.fail} files={got.files}")
        return 1 if single and got.fail else 0
    finally:
        if "://" not in work:
            shutil.rmtree(work, ignore_errors=True)


if __name__ == "__main__":
    raise SystemExit(main())
