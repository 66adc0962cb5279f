"""Links between the tables of a file: numbers of members, their parts, their colours, texts and sounds.

Every table has a column ``file``, and every join is an equality on it and an id, number or position; windows are
partitioned by file. Sides that are small are broadcast by Spark's own measure, larger ones are shuffled by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions import records
from chunkloom.operators import links

#: Parts of members by the group they are linked as; sounds by priority.
GROUPS = {"BITD": "bitmap", "CLUT": "palette", "STXT": "text", "XMED": "font", "snd ": "sound", "SND ": "sound", "ediM": "sound"}
SOUND_TAGS = ("snd ", "SND ", "ediM", "sndS", "sndH")
DRAWN = ("bitmap", "picture")


def numbered(member_list: DataFrame, configs: DataFrame) -> DataFrame:
    """(file, number, res_id): the first member's number plus the place in the list; a later list wins."""
    first = links.first_of(configs, ["file"], "ordinal", "min_member")
    slots = member_list.where("member_res <> 0").join(first, "file", "left")
    slots = slots.withColumn("number", F.coalesce("min_member", F.lit(1)) + F.col("pos"))
    return slots.groupBy("file", "number").agg(F.max_by("member_res", F.struct("list_no", "pos")).alias("res_id"))


def with_numbers(members: DataFrame, numbers: DataFrame) -> DataFrame:
    """Adds each member's number, the least one that names it, else its place among the members from 1."""
    own = numbers.groupBy("file", "res_id").agg(F.min("number").alias("named"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("ordinal"))
    return members.withColumn("place", place.cast("long")).join(own, ["file", "res_id"], "left").withColumn("number", F.coalesce("named", "place")).drop("named")


def parts(link_rows: DataFrame) -> DataFrame:
    """(file, parent, part, child): of links of one group to one parent the last."""
    group = F.element_at(F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv]), F.col("link_tag"))
    named = link_rows.where(F.col("link_tag").isin(*GROUPS)).withColumn("part", group)
    return named.groupBy("file", "parent", "part").agg(F.max_by("child", F.struct("ordinal", "pos")).alias("child"))


def of_part(part_rows: DataFrame, part: str, name: str) -> DataFrame:
    return part_rows.where(F.col("part") == part).select("file", F.col("parent").alias("res_id"), F.col("child").alias(name))


def colours(bitmaps: DataFrame, numbers: DataFrame, part_rows: DataFrame, palettes: DataFrame, members: DataFrame) -> DataFrame:
    """Adds ``colors`` and ``step`` to bitmaps(file, res_id, palette_id): four probes, the first hit wins.

    1 the member of that number; 2 the member of resource id - 1; 3 the colour table of resource id - 1, else id;
    4 the palette member at place id - 1; each member by its link to a table. Ids of 0 or less name built-in palettes
    (step 0). Black slots near the end take the system palette's colours.
    """
    table = links.first_of(palettes.where("error is null"), ["file", "res_id"], "ordinal", "colors")
    by_member = of_part(part_rows, "palette", "clut").join(table.withColumnRenamed("res_id", "clut"), ["file", "clut"]).select("file", "res_id", "colors")
    by_number = numbers.join(by_member, ["file", "res_id"]).select("file", F.col("number").alias("k"), F.col("colors").alias("c1"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("ordinal"))
    nth = members.where("kind = 'palette'").withColumn("k", place.cast("long")).join(by_member, ["file", "res_id"]).select("file", "k", F.col("colors").alias("c4"))
    tables = table.select("file", F.col("res_id").alias("k"), "colors")
    before = F.col("palette_id") - 1
    probes = [
        (by_number, F.col("palette_id"), "c1"),
        (by_member.select("file", F.col("res_id").alias("k"), F.col("colors").alias("c2")), before, "c2"),
        (tables.withColumnRenamed("colors", "c3"), before, "c3"),
        (tables.withColumnRenamed("colors", "c3b"), F.col("palette_id"), "c3b"),
        (nth, F.col("palette_id"), "c4"),
    ]
    df, hits = bitmaps, []
    for side, key, name in probes:
        side = side.withColumnRenamed("file", "__f").withColumnRenamed("k", "__k")
        df = df.join(side, (F.col("file") == F.col("__f")) & (key.cast("long") == F.col("__k")) & (key > 0), "left").drop("__f", "__k")
        hits.append(name)
    step = F.when(F.col("palette_id") <= 0, 0)
    for i, name in zip((1, 2, 3, 3, 4), hits, strict=True):
        step = step.when(F.col(name).isNotNull(), i)
    system = built_in(-1)
    filled = F.transform(F.coalesce(*hits), lambda c, i: F.when((i >= 246) & (i <= 254) & (c["r"] + c["g"] + c["b"] == 0), F.get(system, i)).otherwise(c))
    own = F.when(F.col("palette_id") == 0, system).when(F.col("palette_id") == -2, built_in(-3))
    return df.withColumn("step", step).withColumn("colors", F.when(F.col("palette_id") > 0, filled).otherwise(own)).drop(*hits)


def built_in(number: int) -> Column:
    """A built-in palette as a literal."""
    kind = "array<struct<r:int,g:int,b:int>>"
    text = "[" + ",".join(f'{{"r":{r},"g":{g},"b":{b}}}' for r, g, b in records.builtin_palette(number)) + "]"
    return F.from_json(F.lit(text), kind)


def histograms(codes: DataFrame) -> DataFrame:
    """(file, palette_id, idx, n): how often bitmaps of a palette use a colour, from codes(file, palette_id, bins)."""
    bins = codes.select("file", "palette_id", F.posexplode("bins").alias("idx", "n")).where("n > 0")
    return bins.groupBy("file", "palette_id", "idx").agg(F.sum("n").alias("n"))


def closest(hist: DataFrame, palettes: DataFrame) -> DataFrame:
    """(file, palette_id, colors): for palettes that no probe finds, the file's table that colours most pixels other
    than black; ties go to the least squared distance from the system palette, then to the first table. It has to
    cover half of all pixels. A colour without an index counts as the furthest there is.
    """
    order = F.row_number().over(Window.partitionBy("file").orderBy("ordinal"))
    tables = palettes.where("error is null").withColumn("ci", order)
    system = built_in(-1)
    slots = tables.select("file", "ci", F.posexplode(F.arrays_zip(F.col("colors").alias("c"), system.alias("s"))).alias("idx", "x"))
    far = sum(((F.col(f"x.c.{c}") - F.col(f"x.s.{c}")) ** 2 for c in "rgb"), F.lit(0.0)).cast("long")
    slots = slots.select("file", "ci", "idx", (F.col("x.c.r") + F.col("x.c.g") + F.col("x.c.b") > 0).alias("lit"), far.alias("far"))
    met = hist.join(slots, ["file", "idx"], "left")
    sums = met.groupBy("file", "palette_id", "ci").agg(F.sum(F.when(F.col("lit"), F.col("n")).otherwise(0)).alias("covered"), F.sum(F.coalesce("far", F.lit(195075)) * F.col("n")).alias("dist"))
    best = sums.where("ci is not null").groupBy("file", "palette_id").agg(F.max_by(F.struct("ci", "covered"), F.struct("covered", -F.col("dist"), -F.col("ci"))).alias("b"))
    total = hist.groupBy("file", "palette_id").agg(F.sum("n").alias("total"))
    won = best.join(total, ["file", "palette_id"]).where("total > 0 and b.covered * 2 >= total").select("file", "palette_id", F.col("b.ci").alias("ci"))
    return won.join(tables.select("file", "ci", "colors"), ["file", "ci"]).select("file", "palette_id", "colors")


def texts(members: DataFrame, part_rows: DataFrame, texts_: DataFrame) -> DataFrame:
    """(file, res_id, text) of text members: the linked text, else the one at the same place among texts."""
    place = F.row_number().over(Window.partitionBy("file").orderBy("ordinal"))
    ours = members.where("kind in ('text', 'button')").withColumn("nth", place).join(of_part(part_rows, "text", "child"), ["file", "res_id"], "left")
    linked = links.first_of(texts_.where("error is null"), ["file", "res_id"], "ordinal", "text").select("file", F.col("res_id").alias("child"), F.col("text").alias("t1"))
    nth = texts_.where("error is null").withColumn("nth", place).select("file", "nth", F.col("text").alias("t2"))
    return ours.join(linked, ["file", "child"], "left").join(nth, ["file", "nth"], "left").select("file", "res_id", F.coalesce("t1", "t2").alias("text"))


def sounds(members: DataFrame, part_rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file, res_id, tag, data) of sound members: the linked chunk, else the file's first by priority of tags."""
    rank = F.array_position(F.array(*map(F.lit, SOUND_TAGS)), F.col("tag"))
    all_ = chunks.where(F.col("tag").isin(*SOUND_TAGS) & (F.length("data") > 0)).select("file", "ordinal", F.col("res_id").alias("child"), "tag", "data", rank.alias("rank"))
    first = all_.groupBy("file").agg(F.min_by(F.struct("tag", "data"), F.struct("rank", "ordinal")).alias("d"))
    ours = members.where("kind = 'sound'").select("file", "res_id").join(of_part(part_rows, "sound", "child"), ["file", "res_id"], "left")
    linked = links.first_of(all_, ["file", "child"], "ordinal", "tag", "data")
    out = ours.join(linked, ["file", "child"], "left").join(first, "file", "left")
    return out.select("file", "res_id", F.coalesce("tag", "d.tag").alias("tag"), F.coalesce("data", "d.data").alias("data")).where("data is not null")


def scripts(members: DataFrame, contexts: DataFrame) -> DataFrame:
    """(file, res_id, script_res) of members with a script: place script id - 1 of the first script context."""
    first = contexts.withColumn("first", F.min("ordinal").over(Window.partitionBy("file"))).where("ordinal = first and section_id > 0")
    ours = members.where("kind = 'script' and script_id > 0").select("file", "res_id", (F.col("script_id") - 1).cast("int").alias("pos"))
    return ours.join(first.select("file", "pos", F.col("section_id").alias("script_res")), ["file", "pos"]).drop("pos")
