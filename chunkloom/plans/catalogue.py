"""Relational queries over Parquet tables, each with its SQL: the dataflow patterns of the format engine by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.functions import text
from chunkloom.operators import groups, links, ordered
from chunkloom.sources import container, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a function of tables as a query with its SQL."""

    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__], SQL[f.__name__] = run, sql
        return run

    return add


def fallback_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["fallback_chain"](spark, sf_dir).groupBy("step").agg(F.count("*").alias("n")).orderBy("step")


# --- scans, filters, dispatch -------------------------------------------------------------------------------------


@query("SELECT page_id, position('<!DOCTYPE' IN substr(html, 1, 15)) > 0 AS stub FROM pages")
def sniff_filter(t):
    """Which pages begin with the marker of an HTML stub."""
    return t("pages").select("page_id", (F.instr(F.substring("html", 1, 15), "<!DOCTYPE") > 0).alias("stub"))


@query("SELECT page_id, lower(regexp_extract(regexp_extract(url, '^([^?]*)', 1), '([^/]*)$', 1)) AS tail FROM pages")
def path_extension_scan(t):
    return t("pages").select("page_id", text.extension(F.col("url")).alias("tail"))


@query("SELECT event_type, min(event_id) AS first_id, count(*) AS n FROM events GROUP BY event_type")
def tag_filter_first(t):
    return t("events").groupBy("event_type").agg(F.min("event_id").alias("first_id"), F.count("*").alias("n"))


@query(
    """SELECT CASE event_type WHEN 'view' THEN 'bitmaps' WHEN 'click' THEN 'sounds' WHEN 'purchase' THEN 'scripts' ELSE 'other' END AS folder,
              count(*) AS n FROM events GROUP BY 1"""
)
def kind_dispatch(t):
    kind = F.col("event_type")
    folder = F.when(kind == "view", "bitmaps").when(kind == "click", "sounds").when(kind == "purchase", "scripts").otherwise("other")
    return t("events").groupBy(folder.alias("folder")).agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (event_type = 'error') AS fail, count(*) FILTER (event_type = 'view') AS skip, count(*) FILTER (event_type NOT IN ('error', 'view')) AS ok, count(*) AS files FROM events")
def outcome_counts(t):
    kind = F.col("event_type")
    return t("events").agg(
        F.count_if(kind == "error").alias("fail"),
        F.count_if(kind == "view").alias("skip"),
        F.count_if(~kind.isin("error", "view")).alias("ok"),
        F.count("*").alias("files"),
    )


# --- links and fallbacks ------------------------------------------------------------------------------------------


@query(
    """SELECT c_custkey, event_type, event_id FROM customer LEFT JOIN
       (SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id) ON c_custkey = user_id"""
)
def link_last_wins(t):
    last = t("events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"))
    return t("customer").join(last, F.col("c_custkey") == F.col("user_id"), "left").select("c_custkey", "event_type", "event_id")


@query("SELECT user_id, arg_min(event_type, event_id) AS et FROM events GROUP BY user_id")
def link_first_wins(t):
    return links.first_of(t("events"), ["user_id"], "event_id", "event_type").withColumnRenamed("event_type", "et")


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) + 99 AS num FROM conversations")
def ordinal_number_map(t):
    placed = ordered.positions(t("conversations").select("conv_id", "turn"), ["conv_id", "turn"], "pos")
    return placed.select("conv_id", "turn", (F.col("pos") + 99).alias("num"))


@query(
    """SELECT d.doc_id, CAST(coalesce(a.quality, b.quality, c.quality, -1) AS INTEGER) AS q,
              CASE WHEN a.quality IS NOT NULL THEN 1 WHEN b.quality IS NOT NULL THEN 2 WHEN c.quality IS NOT NULL THEN 3 ELSE 4 END AS step
       FROM documents d LEFT JOIN labels a ON a.doc_id = d.doc_id LEFT JOIN labels b ON b.doc_id = d.doc_id - 1 LEFT JOIN labels c ON c.doc_id = d.doc_id + 1"""
)
def fallback_chain(t):
    """Three probes of a table of links, the first hit wins."""
    table = t("labels").where("quality is not null").select(F.col("doc_id").alias("k"), F.col("quality").alias("v"))
    probes = [(table, F.col("doc_id") + d) for d in (0, -1, 1)]
    out = links.fallback_chain(t("documents").select("doc_id"), probes, "q", "step")
    return out.withColumn("q", F.coalesce("q", F.lit(-1)))


@query(
    """SELECT d.doc_id, l.doc_id AS lid, l.quality FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p FROM documents) d
       LEFT JOIN (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) AS p FROM labels) l USING (p)"""
)
def positional_zip(t):
    a = ordered.positions(t("documents").select("doc_id"), ["doc_id"])
    b = ordered.positions(t("labels").select("doc_id", "quality"), ["doc_id"]).select("pos", F.col("doc_id").alias("lid"), "quality")
    return a.join(b, "pos", "left").select("doc_id", "lid", "quality")


@query(
    """SELECT event_id, coalesce(c_custkey, (SELECT min(c_custkey) FROM customer)) AS k
       FROM events LEFT JOIN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) ON c_custkey = user_id"""
)
def cross_default(t):
    """A linked row, or one default for all that have none; the default is a single row."""
    default = t("customer").agg(F.min("c_custkey").alias("k0"))
    linked = t("customer").where("c_nationkey < 5").select("c_custkey")
    out = t("events").select("event_id", "user_id").join(linked, F.col("c_custkey") == F.col("user_id"), "left")
    return out.join(F.broadcast(default), F.lit(True), "left").select("event_id", F.coalesce("c_custkey", "k0").alias("k"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_join(t):
    return t("documents").select("doc_id").join(t("labels").where("toxic = 1"), "doc_id", "left_semi")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join(t):
    return t("documents").select("doc_id").join(t("labels"), "doc_id", "left_anti")


@query(
    """SELECT event_id AS k, min(CASE WHEN event_type = 'purchase' THEN event_id END)
              OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM events"""
)
def forward_asof(t):
    nxt = links.next_of(t("events"), "user_id", "event_id", F.col("event_type") == "purchase")
    return t("events").select(F.col("event_id").alias("k"), nxt.alias("nxt"))


@query(
    """SELECT user_id, arg_min(event_id, pr * 1000000000000 + event_id) AS event_id, CAST(min(pr) AS INTEGER) AS pr FROM
       (SELECT user_id, event_id, 1 AS pr FROM events WHERE event_type = 'purchase' UNION ALL
        SELECT user_id, event_id, 2 FROM events WHERE event_type = 'click') GROUP BY user_id"""
)
def priority_union(t):
    of = lambda kind: t("events").where(F.col("event_type") == kind).select("user_id", "event_id")
    return links.by_priority([of("purchase"), of("click")], ["user_id"], "event_id")


@query(
    """WITH a AS (SELECT l_orderkey AS k, l_linenumber AS v FROM lineitem WHERE l_discount > 0.09)
       SELECT k, v FROM a UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderkey NOT IN (SELECT k FROM a)"""
)
def if_empty_else(t):
    a = t("lineitem").where("l_discount > 0.09").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("v"))
    return links.else_rows(a, t("orders").select(F.col("o_orderkey").alias("k"), F.lit(0).alias("v")), ["k"])


@query("SELECT event_id, coalesce(n_name, '#' || user_id) AS nm FROM events LEFT JOIN nation ON n_nationkey = user_id")
def dim_lookup_default(t):
    return links.named(t("events"), "user_id", t("nation"), "n_nationkey", "n_name", "nm").select("event_id", "nm")


# --- grouped aggregates -------------------------------------------------------------------------------------------

_BIN = "CAST(floor((CAST(v AS DOUBLE) + 1) * 8) AS BIGINT)"


def _bin(x):
    return F.floor((x.cast("double") + 1) * 8)


@query(f"SELECT label, {_BIN} AS bin, count(*) AS n FROM (SELECT label, unnest(embedding) AS v FROM embeddings) GROUP BY 1, 2")
def index_histogram(t):
    return groups.histogram(t("embeddings"), ["label"], "embedding", _bin)


@query(
    f"""WITH h AS (SELECT label AS pid, {_BIN} AS bin, count(*) AS n FROM (SELECT label, unnest(embedding) AS v FROM embeddings) GROUP BY 1, 2),
        s AS (SELECT pid, n_nationkey AS ci, sum(CASE WHEN (7 * n_nationkey + 13 * bin) % 5 <> 0 THEN n ELSE 0 END) AS covered,
                     sum(((7 * n_nationkey + 13 * bin) % 5 - 2) * ((7 * n_nationkey + 13 * bin) % 5 - 2) * n) AS dist, sum(n) AS total
              FROM h, nation GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY covered DESC, dist, ci) AS rn FROM s)
        SELECT pid, ci, CAST(covered AS BIGINT) AS covered, CAST(dist AS BIGINT) AS dist, CAST(total AS BIGINT) AS total FROM r WHERE rn = 1 AND covered * 2 >= total"""
)
def coverage_argmax(t):
    counts = groups.histogram(t("embeddings"), ["label"], "embedding", _bin).withColumnRenamed("label", "pid")
    bins = counts.select("bin").distinct().withColumn("one", F.lit(1))
    ci = t("nation").select(F.col("n_nationkey").alias("ci"), F.lit(1).alias("one"))
    colours = bins.join(ci, "one").select("ci", "bin", ((7 * F.col("ci") + 13 * F.col("bin")) % 5).alias("colour"))
    return groups.best_cover(counts, colours, "pid", 0, 2)


@query(
    f"""SELECT vec_id, count(DISTINCT {_BIN}) AS d, CAST(count(*) FILTER ({_BIN} < 7) AS DOUBLE) / count(*) AS f
        FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings) GROUP BY vec_id"""
)
def quantised_distinct(t):
    bins = F.transform("embedding", _bin)
    low = F.size(F.filter(bins, lambda b: b < 7)).cast("double")
    return t("embeddings").select("vec_id", F.size(F.array_distinct(bins)).cast("long").alias("d"), (low / F.size("embedding")).alias("f"))


@query("SELECT text, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY text")
def first_seen_distinct(t):
    return t("documents").groupBy("text").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


@query("SELECT conv_id, turn // 2 AS g, max(CASE WHEN turn % 2 = 0 THEN text END) AS a, max(CASE WHEN turn % 2 = 1 THEN text END) AS b FROM conversations GROUP BY 1, 2")
def strided_pivot(t):
    return groups.strided(t("conversations"), ["conv_id"], "turn", "text", ["a", "b"])


@query("SELECT o_orderpriority AS p, min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderdate) AS d0, max(o_orderdate) AS d1 FROM orders GROUP BY 1")
def bbox(t):
    price, day = "o_totalprice", "o_orderdate"
    return t("orders").groupBy(F.col("o_orderpriority").alias("p")).agg(F.min(price).alias("lo"), F.max(price).alias("hi"), F.min(day).alias("d0"), F.max(day).alias("d1"))


@query("SELECT l_returnflag AS f, CAST(sum(l_partkey * 65599 + l_suppkey) & 4294967295 AS BIGINT) AS s FROM (SELECT l_returnflag, CAST(l_partkey AS HUGEINT) AS l_partkey, l_suppkey FROM lineitem) GROUP BY 1")
def wrap_checksum(t):
    return groups.checksum32(t("lineitem").withColumnRenamed("l_returnflag", "f"), "f", F.col("l_partkey") * 65599 + F.col("l_suppkey"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS s FROM conversations GROUP BY conv_id")
def ordered_listagg(t):
    return t("conversations").groupBy("conv_id").agg(F.expr("listagg(role, ',') within group (order by turn)").alias("s"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 3")
def topk_capped(t):
    return links.top(t("events").select("user_id", "event_id", "value"), "user_id", [F.desc("value"), F.asc("event_id")], 3)


# --- order-dependent ----------------------------------------------------------------------------------------------


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, coalesce(sum(l_quantity) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM lineitem"""
)
def running_offset(t):
    """Where each item starts if all are laid end to end."""
    by = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = t("lineitem").select(*by, "l_quantity")
    return ordered.running_sum(rows, by, F.col("l_quantity"), "off").select("l_orderkey", "l_linenumber", "l_partkey", F.col("off").cast("double").alias("off"))


@query("SELECT conv_id, turn, lead(turn, 1, 100) OVER (PARTITION BY conv_id ORDER BY turn) - turn AS len FROM conversations")
def lead_length(t):
    over = Window.partitionBy("conv_id").orderBy("turn")
    return t("conversations").select("conv_id", "turn", (F.coalesce(F.lead("turn").over(over), F.lit(100)) - F.col("turn")).alias("len"))


@query("SELECT min(doc_id) AS s, max(doc_id) AS e, count(*) AS n FROM (SELECT doc_id, doc_id - row_number() OVER (ORDER BY doc_id) AS g FROM labels) GROUP BY g")
def islands(t):
    return ordered.islands(t("labels"), "doc_id")


@query("SELECT event_id, user_id, value - lag(value, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS dv FROM events")
def first_difference(t):
    over = Window.partitionBy("user_id").orderBy("event_id")
    return t("events").select("event_id", "user_id", (F.col("value") - F.lag("value", 1, 0.0).over(over)).alias("dv"))


@query(
    """SELECT event_id, row_number() OVER (PARTITION BY user_id, g ORDER BY event_id) AS k FROM
       (SELECT event_id, user_id, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events)"""
)
def reset_running_sum(t):
    """A running count that starts again at each reset row."""
    over = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = t("events").select("event_id", "user_id", F.count_if(F.col("event_type") == "signup").over(over).alias("g"))
    k = F.row_number().over(Window.partitionBy("user_id", "g").orderBy("event_id"))
    return rows.select("event_id", k.cast("long").alias("k"))


@query("SELECT event_id AS id, event_type FROM events")
def rle_roundtrip(t):
    """Runs of equal types, expanded again: the input."""
    rows = ordered.numbered_runs(t("events").select("event_id", "event_type"), ["event_id"], "event_type")
    encoded = rows.groupBy("run").agg(F.min("pos").alias("first"), F.count("*").alias("n"), F.first("event_type").alias("event_type"))
    return ordered.unrun(encoded, "event_type").join(rows.select("pos", "event_id"), "pos").select(F.col("event_id").alias("id"), "event_type")


@query(
    """WITH RECURSIVE r(root, node, d) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION ALL
         SELECT root, 2 * node + 1, d + 1 FROM r WHERE d < 8 AND 2 * node + 1 < 25)
       SELECT root, max(d) AS d, count(*) AS n FROM r GROUP BY root"""
)
def bounded_recursion(t):
    """Compound parts of parts, to a bounded depth, a join for each level."""
    nodes = t("nation").select(F.col("n_nationkey").alias("node"))
    edges = nodes.select(F.col("node").alias("parent"), (2 * F.col("node") + 1).alias("child")).where("child < 25")
    found = links.descend(nodes.select(F.col("node").alias("root"), "node"), edges, 8)
    return found.groupBy("root").agg(F.max("d").alias("d"), F.count("*").alias("n"))


# --- scalars and generators ---------------------------------------------------------------------------------------


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS s FROM pages")
def sanitise(t):
    return t("pages").select("page_id", text.member_name(F.col("url")).alias("s"))


@query("SELECT doc_id, regexp_replace(replace(text, chr(10), chr(13) || chr(10)), '\\r\\n?', '|', 'g') AS s FROM documents")
def newline_norm(t):
    crlf = F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n"))
    return t("documents").select("doc_id", F.regexp_replace(crlf, "\r\n?", "|").alias("s"))


@query("SELECT p_partkey, printf('%04d', p_partkey) || '_' || lower(p_brand) AS s FROM part")
def padded_name(t):
    return t("part").select("p_partkey", text.padded(F.col("p_partkey"), F.lower("p_brand")).alias("s"))


@query("SELECT l_orderkey, l_linenumber, CAST(((l_linenumber % 4) * 255 + 1) // 3 AS BIGINT) AS s FROM lineitem")
def index_scale(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", text.scaled(F.col("l_linenumber") % 4, 3).alias("s"))


@query("SELECT p_partkey, CAST(b AS INTEGER) AS b, CAST((p_size >> b) & 1 AS INTEGER) AS bit FROM part, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS b)")
def bit_unpack(t):
    bits = F.array(*[F.shiftright("p_size", i).bitwiseAND(F.lit(1)) for i in range(6)])
    return t("part").select("p_partkey", F.posexplode(bits).alias("b", "bit"))


@query("SELECT p_partkey, upper(lpad(hex((p_size % 256) * 65536 + (p_partkey % 256) * 256 + p_size % 7), 6, '0')) AS h FROM part")
def colour_pack(t):
    size, key = F.col("p_size"), F.col("p_partkey")
    return t("part").select("p_partkey", text.hex_colour(size % 256, key % 256, size % 7).alias("h"))


# --- the format engine over containers made of table rows ----------------------------------------------------------------


def _big(n, width: int = 4):
    """A number as big-endian bytes."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * width, "0"))


def _framed(tag: str, body):
    """A frame: its tag, its length, its bytes, and one more where they are odd."""
    return F.concat(F.lit(tag.encode()), _big(F.octet_length(body)), body, F.when(F.octet_length(body) % 2 == 1, F.lit(b"\0")).otherwise(F.lit(b"")))


@query("SELECT doc_id, text, 1 AS n_runs, doc_id % 65536 AS size FROM documents")
def container_text(t):
    """Each document as a file with a styled text of one run, decoded to chunks and read again."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    run = F.concat(F.lit(bytes(12)), _big(F.col("doc_id") % 65536, 2), F.lit(bytes(6)))
    body = F.concat(_big(F.lit(12)), _big(F.octet_length(raw)), _big(F.lit(22)), raw, _big(F.lit(1), 2), run)
    frames = F.concat(_framed("VWLB", F.lit(b"odd")), _framed("STXT", body))
    made = t("documents").select(F.col("doc_id").cast("string").alias("file"), F.concat(F.lit(b"RIFX"), _big(F.octet_length(frames)), frames).alias("content"))
    found = files.texts(files.chunks(made))
    return found.select(F.col("file").cast("long").alias("doc_id"), "text", F.size("runs").alias("n_runs"), F.col("runs")[0]["size"].cast("long").alias("size"))


@query(
    """SELECT l_orderkey, l_partkey AS child, l_suppkey AS parent, CASE l_returnflag WHEN 'A' THEN 'BITD' WHEN 'N' THEN 'CLUT' ELSE 'STXT' END AS link_tag,
              count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem"""
)
def container_links(t):
    """The lines of each order as a table of links in a file of its own, read again."""
    flag = F.col("l_returnflag")
    tag = F.when(flag == "A", "BITD").when(flag == "N", "CLUT").otherwise("STXT")
    row = F.concat(F.hex(_big(F.col("l_partkey"))), F.hex(_big(F.col("l_suppkey"))), F.hex(F.encode(tag, "UTF-8")))
    orders = t("lineitem").groupBy(F.col("l_orderkey").cast("string").alias("file")).agg(F.array_join(F.collect_list(row), "").alias("rows"), F.count("*").alias("n"))
    body = F.concat(F.lit(b"\0\x0c\0\x0c"), _big(F.col("n")), _big(F.col("n")), F.unhex("rows"))
    frames = _framed("KEY*", body)
    made = orders.select("file", F.concat(F.lit(b"RIFX"), _big(F.octet_length(frames)), frames).alias("content"))
    found = files.links(files.chunks(made))
    n = F.count("*").over(Window.partitionBy("file"))
    return found.select(F.col("file").cast("long").alias("l_orderkey"), "child", "parent", "link_tag", n.alias("n"))


@query(
    """SELECT p_partkey, p_name AS name, 'd5' AS layout,
              CASE p_size % 5 WHEN 0 THEN 'bitmap' WHEN 1 THEN 'text' WHEN 2 THEN 'sound' WHEN 3 THEN 'script' ELSE 'font' END AS kind, p_size * 3 AS script_id FROM part"""
)
def container_members(t):
    """Each part as a member with a kind, a name and a script id, in a compressed container, read again."""
    kind = F.element_at(F.array(*map(F.lit, (1, 3, 6, 11, 14))), F.col("p_size") % 5 + 1)
    name = F.encode("p_name", "UTF-8")
    named = F.concat(_big(F.octet_length(name), 1), name)
    items = F.concat(_big(F.lit(2), 2), _big(F.lit(0)), _big(F.lit(0)), _big(F.octet_length(named)), named)
    info = F.concat(_big(F.lit(20)), F.lit(bytes(12)), _big(F.col("p_size") * 3), items)
    member = F.concat(_big(kind), _big(F.octet_length(info)), _big(F.lit(2)), info, F.lit(b"zz"))
    parts = t("part").select(F.col("p_partkey").cast("string").alias("file"), member.alias("member"))

    def pack(batches):
        import pyarrow as pa

        for x in batches:
            packed = [container.write_packed([(7, b"CASt", m.as_py(), False), (8, b"VWLB", b"ab", True)]) for m in x.column(1)]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(packed, pa.binary())], names=["file", "content"])

    found = files.members(files.chunks(parts.mapInArrow(pack, "file string, content binary")))
    return found.select(F.col("file").cast("long").alias("p_partkey"), "name", "layout", "kind", F.col("script_id").cast("int").alias("script_id"))
