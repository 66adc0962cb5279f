"""License scans by ordered signature rules, DataFrame functions only.

A text is searched for keywords first; only where one is found it is brought to words, lower-cased A-Z, between
single blanks, and only the rules whose keyword is among them run. A rule is a regex over words, a label, a priority
and a weight. Detections are intervals of words: one that lies inside another is suppressed, of equal intervals the
one of higher priority stays. Labels of what is left are the document's, beside those of three base phrases.

Rules are made from families of licenses: their names, versions and the wordings that grant or mention them. Beside
them stand hand-written ones for bodies and headers of licenses and for SPDX identifiers, in ``license_texts``.

Defined cases: null counts as empty, which has no words, places or labels and a score of 0; phrases hold across
lines; equal labels count once; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import ALONE, handwritten
from .shared import fold_ascii

WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The phrases that every scan reports, each with its label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label: (keyword, wordings of the name, versions, highest priority first)
FAMILIES = {
    "agpl": ("affero", ["(?:gnu )?affero general public licen[sc]e", "gnu affero gpl"], ["3 0", "3", "1"]),
    "lgpl": ("lesser", ["(?:gnu )?lesser general public licen[sc]e", "lesser gpl"], ["3 0", "3", "2 1"]),
    "lgpl-library": ("library", ["(?:gnu )?library general public licen[sc]e"], ["2 0", "2"]),
    "gpl": ("general public", ["(?:gnu )?general public licen[sc]e"], ["3 0", "3", "2 0", "2", "1"]),
    "gpl-short": ("gpl", ["(?:gnu )?gpl", "(?:gnu )?gplv"], ["3 0", "3", "2 0", "2", "1"]),
    "lgpl-short": ("lgpl", ["(?:gnu )?lgpl", "lgplv"], ["3 0", "3", "2 1", "2"]),
    "agpl-short": ("agpl", ["(?:gnu )?agpl"], ["3 0", "3"]),
    "gfdl": ("documentation", ["(?:gnu )?free documentation licen[sc]e"], ["1 3", "1 2", "1 1"]),
    "apache": ("apache", ["apache(?: software)? licen[sc]e"], ["2 0", "2", "1 1", "1 0"]),
    "mit": ("mit", ["(?:the )?mit(?: x11)? licen[sc]e", "mit style licen[sc]e"], []),
    "bsd": ("bsd", ["(?:(?:simplified|modified|new|revised|original) )?bsd(?: style)? licen[sc]e"], []),
    "bsd-2-clause": ("clause", ["(?:2|two) clause bsd(?: licen[sc]e)?", "bsd (?:2|two) clause(?: licen[sc]e)?"], []),
    "bsd-3-clause": ("clause", ["(?:3|three) clause bsd(?: licen[sc]e)?", "bsd (?:3|three) clause(?: licen[sc]e)?"], []),
    "bsd-4-clause": ("clause", ["(?:4|four) clause bsd(?: licen[sc]e)?", "bsd (?:4|four) clause(?: licen[sc]e)?"], []),
    "mpl": ("mozilla", ["mozilla public licen[sc]e"], ["2 0", "1 1", "1 0"]),
    "epl": ("eclipse", ["eclipse public licen[sc]e"], ["2 0", "1 0"]),
    "cpl": ("common public", ["common public licen[sc]e"], ["1 0"]),
    "cddl": ("common development", ["common development and distribution licen[sc]e"], ["1 1", "1 0"]),
    "eupl": ("european union", ["european union public licen[sc]e"], ["1 2", "1 1", "1 0"]),
    "artistic": ("artistic", ["(?:the )?artistic licen[sc]e"], ["2 0", "1 0"]),
    "zlib": ("zlib", ["zlib(?: libpng)? licen[sc]e"], []),
    "isc": ("isc", ["isc licen[sc]e"], []),
    "boost": ("boost", ["boost software licen[sc]e"], ["1 0"]),
    "unlicense": ("unlicense", ["(?:the )?unlicense"], []),
    "python": ("python", ["python(?: software foundation)? licen[sc]e"], ["2 0", "2"]),
    "php": ("php", ["php licen[sc]e"], ["3 01", "3 0"]),
    "ruby": ("ruby", ["ruby licen[sc]e"], []),
    "openssl": ("openssl", ["openssl licen[sc]e"], []),
    "ofl": ("open font", ["(?:sil )?open font licen[sc]e"], ["1 1", "1 0"]),
    "osl": ("open software", ["open software licen[sc]e"], ["3 0", "2 1"]),
    "afl": ("academic free", ["academic free licen[sc]e"], ["3 0", "2 1"]),
    "odbl": ("database", ["open(?: data commons open)? database licen[sc]e"], ["1 0"]),
    "ms-pl": ("microsoft", ["microsoft public licen[sc]e"], []),
    "cecill": ("cecill", ["cecill(?: (?:b|c))?"], ["2 1", "2 0"]),
    "cc0": ("cc0", ["cc0"], ["1 0"]),
    "cc-by-nc-nd": ("cc", ["cc by nc nd"], ["4 0", "3 0", "2 5", "2 0", "1 0"]),
    "cc-by-nc-sa": ("cc", ["cc by nc sa"], ["4 0", "3 0", "2 5", "2 0", "1 0"]),
    "cc-by-nc": ("cc", ["cc by nc"], ["4 0", "3 0", "2 5", "2 0", "1 0"]),
    "cc-by-nd": ("cc", ["cc by nd"], ["4 0", "3 0", "2 5", "2 0", "1 0"]),
    "cc-by-sa": ("cc", ["cc by sa"], ["4 0", "3 0", "2 5", "2 0", "1 0"]),
    "cc-by": ("cc", ["cc by"], ["4 0", "3 0", "2 5", "2 0", "1 0"]),
    "creative-commons": ("creative commons", ["creative commons(?: (?:attribution|non ?commercial|no ?derivatives|share ?alike|zero))*(?: licen[sc]e)?"], ["4 0", "3 0", "2 5"]),
}

#: Wordings without a family: label, keyword, regex, priority, weight.
SINGLE = (
    ("reserved", "reserved", "all rights(?: are)? reserved", 50, 0.9),
    ("reserved-some", "reserved", "some rights(?: are)? reserved", 50, 0.8),
    ("copyright", "copyright", "copyright(?: c)? (?:19|20)[0-9][0-9]", 20, 0.5),
    ("copyright", "copyright", "copyright notice", 10, 0.4),
    ("public-domain", "public domain", "(?:released|dedicated|placed|put|is|are) (?:in|in to|into|to) the public domain", 60, 0.9),
    ("public-domain", "public domain", "public domain", 10, 0.4),
    ("warranty", "warrant", "(?:provided|distributed) as is without warranty of any kind", 40, 0.7),
    ("warranty", "warrant", "without any warranty", 30, 0.6),
    ("proprietary", "confidential", "proprietary and confidential", 40, 0.7),
    ("proprietary", "permission", "without(?: the)?(?: prior)?(?: express)?(?: written)? permission", 20, 0.4),
    ("licensed", "licen", "(?:this|the) (?:work|software|program|file|document|text) is licen[sc]ed under", 5, 0.3),
)

#: What stands before a name that grants a license, not only mentions it.
GRANT = "(?:(?:licen[sc]ed|released|distributed|available|published|redistributed?|covered|offered) (?:under|by|with)(?: the)?(?: terms of)?(?: the)? )"


def rules() -> list[dict]:
    """All rules in order: from grants of a version to mentions of a family."""
    out = []
    for label, (keyword, names, versions) in FAMILIES.items():
        shown = label.removesuffix("-short").removesuffix("-library")
        for name in names:
            for v in versions:
                full = f"{name}(?: version| v| ver)? ?(?:v)?{v}"
                tag = f"{shown}-{v.replace(' ', '.')}"
                out.append((tag, keyword, GRANT + full, 90, 1.0))
                out.append((f"{tag}-or-later", keyword, f"{full} or(?: at your option)?(?: any)? later(?: version)?", 95, 1.0))
                out.append((tag, keyword, full, 70, 0.9))
            out.append((shown, keyword, GRANT + name, 80, 0.95))
            out.append((shown, keyword, name, 60, 0.8))
    out += [*SINGLE, *handwritten()]
    made = [dict(zip(("label", "keyword", "regex", "priority", "weight"), r, strict=True)) for r in out]
    return [r | {"regex": f" ({r['regex']})(?= )"} for r in made]


#: Parts of words, one of which stands in whatever a rule or base phrase matches ("cc by" and versions of ``ALONE`` aside).
GATES = (
    "licen", "gpl", "clause", "cecill", "cc0", "creative", "reserved", "copyright", "domain", "warrant", "confidential", "permission",
    "spdx", "redistribut", "misrepresented", "endorse", "advertising", "liable", "restriction", "compile", "fuck", "evil", "stuff",
    "openssl", "young", "php", "apache", "mozilla", "jpeg", "font",
)

_SCHEMA = "array<struct<label string, keyword string, regex string, priority int, weight double>>"


def _places(pattern: str) -> str:
    """SQL for the (start, end) of all matches of ``pattern`` in ``__norm``, in words from 0."""
    words = f"split(regexp_replace(__norm, {pattern}, ' \\u0001$1\\u0002'), ' ')"
    # one element, so that the words are made once
    at = "filter(transform(w, (x, i) -> if({}, i - {}, null)), x -> x is not null)"
    both = f"arrays_zip({at.format('startswith(x, chr(1))', 1)}, {at.format('endswith(x, chr(2))', 0)})"
    return f"transform(array({words}), w -> {both})[0]"


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    own = rules()
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("__text"))
    df = df.withColumn("n_words", F.regexp_count("__text", F.lit(WORD)).cast("long")).withColumn("__low", fold_ascii(F.col("__text")))
    has = F.contains("__low", F.lit("cc")) & F.contains("__low", F.lit("by"))
    for part in GATES:
        has = has | F.contains("__low", F.lit(part))
    has = has | F.col("__low").rlike(rf"(?:{'|'.join(ALONE)}){GAP}[0-9]")
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace("__low", GAP, " ")), F.lit(" "))
    df = df.withColumn("__norm", F.when(has, norm)).drop("__text", "__low")

    base = [F.expr(_places(f"' ({phrase})(?= )'")) for phrase in BASE]
    base = [F.when(F.contains("__norm", F.lit(f" {phrase} ")), b) for phrase, b in zip(BASE, base, strict=True)]
    df = df.withColumn("__base", F.array(*base))
    df = df.withColumn("__rules", F.when(F.col("__norm").isNotNull(), F.from_json(F.lit(json.dumps(own)), _SCHEMA)))
    df = df.withColumn("__rules", F.expr("filter(__rules, r -> contains(__norm, r.keyword) and __norm rlike r.regex)"))
    hit = "transform({}, p -> named_struct('start', p.`0`, 'end', p.`1`, 'priority', r.priority, 'label', r.label, 'weight', r.weight))"
    df = df.withColumn("__hits", F.expr(f"flatten(transform(__rules, r -> {hit.format(_places('r.regex'))}))"))
    by = "case when {} then -1 when {} then 1 else 0 end"
    first = by.format(*("{0}.start {2} {1}.start or {0}.start = {1}.start and ({0}.end {3} {1}.end or {0}.end = {1}.end and ({0}.priority {3} {1}.priority or {0}.priority = {1}.priority and {0}.label {2} {1}.label))".format("a", "b", *o) for o in ("<>", "><")))
    df = df.withColumn("__hits", F.expr(f"array_sort(__hits, (a, b) -> {first})"))
    none = "named_struct('upto', -1, 'labels', cast(array() as array<string>), 'score', cast(0 as double))"
    step = "named_struct('upto', h.end, 'labels', array_union(s.labels, array(h.label)), 'score', greatest(s.score, h.weight))"
    df = df.withColumn("__kept", F.expr(f"aggregate(__hits, {none}, (s, h) -> if(h.end <= s.upto, s, {step}))"))

    names = F.array(*[F.when(F.size(F.col("__base")[i]) > 0, F.lit(label)) for i, label in enumerate(BASE.values())])
    names = F.when(F.col("__norm").isNotNull(), F.array_compact(names)).otherwise(F.array().cast("array<string>"))
    starts = F.expr("transform(flatten(filter(__base, x -> x is not null)), p -> cast(p.`0` as long))")
    df = df.withColumn("__names", names).withColumn("__starts", starts)
    all_names = F.array_union("__names", F.coalesce(F.col("__kept.labels"), F.array().cast("array<string>")))
    return df.select(
        "doc_id",
        "n_words",
        F.size("__starts").cast("long").alias("n_base"),
        F.array_min("__starts").alias("first_word"),
        F.array_max("__starts").alias("last_word"),
        F.array_join(F.array_sort("__names"), ",").alias("base_labels"),
        F.array_join(F.array_sort(all_names), ",").alias("labels"),
        F.greatest(F.coalesce(F.col("__kept.score"), F.lit(0.0)), F.when(F.size("__names") > 0, F.lit(0.8)).otherwise(0.0)).alias("score"),
    )


def sql() -> str:
    """The same in DuckDB's SQL, over table documents with ids of their own. Its regexes have no lookahead, so words
    stand between two blanks, of which a match takes one on either side; nor have they any lookbehind, so what a rule
    wants before it is looked for in the words before a match."""
    spaced = lambda regex: re.sub(r"\[[^]]*\]| ", lambda m: "(?:  )" if m[0] == " " else m[0], regex)
    quoted = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    told = []
    for r in rules():
        before, own = re.fullmatch(r" \((?:\(\?<=(.*?\})\))?(.*)\)\(\?= \)", r["regex"]).groups(default="")
        told.append((r["label"], r["keyword"].replace(" ", "  "), spaced(own), before and before + "$", r["priority"], r["weight"], False))
    told += [(label, phrase.replace(" ", "  "), spaced(phrase), "", 0, 0.0, True) for phrase, label in BASE.items()]
    values = ", ".join(f"({', '.join(map(quoted, row))})" for row in told)
    at = "list_filter(range(1, len(w) + 1), lambda i: {}(w[i], chr({})))"
    return f"""
        WITH rules(label, keyword, regex, before, priority, weight, base) AS (VALUES {values}),
        d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents),
        t AS (SELECT doc_id, words, ' ' || array_to_string(words, '  ') || ' ' AS norm FROM d),
        near AS (SELECT t.doc_id, words, r.*, string_split(trim(regexp_replace(norm, ' (' || regex || ') ', ' ' || chr(1) || '\\1' || chr(2) || ' ', 'g'), ' '), '  ') AS w
                 FROM t JOIN rules r ON contains(norm, keyword)),
        placed AS (SELECT * EXCLUDE (w), unnest({at.format("starts_with", 1)}) - 1 AS a, unnest({at.format("ends_with", 2)}) AS b FROM near),
        hits AS (SELECT doc_id, label, priority, weight, base, a, b FROM placed
                 WHERE before = '' OR regexp_matches(' ' || array_to_string(words[1:a], ' ') || ' ', before)),
        swept AS (SELECT doc_id, label, weight, b > coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY a, b DESC, priority DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS kept
                  FROM hits WHERE NOT base),
        named AS (SELECT doc_id, label, weight FROM swept WHERE kept UNION ALL SELECT doc_id, label, CAST(0.8 AS DECIMAL(3, 2)) FROM hits WHERE base),
        all_named AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, CAST(max(weight) AS DOUBLE) AS score FROM named GROUP BY doc_id),
        based AS (SELECT doc_id, count(*) AS n_base, min(a) AS first_word, max(a) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels
                  FROM hits WHERE base GROUP BY doc_id)
        SELECT d.doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
               coalesce(labels, '') AS labels, coalesce(score, 0) AS score
        FROM d LEFT JOIN based USING (doc_id) LEFT JOIN all_named USING (doc_id)"""
