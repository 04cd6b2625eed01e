"""License scans by ordered signature rules.

A rule is a regular expression for one wording of one license, with keywords of
which any match contains one, a word of the wording that it contains besides,
and a priority.  Texts are searched whole, with runs of white space as one
space, so a wording may go over lines; they are gated first: only a text that
holds a rule's keyword and word is searched by that rule.  Of detections that
overlap, one that lies within another of at least its priority is suppressed,
so "MIT License" inside "licensed under the MIT License" counts once, for the
more specific rule.

Besides the rules, three base phrases are sought as consecutive words, also
across lines: ``mit license``, ``apache license``, ``general public license``.

Defined results: null text is empty; texts of any length are searched whole; texts without words have no places and
score 0; equal rows have equal results; a null doc_id is a value like any
other; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, let, pick

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are folded.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: label: (keywords, apart by |, of what the license is called; what it is called; its SPDX identifiers)
NAMES = {
    "mit": ("mit|expat", r"(?:mit|expat)", r"mit(?:-0|-cmu|-feh)?"),
    "apache": ("apache", r"apache(?:\s+software)?", r"apache-(?:1\.[01]|2\.0)"),
    "agpl": ("affero", r"(?:gnu\s+)?affero\s+general\s+public", r"agpl-[13]\.0(?:-only|-or-later)?"),
    "lgpl": ("lesser|library general public", r"(?:gnu\s+)?(?:lesser|library)\s+general\s+public", r"lgpl-(?:2\.[01]|3\.0)(?:-only|-or-later)?"),
    "gpl": ("general public", r"(?:gnu\s+)?general\s+public", r"gpl-[123]\.0(?:-only|-or-later)?"),
    "bsd": ("bsd", r"(?:(?:new|modified|simplified|revised|original|[234]-clause)\s+)?bsd", r"bsd-[0-4]-clause(?:-\w+)?|0bsd"),
    "mpl": ("mozilla", r"mozilla\s+public", r"mpl-(?:1\.[01]|2\.0)"),
    "epl": ("eclipse", r"eclipse\s+public", r"epl-[12]\.0"),
    "edl": ("eclipse", r"eclipse\s+distribution", r"edl-1\.0"),
    "cddl": ("common development", r"common\s+development\s+and\s+distribution", r"cddl-1\.[01]"),
    "cpl": ("common public", r"common\s+public(?!\s+attribution)", r"cpl-1\.0"),
    "cpal": ("common public attribution", r"common\s+public\s+attribution", r"cpal-1\.0"),
    "isc": ("isc", r"isc", r"isc"),
    "zlib": ("zlib", r"zlib(?:/libpng)?", r"zlib(?:-acknowledgement)?"),
    "boost": ("boost", r"boost\s+software", r"bsl-1\.0"),
    "unlicense": ("unlicense", r"unlicense", r"unlicense"),
    "wtfpl": ("wtfpl|do what the fuck", r"wtfpl|do\s+what\s+the\s+fuck\s+you\s+want\s+to\s+public", r"wtfpl"),
    "artistic": ("artistic", r"artistic", r"artistic-(?:1\.0|2\.0)(?:-\w+)?"),
    "python": ("python|psf", r"python\s+software\s+foundation|psf", r"(?:psf|python)-2\.0"),
    "php": ("php", r"php", r"php-3\.0[01]?"),
    "ruby": ("ruby", r"ruby", r"ruby"),
    "postgresql": ("postgresql", r"postgresql", r"postgresql"),
    "openssl": ("openssl", r"openssl", r"openssl"),
    "ofl": ("open font", r"(?:sil\s+)?open\s+font", r"ofl-1\.[01](?:-\w+)?"),
    "eupl": ("european union public", r"european\s+union\s+public", r"eupl-1\.[012]"),
    "ms-pl": ("microsoft public", r"microsoft\s+public", r"ms-pl"),
    "ms-rl": ("microsoft reciprocal", r"microsoft\s+reciprocal", r"ms-rl"),
    "osl": ("open software", r"open\s+software", r"osl-[123]\.\d"),
    "afl": ("academic free", r"academic\s+free", r"afl-[123]\.\d"),
    "ecl": ("educational community", r"educational\s+community", r"ecl-[12]\.0"),
    "ncsa": ("ncsa", r"(?:university\s+of\s+illinois/)?ncsa(?:\s+open\s+source)?", r"ncsa"),
    "qpl": ("q public", r"q\s+public", r"qpl-1\.0"),
    "w3c": ("w3c", r"w3c(?:\s+software(?:\s+notice\s+and)?)?", r"w3c(?:-\d+)?"),
    "x11": ("x11", r"x11", r"x11"),
    "cecill": ("cecill", r"cecill(?:-[bc])?", r"cecill-(?:1\.[01]|2\.[01]|b|c)"),
    "odbl": ("open database", r"open\s+database", r"odbl-1\.0"),
    "pddl": ("public domain dedication", r"public\s+domain\s+dedication\s+and", r"pddl-1\.0"),
    "odc-by": ("open data commons attribution", r"open\s+data\s+commons\s+attribution", r"odc-by-1\.0"),
    "gfdl": ("free documentation", r"(?:gnu\s+)?free\s+documentation", r"gfdl-1\.[123](?:-\w+)*"),
    "vim": ("vim", r"vim", r"vim"),
    "sleepycat": ("sleepycat", r"sleepycat", r"sleepycat"),
    "upl": ("universal permissive", r"universal\s+permissive", r"upl-1\.0"),
    "bsl": ("business source", r"business\s+source", r"busl-1\.1"),
    "sspl": ("server side public", r"server\s+side\s+public", r"sspl-1\.0"),
    "elastic": ("elastic", r"elastic", r"elastic-2\.0"),
    "polyform": ("polyform", r"polyform\s+\w+", r"polyform-[\w-]+-1\.0\.0"),
    "openrail": ("rail", r"(?:\w+\s+)?open\s*rail(?:-[ms]+)?", r"(?:\w+-)?openrail(?:-m|\+\+-m)?"),
    "llama": ("llama", r"llama\s*\d?(?:\.\d)?\s+community", r"llama\d?(?:\.\d)?"),
}
#: Wordings around a name {n}, or an identifier {s}, or a label {l}; their priorities; a word of theirs.
FORMS = (
    (r"spdx-license-identifier:\s*(?:{s})\b", 4, "spdx"),
    (r"(?:dual-?\s*)?(?:licensed|released|distributed|published|available|provided|redistributed)\s+under\s+(?:the\s+terms\s+of\s+)?(?:the\s+|an?\s+)?(?:{n})(?:\s+licen[sc]e)?", 3, "under"),
    (r"(?:{n})\s+licen[sc]e(?:,?\s+v(?:ersion|er\.?|\.)?\s*\d+(?:\.\d+)*)?", 2, "licen"),
    (r"licen[sc]e\s*[:=]\s*[\"'(]?(?:{n}|{s})\b", 3, "licen"),
    (r"\b(?:{n})[- ]licen[sc]ed\b", 2, "licen"),
)
#: Wordings of their own: label, keyword, pattern, priority.
OTHERS = (
    ("cc-by-nc-nd", "cc", r"\bcc[- ]by-nc-nd(?:[- ]\d\.\d)?", 4),
    ("cc-by-nc-sa", "cc", r"\bcc[- ]by-nc-sa(?:[- ]\d\.\d)?", 4),
    ("cc-by-nc", "cc", r"\bcc[- ]by-nc(?:[- ]\d\.\d)?", 3),
    ("cc-by-nd", "cc", r"\bcc[- ]by-nd(?:[- ]\d\.\d)?", 3),
    ("cc-by-sa", "cc", r"\bcc[- ]by-sa(?:[- ]\d\.\d)?", 3),
    ("cc-by", "cc", r"\bcc[- ]by(?:[- ]\d\.\d)?\b", 2),
    ("cc0", "cc0", r"\bcc0(?:[- ]1\.0)?\b", 3),
    ("cc0", "no rights reserved", r"no\s+rights\s+reserved", 2),
    ("cc-by-nc", "creative commons", r"creative\s+commons\s+attribution[- ]non-?commercial(?!-)", 3),
    ("cc-by-sa", "creative commons", r"creative\s+commons\s+attribution[- ]share-?alike", 3),
    ("cc-by-nd", "creative commons", r"creative\s+commons\s+attribution[- ]no-?deriv\w*", 3),
    ("cc-by", "creative commons", r"creative\s+commons\s+attribution(?![- ])", 2),
    ("cc", "creative commons", r"creative\s+commons", 1),
    ("mit", "permission is hereby granted", r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+obtaining", 4),
    ("isc", "permission to use", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose", 4),
    ("bsd", "redistribution and use", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms", 4),
    ("gpl", "free software", r"this\s+program\s+is\s+free\s+software[;:]\s+you\s+can\s+redistribute", 4),
    ("gpl", "gpl", r"\b(?:gnu\s+)?gpl(?:[- ]?v?[123](?:\.0)?)?\+?(?![\w-])", 2),
    ("lgpl", "lgpl", r"\blgpl(?:[- ]?v?[23](?:\.[01])?)?\+?(?![\w-])", 2),
    ("agpl", "agpl", r"\bagpl(?:[- ]?v?[13](?:\.0)?)?\+?(?![\w-])", 2),
    ("apache", "apache.org/licenses", r"https?://(?:www\.)?apache\.org/licenses/license-2\.0(?:\.\w+)?", 4),
    ("mit", "opensource.org", r"https?://(?:www\.)?opensource\.org/licenses?/mit", 4),
    ("gpl", "gnu.org/licenses", r"https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?gpl[\w.-]*", 4),
    ("cc", "creativecommons.org", r"https?://(?:www\.)?creativecommons\.org/(?:licenses|publicdomain)/[\w./-]+", 2),
    ("public-domain", "public domain", r"(?:in|into|to)\s+the\s+public\s+domain", 2),
    ("proprietary", "all rights reserved", r"all\s+rights\s+reserved", 1),
    ("proprietary", "proprietary", r"proprietary\s+(?:and\s+confidential|licen[sc]e|software)", 2),
    ("copyright", "copyright", r"copyright\s+(?:\(c\)|©)?\s*\d{4}(?:\s*[-,]\s*\d{4})*", 1),
)
#: Any match of a rule holds one of these; texts without one go no further.
TRIGGERS = ("licen", "spdx", "under", *(k for k in dict.fromkeys(x[1] for x in OTHERS) if "licen" not in k and k != "cc"), "cc-by", "cc by")
#: How sure a detection of each priority is.
SURE = (0.0, 0.4, 0.7, 0.9, 1.0)
BASE = {"mit": ("mit", "license"), "apache": ("apache", "license"), "gpl": ("general", "public", "license")}


def rules() -> list[tuple[int, str, str, str, str, int]]:
    """(order, label, keywords, word, pattern, priority) of every rule; keywords are apart by |."""
    made = [(label, word if "{s}" in form and "{n}" not in form else keys, word, form.format(n=name, s=spdx, l=label), priority) for label, (keys, name, spdx) in NAMES.items() for form, priority, word in FORMS]
    # an identifier may stand where the name's keywords do not
    made += [(label, "licen", "licen", rf"licen[sc]e\s*[:=]\s*[\"'(]?(?:{spdx})\b", 3) for label, (_, _, spdx) in NAMES.items()]
    others = [(label, key, key, pattern, priority) for label, key, pattern, priority in OTHERS]
    return [(i, *x) for i, x in enumerate(dict.fromkeys([*others, *made]))]


def triggered(text: Column) -> Column:
    out = F.lit(False)
    for t in TRIGGERS:
        out = out | F.contains(text, F.lit(t))
    return out


def collapsed(text: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(text, r"\s+", " ")


def detections(lines: DataFrame) -> DataFrame:
    """(key, line_no, label, priority, from, to) of what no other detection suppresses.

    Takes (key, line_no, line) with A-Z folded; places are those of the line
    with runs of white space as one space.
    """
    spark = SparkSession.active()
    # some hundred rows; where two keywords of a rule stand in a text, its second detections are suppressed
    table = [(i, label, key, *rest) for i, label, keys, *rest in rules() for key in keys.split("|")]
    words = sorted({r[2] for r in table})
    table = F.broadcast(spark.createDataFrame(table, "rule int, label string, keyword string, word string, pattern string, priority int"))
    lines = lines.withColumn("line", collapsed(F.col("line")))
    hit = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col("line"), w))
    gated = lines.withColumn("keyword", F.explode(hit)).join(table, "keyword").where(F.contains("line", F.col("word"))).where(F.rlike("line", F.col("pattern")))
    matches = F.regexp_extract_all("line", F.col("pattern"), F.lit(0))
    apart = F.split("line", F.col("pattern"), -1)
    state = "struct<at:int,out:array<struct<f:int,t:int>>>"

    def walk(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(x["p"])
        return F.struct((begin + F.length(x["m"])).alias("at"), F.concat(s["out"], F.array(F.struct(begin.alias("f"), (begin + F.length(x["m"])).alias("t")))).alias("out")).cast(state)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<f:int,t:int>>").alias("out")).cast(state)
    pairs = F.zip_with(matches, F.slice(apart, F.lit(1), F.size(matches)), lambda m, p: F.struct(m.alias("m"), p.alias("p")))
    found = gated.select("key", "line_no", "rule", "label", "priority", F.inline(F.aggregate(pairs, start, walk)["out"]))
    # within a line: an earlier interval that reaches as far contains this one
    before = W.partitionBy("key", "line_no").orderBy("f", F.desc("t"), F.desc("priority"), "rule").rowsBetween(W.unboundedPreceding, -1)
    reach = [F.when(F.col("priority") <= p, F.max(F.when(F.col("priority") == p, F.col("t"))).over(before)) for p in range(1, len(SURE))]
    return found.withColumn("reach", F.greatest(*reach)).where("reach is null or reach < t").select("key", "line_no", "label", "priority", "f", "t")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections), a row for each row of ``docs``."""
    d = pick(docs, doc_id="bigint", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("key", F.xxhash64("doc_id", "text"))

    def places(words: Column) -> Column:
        def named(i: Column) -> Column:
            at = lambda k: F.get(words, i - k)
            two = F.when(at(1) == "mit", "mit").when(at(1) == "apache", "apache")
            return F.when(at(0) == "license", two.when((at(1) == "public") & (at(2) == "general"), "gpl"))

        every = F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.struct(named(i).alias("label"), (i - F.when(named(i) == "gpl", 2).otherwise(1)).alias("at")))
        return F.filter(every, lambda x: x["label"].isNotNull())

    none = F.array().cast("array<struct<label:string,at:int>>")
    words = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"({WORD})"), F.lit(1))
    gated = F.contains(F.lower("text"), F.lit("license"))  # few texts go on
    base = F.when(gated, let(words, lambda w: F.when(F.size(w) == 0, none).otherwise(places(w)))).otherwise(none)
    rows = d.select("doc_id", "key", F.regexp_count("text", F.lit(WORD_ANY_CASE)).cast("bigint").alias("n_words"), base.alias("base"))

    # white space is collapsed once for all triggers
    low = d.select("key", F.lit(0).alias("line_no"), let(collapsed(F.lower("text")), lambda x: F.when(triggered(x), x)).alias("line"))
    seen = detections(low.where("line is not null").distinct())
    seen = seen.groupBy("key").agg(F.collect_set("label").alias("found"), F.max("priority").alias("priority"), F.count("*").alias("n_detections"))
    sure = F.get(F.array(*[F.lit(x) for x in SURE]), F.greatest(F.coalesce("priority", F.lit(0)), F.when(F.size("base") > 0, 2).otherwise(0)))
    out = rows.join(seen, "key", "left")
    labels = F.array_sort(F.array_distinct(F.col("base.label")))
    return out.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min("base.at").cast("bigint").alias("first_word"),
        F.array_max("base.at").cast("bigint").alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        sure.alias("score"),
        F.coalesce("n_detections", F.lit(0)).cast("bigint").alias("n_detections"),
    )
