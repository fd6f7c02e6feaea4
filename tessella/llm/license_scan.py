"""Operator 1: licence scan by canonical digest lookup.

A text is brought to a canonical form (lower case; copyright notices and licence titles gone; equivalent spellings made one; punctuation and
white space runs a single blank), and the SHA-256 of the whole form is hash-joined to the digests of known licences.
Only DataFrame functions are used.

A line is a notice if its copyright mark is followed by a year or (c) and a name, or if it is "all rights reserved" alone.
Above the body, "copyright" and a name are a notice too. Other lines that begin with "copyright" are running text: where
a line breaks does not matter there. A placeholder such as "copyright (c) <year>" is no notice.

Edge cases: null texts count as empty; a text without a letter or digit has the digest of the empty form and never
matches; several known names with one canonical text give the smallest name; repeated rows and null doc_ids are kept;
an empty table gives an empty result; an empty table of known licences gives nulls. `scan_lines` looks single lines up
the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import DIGESTS, KNOWN

#: Spellings that licences use as equals (first is replaced by second), in lower case.
EQUIVALENT = [
    ("licence", "license"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("fulfil ", "fulfill "),
    ("judgement", "judgment"),
    ("merchantibility", "merchantability"),
    ("noninfringement", "non-infringement"),
    ("per cent", "percent"),
    ("http://", "https://"),
]

_MARKS = r"[ \t/*#;:.-]*+"
_NOTICE = r"(copyright[ \t:,]*(\(c\)[ \t:,]*)?(1[89]|20)\d\d\b|copyright[ \t:,]*\(c\)[ \t:,]*[^\s<\[{]|\(c\)[ \t:,]*(copyright\b|(1[89]|20)\d\d\b))[^\n]*"
_RIGHTS = r"all rights reserved[ \t.*/#;-]*(?=\n|$)"
_TITLE = r"(the )?(mit|expat|isc|zlib|cc|gpl|0bsd|(zero|two|three|[023])[- ]clause bsd|bsd|unlicense|simplified bsd|new bsd|apache)\b( [\w\"'().,-]+){0,5}(?<=license|licence|unlicense|0bsd|bsd|[)])[ \t.:*/#;-]*(?=\n|$)"
_NAME = r"(copyright\b(?![ \t]*[<\[{])|\(c\)(?= *[^\s<\[{]))[^\n]*"
NOTICE_LINE = rf"(^|\n){_MARKS}({_NOTICE}|{_RIGHTS})"
HEAD = rf"\G\s*+{_MARKS}({_NOTICE}|{_RIGHTS}|{_TITLE}|{_NAME})(?=\n|$)"
BROADCAST_ROWS = 50_000


def canonical(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.replace(t, F.lit("©"), F.lit("(c)"))
    t = F.regexp_replace(t, "\r\n?", "\n")
    t = F.regexp_replace(t, HEAD, "\n")
    t = F.regexp_replace(t, NOTICE_LINE, "\n")
    for a, b in EQUIVALENT:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def canonical_sql(text: str) -> str:
    """The same form in SQL, line by line: leading lines that are blank, notice, title or name go, later ones only if notices."""
    marks, year = r"^[ \t/*#;:.-]*", r"(1[89]|20)[0-9][0-9]"
    notice = f"regexp_matches(x, '{marks}(copyright[ \t:,]*([(]c[)][ \t:,]*)?{year}($|[^0-9a-z_])|copyright[ \t:,]*[(]c[)][ \t:,]*[^ \t<\\[{{]|[(]c[)][ \t:,]*(copyright($|[^0-9a-z_])|{year}($|[^0-9a-z_])))')"
    rights = f"regexp_matches(x, '{marks}all rights reserved[ \t.*/#;-]*$')"
    words = r"( [0-9a-z_\"''().,-]+)"
    title = f"regexp_matches(x, '{marks}(the )?(mit|expat|isc|zlib|cc|gpl|0bsd|(zero|two|three|[023])[- ]clause bsd|bsd|unlicense|simplified bsd|new bsd|apache){words}{{0,5}}[ \t.:*/#;-]*$') AND regexp_matches(x, '(license|licence|unlicense|0bsd|bsd|[)])[ \t.:*/#;-]*$')"
    name = f"(regexp_matches(x, '{marks}copyright($|[^0-9a-z_])') AND NOT regexp_matches(x, '{marks}copyright[ \t]*[<\\[{{]') OR regexp_matches(x, '{marks}[(]c[)] *[^ <\\[{{]'))"
    lines = f"string_split(replace(replace(replace(lower(coalesce({text}, '')), '©', '(c)'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"
    out = f"(SELECT string_agg(x, chr(10) ORDER BY i) FILTER (NOT ({notice} OR {rights}) AND NOT (i < body)) FROM (SELECT x, i, coalesce(min(CASE WHEN NOT (trim(x, ' ' || chr(9) || chr(11) || chr(12)) = '' OR {notice} OR {rights} OR {title} OR {name}) THEN i END) OVER (), 1 << 30) AS body FROM (SELECT unnest(ls) AS x, unnest(range(len(ls))) AS i FROM (SELECT {lines} AS ls))))"
    t = f"coalesce({out}, '')"
    for a, b in EQUIVALENT:
        t = f"replace({t}, '{a}', '{b}')"
    return f"trim(regexp_replace({t}, '[^a-z0-9]+', ' ', 'g'))"


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, canonical_sha256) of the texts and digests in `license_texts`."""
    texts = spark.createDataFrame(sorted(KNOWN.items()), "license_id string, license_text string")
    return digests_of(texts).unionByName(spark.createDataFrame(sorted(DIGESTS.items()), "license_id string, canonical_sha256 string"))


def digests_of(known: DataFrame) -> DataFrame:
    """(license_id, canonical_sha256) of a table (license_id, license_text)."""
    forms = known.select("license_id", canonical(F.col("license_text")).alias("form")).where("form <> ''")
    return forms.select("license_id", F.sha2("form", 256).alias("canonical_sha256"))


def _one_name(known: DataFrame) -> DataFrame:
    digests = known.where("canonical_sha256 is not null").groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id"))
    # a checked size is broadcast; else Spark joins by a shuffle
    return F.broadcast(digests) if digests.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else digests


def scan_lines(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license_id), distinct: known one-line texts that are a whole line of a document. Lines that name no licence are not looked up."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.split(F.col(text_col), "[\r\n]+")).alias("line")).where("lower(line) rlike 'licen[cs]e'")
    rows = lines.select("doc_id", F.sha2(canonical(F.col("line")), 256).alias("canonical_sha256"))
    return rows.join(_one_name(known), "canonical_sha256").select("doc_id", "license_id").distinct()


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, canonical_sha256, license_id): the known licence whose canonical text equals the whole document's, or null.

    known: (license_id, canonical_sha256), see `known_licenses` and `digests_of`.
    """
    digests = _one_name(known)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(canonical(F.col(text_col)), 256).alias("canonical_sha256"))
    return rows.join(digests, "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license_id")
