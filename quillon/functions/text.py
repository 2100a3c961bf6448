"""Scalar text functions as column expressions: cleaning, identity, URLs, links, regex-tier HTML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of page titles, URL parts that mark no page, time words, version-segment patterns.
TITLE_SUFFIXES = ["documentation", "docs", "reference", "guide", "api", "manual", "wiki"]
SKIPPED_URL_PARTS = [".pdf", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".zip", ".tar", ".gz", ".bz2", ".whl", ".exe", ".dmg", ".ico", "?download", "mailto:", "javascript:"]
TIME_WORDS = ["latest", "recent", "current", "today", "this year", "2024", "2025", "2026", "new", "just released", "announcement", "preprint"]
VERSION_SEGMENTS = [
    r"(?i)/v?\d+\.\d+(?:\.\d+)?(?:[-.\w]*)/",
    r"(?i)/\d{2,}/",
    r"(?i)/(?:release[_-]|version[_-])[\d][\d._-]*/",
    r"(?i)/[a-zA-Z][\w-]*-\d+\.\d+(?:\.\d+)?/",
]


def strip(c: Column) -> Column:
    """All white space off both ends, not only spaces: the six characters that \\s stands for."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def one_line(c: Column) -> Column:
    """Stripped, newlines as spaces."""
    return F.replace(strip(c), F.lit("\n"), F.lit(" "))


def words(c: Column) -> Column:
    """White-space tokens; none for null or blank text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")


def year_of(date: Column) -> Column:
    """The first four characters of an ISO date as a year; null where they aren't one."""
    return F.when(F.substring(date, 1, 4).rlike(r"^\d{4}$"), F.substring(date, 1, 4)).cast("int")


def pdf_year(date: Column) -> Column:
    """Year of a PDF creation date, D:YYYY…"""
    return year_of(F.substring(date, 3, 4))


def long_id(key: Column) -> Column:
    """A 63-bit id: the first 15 hex digits of the key's SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("long")


def uuid_id(key: Column) -> Column:
    """The first 16 bytes of the key's SHA-256 in UUID form."""
    return F.regexp_replace(F.substring(F.sha2(key, 256), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def short_key(title: Column) -> Column:
    return F.substring(F.md5(title), 1, 8)


def strip_inline_images(c: Column) -> Column:
    """Markdown data-URI images become a mark; bare base64 runs of 100 and more characters go."""
    return F.regexp_replace(F.regexp_replace(c, r"!\[[^\]]*\]\(data:image/[^)]+\)", "[image]"), r"[A-Za-z0-9+/]{100,}={0,2}", "")


def clean_title(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?i)\s*[|—–\-]\s*(" + "|".join(TITLE_SUFFIXES) + r")\s*$", ""))


def clean_topic(c: Column, fallback: Column) -> Column:
    """A model's topic name without its label and quotes, 60 characters at most."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)^\s*(topic|name|label)\s*:\s*", ""), r"^[\s\"']+|[\s\"']+$", "")
    return F.coalesce(F.nullif(F.left(bare, F.lit(60)), F.lit("")), fallback)


def defragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def url_authority(url: Column) -> Column:
    """Host and port; empty where there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def skipped_url(url: Column) -> Column:
    """Any marker anywhere in the lower-cased URL."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(url), F.lit(p)) for p in SKIPPED_URL_PARTS])


def seed_prefix(seed: Column) -> Column:
    """The directory of the seed's path."""
    return F.regexp_extract(url_path(seed), r"^(.*/)", 1)


def under_seed(url: Column, seed: Column) -> Column:
    """Same authority, and a path below the seed's directory."""
    return (url_authority(url) == url_authority(seed)) & url_path(url).startswith(F.coalesce(seed_prefix(seed), F.lit("")))


def old_version(url: Column, seed: Column) -> Column:
    """A version segment that the seed's path lacks, under any of the patterns."""
    found = []
    for p in VERSION_SEGMENTS:
        segment = F.regexp_extract(url_path(url), p, 0)
        found.append((segment != "") & ~F.contains(url_path(seed), segment))
    return reduce(lambda a, b: a | b, found)


def time_sensitive(query: Column) -> Column:
    """A time word anywhere, also inside other words."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(query), F.lit(w)) for w in TIME_WORDS])


def links(html: Column) -> Column:
    """Stripped, non-empty href values of anchors, in order."""
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(r'<a[^>]*href="([^"]*)"'), F.lit(1)), strip), lambda h: h != "")


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)


def html_h1(html: Column) -> Column:
    return F.regexp_extract(html, r"(?s)<h1[^>]*>(.*?)</h1>", 1)


def html_text(html: Column) -> Column:
    """Regex tier: boilerplate elements and tags go, runs of white space become one space. See functions.html for the parser tier."""
    bare = reduce(lambda c, tag: F.regexp_replace(c, rf"(?s)<{tag}[^>]*>.*?</{tag}>", " "), ["script", "style", "nav", "footer", "header", "aside"], html)
    return squeeze(F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " "))


def limit_blank_lines(c: Column) -> Column:
    """White space within lines squeezed, two blank lines in a row at most."""
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"(?m)^ | $", ""), "\n{4,}", "\n\n\n"))


def paper_ids(text: Column) -> Column:
    """Distinct new-style paper ids in order of appearance, without versions."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d{4}\.\d{4,5}(?:v\d+)?)\b"), F.lit(1)), lambda x: F.split_part(x, F.lit("v"), F.lit(1))))


def paper_id_of_url(url: Column) -> Column:
    """Last path segment without its version."""
    return F.split_part(F.element_at(F.split(url, "/"), -1), F.lit("v"), F.lit(1))


def reference_titles(text: Column, most: int = 100) -> Column:
    """Titles of a bibliography's entries: ``[n] …`` else ``n. …``, over 30 characters, 200 at most of each."""
    found = lambda p: F.filter(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), squeeze), lambda t: F.length(t) > 30)
    first, second = found(r"\[\d+\]\s+([^\[]+)"), found(r"(?m)^\d+\.\s+(.+)$")
    return F.transform(F.slice(F.when(F.size(first) > 0, first).otherwise(second), 1, most), lambda t: F.left(t, F.lit(200)))


def as_list(c: Column, separator: str = r"\s+") -> Column:
    """A delimited string as an array of stripped, non-empty parts."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), separator), strip), lambda x: x != "")
