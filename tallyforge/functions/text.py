"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash31(text: Column, seed: int = 0) -> Column:
    """The polynomial hash h = 31 h + code modulo 2^32 over the characters of a text; null for null."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(codes, F.lit(seed).cast("bigint"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(4294967295)))


def initials(text: Column) -> Column:
    """The capital first letters of the first two words."""
    words = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.upper(F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.substring(w, 1, 1)), ""))


def section(body: Column, heading: str) -> Column:
    """The trimmed text below a `### heading` line up to the next heading; null if it is not there."""
    pattern = rf"(?s)(?:^|\n)### {heading}[ \t]*\r?\n(.*?)(?:\n### |$)"
    return F.when(body.rlike(pattern), F.trim(F.regexp_replace(F.regexp_extract(body, pattern, 1), r"^\s+|\s+$", "")))


def repository_slug(url: Column) -> Column:
    """owner/name in lower case of a repository URL, without .git; null if the URL has no such path."""
    path = r"^https?://[^/]+/([^/\s]+)/([^/\s#?]+?)(?:\.git)?/?(?:[#?].*)?$"
    return F.when(url.rlike(path), F.lower(F.concat_ws("/", F.regexp_extract(url, path, 1), F.regexp_extract(url, path, 2))))


def payload(text: Column, marker: str) -> Column:
    """The JSON text in the last `<!-- marker BASE64 -->` comment, in the usual or the URL-safe alphabet; null if there is none."""
    found = F.regexp_extract_all(text, F.lit(rf"<!-- {marker} ([A-Za-z0-9+/_=-]+) -->"), F.lit(1))
    last = F.try_element_at(found, F.lit(-1))
    return F.try_to_binary(F.translate(last, "-_", "+/"), F.lit("base64")).cast("string")


def markdown_escape(text: Column) -> Column:
    """Text with a backslash before characters that mean something in Markdown tables and emphasis."""
    return F.regexp_replace(text, r"([\\`*_{}\[\]<>|])", r"\\$1")


def sentence(text: Column, limit: int = 500) -> Column:
    """One line of text of at most limit characters that ends in a full stop, question or exclamation mark."""
    line = F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, limit)
    return F.when(line.rlike(r"[.!?]$"), line).otherwise(F.concat(line, F.lit(".")))


def code_blocks(text: Column) -> Column:
    """language and code of every fenced block of a text, in order; an unclosed fence has no block."""
    fence = r"(?s)(?:^|\n)```([A-Za-z0-9+#-]*)[^\n]*\n(.*?)\n```"
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(fence), F.lit(1)).alias("language"), F.regexp_extract_all(text, F.lit(fence), F.lit(2)).alias("code"))


def checklist(text: Column) -> Column:
    """How many items of a Markdown checklist are ticked and how many there are."""
    items = F.regexp_extract_all(text, F.lit(r"(?m)^\s*[-*] \[([ xX])\]"), F.lit(1))
    return F.struct(F.size(F.filter(items, lambda x: F.lower(x) == "x")).alias("done"), F.size(items).alias("all"))


def tags(raw: Column, aliases: dict[str, str | None], most: int = 3) -> Column:
    """At most `most` distinct tags in their order, in lower case with dashes; aliases rename tags, an alias of None drops one."""
    plain = F.filter(F.transform(raw, lambda t: F.regexp_replace(F.regexp_replace(F.lower(F.trim(t)), r"[\s_]+", "-"), r"[^a-z0-9-]", "")), lambda t: t != "")
    if aliases:
        names = F.create_map(*[F.lit(x) for k, v in aliases.items() for x in (k, v or "")])
        plain = F.filter(F.transform(plain, lambda t: F.coalesce(F.try_element_at(names, t), t)), lambda t: t != "")
    return F.slice(F.array_distinct(plain), 1, most)


def full_trim(text: Column) -> Column:
    """Text without white space of any script, line ends and byte-order marks at either end."""
    return F.regexp_replace(text, "(?U)^[\\s\ufeff&&[^\u0085]]+|[\\s\ufeff&&[^\u0085]]+$", "")


def path_segments(path: Column) -> Column:
    """A path with every segment percent-encoded, slashes kept and spaces as %20."""
    return F.array_join(F.transform(F.split(path, "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), "/")


def unfenced(text: Column) -> Column:
    """Text without one code fence around it."""
    return F.regexp_replace(F.trim(text), r"(?s)^```[a-z]*\s*\n(.*?)\n?```$", "$1")


def safe_path(path: Column) -> Column:
    """Whether a path is relative and stays where it is: no leading slash, drive, back slash, zero, and no empty, `.` or `..` step; false for null."""
    steps = F.filter(F.split(path, "/"), lambda s: s.isin("", ".", ".."))
    return F.coalesce(~path.rlike(r"^/|^[A-Za-z]:|\\|\x00") & (F.size(steps) == 0), F.lit(False))


def preferred(values: Column, order: list[str]) -> Column:
    """The element that stands first in order; elements not listed come behind, by name. Null for none."""
    known = F.array(*[F.lit(x) for x in order])
    place = F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: F.struct(F.coalesce(F.nullif(F.array_position(known, v), F.lit(0)), F.lit(len(order) + 1)).alias("p"), v.alias("v")))
    return F.array_min(place)["v"]


def release_tag(tag: Column) -> Column:
    """A release tag if it is a proper one: at most 256 characters, none of them control characters, marks of direction, line separators or halves of pairs; else null."""
    return F.when((F.length(tag).between(1, 256)) & ~tag.rlike(r"[\x{0}-\x{1f}\x{7f}-\x{9f}\x{61c}\x{200e}\x{200f}\x{2028}-\x{202e}\x{2066}-\x{2069}]"), tag)


def pointer_key(pointer: Column) -> Column:
    """The last name of a JSON pointer such as `$.statistics.records`; null if it is none."""
    form = r"^\$(?:\.[A-Za-z_][A-Za-z0-9_]*)*\.([A-Za-z_][A-Za-z0-9_]*)$"
    return F.when(pointer.rlike(form), F.regexp_extract(pointer, form, 1))


def marked_lines(text: Column, marker: str) -> Column:
    """The lines of a text that start with a marker, without it."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda l: F.trim(l)), lambda l: l.startswith(marker))
    return F.transform(lines, lambda l: F.ltrim(F.substring(l, len(marker) + 1, 1 << 30)))
