"""Text operators as column expressions: front matter, dates, slugs, markup, tokens, guards and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def front_matter(raw: Column | str) -> Column:
    """Map of lower-cased keys to trimmed values from a leading block between lines of "---"; null without one."""
    block = F.regexp_extract(F.regexp_replace(_c(raw), "^﻿", ""), r"(?s)^---\n(.*?)---", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: F.instr(x, ":") > 0)
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("v")))
    # the last of equal keys holds
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda y: y["k"] == x["k"]))
    return F.when(_c(raw).rlike(r"(?s)^﻿?---\n.*?---"), F.map_from_entries(last))


def body(raw: Column | str) -> Column:
    """The text after the front matter, trimmed."""
    return F.trim(F.regexp_replace(_c(raw), r"(?s)^﻿?---\n.*?---", ""))


def tag_list(value: Column) -> Column:
    """[a, "b"] as an array of trimmed names without quotes."""
    inner = F.regexp_extract(value, r"^\[(.*)\]$", 1)
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")), lambda x: x != "")


def typed_kind(value: Column) -> Column:
    """How a value reads: list, boolean, integer or string."""
    return F.when(value.rlike(r"^\[.*\]$"), "list").when(F.lower(value).isin("true", "false"), "boolean").when(value.rlike(r"^-?[0-9]+$"), "integer").otherwise("string")


def parse_date(v: Column | str) -> Column:
    """YYYY-MM as the month's first day, else the first ten characters as YYYY-MM-DD; null if that is no date."""
    v = _c(v)
    return F.when(F.length(v) == 7, F.try_to_date(F.concat(v, F.lit("-01")), "yyyy-MM-dd")).otherwise(F.try_to_date(F.left(v, F.lit(10)), "yyyy-MM-dd"))


def month_label(d: Column) -> Column:
    return F.date_format(d, "MMMM yyyy")


def slugify(t: Column | str) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(_c(t)), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("untitled"))


#: One token of a line: code, image, link, bold (which may hold single stars), italics by stars or underscores, a run
#: without marks, or a lone mark.
_MARKS = r"(?s)`[^`]+`|!?\[[^\]]*\]\([^)]*\)|\*\*.+?\*\*|(?<!\*)\*(?!\*).+?(?<!\*)\*(?!\*)|(?<!_)_(?!_).+?(?<!_)_(?!_)|[^`!\[*_]+|."


def inline_markup(t: Column | str) -> Column:
    """One line's tokens, each written by its kind: what is in code stays as it is."""
    between = lambda x, left, right: F.substr(x, F.lit(left + 1), F.length(x) - left - right)
    tag = lambda name, inner: F.concat(F.lit(f"<{name}>"), inner, F.lit(f"</{name}>"))

    def written(x: Column) -> Column:
        name, target = F.regexp_extract(x, r"(?s)\[([^\]]*)\]", 1), F.regexp_extract(x, r"(?s)\(([^)]*)\)$", 1)
        link = F.concat(F.lit('<a href="'), target, F.lit('">'), name, F.lit("</a>"))
        image = F.concat(F.lit('<img src="'), target, F.lit('" alt="'), name, F.lit('">'))
        out = F.when(F.length(x) == 1, x).when(x.startswith("`"), tag("code", between(x, 1, 1))).when(x.startswith("!["), image)
        return out.when(x.startswith("["), link).when(x.startswith("**"), tag("strong", between(x, 2, 2))).when(x.startswith("*") | (x.startswith("_")), tag("em", between(x, 1, 1))).otherwise(x)

    return F.array_join(F.transform(F.regexp_extract_all(_c(t), F.lit(_MARKS), F.lit(0)), written), "")


def escape_html(t: Column | str, marks: str = "&<>\"'") -> Column:
    """Replace the given marks by entities, ampersands first."""
    entities = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#039;"}
    out = _c(t)
    for m in sorted(marks, key="&<>\"'".index):
        out = F.replace(out, F.lit(m), F.lit(entities[m]))
    return out


def mentions(t: Column | str) -> Column:
    return F.regexp_extract_all(_c(t), F.lit(r"@(\w+)"), F.lit(1))


def link_mentions(t: Column | str) -> Column:
    return F.regexp_replace(_c(t), r"@(\w+)", '<a href="/users/$1">@$1</a>')


def words(t: Column | str) -> Column:
    """Distinct runs of a-z of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_c(t)), F.lit("[a-z]+"), F.lit(0)))


def neighbours(t: Column | str) -> Column:
    """Neighbours w1_w2 of all those runs, repeated ones too."""
    w = F.regexp_extract_all(F.lower(_c(t)), F.lit("[a-z]+"), F.lit(0))
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat_ws("_", a, b))


def bigrams(t: Column | str) -> Column:
    """Distinct neighbours w1_w2 of those runs."""
    return F.array_distinct(neighbours(t))


def split_words(t: Column | str) -> Column:
    return F.filter(F.split(_c(t), r"\s+"), lambda x: x != "")


def characters(t: Column | str) -> Column:
    return F.filter(F.split(_c(t), ""), lambda x: x != "")


def measure(t: Column | str, width: int = 8, height: int = 16) -> Column:
    """(width, height) of a text set in a fixed font: its whole length by the glyph's width, its lines by the height."""
    return F.struct((F.length(_c(t)) * width).alias("width"), (F.size(F.split(_c(t), "\n")) * height).alias("height"))


def allowed_prefix(t: Column | str, prefixes: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(_c(t), p))


def ellipsis(t: Column | str, n: int) -> Column:
    return F.when(F.length(_c(t)) > n, F.concat(F.left(_c(t), F.lit(n)), F.lit("..."))).otherwise(_c(t))


def first_lines(t: Column | str, n: int = 30) -> Column:
    """The first n lines, and a note on how many are left out."""
    lines = F.split(_c(t), "\n")
    head = F.array_join(F.slice(lines, 1, n), "\n")
    return F.when(F.size(lines) > n, F.concat(head, F.lit("\n... ("), (F.size(lines) - n).cast("string"), F.lit(" more lines)"))).otherwise(head)


def age_label(seconds: Column) -> Column:
    return F.when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m"))).when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d")))


def display_name(display: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(display), F.lit("")), name)


def initials(name: Column) -> Column:
    return F.upper(F.left(name, F.lit(2)))


def card(title: Column, text: Column) -> Column:
    return F.concat(F.lit("## "), title, F.lit("\n"), F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit("(empty)")))


def join_nonblank(parts: Column, sep: str = ", ") -> Column:
    return F.array_join(F.filter(parts, lambda x: F.trim(x) != ""), sep)


def seed_hash(t: Column | str) -> Column:
    """SHA-256 of a text modulo 2 to the 32."""
    return F.conv(F.right(F.sha2(_c(t), 256), F.lit(8)), 16, 10).cast("bigint")


def rolling_hash(t: Column | str) -> Column:
    """h = h * 31 + code point, modulo 2 to the 32, over ASCII texts."""
    return F.aggregate(characters(t), F.lit(0).cast("bigint"), lambda h, c: F.pmod(h * 31 + F.ascii(c), F.lit(4294967296)))


def join_url(base: Column, path: Column) -> Column:
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), F.ltrim(path, F.lit("/")))


def query_map(url: Column | str) -> Column:
    """The query string of a URL as a map."""
    q = F.regexp_extract(_c(url), r"\?([^#]*)", 1)
    return F.when(q != "", F.str_to_map(q, F.lit("&"), F.lit("=")))
