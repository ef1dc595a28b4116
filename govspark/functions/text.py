"""Text cleanup and text tests as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"

# Bounds of the meaningful-text test.
MIN_TEXT, MAX_TEXT, MIN_WORDS, MIN_DISTINCT_CHARS = 10, 5000, 3, 5

# Named markdown patterns, in order of report; dot matches line ends, ^ matches at each line.
MARKDOWN_PATTERNS = [
    ("Bold markdown (**text**)", r"\*\*.*?\*\*"),
    ("Italic markdown (*text*)", r"\*.*?\*(?!\*)"),
    ("Bold markdown (__text__)", r"__.*?__"),
    ("Italic markdown (_text_)", r"_.*?_(?!_)"),
    ("Headers (# ## ###)", r"^#{1,6}\s"),
    ("Code blocks (```code```)", r"```.*?```"),
    ("Inline code (`code`)", r"`.*?`"),
    ("Links ([text](url))", r"\[.*?\]\(.*?\)"),
    ("Arrow symbols (->)", r"->"),
    ("Bullet symbols (•)", r"•"),
    ("Strikethrough (~~text~~)", r"~~.*?~~"),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def is_meaningful(text: Column) -> Column:
    """Running text: not too short or long, at least three words, not only digits or punctuation, not a link."""
    body = strip(text)
    distinct_chars = F.size(F.array_distinct(F.split(F.replace(body, F.lit(" "), F.lit("")), "")))
    return (
        F.length(body).between(MIN_TEXT, MAX_TEXT)
        & ~body.rlike(r"^[0-9\-\s.,:;]+$")
        & (word_count(body) >= MIN_WORDS)
        & ~body.startswith("http")
        & (distinct_chars >= MIN_DISTINCT_CHARS)
    )


def truncated(text: Column, limit: int, suffix: str) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(suffix))).otherwise(text)


def content_preview(text: Column, limit: int = 200, keep_markdown: bool = True) -> Column:
    """The first characters with a mark where text was cut; empty for missing text."""
    body = F.coalesce(text, F.lit(""))
    if not keep_markdown:
        body = F.regexp_replace(body, r"[#*]", "")
    return strip(truncated(body, limit, "..."))


def format_epoch(seconds: Column) -> Column:
    """Epoch seconds as text in UTC; zero and null have no date."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    shown = (epoch + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))).cast("string")
    return F.when(seconds.isNull() | (seconds == 0), F.lit("Unknown date")).otherwise(shown)


def keep_allowed_images(text: Column, allowed_host: str) -> Column:
    """Drops every line that shows an image from another place than ``allowed_host``."""
    image = r"!\[[^\]]*\]\([^)]+\)"
    kept = F.filter(
        lines(text),
        lambda line: ~F.exists(
            F.regexp_extract_all(line, F.lit(rf"({image})"), F.lit(1)),
            lambda shown: ~F.contains(F.regexp_extract(shown, r"\]\(([^)]+)\)", 1), F.lit(allowed_host)),
        ),
    )
    return F.array_join(kept, "\n")


def strip_markup(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("**"), F.lit("")), F.lit("-"), F.lit(""))


def markdown_matches(text: Column, samples: int = 3) -> Column:
    """Array of (issue, matches, samples) for every pattern that occurs."""
    found = []
    for issue, pattern in MARKDOWN_PATTERNS:
        regex = F.lit(f"(?ms)({pattern})")
        every = F.regexp_extract_all(text, regex, F.lit(1))
        found.append(
            F.struct(
                F.lit(issue).alias("issue"),
                F.size(every).alias("matches"),
                F.slice(every, 1, samples).alias("samples"),
            )
        )
    return F.filter(F.array(*found), lambda f: f["matches"] > 0)


def approx_tokens(text: Column) -> Column:
    """Four characters per token, rounded down."""
    return F.floor(F.length(text) / 4)


def result_line(columns: list[str], limit: int = 2000) -> Column:
    """``Key: value`` pairs of a row; keys in title case, long texts cut, empty fields left out."""
    fields = []
    for name in columns:
        value = truncated(F.col(name).cast("string"), limit, "... [truncated]")
        shown = F.concat(F.lit(f"{name.replace('_', ' ').title()}: "), value)
        fields.append(F.when(value.isNotNull() & (strip(value) != "") & (value != "None"), shown))
    return F.concat_ws(", ", *fields)
