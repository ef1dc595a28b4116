"""Documents out of text files, JSON documents and proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark.functions.links import NETWORKS
from govspark.functions.text import let, lines, strip
from govspark.operators.ordered import positions, running

# Header marks, the separator line, the number of lines and topics that are read.
TITLE, URL, TYPE, DESCRIPTION = "Title: ", "URL: ", "Type: ", "Description: "
SEPARATOR = "======="
HEADER_LINES, MAX_TOPICS = 10, 10

#: Characters of one part of a combined document.
PART_CHARS = 1_000_000


def _value(line: Column, mark: str) -> Column:
    return strip(F.replace(line, F.lit(mark), F.lit("")))


def _line(all_lines: Column, i: int) -> Column:
    return F.get(all_lines, F.lit(i))


def _rest(all_lines: Column, start: Column) -> Column:
    """Lines after the first ``start`` ones, joined and stripped."""
    return strip(F.array_join(F.slice(all_lines, start + 1, F.size(all_lines)), "\n"))


def _first(all_lines: Column, test) -> Column:
    """1-based number of the first line that passes; 0 where none does."""
    return F.array_position(F.transform(all_lines, test), F.lit(True)).cast("int")


def fixed_header(text: Column) -> Column:
    """Header marks in fixed lines; the body follows a separator line, else the first blank line."""
    return let(lines(text), _fixed_fields)


def _fixed_fields(rows: Column) -> Column:
    third, fourth = _line(rows, 2), _line(rows, 3)
    has_type = third.startswith(TYPE)
    separator, blank = _first(rows, lambda r: F.contains(r, F.lit(SEPARATOR))), _first(rows, lambda r: strip(r) == "")
    return F.struct(
        F.when(_line(rows, 0).startswith(TITLE), _value(_line(rows, 0), TITLE)).alias("title"),
        F.when(_line(rows, 1).startswith(URL), _value(_line(rows, 1), URL)).alias("url"),
        F.when(has_type, _value(third, TYPE)).alias("type"),
        F.when(third.startswith(DESCRIPTION), _value(third, DESCRIPTION))
        .when(has_type & fourth.startswith(DESCRIPTION), _value(fourth, DESCRIPTION)).alias("description"),
        _rest(rows, F.when(separator > 0, separator).otherwise(blank)).alias("content"),
    )


def free_header(text: Column, stem: Column) -> Column:
    """Header marks in any order in the first lines; a rule or a blank line ends them; the stem is the spare title."""
    def split_head(rows: Column) -> Column:
        head = F.slice(rows, 1, HEADER_LINES)
        end = _first(head, lambda r: strip(r).isin("", "---"))
        return F.struct(rows.alias("rows"), head.alias("head"), end.alias("end"))

    return let(let(lines(text), split_head), lambda parts: _free_fields(parts["rows"], parts["head"], parts["end"], stem))


def _free_fields(rows: Column, head: Column, end: Column, stem: Column) -> Column:
    scanned = F.when(end > 0, F.slice(head, 1, F.greatest(end - 1, F.lit(0)))).otherwise(head)

    def found(mark: str) -> Column:
        return _value(F.try_element_at(F.filter(scanned, lambda r: r.startswith(mark)), F.lit(-1)), mark)

    def marked(row: Column, i: Column) -> Column:
        is_header = row.startswith(TITLE) | row.startswith(URL) | row.startswith(TYPE) | row.startswith(DESCRIPTION)
        return F.when(is_header, i + 1).otherwise(0)

    last = F.coalesce(F.array_max(F.transform(scanned, marked)), F.lit(0))
    return F.struct(
        F.coalesce(found(TITLE), stem).alias("title"),
        found(URL).alias("url"),
        found(TYPE).alias("type"),
        found(DESCRIPTION).alias("description"),
        _rest(rows, F.when(end > 0, end).otherwise(last)).alias("content"),
    )


JSON_DOCUMENT = (
    "title string, url string, description string, content string, content_type string, site_type string, "
    "topics array<struct<title:string>>"
)


def json_document(json_text: Column) -> Column:
    """Content and metadata of a JSON document."""
    doc = F.from_json(json_text, JSON_DOCUMENT)
    topics = F.transform(F.slice(doc["topics"], 1, MAX_TOPICS), lambda t: F.concat(F.lit("- "), F.coalesce(t["title"], F.lit("")), F.lit("\n")))
    content = F.concat_ws(
        "\n\n",
        F.concat(F.lit(TITLE), doc["title"]),
        F.concat(F.lit(DESCRIPTION), doc["description"]),
        F.when(doc["content"] != "", doc["content"]),
        F.when(F.size(doc["topics"]) > 0, F.concat(F.lit("Related Topics:\n"), F.array_join(topics, ""))),
    )
    return F.struct(
        content.alias("content"),
        F.coalesce(doc["title"], F.lit("")).alias("title"),
        F.coalesce(doc["url"], F.lit("")).alias("url"),
        F.coalesce(doc["content_type"], doc["site_type"], F.lit("unknown")).alias("content_type"),
    )


def proposal_documents(items: DataFrame, file: str) -> DataFrame:
    """Proposals as documents: title, content, proposer, status and hash, for files of a known network."""
    name = F.lower(F.col(file))
    network = F.when(F.lit(False), F.lit(""))
    for known in NETWORKS:
        network = network.when(name.startswith(f"{known}_"), known)
    has_chain = F.coalesce("proposer", "status", "hash").isNotNull()

    def labelled(label: str, column: str) -> Column:
        return F.when(F.col(column) != "", F.concat(F.lit(f"{label}: "), F.col(column)))

    content = F.concat_ws(
        "\n\n",
        labelled("Title", "title"),
        F.when(F.col("content") != "", F.col("content")),
        F.when(has_chain, F.lit("\nOn-chain Information:")),
        labelled("Proposer", "proposer"),
        labelled("Status", "status"),
        labelled("Hash", "hash"),
    )
    documents = items.withColumn("network", network).withColumn("content", content)
    return documents.where(F.col("network").isNotNull() & (strip(F.col("content")) != ""))


def text_before_json(files: DataFrame) -> DataFrame:
    """Drops the JSON form of a file where a text form lies beside it."""
    texts = files.where(F.col("extension") == "txt").select("folder", "stem")
    kept = files.where(F.col("extension") == "json").join(texts, ["folder", "stem"], "left_anti")
    return files.where(F.col("extension") == "txt").unionByName(kept)


def file_pieces(files: DataFrame, group: str, order: str, title: str, content: str) -> DataFrame:
    """(group, order, piece): every file that is not blank, behind a blank line and its title."""
    piece = F.concat(F.lit("\n\n--- FILE: "), F.col(title), F.lit(" ---\n"), F.col(content))
    return files.where(strip(F.col(content)) != "").select(group, order, piece.alias("piece"))


def combined_pieces(files: DataFrame, order: str, title: str, content: str, group: str | None = None) -> DataFrame:
    """A combined document as ordered pieces: one row per file with its place, whatever the size of the document.

    Without a group all files make one document.
    """
    name = group or "_all"
    grouped = files if group else files.withColumn(name, F.lit(0))
    numbered = positions(file_pieces(grouped, name, order, title, content), [name], [order], "position")
    return numbered.select(*([group] if group else []), "position", "piece")


def combine_by_group(files: DataFrame, group: str, order: str, title: str, content: str, part_chars: int = PART_CHARS) -> DataFrame:
    """All files of a group as one document, in parts.

    A document of a large group would not fit one row, so it comes as numbered parts whose texts, joined by line
    breaks in order, are the document. A part holds about ``part_chars`` characters and never cuts a file.
    """
    pieces = file_pieces(files, group, order, title, content)
    measured = running(pieces, [group], [order], {"end": F.length("piece") + F.lit(1)})
    start = F.col("end") - F.length("piece") - 1
    return (
        measured.withColumn("part", F.floor(start / part_chars))
        .groupBy(group, "part")
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "piece"))), lambda p: p["piece"]), "\n").alias("content"),
            F.count(F.lit(1)).alias("file_count"),
        )
    )
