"""Lines, sections, blocks, sentences and clauses as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where lines, sentences and clauses end, list marks, and what similarity ignores.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
SENTENCE_END = r"[。！？!?；;\n]+"
CLAUSE_END = r"[，、,]"
BULLET = r"(?U)^\s*(?:[-*•]|\d+[.、)]|\[[ xX]\])\s*"
PUNCTUATION = r"(?U)[，。；：、！？“”\"'（）()《》【】\s\-—…]+"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def cn_len(x: Column) -> Column:
    """Characters that are not blank."""
    return F.length(F.regexp_replace(x, r"(?U)\s+", ""))


def pieces(x: Column, pattern: str, least: int) -> Column:
    """Stripped pieces of at least ``least`` characters."""
    return F.filter(F.transform(F.split(x, pattern), strip), lambda p: F.length(p) >= least)


def sentences_of(x: Column) -> Column:
    return pieces(x, SENTENCE_END, 4)


def clauses_of(x: Column) -> Column:
    return pieces(x, CLAUSE_END, 3)


def normalize(x: Column) -> Column:
    return F.lower(strip(F.regexp_replace(x, PUNCTUATION, "")))


def unbullet(x: Column) -> Column:
    return F.regexp_replace(x, BULLET, "")


def flat(x: Column) -> Column:
    """The text with every line stripped and ended by a line feed; a null text is empty."""
    return F.array_join(F.transform(F.split(F.coalesce(x, F.lit("")), LINE_END), strip), "\n")


def _sections(flat_text: Column) -> Column:
    """Array of (section, headed, body): the parts of a flat text that start at its headings; ``body`` has the
    lines below the heading."""

    def part(p: Column) -> Column:
        lines = F.split(p, "\n")
        named = strip(F.regexp_replace(F.get(lines, F.lit(0)), "^[# ]+", ""))
        headed = p.startswith("#")
        body = F.when(headed, F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))).otherwise(lines)
        return F.struct(F.when(headed, named).otherwise("").alias("section"), headed.alias("headed"), body.alias("body"))

    return F.transform(F.split(flat_text, r"\n(?=#)"), part)


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, heading, section) of docs(doc_id, text), headings and blank lines included.

    ``section`` is the last heading above the line, empty before the first. All is worked out inside a document's
    row; nothing is shuffled.
    """

    def rows(p: Column) -> Column:
        head = F.when(p["headed"], F.array(F.struct(F.concat(F.lit("# "), p["section"]).alias("line"), p["section"].alias("heading"), p["section"].alias("section"))))
        body = F.transform(p["body"], lambda x: F.struct(x.alias("line"), F.lit(None).cast("string").alias("heading"), p["section"].alias("section")))
        return F.concat(F.coalesce(head, F.array().cast("array<struct<line:string,heading:string,section:string>>")), body)

    every = F.flatten(F.transform(_sections(flat(F.col("text"))), rows))
    return docs.select("doc_id", F.posexplode(every).alias("line_no", "r")).select("doc_id", "line_no", "r.*")


def title_of(flat_text: Column, has_title_word) -> Column:
    """The first line that is not blank or a heading, if it is short, no sentence and holds a title word
    (``has_title_word``, a function of the line); else empty."""
    line = F.regexp_extract(flat_text, r"(?m)^[^#\n][^\n]*", 0)
    fits = (F.length(line) <= 24) & ~line.rlike("[。！？!?；;]") & has_title_word(line)
    return F.when(fits, line).otherwise("")


def blocks_of(flat_text: Column) -> Column:
    """Array of (section, block): runs of lines between headings and blank lines."""

    def rows(p: Column) -> Column:
        found = F.filter(F.split(F.array_join(p["body"], "\n"), r"\n{2,}"), lambda b: b.rlike(r"[^\n]"))
        return F.transform(found, lambda b: F.struct(p["section"].alias("section"), F.regexp_replace(b, r"^\n+|\n+$", "").alias("block")))

    return F.flatten(F.transform(_sections(flat_text), rows))


def sentences_in(flat_text: Column, of_line) -> Column:
    """Array of (section, mark, s): the sentences of all lines that are no headings, in order; ``mark`` is
    what ``of_line`` makes of a sentence's line."""

    def of(section: Column, line: Column) -> Column:
        mark = F.array(F.struct(of_line(line).alias("mark")))
        # The mark is worked out once for a line: it enters the inner function as an element.
        return F.flatten(F.transform(mark, lambda m: F.transform(sentences_of(line), lambda s: F.struct(section.alias("section"), m["mark"].alias("mark"), s.alias("s")))))

    def rows(p: Column) -> Column:
        return F.flatten(F.transform(F.filter(p["body"], lambda x: x != ""), lambda x: of(p["section"], x)))

    return F.flatten(F.transform(_sections(flat_text), rows))
