"""String functions over columns: cleaning, splitting, previews, formats. All of them stay inside the JVM.

Offsets and lengths are code points. `strip` removes Unicode white space at both ends.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and their replacements, applied in this order.
LATEX_STRUCTURE = [
    (r"(?md)%.*$", ""),
    (r"\\section\{([^}]+)\}", "\n\n### SECTION: $1 ###\n\n"),
    (r"\\subsection\{([^}]+)\}", "\n\n### SUBSECTION: $1 ###\n\n"),
    (r"\\ProvidesPackage\{([^}]+)\}", "PACKAGE: $1"),
    (r"\\RequirePackage\{([^}]+)\}", "REQUIRES: $1"),
    (r"\\newcommand\{\\([^}]+)\}", "COMMAND: $1"),
    (r"\\[a-zA-Z]+(\[[^\]]*\])?(\{[^}]*\})?", ""),
    (r"\n(?U)\s*\n", "\n"),
]
LATEX_PLAIN = [
    (r"(?md)%.*$", ""),
    (r"\\begin\{[^}]+\}", ""),
    (r"\\end\{[^}]+\}", ""),
    (r"\\section\{([^}]+)\}", "$1\n"),
    (r"\\subsection\{([^}]+)\}", "$1\n"),
    (r"\\textbf\{([^}]+)\}", "$1"),
    (r"\\textit\{([^}]+)\}", "$1"),
    (r"\\emph\{([^}]+)\}", "$1"),
    (r"\\label\{[^}]+\}", ""),
    (r"\\cite\{[^}]+\}", "[CITATION]"),
    (r"\\ref\{[^}]+\}", "[REFERENCE]"),
    (r"\\usepackage\{[^}]+\}", ""),
    (r"\\documentclass\{[^}]+\}", ""),
    (r"\\[a-zA-Z]+(\[[^\]]*\])?(\{[^}]*\})?", ""),
    (r"\n(?U)\s*\n", "\n\n"),
]
LATEX_MARKS = ("\\documentclass", "\\usepackage", "\\begin{")
STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "is", "are", "was", "were", "of", "with"]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s++|(?<!\s)\s++\z", "")  # tried once a run of white space


def is_blank(text: Column) -> Column:
    return ~F.rlike(text, F.lit(r"(?U)\S"))  # ends at the first character that isn't white space


def replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def clean_latex(text: Column) -> Column:
    """LaTeX to text that keeps sections, packages and new commands as marked lines."""
    return strip(replaced(text, LATEX_STRUCTURE))


def clean_latex_plain(text: Column) -> Column:
    """LaTeX to text that keeps the arguments of formatting commands."""
    return strip(replaced(text, LATEX_PLAIN))


def collapse_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def file_type(text: Column) -> Column:
    latex = F.lit(False)
    for mark in LATEX_MARKS:
        latex = latex | F.contains(text, F.lit(mark))
    return F.when(latex, F.lit("latex")).otherwise(F.lit("plain_text"))


def preview(text: Column, n: int = 50) -> Column:
    """The first n characters; the 50-character form is one line."""
    head = F.substring(text, 1, n)
    return F.translate(head, "\n", " ") if n == 50 else head


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(strip(text), r"(?<=[.!?])(?U)\s+"), strip), lambda s: s != "")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def words(text: Column) -> Column:
    return tokens(F.lower(text))


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def chunk_name(start: Column) -> Column:
    return F.format_string("chunk_%06d", start)


def span_name(start: Column, end: Column) -> Column:
    return F.format_string("chunk_%04d_%04d", start, end)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]+)$", 1))


def truncated(text: Column, n: int, always: bool = False) -> Column:
    cut = F.concat(F.substring(text, 1, n), F.lit("..."))
    return cut if always else F.when(F.length(text) > n, cut).otherwise(text)


def percent(x: Column) -> Column:
    return F.concat(F.call_function("format_number", x * 100, F.lit("0.00")), F.lit("%"))  # rounds the double itself, as C and SQL do, not its shortest decimal


def fixed3(x: Column) -> Column:
    return F.format_string("%.3f", x)
