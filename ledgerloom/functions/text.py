"""Text expressions, all of them built in and null-safe: null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import rules

# Function words that the lexical index leaves out; bare digits that count as evidence.
STOP = "a an the of is are was were be been for to in on at by with and or what which how do does did i my me it its this that these those can could would should shall will may might must you your we our they their he she his her please tell know give get if so no not any some more most".split()
CARRY = ("2", "3", "4", "5", "10")
TERMINAL = (".", "!", "?")


def words(text: Column) -> Column:
    """Runs of non-space characters."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def squeeze(text: Column) -> Column:
    """White space collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def collapse_line(text: Column) -> Column:
    """Spaces and tabs within a line collapsed; line ends stay."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\f\x0b]+", " "))


def heading(text: Column) -> Column:
    return F.trim(F.regexp_replace(collapse_line(text), ":+$", ""))


def tokens(text: Column) -> Column:
    """Lower-case alphanumeric tokens of two characters or more, without stop words; repeats stay.

    ``isin`` with this many values is a look-up in a set.
    """
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), 0), lambda t: ~t.isin(*STOP))


def sentences(text: Column) -> Column:
    """Split after a terminal mark before a capital, figure or rupee sign; blanks dropped."""
    parts = F.split(F.trim(text), "(?U)(?<=[.!?])\\s+(?=[A-Z0-9₹])")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def strip_urls(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"https?://\S+|www\.\S+", " "), r"(?U)\s{2,}", " "))


def cap_sentences(text: Column, most: int) -> Column:
    """The first sentences; a text with few enough keeps its own spacing."""
    parts = sentences(text)
    return F.when(F.size(parts) > most, F.array_join(F.slice(parts, 1, most), " ")).otherwise(text)


def tidy_tail(text: Column) -> Column:
    """Drops reference lead-ins left at the end, however many; then exactly one terminal mark."""
    lead_in = rules.DANGLING.removeprefix("(?i)").removesuffix("$")
    cut = F.trim(F.regexp_replace(F.trim(text), rules.java(f"(?i)(?:{lead_in})+$"), ""))
    cut = F.regexp_replace(cut, "[ ,;:-]+$", "")
    return F.when(cut == "", cut).when(F.right(cut, F.lit(1)).isin(*TERMINAL), cut).otherwise(F.concat(cut, F.lit(".")))


def numbers(text: Column) -> Column:
    """Distinct numbers without commas; a bare digit counts only if it is in the carry set."""
    found = F.regexp_extract_all(text, F.lit(r"(?U)\d[\d,]*(?:\.\d+)?"), 0)
    facts = F.filter(found, lambda n: (F.length(n) > 1) | n.isin(*CARRY))
    return F.array_distinct(F.transform(facts, lambda n: F.replace(n, F.lit(","), F.lit(""))))


def ascii_citations(text: Column) -> Column:
    return F.regexp_replace(text, "【(\\d+)】", "[$1]")


def citations(text: Column) -> Column:
    """Numbers of the references in the text, in order."""
    return F.transform(F.regexp_extract_all(ascii_citations(text), F.lit(r"\[(\d+)\]"), 1), lambda n: n.cast("int"))


def strip_references(text: Column) -> Column:
    out = F.regexp_replace(ascii_citations(text), r"\[\d+\]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?U)\s+\.", "."), r"\.\.(?!\.)", "."))


def grounded(answer: Column, contexts: Column) -> Column:
    """True if every number of the answer is in one of the context texts."""
    seen = F.flatten(F.transform(contexts, numbers))
    return F.size(F.array_except(numbers(answer), seen)) == 0


def normal(text: Column) -> Column:
    """For substring checks of facts: lower case, white space collapsed, commas out."""
    return F.replace(squeeze(F.lower(text)), F.lit(","), F.lit(""))


def row_id(url: Column, section: Column, text: Column) -> Column:
    """16 hexadecimal digits of the row's content."""
    return F.substring(F.sha2(F.concat_ws("|", url, section, text), 256), 1, 16)
