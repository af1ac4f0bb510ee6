"""Text as column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Corrections.
LIGATURES = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))
SINGLES = ("‘’“”—–­", "''\"\"--")
WORDS = {
    "eng": {"tbe": "the", "tlie": "the", "arid": "and", "lias": "has", "liave": "have", "witli": "with", "wliich": "which"},
    "spa": {"quc": "que", "cstc": "este", "csta": "esta", "dcl": "del", "csto": "esto"},
}
LATEX = {
    "\\": r"\textbackslash{}", "{": r"\{", "}": r"\}", "$": r"\$", "&": r"\&", "%": r"\%", "#": r"\#", "_": r"\_", "^": r"\^{}", "~": r"\~{}",
}
WHITE = r"\p{IsWhite_Space}+"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no such function."""
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def collapse(text: Column) -> Column:
    """Every run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def sequences(text: Column) -> Column:
    """Ligatures and typographic characters in plain letters."""
    for a, b in LIGATURES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.translate(text, *SINGLES)


def mapping(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def corrected(text: Column, language: str) -> Column:
    """``sequences``, then whole words of the language's list; other languages keep their white space."""
    text = sequences(text)
    if language not in WORDS:
        return text
    table = mapping(WORDS[language])
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, F.lower(w)), w)), " ")


def cleaned(text: Column, normalize: bool = True, spaces: bool = True, dictionary: bool = False, language: str = "spa") -> Column:
    if normalize:
        text = nfc(text)
    if spaces:
        text = collapse(text)
    return corrected(text, language) if dictionary else text


def repeat_key(text: Column) -> Column:
    """Text that headers of different pages share: lower case, digits as #, separators as blanks, no other marks."""
    kept = F.regexp_replace(F.lower(text), r"[^\p{IsAlphabetic}\p{N}\p{IsWhite_Space}\-–—_/:]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(kept, "[0-9]", "#"), r"[\p{IsWhite_Space}\-–—_/:]+", " "))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer text, in single precision."""
    longer = F.greatest(F.length(a), F.length(b)).cast("float")
    part = F.lit(1).cast("float") - (F.levenshtein(a, b).cast("float") / longer).cast("float")
    return F.when(a == b, F.lit(1.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(part).cast("float")


def escape_latex(text: Column) -> Column:
    """The ten special characters, each replaced once."""
    table = mapping(LATEX)
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")


def plain_table(table: Column) -> Column:
    """Cells joined by tabs, every row ended by a line feed."""
    return F.array_join(F.transform(table["rows"], lambda r: F.concat(F.array_join(F.transform(r, lambda c: c["content"]), "\t"), F.lit("\n"))), "")


def markdown_table(table: Column) -> Column:
    """Rows between bars; dashes after the header row (the first index, 0 without one); empty without rows."""
    rows = table["rows"]
    header = F.least(F.coalesce(F.get(table["header_row_indices"], F.lit(0)), F.lit(0)), F.size(rows) - 1)
    bar = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: c["content"]), " | "), F.lit(" |"))
    dash = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.lit("---")), " | "), F.lit(" |"))
    lines = F.transform(rows, lambda r, i: F.when(i == header, F.concat(bar(r), F.lit("\n"), dash(r), F.lit("\n"))).otherwise(F.concat(bar(r), F.lit("\n"))))
    return F.when(F.size(rows) <= 0, F.lit("")).otherwise(F.array_join(lines, ""))


@F.pandas_udf(StringType())
def winansi_hex(text: pd.Series) -> pd.Series:
    """The text as a hexadecimal string in cp1252: characters outside it lose their marks, else become ?."""

    def one(c: str) -> bytes:
        for form in (c, "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))):
            try:
                if form:
                    return form.encode("cp1252")
            except UnicodeEncodeError:
                pass
        return b"?"

    return text.map(lambda t: None if t is None else b"".join(map(one, t)).hex().upper())
