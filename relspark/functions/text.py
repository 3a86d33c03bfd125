"""Scalar functions on texts, ids and numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Marks that become blanks in definitions.
MARKS = ".;:,?!(){}\"`$%@<>"


def lower(text: Column) -> Column:
    return F.lower(text)


def blank_marks(text: Column) -> Column:
    return F.translate(text, MARKS, " " * len(MARKS))


def plain_quotes(text: Column) -> Column:
    """Apostrophes stay only between word characters; others, and double hyphens, become blanks."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?<!\w)'", " "), r"'(?!\w)", " "), "--", " ")


def one_blank(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean(text: Column) -> Column:
    """A definition as words: marks blanked, quotes plain, blanks single, lower case."""
    return F.lower(one_blank(plain_quotes(blank_marks(text))))


def definition(gloss: Column) -> Column:
    """The gloss up to its first double quote."""
    return F.substring_index(gloss, '"', 1)


def examples(gloss: Column) -> Column:
    """All quoted parts of the gloss."""
    return F.regexp_extract_all(gloss, F.lit('"([^"]*)"'), F.lit(1))


def join_numbers(text: Column) -> Column:
    """Neighbouring numbers become one."""
    return F.regexp_replace(text, r"(?<=[0-9])\s+(?=[0-9])", "")


def corpus_words(text: Column) -> Column:
    """Corpus text as lower-case words and numbers, one blank between them."""
    return F.trim(join_numbers(F.regexp_replace(F.regexp_replace(F.lower(text), "'", ""), "[^a-z0-9]+", " ")))


def vector_words(text: Column, fold_case: bool = True) -> Column:
    """Text for word vectors. Without fold_case capitals are lost, as the reference loses them."""
    kept = F.lower(text) if fold_case else text
    return F.trim(F.regexp_replace(F.regexp_replace(kept, "'", ""), "[^a-z0-9]+", " "))


def words(text: Column) -> Column:
    """The words between blanks; none for an empty text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def pad_id(id_: Column) -> Column:
    """Eight digits or more."""
    return F.when(F.length(id_.cast("string")) < 8, F.lpad(id_.cast("string"), 8, "0")).otherwise(id_.cast("string"))


def offset_pos(id_: Column, pos: Column) -> Column:
    return F.concat(id_.cast("string"), pos)


def trimmed_decimal(x: Column, digits: int = 4) -> Column:
    """Rounded, without zeros at the end."""
    return F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", x), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def lexicon_hash(sizes: Column) -> Column:
    """SHA-1 in unpadded base 64 of the file sizes joined by points; sizes is an array of them."""
    return F.rtrim(F.base64(F.unhex(F.sha1(F.array_join(F.transform(sizes, lambda s: s.cast("string")), ".")))), F.lit("="))


def pair_random(a: Column, b: Column, top: float = 1.0) -> Column:
    """A number from 0 to top with three decimals, always the same for a pair. From the first 13
    hexadecimal digits of an MD5 hash, which every engine computes alike."""
    return F.round(F.conv(F.substring(F.md5(F.concat_ws("|", a, b)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52)) * F.lit(top), 3)
