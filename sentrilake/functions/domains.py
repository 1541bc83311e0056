"""Tests for machine-generated domain names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_label(domain: Column) -> Column:
    return F.substring_index(domain, ".", 1)


def text_entropy(text: Column) -> Column:
    """Shannon entropy in bits over the UTF-8 bytes of a short text.

    Two hex digits stand for one byte. The distinct bytes are few, so this stays
    a row-local expression.
    """
    hexed = F.hex(F.encode(text, "UTF-8"))
    size = F.octet_length(text).cast("double")
    # "4142" -> "41 42 ": a byte value can then be counted without overlap.
    spaced = F.regexp_replace(hexed, "(..)", "$1 ")
    byte_values = F.array_distinct(F.split(F.rtrim(spaced), " "))

    def term(byte: Column) -> Column:
        count = F.length(spaced) - F.length(F.replace(spaced, F.concat(byte, F.lit(" "))))
        share = (count / 3) / size
        return share * F.log2(share)

    total = F.aggregate(byte_values, F.lit(0.0), lambda acc, byte: acc - term(byte))
    return F.when(text == "", F.lit(0.0)).otherwise(total)


def domain_entropy(domain: Column) -> Column:
    return text_entropy(first_label(domain))


def is_likely_dga(domain: Column) -> Column:
    """True if the first label looks machine-generated."""
    label = F.lower(first_label(domain))
    size = F.octet_length(label)
    entropy = text_entropy(label)

    def count(outside: str) -> Column:
        return F.length(F.regexp_replace(label, outside, ""))

    digits = count("[^0-9]")
    vowels = count("[^aeiou]")
    consonants = count(r"[^\p{IsAlphabetic}]") - vowels
    return (size >= 8) & (
        ((entropy > 3.65) & (vowels / size < 0.18))
        | ((digits > 5) & (entropy > 3.2))
        | ((consonants > 9) & (vowels <= 1))
    )
