"""TLS client fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fingerprints of known attack tools.
KNOWN_BAD_FINGERPRINTS = {
    "a0e9f5d64349fb13191bc781f81f42e1": "Cobalt Strike Default Malleable C2",
    "72a589da586844d7f0818ce684948eea": "Metasploit Meterpreter Reverse HTTPS",
    "4d7a28d6f22da2d8e907d722d427d14d": "Emotet Banking Trojan TLS Payload",
    "e7d705a3286e19ea42f587b344ee6865": "Sliver C2 Implant Framework",
}


def ja3_string(
    version: Column, ciphers: Column, extensions: Column, curves: Column, formats: Column
) -> Column:
    """Comma-joined fields, lists joined by dashes; an empty list leaves a gap."""

    def dashed(numbers: Column) -> Column:
        return F.array_join(F.transform(numbers, lambda n: n.cast("string")), "-")

    return F.concat_ws(
        ",",
        version.cast("string"),
        *[F.coalesce(dashed(c), F.lit("")) for c in (ciphers, extensions, curves, formats)],
    )


def ja3_hash(
    version: Column, ciphers: Column, extensions: Column, curves: Column, formats: Column
) -> Column:
    """MD5 of the JA3 string, as in the public JA3 definition."""
    return F.md5(ja3_string(version, ciphers, extensions, curves, formats))


def known_threat(fingerprint: Column) -> Column:
    """Name of the tool with this fingerprint, null if it is not listed."""
    table = F.create_map(*[F.lit(x) for pair in KNOWN_BAD_FINGERPRINTS.items() for x in pair])
    return F.try_element_at(table, F.lower(fingerprint))
