"""Hashing, pseudonyms, text cleaning and report sentences."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerscope import constants as C
from ledgerscope.functions.vectors import top_features


def _key_block(key: str) -> bytes:
    raw = key.encode()
    if len(raw) > 64:
        raw = hashlib.sha256(raw).digest()
    return raw.ljust(64, b"\0")


def hmac_sha256(value: Column, key: str) -> Column:
    """Keyed SHA-256 as hex: two built-in digests over the padded key, no Python per row."""
    block = _key_block(key)
    inner = F.lit(bytearray(b ^ 0x36 for b in block))
    outer = F.lit(bytearray(b ^ 0x5C for b in block))
    first = F.sha2(F.concat(inner, F.encode(value.cast("string"), "UTF-8")), 256)
    return F.sha2(F.concat(outer, F.unhex(first)), 256)


def pseudonymize(value: Column, key: str = "", salt: str = "") -> Column:
    """12 hex characters: keyed digest, or salted digest while no key is set."""
    if key:
        return F.substring(hmac_sha256(value, key), 1, 12)
    return F.substring(F.sha2(F.concat(F.lit(salt), value.cast("string")), 256), 1, 12)


def _python_float(x: Column) -> Column:
    """Two-place float text as the feedback and discovery sides both print it (1.0, 0.25)."""
    rounded = F.bround(F.coalesce(x, F.lit(0.0)), 2)
    text = F.format_string("%.2f", rounded)
    return F.regexp_replace(text, "0$", "")


def fingerprint(features: Column) -> Column:
    """SHA-256 over the ten largest features, printed ``name:value`` and joined by a bar."""
    parts = F.transform(
        top_features(features), lambda e: F.concat(e["key"], F.lit(":"), _python_float(e["value"]))
    )
    return F.sha2(F.concat_ws("|", parts), 256)


def canonical_hash(*columns: str) -> Column:
    """SHA-256 of compact JSON with keys in alphabetical order."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def report_hash(alert_id: Column, transaction_id: Column, amount: Column) -> Column:
    return F.sha2(
        F.concat_ws(
            "|",
            alert_id.cast("string"),
            transaction_id.cast("string"),
            F.format_string("%.2f", amount.cast("double")),
        ),
        256,
    )


def clean_text(value: Column, length: int = 500) -> Column:
    """Drop control characters, then keep the first 500 characters.

    The escape character itself is a control character and goes first, so what
    is left of a colour sequence is its printable tail.
    """
    return F.substring(F.regexp_replace(value.cast("string"), "[\\x00-\\x1f\\x7f\\x9b-\\x9f]", ""), 1, length)


def narrative(gate: Column, top_names: Column, score: Column) -> Column:
    """Report text: score, gate sentence, three leading factors, closing sentence."""
    sentence = F.lit(None).cast("string")
    for name, text in C.GATE_NARRATIVES.items():
        sentence = F.when(gate == name, text).otherwise(sentence)
    sentence = F.when(
        gate.isNotNull(), F.coalesce(sentence, F.concat(F.lit("Hard gate fired: "), gate, F.lit(".")))
    )
    factors = F.when(
        F.size(top_names) > 0,
        F.concat(
            F.lit("Top contributing factors: "),
            F.concat_ws(", ", F.slice(top_names, 1, 3)),
            F.lit("."),
        ),
    )
    return F.concat_ws(
        " ",
        F.concat(F.lit("System fraud score: "), F.format_string("%.2f%%", score * 100), F.lit(".")),
        sentence,
        factors,
        F.lit(C.NARRATIVE_CLOSE),
    )
