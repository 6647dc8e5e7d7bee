"""Canonical records, their hashes and signatures, identifiers, admission limits and hashed embeddings."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.safety import REDACTED, REDACTION_RULES, SENSITIVE_KEYS

# Limits of what is admitted, and the letters of identifiers in the order of their values.
PAYLOAD_BYTES, TEXT_CHARS, KEY_CHARS, ARRAY_ITEMS = 256 * 1024, 8192, 256, 10_000
ID_LETTERS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def canonical(**fields: Column) -> Column:
    """A record as JSON: keys in order, no spaces, nulls left out."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


def content_hash(record: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(record, 256))


def signature(record: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a record by a key, as hexadecimal digits; two nested hashes, so it stays a built-in expression."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, record.cast("binary")), 256))), 256)


def verified(record: Column, signed: Column, key: bytes) -> Column:
    """Whether a signature is right; a missing one is not."""
    return F.coalesce(signed == signature(record, key), F.lit(False))


def valid_id(value: Column) -> Column:
    return F.coalesce(value.rlike(f"^[0-7][{ID_LETTERS}]{{25}}$"), F.lit(False))


def id_millis(value: Column) -> Column:
    """The time in an identifier, milliseconds since 1970; null if it is none."""
    digits = F.translate(F.substring(value, 1, 10), ID_LETTERS, "0123456789ABCDEFGHIJKLMNOPQRSTUV")
    return F.when(valid_id(value), F.conv(digits, 32, 10).cast("long"))


def refusal(project_id: Column, payload: Column, text: Column) -> Column:
    """Why an event is not admitted, null if it is."""
    return (
        F.when(F.coalesce(F.trim(project_id), F.lit("")) == "", "blank_project")
        .when(F.octet_length(payload) > PAYLOAD_BYTES, "payload_too_large")
        .when(F.length(text) > TEXT_CHARS, "text_too_long")
        .when(F.exists(F.json_object_keys(payload), lambda k: F.length(k) > KEY_CHARS), "key_too_long")
        .when(F.json_array_length(payload) > ARRAY_ITEMS, "array_too_long")
    )


def _compiled() -> list[tuple[str, re.Pattern, str]]:
    return [(family, re.compile(pattern), re.sub(r"\$(\d)", r"\\\1", to)) for family, pattern, to in REDACTION_RULES]


def _cleaned(value, rules):
    """A JSON value redacted: by key where the key says it, else every string by the rules."""
    if isinstance(value, str):
        for _, pattern, to in rules:
            value = pattern.sub(to, value)
        return value
    if isinstance(value, list):
        return [_cleaned(x, rules) for x in value]
    if isinstance(value, dict):
        secret = {k for k in value if k.strip().lower().lstrip("-_") in SENSITIVE_KEYS}
        return {k: (REDACTED if k in secret and x not in (None, "") else x if k in secret else _cleaned(x, rules)) for k, x in value.items()}
    return value


def redact_json(payload: Column) -> Column:
    """JSON payloads redacted at any depth; text that is no JSON goes through the rules as it is."""

    def run(payloads: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rules = _compiled()

        def one(text):
            if text is None:
                return None
            try:
                value = json.loads(text)
            except ValueError:
                value = None
            if not isinstance(value, (dict, list)):
                return _cleaned(text, rules)
            return json.dumps(_cleaned(value, rules), ensure_ascii=False, separators=(",", ":"), sort_keys=True)

        for batch in payloads:
            yield batch.map(one)

    return F.pandas_udf(run, "string")(payload)


def hashed_vector(text: str, dims: int = 256) -> np.ndarray:
    """Words hashed to signed dimensions, at unit length."""
    out = np.zeros(dims)
    for word in text.lower().split():
        word = word.strip(".,;:!?()[]{}\"'`")
        if word:
            v = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            out[v % dims] += 1.0 if v >> 63 & 1 else -1.0
    norm = float(np.sqrt((out * out).sum()))
    return out / norm if norm else out


def hash_embedding(text: Column, dims: int = 256) -> Column:
    """``hashed_vector`` of each text."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: hashed_vector(t or "", dims).astype(np.float32).tolist())

    return F.pandas_udf(run, "array<float>")(text)


def packed(vector: Column) -> Column:
    """Vectors as little-endian 32-bit floats."""

    def run(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in vectors:
            yield batch.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return F.pandas_udf(run, "binary")(vector)


def unpacked(blob: Column) -> Column:
    def run(blobs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in blobs:
            yield batch.map(lambda b: None if b is None else np.frombuffer(b, "<f4").tolist())

    return F.pandas_udf(run, "array<float>")(blob)
