"""Keyed, deterministic tokens for personal data (HMAC-SHA256 from built-in functions)."""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

KEY_VARIABLE = "LOSSLEDGER_TOKEN_KEY"

# The key used when none is set, the token prefix and the token length.
DEVELOPMENT_KEY = b"development-only-key"
TOKEN_PREFIX = "tok_"
TOKEN_HEX_DIGITS = 24

# Fixed value: the characters Python's str.strip removes, as a Java regex class body.
STRIP_CLASS = r"\t-\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_BLOCK = 64  # SHA-256 block size in bytes


def token_key(key: bytes | None = None, *, allow_development_key: bool = False) -> bytes:
    """The given key, else the one in the environment; the development key only on request."""
    chosen = key or os.environ.get(KEY_VARIABLE, "").encode()
    if chosen:
        return chosen
    if not allow_development_key:
        raise ValueError(f"no tokenization key: pass one or set {KEY_VARIABLE}")
    return DEVELOPMENT_KEY


def pads(key: bytes) -> tuple[bytes, bytes]:
    """The inner and outer padded keys of HMAC."""
    block = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def strip(col: Column) -> Column:
    return F.regexp_replace(col, f"^[{STRIP_CLASS}]+|[{STRIP_CLASS}]+\\z", "")


@dataclass(frozen=True)
class Tokenizer:
    """Turns text columns into tokens.

    The pads reach the executors as one-row scalar subqueries, so neither the key nor
    anything equivalent to it is a literal in a plan, an explain text or the event log.
    """

    inner: Column
    outer: Column

    @classmethod
    def create(
        cls, spark: SparkSession, key: bytes | None = None, *, allow_development_key: bool = False
    ) -> Tokenizer:
        inner, outer = pads(token_key(key, allow_development_key=allow_development_key))
        row = spark.createDataFrame([(bytearray(inner), bytearray(outer))], "i binary, o binary")
        return cls(row.select("i").scalar(), row.select("o").scalar())

    def token(self, col: Column | str) -> Column:
        value = F.col(col) if isinstance(col, str) else col
        message = F.encode(F.lower(strip(value)), "UTF-8")
        digest = F.unhex(F.sha2(F.concat(self.inner, message), 256))
        hexed = F.sha2(F.concat(self.outer, digest), 256)
        return F.concat(F.lit(TOKEN_PREFIX), F.left(hexed, F.lit(TOKEN_HEX_DIGITS)))

    def protect(self, names: list[str], pii: tuple[str, ...]) -> list[Column]:
        """Columns `names` with every one in `pii` replaced by `<name>_token`."""
        return [self.token(n).alias(f"{n}_token") if n in pii else F.col(n) for n in names]
