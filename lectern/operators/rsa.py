"""Segmented RSA: encryption with PKCS #1 v1.5 padding, and recovery of text from blocks with a public key."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes of a plain segment and of a cipher block for a 1024-bit key.
SEGMENT, BLOCK = 117, 128


def recover_bytes(cipher: bytes, n: int, e: int, block: int = BLOCK, factors: tuple[int, int] | None = None) -> bytes:
    """Each block to the power e; what follows its first zero byte at place 2 or later is text. ``factors`` of n, if known, shorten the work."""
    out = []
    p, q = factors or (n, 1)
    back = pow(q, -1, p)

    def power(x: int) -> int:
        if not factors:
            return pow(x, e, n)
        rest = pow(x % q, e % (q - 1), q)
        return rest + q * ((pow(x % p, e % (p - 1), p) - rest) * back % p)

    for i in range(0, len(cipher), block):
        data = power(int.from_bytes(cipher[i : i + block], "big")).to_bytes((n.bit_length() + 7) // 8, "big")
        out.append(data[data.find(b"\0", 2) + 1 :] if data.find(b"\0", 2) >= 0 else data)
    return b"".join(out)


def recovered(cipher: Column, n: int, e: int, block: int = BLOCK, factors: tuple[int, int] | None = None) -> Column:
    """The text in base64 ``cipher``, invalid UTF-8 dropped; null for null and for text that is no base64."""
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else recover_bytes(bytes(b), n, e, block, factors).decode("utf-8", errors="ignore"))

    return run(F.try_to_binary(cipher, F.lit("base64")))


def encrypt_bytes(text: bytes, n: int, e: int, pad, segment: int = SEGMENT) -> bytes:
    """Segments padded as type 2 blocks; ``pad`` gives that many bytes that are not zero."""
    size = (n.bit_length() + 7) // 8
    out = []
    for i in range(0, len(text), segment):
        part = text[i : i + segment]
        block = b"\0\2" + pad(size - 3 - len(part)) + b"\0" + part
        out.append(pow(int.from_bytes(block, "big"), e, n).to_bytes(size, "big"))
    return b"".join(out)


def encrypted(text: Column, n: int, e: int) -> Column:
    """``text`` encrypted with the public key (n, e), as base64; padding is random."""
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        import secrets

        pad = lambda k: bytes(secrets.randbelow(255) + 1 for _ in range(k))
        return values.map(lambda x: None if x is None else base64.b64encode(encrypt_bytes(x.encode(), n, e, pad)).decode())

    return run(text)
