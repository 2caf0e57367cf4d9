"""Word shingles as 64-bit numbers: words are runs without ASCII white space, A-Z lower-cased."""

from __future__ import annotations

WORDS = 5
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def mix(x):
    """A bijection on 64-bit numbers that spreads every bit."""
    import numpy as np

    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_hashes(found: list[bytes]):
    import numpy as np
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def sequence(hashes, n: int = WORDS):
    """The shingle at each word: one for each run of ``n`` words, or one of all words if there are fewer."""
    import numpy as np

    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    out = np.full(len(hashes) - n + 1, n, np.uint64)
    for j in range(n):
        out += hashes[j : len(hashes) - n + 1 + j] * np.uint64(_FACTORS[j % len(_FACTORS)])
    return mix(out)


def shingle_set(text: str | None):
    """The distinct shingles of a text, sorted."""
    import numpy as np

    return np.unique(sequence(word_hashes(words(text))))
