"""Hashed character n-grams and MinHash signatures, row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.functions.normalize import tokens

MODULUS = 2147483647


def char_grams(text: Column, low: int = 2, high: int = 5) -> Column:
    """N-grams inside the tokens, each with a space on either side; a token shorter than n gives itself once."""

    def of_token(token: Column) -> Column:
        padded, size = F.concat(F.lit(" "), token, F.lit(" ")), F.length(token) + 2

        def of_size(n: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: F.substr(padded, at, n))

        return F.flatten(F.transform(F.sequence(F.least(F.lit(low), size), F.least(F.lit(high), size)), of_size))

    return F.flatten(F.transform(tokens(text), of_token))


def feature_id(gram: Column, n_features: int = 1 << 20) -> Column:
    """A gram's feature: the first 32 bits of its MD5, modulo ``n_features``."""
    return F.pmod(F.conv(F.substr(F.md5(gram), F.lit(1), F.lit(8)), 16, 10).cast("long"), F.lit(n_features)).cast("int")


def features(text: Column, n_features: int = 1 << 20, ngrams: tuple[int, int] = (2, 5)) -> Column:
    """All features of a text, repeated ones too."""
    return F.transform(char_grams(text, *ngrams), lambda g: feature_id(g, n_features))


def permutations(count: int) -> list[tuple[int, int]]:
    """Coefficients of the permutations x -> (a * x + b) mod MODULUS."""
    return [((1103515245 * (k + 1) + 12345) % (MODULUS - 1) + 1, (69069 * (k + 7) + 1) % MODULUS) for k in range(count)]


def minhash(ids: Column, count: int = 32) -> Column:
    """Signature of a set of features below 2**22, so that products stay within 53 bits; null of an empty set."""
    table = F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in permutations(count)))
    signature = F.transform(table, lambda p: F.array_min(F.transform(ids, lambda x: (p["a"] * x + p["b"]) % MODULUS)))
    return F.when(F.size(ids) > 0, signature)
