"""Hash columns: token buckets and deterministic point ids.

Two bucket functions are offered for sparse term vectors:

* ``md5_bucket`` - first 8 hex digits of md5(token) mod N; built-in, codegen'd,
  and reproducible in any SQL engine (the default).
* ``murmur_bucket`` - ``abs(murmur3_x86_32(token, seed=0)) mod N``, the bucket
  numbering of the original system, from built-in functions as well.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DNS_NAMESPACE_HEX = "6ba7b8109dad11d180b400c04fd430c8"


def md5_prefix(token: Column) -> Column:
    """First 8 hex digits of md5(token) as a non-negative integer."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint")


def md5_bucket(token: Column, buckets: int) -> Column:
    return F.pmod(md5_prefix(token), F.lit(buckets))


_M32 = 0xFFFFFFFF


def _let(x: Column, f) -> Column:
    """``f(x)`` with ``x`` evaluated once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _times32(x: Column, constant: int) -> Column:
    """``x * constant`` modulo 2**32 for x below 2**32, in halves so that no product passes 2**63."""
    def product(v: Column) -> Column:
        high = F.shiftleft((v * F.lit(constant >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)
        return (v * F.lit(constant & 0xFFFF) + high).bitwiseAND(F.lit(_M32))
    return _let(x, product)


def _rotl32(x: Column, bits: int) -> Column:
    return _let(x, lambda v: F.shiftleft(v, bits).bitwiseOR(F.shiftrightunsigned(v, 32 - bits)).bitwiseAND(F.lit(_M32)))


def _shifted32(x: Column, bits: int) -> Column:
    return _let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, bits)))


def _word(hexed: Column, first: Column, n: int) -> Column:
    """Little-endian number of ``n`` bytes from byte ``first`` (0-based) of a hex string."""
    at = (2 * first).cast("int")
    swapped = F.concat(*[F.substring(hexed, at + (2 * i + 1), F.lit(2)) for i in reversed(range(n))])
    return F.conv(swapped, 16, 10).cast("bigint")


def murmur3_32(token: Column, seed: int = 0) -> Column:
    """MurmurHash3 x86_32 of the UTF-8 bytes as a number below 2**32; built-in functions only.

    Spark's ``hash`` mixes the last bytes one by one and cannot stand in.
    """
    def mixed(k: Column) -> Column:
        return _times32(_rotl32(_times32(k, 0xCC9E2D51), 15), 0x1B873593)

    def hashed(h: Column) -> Column:
        n = (F.length(h) / 2).cast("int")
        blocks = (n / 4).cast("int")

        def step(acc: Column, i: Column) -> Column:
            x = _rotl32(acc.bitwiseXOR(mixed(_word(h, i * 4, 4))), 13)
            return (x * 5 + F.lit(0xE6546B64)).bitwiseAND(F.lit(_M32))

        places = F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>"))
        body = F.aggregate(places, F.lit(seed).cast("bigint"), step)
        tail = F.when(n % 4 == 0, F.lit(0).cast("bigint"))
        for r in (1, 2, 3):
            tail = tail.when(n % 4 == r, mixed(_word(h, blocks * 4, r)))
        x = body.bitwiseXOR(tail).bitwiseXOR(n.cast("bigint"))
        return _shifted32(_times32(_shifted32(_times32(_shifted32(x, 16), 0x85EBCA6B), 13), 0xC2B2AE35), 16)

    return _let(F.hex(F.encode(token, "UTF-8")), hashed)


def murmur_bucket(token: Column, buckets: int) -> Column:
    """``abs`` of the signed hash, modulo ``buckets``."""
    return _let(murmur3_32(token), lambda x: F.pmod(F.when(x >= 1 << 31, F.lit(1 << 32) - x).otherwise(x), F.lit(buckets)))


def bucket(token: Column, buckets: int, method: str = "md5") -> Column:
    if method == "md5":
        return md5_bucket(token, buckets)
    if method == "murmur3":
        return murmur_bucket(token, buckets)
    raise ValueError(f"unknown bucket method {method!r}")


def uuid5_dns(name: Column) -> Column:
    """RFC 4122 version-5 UUID of ``name`` in the DNS namespace, as a string."""
    h = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE_HEX)), F.encode(name, "UTF-8")))
    variant_digit = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.substring(F.lit("89ab89ab89ab89ab"), variant_digit + 1, 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4),
                       F.concat(F.lit("5"), F.substring(h, 14, 3)),
                       F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
