"""Sub-word features of the word-vector library as Spark expressions
(STR-10..13).  All built-in higher-order functions, no Python per row.

Fixed values (must equal the library's for right bucket ids):
  FNV-1a 32-bit offset basis 2166136261, prime 16777619;
  word n-gram multiplier 116049371; boundary marks '<' and '>'.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
NGRAM_MULT = 116049371
BOW, EOW = "<", ">"
MASK32 = 4294967295
SIGN_EXT = 4294967040     # 0xFFFFFF00: a byte >= 128 read as a signed char


def char_ngrams(word: Column, minn: int = 3, maxn: int = 6) -> Column:
    """STR-10: n-grams of ``<word>``, lengths minn..maxn in code points, in
    the library's order (by start, then length); a lone boundary mark is
    never a gram."""
    if maxn <= 0:
        return F.array().cast("array<string>")
    w = F.concat(F.lit(BOW), word, F.lit(EOW))
    L = F.length(w)

    def at(i):
        top = F.least(F.lit(maxn), L - i)
        grams = F.transform(F.sequence(F.lit(minn), top),
                            lambda n: F.struct(F.substring(w, i + 1, n).alias("g"), n.alias("n")))
        return F.when(top >= minn, grams).otherwise(F.array().cast("array<struct<g:string,n:int>>"))

    allg = F.flatten(F.transform(F.sequence(F.lit(0), L - 1), lambda i: F.transform(
        at(i), lambda s: F.struct(s["g"].alias("g"), s["n"].alias("n"), i.alias("i")))))
    keep = F.filter(allg, lambda s: ~((s["n"] == 1) & ((s["i"] == 0) | (s["i"] + 1 == L))))
    return F.transform(keep, lambda s: s["g"])


def utf8_bytes(s: Column) -> Column:
    """Array of the UTF-8 byte values (0..255) of a string."""
    from textlake.functions.text import let

    def body(hx):
        hx = hx[0]
        n = F.length(hx) / 2
        return F.when(F.length(hx) > 0, F.transform(
            F.sequence(F.lit(0), (n - 1).cast("int")),
            lambda k: F.conv(F.substring(hx, k * 2 + 1, 2), 16, 10).cast("bigint"))
        ).otherwise(F.array().cast("array<bigint>"))
    return let(F.array(F.hex(F.encode(s, "UTF-8"))), body)


def fnv1a(s: Column) -> Column:
    """STR-11: 32-bit FNV-1a of the UTF-8 bytes with sign-extended bytes, as
    an unsigned value in a BIGINT."""
    # a string of ASCII only is read character by character, which is much cheaper than by hex digits
    ascii_codes = F.transform(F.sequence(F.lit(1), F.length(s)), lambda k: F.ascii(F.substring(s, k, F.lit(1))).cast("bigint"))
    codes = F.when((F.length(s) > 0) & (F.octet_length(s) == F.length(s)), ascii_codes).otherwise(utf8_bytes(s))
    return F.aggregate(
        codes, F.lit(FNV_OFFSET).cast("bigint"),
        lambda h, b: (h.bitwiseXOR(F.when(b >= 128, b + SIGN_EXT).otherwise(b)) * FNV_PRIME).bitwiseAND(MASK32))


def fnv_bucket(s: Column, bucket: int) -> Column:
    return F.pmod(fnv1a(s), F.lit(bucket))


def as_int32(h: Column) -> Column:
    """The unsigned 32-bit hash read as a signed int32."""
    return F.when(h >= 2 ** 31, h - 2 ** 32).otherwise(h)


def word_ngram_buckets(hashes: Column, n: int, bucket: int, offset: Column | int = 0) -> Column:
    """STR-12: ids of word n-grams (2..n) of a line from its token hashes.

    ``h = h * 116049371 + next`` in unsigned 64-bit arithmetic with int32
    hashes sign-extended, kept as two halves of 32 bits in BIGINTs, none of whose
    products overflows, then reduced mod ``bucket`` (below 2^31).
    """
    if n <= 1:
        return F.array().cast("array<bigint>")
    if not 0 < bucket < 1 << 31:
        raise ValueError("bucket must be positive and below 2**31")
    from textlake.functions.text import let
    wrap = (1 << 32) % bucket

    def step(h, token):
        low = h["lo"] * NGRAM_MULT + token["lo"]
        high = h["hi"] * NGRAM_MULT + token["hi"] + F.shiftrightunsigned(low, 32)
        return F.struct(high.bitwiseAND(MASK32).alias("hi"), low.bitwiseAND(MASK32).alias("lo"))

    def body(u):
        size = F.size(u)
        # level k holds the hashes of all k-grams: zip(level k-1, tokens
        # shifted by k-1), so every level is one linear pass over the line
        levels, prev = [], u
        for k in range(2, n + 1):
            m = F.greatest(size - k + 1, F.lit(0))
            prev = F.zip_with(F.slice(prev, 1, m), F.slice(u, k, m), step)
            levels.append(prev)
        return F.concat(*levels)

    def halves(h):
        h = as_int32(h).cast("bigint")
        return F.struct(F.when(h < 0, F.lit(MASK32)).otherwise(F.lit(0)).cast("bigint").alias("hi"), h.bitwiseAND(MASK32).alias("lo"))
    allh = let(F.transform(hashes, halves), body)
    return F.transform(allh, lambda h: ((h["hi"] % bucket) * wrap + h["lo"]) % bucket + offset)


def subword_ids(word: Column, word_id: Column, nwords: int, bucket: int, minn: int, maxn: int,
                eos: str = "</s>") -> Column:
    """STR-13: own id first when known, then ``nwords + bucket(gram)``; the
    end-of-sentence token has no grams."""
    grams = F.transform(char_ngrams(word, minn, maxn), lambda g: fnv_bucket(g, bucket) + nwords)
    grams = F.when(word == F.lit(eos), F.array().cast("array<bigint>")).otherwise(grams)
    own = F.when(word_id.isNotNull(), F.array(word_id.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.concat(own, grams)
