"""Scalar expressions on DNA: reverse complement, canonical k-mers, packing, tails and their targets."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

K = 23


def dna(text: Column) -> Column:
    """Letters of any text as bases (all other characters are left out)."""
    return F.translate(F.lower(F.regexp_replace(text, "[^A-Za-z]", "")), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


def revcomp(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def revcomp_any(s: Column) -> Column:
    """The reverse complement of any text: what is no base becomes N."""
    return revcomp(F.regexp_replace(s, "[^ACGT]", "N"))


def canonical(kmer: Column) -> Column:
    """The lesser of both strands; for odd k they differ."""
    return F.least(kmer, revcomp(kmer))


def pack(kmer: Column) -> Column:
    """Two bits a base, first base highest; k up to 31."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def _spelled(n: int) -> str:
    """The n-mers in order, as a constant array in SQL."""
    return f"split('{','.join(map(''.join, product('ACGT', repeat=n)))}', ',')"


def unpack(packed: Column, k: int = K) -> Column:
    """Four bases at a time, from a table."""
    sizes = [k % 4] * (k % 4 > 0) + [4] * (k // 4)
    ends = [sum(sizes[i + 1 :]) for i in range(len(sizes))]
    return F.concat(*[F.expr(_spelled(n))[F.shiftright(packed, 2 * end).bitwiseAND((1 << 2 * n) - 1).cast("int")] for n, end in zip(sizes, ends, strict=True)])


def revcomp_id(packed: Column, k: int = K) -> Column:
    """The packed reverse complement of a packed k-mer."""
    return pack(revcomp(unpack(packed, k)))


def tail_path(smer: Column, side: Column, bases: Column) -> Column:
    """The node, read towards the tail, and the tail."""
    return F.concat(F.when(side == "S", smer).otherwise(revcomp(smer)), bases)


def target(path: Column, k: int = K) -> Column:
    return canonical(F.right(path, F.lit(k)))


def orientation(path: Column, side: Column, k: int = K) -> Column:
    """1 if the far node is met in the orientation of this one, else -1."""
    t = F.right(path, F.lit(k))
    return F.when((side == "S") == (t < revcomp(t)), 1).otherwise(-1)


def quality_ints(qual: Column, offset: int = 33, seq: Column | None = None) -> Column:
    """Qualities as numbers; with seq, 0 where it has N."""
    out = F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.ascii(c) - offset)
    return out if seq is None else F.transform(out, lambda q, i: F.when(F.substring(seq, i + 1, F.lit(1)) == "N", 0).otherwise(q))
