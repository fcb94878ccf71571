"""Deterministic hashes: rank keys for sampling, slots for splitting, and a wrapping integer mixer."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS = 10_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rank_key(salt: str, *columns: Column | str) -> Column:
    """A text that orders rows at random but reproducibly: md5 of the salt and the columns. Any engine can recompute it."""
    return F.md5(F.concat_ws("|", F.lit(salt), *[_col(c).cast("string") for c in columns]))


def slot(salt: str, *columns: Column | str, slots: int = SLOTS) -> Column:
    """A number in [0, slots), from the first 32 bits of the rank key."""
    return F.conv(F.substring(rank_key(salt, *columns), 1, 8), 16, 10).cast("long") % slots


def uniform(salt: str, *columns: Column | str) -> Column:
    """A number in (0, 1), from 32 bits."""
    return (F.conv(F.substring(rank_key(salt, *columns), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def _let(x: Column, then) -> Column:
    """``then(x)``, with x worked out once however often it is used."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def _wrap(x: Column, bits: int) -> Column:
    return F.shiftright(F.shiftleft(x, 64 - bits), 64 - bits) if bits < 64 else x


def _times(x: Column, factor: int, bits: int) -> Column:
    """x * factor modulo 2^bits, signed, without overflow errors."""
    if bits == 32:
        return _wrap(x * F.lit(factor - (1 << 32) if factor >= 1 << 31 else factor), 32)
    wide, low = "decimal(38,0)", factor & 0xFFFFFFFF
    whole = F.lit(Decimal(1 << 64)).cast(wide)
    half = F.lit(1 << 32).cast("decimal(20,0)")

    def product(exact: Column) -> Column:
        upper = F.pmod((exact * F.lit(factor >> 32).cast("decimal(10,0)")).cast(wide), F.lit(1 << 32).cast(wide)).cast("decimal(10,0)")
        return F.pmod((exact * F.lit(low).cast("decimal(10,0)")).cast(wide) + (upper * half).cast(wide), whole)

    signed = lambda total: F.when(total >= F.lit(Decimal(1 << 63)).cast(wide), total - whole).otherwise(total).cast("long")
    return _let(product(x.cast("decimal(20,0)")), signed)


# Shifts and factors of the two mixers.
MIX = {32: ((16, 0x7FEB352D), (15, 0x846CA68B), (16, None)), 64: ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None))}


def _xor_shift(by: int):
    return lambda v: v.bitwiseXOR(F.shiftright(v, by))


def _multiply(by: int, bits: int):
    return lambda v: _times(v, by, bits)


def integer_mix(x: Column | str, bits: int = 64, rounds: int = 2) -> Column:
    """The integer hash of x + 1: in each round shift-xor, multiply, shift-xor, multiply, shift-xor, wrapping at ``bits`` (32 or 64)."""
    h = _wrap(_col(x).cast("long") + 1, bits)
    for _ in range(rounds):
        for shift, factor in MIX[bits]:
            h = _let(h, _xor_shift(shift))
            h = h if factor is None else _let(h, _multiply(factor, bits))
    return h.cast("int") if bits == 32 else h


def composite_id(type_code: Column | str, node_id: Column | str) -> Column:
    """(type << 32) | id, in one 64-bit number."""
    return F.shiftleft(_col(type_code).cast("long"), 32).bitwiseOR(_col(node_id).cast("long"))


def split_composite_id(composite: Column | str) -> tuple[Column, Column]:
    """(type, id) of a composite id."""
    return F.shiftright(_col(composite), 32), _col(composite).bitwiseAND(F.lit(0xFFFFFFFF))
