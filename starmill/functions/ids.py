"""Typed particle ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..sources.views import BULGE, BULGE_BASE, DARK, DARK_BASE, DISK

ID_BITS = 48


def type_of(gid: Column) -> Column:
    """0 dark matter, 1 bulge, 2 disk by the range the id lies in; 3 for negative ids."""
    return F.when(gid >= DARK_BASE, DARK).when(gid >= BULGE_BASE, BULGE).when(gid >= 0, DISK).otherwise(3).cast("int")


def local_id(gid: Column) -> Column:
    return gid - F.when(gid >= DARK_BASE, F.lit(DARK_BASE)).when(gid >= BULGE_BASE, F.lit(BULGE_BASE)).otherwise(F.lit(0).cast("long"))


def pack(ptype: Column, local: Column) -> Column:
    """Type in the upper 16 bits, id in the lower 48."""
    return F.shiftleft(ptype.cast("long"), ID_BITS).bitwiseOR(local.bitwiseAND((1 << ID_BITS) - 1))


def unpack(packed: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(packed, ID_BITS).cast("int"), packed.bitwiseAND((1 << ID_BITS) - 1)


def v1_to_v2(old: Column, is_dark: Column) -> Column:
    """32-bit ids of old files: dark matter and bulge (from 1e8) move to their ranges."""
    return old.cast("long") + F.when(is_dark, F.lit(DARK_BASE)).when(old >= 100_000_000, F.lit(BULGE_BASE)).otherwise(F.lit(0).cast("long"))


def v1_kind(old: Column) -> Column:
    """Extended codes of old ids: 2 disk, 4 glowing, 3 dust, 5 massless glow, 1 bulge, 0 dark matter."""
    return F.when(old < 40_000_000, 2).when(old < 50_000_000, 4).when(old < 70_000_000, 3).when(old < 100_000_000, 5).when(old < 200_000_000, 1).otherwise(0).cast("int")
