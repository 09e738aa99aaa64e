"""Chromosome labels, coordinate ids and bins as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of the sex chromosomes and the mitochondrion in coordinate ids; ids are code * 10**9 + position.
CODES = {"X": 23, "Y": 24, "M": 25}
SCALE = 1_000_000_000


def _bare(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(c.cast("string")), "^[cC][hH][rR]", ""))


def strict_chromosome(c: Column) -> Column:
    """chrN, chrX, chrY or chrM; any other label raises."""
    b = _bare(c)
    number = F.when(b.rlike("^[+]?0*([1-9]|1[0-9]|2[0-2])$"), F.concat(F.lit("chr"), b.try_cast("int").cast("string")))
    return (
        F.when(b.isin("M", "MT"), "chrM")
        .when(b.isin("X", "Y"), F.concat(F.lit("chr"), b))
        .otherwise(F.coalesce(number, F.raise_error(F.concat(F.lit("unsupported chromosome label: "), F.coalesce(c.cast("string"), F.lit("null")))).cast("string")))
    )


def permissive_chromosome(c: Column) -> Column:
    """Any label behind chr, in capitals; MT is chrM."""
    b = _bare(c)
    return F.when(b.isin("M", "MT"), "chrM").otherwise(F.concat(F.lit("chr"), b))


def nullable_chromosome(c: Column) -> Column:
    """As strict, 23 and 24 are X and Y; null for unknown labels."""
    b = _bare(c)
    b = F.when(b == "23", "X").when(b == "24", "Y").when(b.isin("M", "MT"), "M").otherwise(b)
    return F.when(b.rlike("^([1-9]|1[0-9]|2[0-2]|X|Y|M)$"), F.concat(F.lit("chr"), b))


def chromosome_code(c: Column) -> Column:
    """1..22, 23 X, 24 Y, 25 M; -1 for unknown labels."""
    b = F.substring(nullable_chromosome(c), 4, 2)
    return F.coalesce(F.when(b == "X", 23).when(b == "Y", 24).when(b == "M", 25).otherwise(b.try_cast("int")), F.lit(-1))


def encode_id(chrom: Column, pos: Column) -> Column:
    """Coordinate id, -1 for an unknown chromosome or a position outside 1 .. 10**9 - 1."""
    code = chromosome_code(chrom)
    ok = (code > 0) & (pos >= 1) & (pos < SCALE)
    return F.coalesce(F.when(ok, code.cast("long") * SCALE + pos.cast("long")), F.lit(-1).cast("long"))


def decode_chromosome(ident: Column) -> Column:
    code = F.floor(ident / SCALE).cast("int")
    return F.when(code == 23, "chrX").when(code == 24, "chrY").when(code == 25, "chrM").when(code.between(1, 22), F.concat(F.lit("chr"), code.cast("string")))


def decode_position(ident: Column) -> Column:
    return F.pmod(ident, F.lit(SCALE)).cast("long")


def to_one_based(pos: Column, base: int) -> Column:
    return pos + (1 if base == 0 else 0)


def bin_index(pos: Column, resolution: int) -> Column:
    """Zero-based bin of a one-based position."""
    return F.floor((pos - 1) / resolution).cast("long")


def block_label(chrom: Column, pos: Column, size: int = 1_000_000) -> Column:
    return F.concat_ws(":", chrom, F.floor(pos / size).cast("string"))


def patient_of(barcode: Column) -> Column:
    """First three dash parts of a project barcode; other names as they are."""
    parts = F.split(barcode, "-")
    return F.when(barcode.startswith("TCGA"), F.array_join(F.slice(parts, 1, 3), "-")).otherwise(barcode)
