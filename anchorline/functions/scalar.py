"""Scalar expressions on coordinates, scores and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from anchorline.config import Settings

#: Track colours by conservation class and functional flag: fixed values.
COLOURS = {
    "DC": "127,201,127",
    "IC": "253,180,98",
    "NC": "141,153,174",
    "DC+": "255,0,0",
    "IC+": "255,0,0",
    "DC-": "30,30,30",
    "IC-": "30,30,30",
    "NC+": "141,153,174",
    "NC-": "141,153,174",
}
REVERSE_BIT = 1 << 15


def centre(start: Column, end: Column) -> Column:
    """The middle of a half-open interval, rounded down."""
    return F.floor((start + end) / 2).cast("long")


def ref_end(start: Column, length: Column) -> Column:
    return (start + length - 1).cast("long")


def qry_end(start: Column, length: Column, reverse: Column) -> Column:
    """Inclusive end; a reverse block runs downwards."""
    return F.when(reverse, start - length + 1).otherwise(start + length - 1).cast("long")


def pack(length: Column, reverse: Column) -> Column:
    """Length in 15 bits with the strand in the 16th."""
    return length.cast("int").bitwiseOR(F.when(reverse, REVERSE_BIT).otherwise(0))


def unpack_length(word: Column) -> Column:
    return word.bitwiseAND(REVERSE_BIT - 1)


def unpack_reverse(word: Column) -> Column:
    return word.bitwiseAND(REVERSE_BIT) != 0


def flip(start: Column, size: Column, reverse: Column) -> Column:
    """A chain's start on the forward strand."""
    return F.when(reverse, size - start - 1).otherwise(start)


def decay_score(loc: Column, up: Column, down: Column, genome_size: Column, s: Settings) -> Column:
    """Halves with every half-life of distance to the nearer bound, scaled by genome size."""
    near = F.least(loc - up, down - loc)
    return F.pow(F.lit(0.5), (near / F.lit(float(s.half_life))) * (F.lit(float(s.genome_basis)) / genome_size))


def floor3(score: Column) -> Column:
    return F.floor(score * 1000) / 1000


def interpolate(loc: Column, up: Column, down: Column, qry_up: Column, qry_down: Column, reverse: Column) -> Column:
    """The place between two anchors that corresponds to loc, half a base in."""
    part = (loc - up + 0.5) / (down - up)
    return F.when(reverse, qry_up - part * (qry_up - qry_down)).otherwise(qry_up + part * (qry_down - qry_up)).cast("long")


def sequence_class(direct: Column, multi: Column, dc: Column | float, ic: Column | float) -> Column:
    return F.when(direct >= dc, "DC").when(multi >= ic, "IC").otherwise("NC")


def coord_text(chrom: Column, loc: Column) -> Column:
    return F.when(chrom.isNotNull(), F.concat_ws(":", chrom, loc.cast("string")))


def colour(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])[kind]


def clean_chromosome(name: Column, species: Column, sizes_mention_species: Column) -> Column:
    """Doubled species prefixes become single where the sizes bear it, else every mention goes."""
    twice = F.replace(name, F.concat(species, species), species)
    return F.when(sizes_mention_species, twice).otherwise(F.replace(name, species, F.lit("")))
