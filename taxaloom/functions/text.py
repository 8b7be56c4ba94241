"""Small text functions of the metadata and report stages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The forms of an assembly accession and of the key before an
#: infraspecific name.
ACCESSION = r"GC[AF]_[0-9]+\.[0-9]+"
KEY = "^[a-z]+="


def sequence_id(header: Column) -> Column:
    """A header up to its first blank."""
    return F.split(header, " ").getItem(0)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def file_accession(path: Column) -> Column:
    """The assembly accession in a file name, else the file name."""
    found = F.regexp_extract(basename(path), ACCESSION, 0)
    return F.coalesce(F.nullif(found, F.lit("")), basename(path))


def organism_name(organism: Column, infraspecific: Column) -> Column:
    """The organism, with the infraspecific name (without its key=) added unless the
    organism ends in it already."""
    infra = F.regexp_replace(F.coalesce(infraspecific, F.lit("")), KEY, "")
    return F.when((infra == "") | F.endswith(organism, infra), organism).otherwise(F.concat_ws(" ", organism, infra))


def decode_target(name: Column) -> Column:
    """Placeholders of special characters in an index's target names: ||| is a dot, ---
    a blank; a minimiser extension goes."""
    return F.replace(F.replace(F.regexp_replace(name, r"\.minimiser$", ""), F.lit("|||"), F.lit(".")), F.lit("---"), F.lit(" "))


def gtdb_accession(name: Column) -> Column:
    """Without the three-letter prefix."""
    return F.substring(name, F.lit(4), F.length(name))


def gtdb_node(lineage: Column) -> Column:
    """The last rank of a ;-separated lineage."""
    return F.element_at(F.split(lineage, ";"), -1)
