"""The comma-separated domain list of a service."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space around names.
BLANKS = " \t\n\x0b\f\r\x85\xa0"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def split_domains(text: Column) -> Column:
    """Domain names without outer commas, empty parts and surrounding blanks."""
    inner = F.btrim(trimmed(text), F.lit(","))
    parts = F.filter(F.split(inner, ","), lambda part: part != "")
    return F.transform(parts, trimmed)


def with_default(domain: Column, default_domain: str) -> Column:
    """A short name counts twice: completed with the default domain, and as it is."""
    full = F.concat(domain, F.lit(f".{default_domain}"))
    return F.when(F.contains(domain, F.lit(".")), F.array(domain)).otherwise(F.array(full, domain))
