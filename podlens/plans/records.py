"""From enriched lines to JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podlens.operators.filters import deliverable, without_reserved
from podlens.operators.output import json_text
from podlens.operators.parsing import assemble_record, parse_lines
from podlens.options import ParseOptions
from podlens.session import configure
from podlens.sources.lines import bounded_lines


def record_lines(lines: DataFrame, options: ParseOptions = ParseOptions()) -> DataFrame:
    """The JSON record of every line that may be delivered, as ``value``.

    Split lines that are too long, parse, assemble, filter, strip and write in one narrow stage; nothing is shuffled. A
    suppressed record is recognised before it is written.
    """
    configure(lines.sparkSession)
    columns = [c for c in ("value", "format", "ext") if c in lines.columns]
    bounded = bounded_lines(lines.select(*columns), options.max_line_bytes)
    records = assemble_record(parse_lines(bounded, options), options)
    record = F.col("record")
    text = json_text(without_reserved(record, options.user_key))
    return records.select(F.explode(F.when(deliverable(record, options.user_key), F.array(text))).alias("value"))
