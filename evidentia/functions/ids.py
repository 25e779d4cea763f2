"""Content-addressed identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(**fields: Column) -> Column:
    """JSON object with sorted keys and without spaces; null fields stay as null."""
    packed = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.to_json(packed, {"ignoreNullFields": "false"})


def content_id(prefix: str, digits: int = 64, **fields: Column) -> Column:
    """prefix and the first hex digits of the SHA-256 of the canonical JSON."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(canonical_json(**fields), 256), 1, digits))
