"""Masks, as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what replaces a value that cannot be masked in part.
HIDDEN = "***"


def mask_email(email: Column) -> Column:
    """Keep the first character and everything after the first ``@``.

    NULL stays NULL. A value without ``@``, or with nothing on one side of it, is hidden
    whole, so a malformed value never shows more than a valid one.
    """
    at = F.instr(email, "@")
    malformed = (at <= 1) | (at == F.length(email))
    kept = F.concat(F.substring(email, 1, 1), F.lit(HIDDEN), F.substr(email, at))
    return F.when(email.isNull(), None).when(malformed, HIDDEN).otherwise(kept)
