"""Settings read from JSON: values that are absent, of another kind or out of range fall back or are brought into range."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name, kind, least, greatest, default, and whether a value out of range is clamped (else it is the default).
RULES = [
    ("k", "int", 1, 30, 10, False),
    ("minSim", "double", 0.0, 0.95, 0.2, False),
    ("indexConcurrency", "int", 1, 32, 6, True),
    ("convertMaxPixels", "long", 100_000, 8_000_000, 2_500_000, True),
    ("convertPageTimeoutSec", "long", 30, 7_200, 600, True),
]


def settings_of(stored: Column) -> Column:
    """Struct of all settings; null or malformed JSON gives the defaults. Clamped settings take 0 and less as the default."""
    read = F.from_json(stored, ", ".join(f"{name} {kind}" for name, kind, *_ in RULES))

    def value(name: str, kind: str, least, greatest, default, clamp: bool) -> Column:
        x = read[name]
        if clamp:
            return F.when(x > 0, F.least(F.greatest(x, F.lit(least)), F.lit(greatest))).otherwise(F.lit(default)).cast(kind).alias(name)
        return F.when(x.between(least, greatest), x).otherwise(F.lit(default)).cast(kind).alias(name)

    return F.struct(*[value(*rule) for rule in RULES])
