"""SHA-256 of UTF-8 texts, JVM-side."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
