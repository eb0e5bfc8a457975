"""The engine's functions for SQL users: register(spark) makes them callable by name in a session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lipigraph.functions import entities as E
from lipigraph.functions import text as T

_SPACE = T.SPACE.replace("\\", "\\\\")
_NFKC = "CASE WHEN octet_length(t) = char_length(t) THEN t ELSE java_method('com.ibm.icu.text.Normalizer', 'compose', coalesce(t, ''), true) END"
#: Name, parameters, type and body of each function that is an expression; Catalyst inlines it where it is called.
EXPRESSIONS = {
    "display_normalize": ("t STRING", "STRING", f"trim(regexp_replace(coalesce({_NFKC}, ''), '{_SPACE}+', ' '))"),
    "normalize_text": ("t STRING", "STRING", "java_method('com.ibm.icu.lang.UCharacter', 'foldCase', display_normalize(t), true)"),
    "to_native_digits": ("t STRING", "STRING", f"translate(coalesce(t, ''), '{T.ASCII_DIGITS}', '{T.NATIVE_DIGITS}')"),
    "to_ascii_digits": ("t STRING", "STRING", f"translate(coalesce(t, ''), '{T.NATIVE_DIGITS}', '{T.ASCII_DIGITS}')"),
    "scope_of": ("s STRING", "STRING", f"coalesce(nullif(trim(s), ''), '{T.SCOPE_NONE}')"),
}


def detect(text: pd.Series) -> pd.Series:
    return text.map(E.find_entities)


class SegmentText:
    """Blocks of a text between blank lines, as a table function (sequence, source_text)."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        from lipigraph.sources.segmenters import text_blocks

        for i, (_, t, _) in enumerate(text_blocks(text or ""), 1):
            yield i, t


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to a session and gives their names."""
    for name, (parameters, returns, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    spark.udf.register("detect_entities", F.pandas_udf(detect, f"array<{E.ENTITY}>"))
    spark.udtf.register("segment_text", F.udtf(SegmentText, returnType="sequence int, source_text string"))
    return [*EXPRESSIONS, "detect_entities", "segment_text"]
