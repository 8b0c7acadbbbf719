"""No-break spaces after one-letter words in the visible text of HTML."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from .dialect import rx

_ONE = r"(?<![\p{L}\p{N}])([AaIiOoUuWwZz]) +(?=\S)"
_SPLIT = r"(?is)(<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>)"


def tied(html: str | None) -> str | None:
    if html is None:
        return None
    parts = rx(_SPLIT).split(html)
    for i in range(0, len(parts), 2):
        while (new := rx(_ONE).sub("\\1\u00a0", parts[i])) != parts[i]:
            parts[i] = new
    return "".join(parts)


def tie_words(html):
    """A column of HTML with its words tied."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([tied(h) for h in pages], dtype=object)

    return run(html)
