"""Files of hyphenation patterns (hyph-LANGUAGE.pat.txt) and exceptions (hyph-LANGUAGE.hyp.txt), and words parted by the language of their row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from isoline.functions.algorithms import hyphenation_tables, parted

#: Bytes of all files of a folder: they are sent to every task. The known languages together have some four million.
MOST_BYTES = 64_000_000


def read_hyphenation(spark: SparkSession, folder: str) -> dict[str, tuple[list[str], list[str]]]:
    """Patterns and exceptions of each language that has a file of patterns. Lines are UTF-8; empty ones and those that begin with % are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "hyph-*.txt").load(folder)
    size = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of patterns are too many to send to every task")
    out: dict = {}
    for r in files.select(F.substring_index("path", "/", -1).alias("name"), "content").orderBy("name").collect():
        language, _, kind = r["name"].removeprefix("hyph-").removesuffix(".txt").rpartition(".")
        lines = [x.strip() for x in bytes(r["content"]).decode("utf-8-sig").splitlines()]
        if kind in ("pat", "hyp"):
            out.setdefault(language, ([], []))[kind == "hyp"].extend(x for x in lines if x and not x.startswith("%"))
    return {k: v for k, v in out.items() if v[0]}


def hyphenate_by(text: Column, language: Column, lists: dict[str, tuple[list[str], list[str]]], separator: str = "|", left: int = 2, right: int = 3) -> Column:
    """separator at every possible break of the text's words, by the patterns of its row's language. Texts of other languages, and null ones, stay as they are."""
    spark = SparkSession.active()
    sent = spark.sparkContext.broadcast(lists)
    tables: dict = {}

    @pandas_udf("string")
    def run(texts: pd.Series, languages: pd.Series) -> pd.Series:
        out = []
        for t, k in zip(texts, languages, strict=True):
            if t is not None and k in sent.value:
                if k not in tables:
                    tables[k] = hyphenation_tables(*sent.value[k])
                t = parted(t, tables[k], separator, left, right)
            out.append(t)
        return pd.Series(out, dtype=object)

    return run(text, language)
