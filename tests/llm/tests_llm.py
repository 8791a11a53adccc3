from __future__ import annotations

import duckdb

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def rows_of(name: str, sf_dir: str = SF) -> list[tuple]:
    return duckdb.sql(f"SELECT * FROM '{sf_dir}/{name}.parquet'").fetchall()


# texts that every operator has to bear: null, empty, blank, one word, very long, repeated
ODD_TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "word"), (5, "word"),
    (6, "long text of many words " * 20_000), (7, "x" * 200_000), (8, "Ünï cödé ﬁ 𝟙𝟚 \U0001f600 " * 3),
    (9, "\0 nul \x1c sep \x85 nel \xa0 nbsp"), (10, "one two three four five six seven eight nine ten eleven"),
    (None, "no id at all but some words here"),
]
