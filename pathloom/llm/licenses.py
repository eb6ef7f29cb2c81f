"""License notices: MinHash bands over overlapping text windows, verified by exact shingle containment.

Everything is DataFrame expressions. A text becomes its words (lower-cased runs of letters and digits) and the hashes
of its 5-word shingles. Windows overlap so far that a notice lies whole in one of them. Only windows that hold a
shingle of a template can collide with it, so windows are laid only around such shingles. A window's MinHash signature
has BANDS values, one a band: a window of which a share J of shingles is shared with the template collides in some band
with probability 1 - (1 - J)^BANDS. Windows are at most half as long again as the template, hence J is at least
0.8 / (1.5 + 0.2) = 0.47 where the containment reaches 0.8, and the probability above 0.9999. A collision is verified
by the exact share of the template's shingles that the window holds.
"""

from __future__ import annotations


import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm._common import text_of

WIDTH, CONTAINMENT, BANDS = 5, 0.8, 16

#: License identifier and a notice by which it is given.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _hashes(words: str) -> Column:
    """Hashes of the shingles of an array of words, in order; of fewer words (but some), one of the whole sequence."""
    parts = ", ".join(f"{words}[i + {k}]" for k in range(WIDTH))
    return F.expr(f"case when size({words}) >= {WIDTH} then transform(sequence(0, size({words}) - {WIDTH}), i -> xxhash64({parts})) when size({words}) > 0 then array(xxhash64({words})) else array() end")


def _shingles(words: str) -> Column:
    return F.expr(f"case when size({words}) >= {WIDTH} then transform(sequence(1, size({words}) - {WIDTH - 1}), i -> array_join(slice({words}, i, {WIDTH}), ' ')) when size({words}) > 0 then array(array_join({words}, ' ')) else array() end")


def _signature(hashes: str) -> Column:
    return F.array(*[F.expr(f"array_min(transform({hashes}, h -> xxhash64(h, {j})))") for j in range(BANDS)])


def _bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row: the optimizer doesn't copy a generator's output into its uses."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def template_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """template (number), license, span (words of its windows), stride, shingles, signature; a row for each template."""
    rows = pa.table({"template": pa.array(range(len(templates)), pa.int32()), "license": [x for x, _ in templates], "notice": [t for _, t in templates]}, schema=pa.schema([("template", pa.int32()), ("license", pa.string()), ("notice", pa.string())]))
    t = spark.createDataFrame(rows).withColumn("w", _words(F.col("notice"))).where(F.size("w") > 0).withColumn("h", _hashes("w"))
    # windows come in few sizes: the template's words and a stride of a quarter of them
    t = t.withColumn("stride", F.expr("greatest(1, int(size(w) / 4))")).withColumn("span", F.expr("size(w) + stride - 1"))
    return t.select("template", "license", "span", "stride", F.array_distinct(_shingles("w")).alias("shingles"), _signature("h").alias("signature"), F.array_distinct("h").alias("h"))


def find_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, containment, first_word, n_windows: for each document and license, the best window's share of
    the notice's shingles, the place of its first word, and how many windows match.

    Null and empty texts match nothing. Rows that repeat an id are counted together; so are rows with a null id. Ties go
    to the first window. Templates are a list that the caller passes: its tables are broadcast, as they don't grow with
    the documents. Other columns are not read. No Python runs on the executors; texts are not shuffled.
    """
    spark = docs.sparkSession
    table = template_table(spark, templates if templates is not None else TEMPLATES)
    known = table.select("template", "span", "stride", "h").collect()
    if not known:
        return docs.select(F.col(id_col).alias("doc_id")).limit(0).select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("first_word"), F.lit(0).cast("long").alias("n_windows"))
    every = sorted({h for r in known for h in r["h"]})
    sizes = sorted({(r["span"], r["stride"]) for r in known})

    def literal(hashes: list[int]) -> Column:
        return F.lit(list(hashes)).cast("array<long>")

    rows = _bind(_bind(docs.select(F.col(id_col).alias("doc_id"), text_of(docs, text_col).alias("text")), "w", _words(F.col("text"))).drop("text"), "h", _hashes("w")).where(F.arrays_overlap("h", literal(every)))
    # a window starts at a multiple of its stride; the last ones of a text may be shorter
    laid = []
    for span, stride in sizes:
        own = literal(sorted({h for r in known if (r["span"], r["stride"]) == (span, stride) for h in r["h"]}))
        at = F.filter(F.transform("h", lambda x, i: F.when(F.array_contains(own, x), i)), lambda i: i.isNotNull())
        first = F.flatten(F.transform(at, lambda i: F.sequence(F.floor(F.greatest(i - (span - WIDTH), F.lit(0)) / stride), F.floor(i / stride))))
        laid.append(F.transform(F.array_distinct(first), lambda k: F.struct(F.lit(span).alias("span"), (k * stride).cast("int").alias("start"))))
    windows = rows.select("doc_id", "w", "h", F.explode(F.flatten(F.array(*laid))).alias("x"))
    windows = windows.select(
        "doc_id", F.col("x.span").alias("span"), F.col("x.start").alias("start"),
        F.expr("slice(w, x.start + 1, x.span)").alias("w"), F.expr(f"slice(h, x.start + 1, greatest(1, x.span - {WIDTH - 1}))").alias("h"),
    ).where(F.size("h") > 0)
    bands = _bind(windows, "signature", _signature("h")).select("doc_id", "span", "start", "w", F.posexplode("signature").alias("band", "value"))
    listed = F.broadcast(table.select("template", F.col("span").alias("_span"), F.posexplode("signature").alias("_band", "_value")))
    met = bands.join(listed, (F.col("band") == F.col("_band")) & (F.col("value") == F.col("_value")) & (F.col("span") == F.col("_span")))
    met = met.join(F.broadcast(table.select(F.col("template").alias("_t"), "license", F.col("shingles").alias("_shingles"))), F.col("template") == F.col("_t"))
    # a window may collide in several bands
    met = met.select("doc_id", "license", "template", "span", "start", "w", "_shingles")
    share = F.size(F.array_intersect("_shingles", F.array_distinct(_shingles("w")))) / F.size("_shingles")
    sure = _bind(met, "share", share).where(F.col("share") >= containment)
    return sure.groupBy("doc_id", "license").agg(
        F.max("share").alias("containment"), F.min(F.struct((-F.col("share")).alias("s"), "start"))["start"].alias("first_word"), F.count_distinct("span", "start").alias("n_windows")
    )


