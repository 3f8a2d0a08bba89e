"""Licence recognition by ordered sentences, with DataFrame operations only."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import row_key, whole_text

#: Sentences of well-known licence texts and notices, normalised (lower case, words and digits only).
SENTENCES: dict[str, str] = {
    "mit.name": "mit license",
    "mit.released": "released under the mit license",
    "mit.licensed": "licensed under the mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit.warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache.licensed": "licensed under the apache license version 2 0",
    "apache.header": "licensed under the apache license version 2 0 the license",
    "apache.use": "you may not use this file except in compliance with the license",
    "apache.obtain": "you may obtain a copy of the license at",
    "apache.basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl3.licensed": "this work is licensed under the gnu general public license version 3",
    "gpl.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl.hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl.see": "see the gnu general public license for more details",
    "bsd.grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc.by.nc": "licensed under cc by nc 4 0",
    "cc.by": "licensed under cc by 4 0",
    "cc.by.sa": "licensed under cc by sa 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "rights": "all rights reserved",
}

#: A licence is found where all sentences of one of its rules occur in this order, others between them or not.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit.released",)),
    ("MIT", ("mit.licensed",)),
    ("MIT", ("mit.grant", "mit.notice", "mit.warranty")),
    ("Apache-2.0", ("apache.licensed",)),
    ("Apache-2.0", ("apache.header", "apache.use", "apache.obtain", "apache.basis")),
    ("GPL-3.0", ("gpl3.licensed",)),
    ("GPL-3.0-or-later", ("gpl.free", "gpl.hope", "gpl.see")),
    ("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse")),
    ("CC-BY-NC-4.0", ("cc.by.nc",)),
    ("CC-BY-4.0", ("cc.by",)),
    ("CC-BY-SA-4.0", ("cc.by.sa",)),
    ("CC0-1.0", ("cc0",)),
    ("Proprietary", ("rights",)),
)
#: Where a sentence may begin or end, and no known one goes on: sentence ends and blank lines, with marks in them or not.
HARD_END = r"[.!?]+(?:\s+|$)|\n[^\p{L}\p{N}]*\n"
#: Where a sentence may begin or end, or go on: line ends and inner stops.
SOFT_END = r"[.!?;:]+(?:\s+|$)|\n"


def normalised(sentence: Column) -> Column:
    """Lower-cased words and digits with single spaces between them."""
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))


def marked(text: Column) -> Column:
    """Normalised words with ``|`` where a sentence may end or go on, and ``#`` where it must end."""
    text = F.regexp_replace(F.translate(text, "|#", "  "), HARD_END, "#")
    text = F.regexp_replace(F.lower(F.regexp_replace(text, SOFT_END, "|")), r"[^\p{L}\p{N}|#]+", " ")
    return F.concat(F.lit("#"), text, F.lit("#"))


def known_sentence(known: Sequence[str]) -> str:
    """Pattern of the longest known sentence that begins at a mark and ends at one; its words may be on several lines."""
    longest_first = sorted(set(known), key=lambda x: (-len(x), x))
    return "[|#] ?(?=(" + "|".join("[ |]+".join(map(re.escape, x.split())) for x in longest_first) + ") ?[|#])"


def in_order(found: Column, rule: Sequence[str]) -> Column:
    """Whether the names of ``rule`` occur in the array ``found`` of places and names, one after the other."""
    names = F.array(*[F.lit(x) for x in rule])
    start = F.struct(F.lit(0).alias("done"), F.lit(-1).alias("last"))

    def step(state: Column, x: Column) -> Column:
        next_one = F.coalesce((F.get(names, state["done"]) == x["sentence_id"]) & (x["at"] > state["last"]), F.lit(False))
        return F.struct(
            (state["done"] + next_one.cast("int")).alias("done"), F.when(next_one, x["at"]).otherwise(state["last"]).alias("last"),
        )

    return F.aggregate(found, start, step)["done"] == len(rule)


def scan_licenses(
    docs: DataFrame,
    sentences: Mapping[str, str] | None = None,
    rules: Sequence[tuple[str, Sequence[str]]] | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Licences whose sentences a document holds in the order of a rule.

    Whole texts are normalised, with marks at sentence ends, inner stops and line
    ends. A known sentence is found where its words, and no others, stand between
    two marks; single line ends, comment signs and inner stops (``;`` and ``:``)
    may be among them, a blank line or a sentence end may not. Each place gives
    the longest one; those that begin like it and end at a mark in it are found
    too. Only what is found is joined and shuffled, to put the sequence of a
    document together. The list of known sentences is a parameter of a fixed
    size, and the only side that may be broadcast.

    Returns for each distinct row of id and text: ``doc_id, n_sentences`` (known
    ones found), ``sentence_ids`` (comma-separated, in order) and ``licenses``
    (sorted and comma-separated; empty if none). Null and empty texts have none.
    Rows with a null id are kept apart by their text. Other columns are not read.
    """
    known = dict(SENTENCES if sentences is None else sentences)
    rules = RULES if rules is None else rules
    spark = docs.sparkSession
    nested = [
        (long, text_, name) for long in known.values() for name, text_ in known.items() if f"{long} ".startswith(f"{text_} ")
    ]
    table = spark.createDataFrame(
        sorted(set(nested)), T.StructType([T.StructField(x, T.StringType()) for x in ("longest", "sentence", "sentence_id")]),
    )
    base = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("key"), whole_text(text).alias("body"))
    places = F.regexp_extract_all(marked(F.col("body")), F.lit(known_sentence(list(known.values()))), F.lit(1))
    found = (
        base.select("key", F.posexplode(places).alias("at", "piece"))
        .withColumn("piece", F.regexp_replace("piece", r" ?\|[ |]*", "|"))
        .withColumn("longest", F.translate("piece", "|", " "))
        .join(F.broadcast(table), "longest")
        .where(F.substr("piece", F.length("sentence") + 1, F.lit(1)).isin("", "|"))
        .groupBy("key")
        .agg(F.array_sort(F.collect_set(F.struct("at", F.length("sentence").alias("length"), "sentence_id"))).alias("found"))
    )
    names = F.array_compact(F.array(*[F.when(in_order(F.col("found"), rule), F.lit(name)) for name, rule in rules]))
    decided = found.select(
        "key", F.col("found")["sentence_id"].alias("found"), F.concat_ws(",", F.array_sort(F.array_distinct(names))).alias("names"),
    )
    return (
        base.select("doc_id", "key").distinct().join(decided, "key", "left")
        .select(
            "doc_id",
            F.coalesce(F.size("found"), F.lit(0)).alias("n_sentences"),
            F.coalesce(F.concat_ws(",", "found"), F.lit("")).alias("sentence_ids"),
            F.coalesce("names", F.lit("")).alias("licenses"),
        )
    )
