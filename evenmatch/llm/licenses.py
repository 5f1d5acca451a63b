"""License scan by diagonal voting.

All rolling word k-gram hashes of the documents are joined to the positions of the same grams in
the license templates. A hit votes for the diagonal (document position minus template position);
neighbouring diagonals of a long template are one span, so that dropped or added words do not
split it. Spans are verified on the words themselves: a phrase must stand word for word, a long
template must be found to ``ENOUGH``.

A null or empty text has no places and the score 0. Rows are told apart by id and text; repeated rows
get equal results. Of equally placed spans all count, each for its own label. An empty table gives an
empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .words import NOT_ALNUM, hashed_words, mix

# Phrases that are counted word for word, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further notices that must stand word for word, and their labels.
NOTICES = {
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "boost software license": "boost",
    "isc license": "isc",
    "zlib license": "zlib",
    "cc0 1 0": "cc0",
}
# Opening passages of license texts.
PASSAGES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "agpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "epl": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
    "boost": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "cc0": "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide this software is distributed without any warranty",
}
# Later passages.
LATER = {
    "mit": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability",
    "apache": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "bsd": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
}
SHORT, LONG = 2, 5  # words in a gram of phrases and of passages
NEAR = 4  # diagonals so close belong to one span
ENOUGH = 0.75  # share of a passage's words found in order
_STEP = 0xD1342543DE82EF95


def templates() -> list[tuple[str, bool, bool, list[str]]]:
    """``(label, counted as base, passage, words)`` of every template."""
    found = [(label, True, False, phrase.split()) for phrase, label in PHRASES.items()]
    found += [(label, False, False, phrase.split()) for phrase, label in NOTICES.items()]
    return found + [(label, False, True, text.split()) for label, text in (*PASSAGES.items(), *LATER.items())]


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (of the words there are, near the end)."""
    value = np.full(len(words), k, np.uint64)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    for j in range(k):
        value = value * np.uint64(_STEP) + padded[j : j + len(words)]
    return mix(value).view(np.int64)


def template_grams(spark) -> DataFrame:
    """``gram, template, at`` of all template positions: a table of fixed size."""
    rows = []
    for no, (_, _, passage, words) in enumerate(templates()):
        k = LONG if passage else SHORT
        for _, _, hashes, _ in hashed_words(pa.array([" ".join(words)]), NOT_ALNUM):
            rows += [(int(g), no, at) for at, g in enumerate(_grams(hashes, k)[: len(words) - k + 1])]
    return spark.createDataFrame(rows, "gram long, template int, at int")


def _document_grams(batches):
    for batch in batches:
        k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
        for row, to, words, at in hashed_words(batch.column("text"), NOT_ALNUM):
            size = np.diff(at)
            which = np.repeat(np.arange(row, to), size)
            place = np.arange(len(words)) - np.repeat(at[:-1], size)
            left = np.repeat(at[1:], size) - np.arange(len(words))  # words up to the end of the text
            short, long = _grams(words, SHORT), _grams(words, LONG)
            for gram, keep in ((short, left >= SHORT), (long, left >= LONG)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[which[keep]]), pa.array(k2[which[keep]]), pa.array(place[keep].astype(np.int32)), pa.array(gram[keep])], names=["k1", "k2", "pos", "gram"]
                )


def _keys(id_col: str) -> list[Column]:
    """128 bits that tell rows apart."""
    return [F.xxhash64(id_col, "text").alias("k1"), F.xxhash64("text", F.lit("license"), id_col).alias("k2")]


def spans(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``k1, k2, template, lo, hi``: voted word ranges (from, to) of the rows, before verification."""
    kinds = templates()
    spark = docs.sparkSession
    grams = docs.select(*_keys(id_col), F.col("text")).mapInArrow(_document_grams, "k1 long, k2 long, pos int, gram long")
    hits = grams.join(F.broadcast(template_grams(spark)), "gram").select("k1", "k2", "template", "pos", "at").distinct()
    passage = F.col("template").isin([no for no, kind in enumerate(kinds) if kind[2]])
    grams_of = F.element_at(F.array(*[F.lit(len(k[3]) - SHORT + 1) for k in kinds]), F.col("template") + 1)
    lines = hits.groupBy("k1", "k2", "template", (F.col("pos") - F.col("at")).alias("d")).agg(F.count("*").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    phrases = lines.where(~passage & (F.col("votes") == grams_of)).select("k1", "k2", "template", "lo", (F.col("hi") + SHORT).alias("hi"))
    order = W.partitionBy("k1", "k2", "template").orderBy("d")
    long = lines.where(passage).withColumn("new", F.when(F.col("d") - F.lag("d").over(order) <= NEAR, 0).otherwise(1))
    long = long.withColumn("span", F.sum("new").over(order)).groupBy("k1", "k2", "template", "span").agg(F.min("lo").alias("lo"), (F.max("hi") + LONG).alias("hi"))
    return phrases.unionByName(long.drop("span"))


def _alike(found: list[str], wanted: list[str]) -> float:
    """Share of the wanted words that are found in order."""
    return sum(b.size for b in SequenceMatcher(None, found, wanted, autojunk=False).get_matching_blocks()) / len(wanted)


def _verify(frames):
    import re

    word, kinds = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), templates()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for frame in frames:
        out = []
        for k1, k2, text, found in zip(frame.k1, frame.k2, frame.text, frame.spans, strict=True):
            words = word.findall((text or "").translate(lower))
            base, base_labels, labels, score, places = [], set(), set(), 0.0, []
            for s in found:
                label, counted, passage, wanted = kinds[s["template"]]
                if passage:
                    slack = len(wanted) // 4
                    alike = _alike(words[max(0, s["lo"] - slack) : s["hi"] + slack], wanted)
                    good = alike >= ENOUGH
                else:
                    good = words[s["lo"] : s["hi"]] == wanted
                    alike = 1.0
                if good:
                    labels.add(label)
                    score = max(score, min(1.0, alike))
                    places.append((int(s["lo"]), int(s["hi"]), label))
                    if counted:
                        base.append(int(s["lo"]))
                        base_labels.add(label)
            out.append((k1, k2, len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, sorted(places)))
        cols = ["k1", "k2", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]
        result = pd.DataFrame(out, columns=cols)
        yield result.astype({"first_word": "Int64", "last_word": "Int64"})


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, base places, labels, score and all verified places."""
    docs = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = spans(docs, id_col).groupBy("k1", "k2").agg(F.collect_list(F.struct("template", "lo", "hi")).alias("spans"))
    texts = docs.select(*_keys(id_col), "text").join(found, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    checked = texts.mapInPandas(
        _verify, "k1 long, k2 long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<lo:int,hi:int,label:string>>"
    )
    count = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")
    out = docs.select(id_col, *_keys(id_col), count.alias("n_words")).join(checked, ["k1", "k2"], "left")
    return out.select(
        id_col, "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "places",
    )
