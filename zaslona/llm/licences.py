"""License scans by diagonal voting.

Every run of ``k`` words of every text is hashed and joined with the positions of the same runs in the license
templates. A hit votes for its diagonal, the offset between document and template. Diagonals are aggregated, those
within ``slack`` of each other and overlapping in the document are merged into a span, and a span is verified by
aligning its words with the template's: it counts if the aligned share of the template reaches ``least`` (0.8 for
templates of fewer than 12 words), its naming words are aligned and it names no restriction that the label lacks.

The base labels are phrases that stand in the text word for word. The templates are a fixed library of a few hundred
words, so their positions are broadcast.

Defined results: null and wordless texts have no words, places or labels and score 0; repeated rows each get a row;
rows are told apart by id and text; null ids are allowed. The score is the largest verified share of a template, at
least 0.5 where a base phrase stands.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash, sliced
from .runs import classes, hashes, mixed

# The phrases of the base labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices by which works are put under public licenses.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("reserved", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0."),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
]

# Words without which a notice is not that license's, where its template has them.
NAMING = {
    "apache": (b"apache",),
    "cc": (b"creative", b"commons", b"attribution", b"by"),
    "gpl": (b"gnu", b"general"),
    "lgpl": (b"gnu", b"lesser"),
    "mit": (b"mit",),
    "mpl": (b"mozilla",),
}
# Words of the restricting parts of Creative Commons names.
RESTRICTING = {"nc": (b"nc", b"noncommercial"), "nd": (b"nd", b"noderivatives", b"noderivs"), "sa": (b"sa", b"sharealike")}
RESTRICTIONS = frozenset(w for words in RESTRICTING.values() for w in words)
#: Templates of fewer words must stand in a higher share.
SHORT, LEAST_SHORT = 12, 0.8

_WORD = bytes([*range(48, 58), *range(97, 123), *range(128, 256)])
_KINDS = classes(words=_WORD)
_TO_WORDS = bytes(b if b in _WORD else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_MIX = np.uint64(0x9FB21C651E98DF25)


def flat(text: str | None) -> bytes:
    """Folded words with single or more spaces between them."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out = mixed(out * _MIX + h[j : j + n])
    return out


def places(words: bytes, h: np.ndarray, phrase: str) -> np.ndarray:
    """Starts of a phrase among words with hashes h."""
    goal = hashes([phrase.encode()], _KINDS)[0]
    n = len(h) - len(goal) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    hit = np.ones(n, bool)
    for j, x in enumerate(goal):
        hit &= h[j : j + n] == x
    at = np.flatnonzero(hit)
    if len(at):  # equal hashes are not yet equal words
        w, want = words.split(), phrase.encode().split()
        at = np.array([i for i in at if w[i : i + len(want)] == want], np.int64)
    return at


def _hashed(k: int):
    names = sorted(set(PHRASES.values()))

    def run(batches):
        for batch in batches:
            texts = [flat(t) for t in batch.column(2).to_pylist()]
            hs = hashes(texts, _KINDS)
            found: list[tuple] = []
            for words, h in zip(texts, hs):
                at = {label: places(words, h, phrase) for phrase, label in PHRASES.items()}
                every = np.concatenate(list(at.values()))
                some = len(every) > 0
                found.append((len(h), len(every), int(every.min()) if some else None, int(every.max()) if some else None, [x for x in names if len(at[x])]))
            runs = [grams(h, k) for h in hs]
            ends = np.concatenate([[0], np.cumsum([len(g) for g in runs])]).astype(np.int32)
            values = pa.array(np.concatenate(runs).view(np.int64) if runs else np.zeros(0, np.int64))
            cols = list(zip(*found)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(ends), values)], names=["id", "text_hash", "n_words", "n_base", "first_word", "last_word", "base", "grams"])

    return run


def template_words() -> list[list[bytes]]:
    return [flat(text).split() for _, text in TEMPLATES]


def naming(label: str, template: list[bytes]) -> set[bytes]:
    """The words of a template that tell its license from others."""
    return {*NAMING.get(label.split("-")[0], ()), *RESTRICTIONS} & set(template)


def aligned(words: list[bytes], template: list[bytes], needed: set[bytes] = frozenset()) -> float:
    """The share of a template whose words stand in order in a span; 0 where a needed one does not."""
    blocks = SequenceMatcher(None, words, template, autojunk=False).get_matching_blocks()
    met = {w for b in blocks for w in template[b.b : b.b + b.size]}
    return sum(b.size for b in blocks) / len(template) if met >= needed else 0.0


def foreign(label: str, words: list[bytes]) -> bool:
    """Whether words name a restriction that a Creative Commons label lacks."""
    own = {w for x in label.split("-") for w in RESTRICTING.get(x, ())}
    return label.startswith("cc-by") and not RESTRICTIONS.isdisjoint(set(words) - own)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, slack: int = 3, least: float = 0.6) -> DataFrame:
    """One row per document: the id, n_words, n_base, first_word, last_word, base_labels, labels, score, and spans (array of struct<label, first, last, share>)."""
    spark = docs.sparkSession
    stash = Stash(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))
    hashed = src.mapInArrow(sliced(_hashed(k)), "id long, text_hash long, n_words long, n_base long, first_word long, last_word long, base array<string>, grams array<long>")

    rows = []
    for t, words in enumerate(template_words()):
        h = grams(hashes([b" ".join(words)], _KINDS)[0], k).view(np.int64)
        rows += [(int(x), t, i) for i, x in enumerate(h)]
    library = spark.createDataFrame(rows, "g long, template int, there int")

    # Element 0 stands for the document itself, so that one pass over the texts gives both the documents and their hits.
    one = hashed.select("*", F.posexplode(F.concat(F.array(F.lit(None).cast("long")), "grams")).alias("p", "g")).drop("grams")
    voted = stash(one.join(F.broadcast(library), "g", "left").where("p = 0 or template is not null"))
    facts = voted.where("p = 0").select("id", "text_hash", "n_words", "n_base", "first_word", "last_word", "base")
    diagonal = (F.col("p") - 1 - F.col("there")).alias("diagonal")
    # Equal rows vote alike; distinct votes count them once.
    votes = voted.where("p > 0").select("id", "text_hash", "template", diagonal, (F.col("p") - 1).alias("at")).distinct()
    lines = votes.groupBy("id", "text_hash", "template", "diagonal").agg(F.count("*").alias("votes"), F.min("at").alias("first"), (F.max("at") + k).alias("last"))
    size = F.create_map(*[F.lit(x) for t, w in enumerate(template_words()) for x in (t, len(w))])
    by = Window.partitionBy("id", "text_hash", "template").orderBy("first", "diagonal")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    apart = (F.col("first") > F.max("last").over(before) + slack) | (F.abs(F.col("diagonal") - F.lag("diagonal").over(by)) > slack)
    spans = (
        lines.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("span", F.sum("new").over(by))
        .groupBy("id", "text_hash", "template", "span")
        .agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
        .where(F.col("votes") + k - 1 >= least / 2 * size[F.col("template")])
    )
    claims = spans.groupBy("id", "text_hash").agg(F.collect_list(F.struct("template", "first", "last")).alias("claims"))

    def verify(batches):
        templates = template_words()
        for batch in batches:
            ids, keys, texts, every = (c.to_pylist() for c in batch.columns)
            out = []
            for text, claim in zip(texts, every):
                words, good = flat(text).split(), []
                for c in claim:
                    t = templates[c["template"]]
                    label = TEMPLATES[c["template"]][0]
                    share = aligned(words[c["first"] : c["last"]], t, naming(label, t))
                    if share >= (max(least, LEAST_SHORT) if len(t) < SHORT else least) and not foreign(label, words[c["first"] : c["last"] + 1]):
                        good.append({"label": label, "first": c["first"], "last": c["last"], "share": share})
                out.append(sorted(good, key=lambda s: (s["first"], s["last"], s["label"], s["share"])))
            kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(out, kind)], names=["id", "text_hash", "spans"])

    same = F.expr("id <=> claim_id and text_hash = claim_hash")
    named = claims.select(F.col("id").alias("claim_id"), F.col("text_hash").alias("claim_hash"), "claims")
    checked = src.join(named, same).select("id", "text_hash", "text", "claims").mapInArrow(sliced(verify), "id long, text_hash long, spans array<struct<label string, first long, last long, share double>>").groupBy("id", "text_hash").agg(F.first("spans").alias("spans"))
    checked = checked.select(F.col("id").alias("claim_id"), F.col("text_hash").alias("claim_hash"), "spans")
    full = facts.join(checked, same, "left").withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<label string, first long, last long, share double>>)")))
    best = F.coalesce(F.array_max(F.col("spans.share")), F.lit(0.0))
    score = F.least(F.greatest(best, F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)), F.lit(1.0))
    labels = F.array_sort(F.array_union("base", F.col("spans.label")))
    return full.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), "spans")
