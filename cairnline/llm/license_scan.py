"""License scan by diagonal voting.

Every run of k words of every text is hashed. Runs that occur in some template are joined to their
positions there; each pair votes for a diagonal, the offset between text and template. Votes are
counted by diagonal, neighbouring diagonals (a word more or less) are merged into spans, and each
span is verified word by word against its template by their longest common subsequence.

Runs that occur in no template can't vote, so they are dropped where they are hashed, by look-up in
the sorted template hashes; templates are a parameter whose size is checked. Only texts with votes
travel further. Places of exact phrases (base labels) are found in the same pass.

Defined results: null text is empty; a text without words has null positions, no labels and score 0;
rows with equal ids and texts get equal results; templates under k words never vote. The score is the
best share found of any template's words, or 1 where a phrase stands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices
from .wordhash import alnum_words, runs, split_hashes, word_hashes

K = 3
MOST_TEMPLATE_WORDS = 1_000_000
# Notices of public licenses by label, whole or (the last of each kind) as authors shorten them.
_PERMIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
_MIT_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_REDISTRIBUTE = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_1_2 = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_3 = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_AS_IS = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
TEMPLATES = [
    ("mit", f"{_PERMIT} {_MIT_AS_IS}"),
    ("mit", _PERMIT.split(" the software to deal")[0]),
    ("mit", "released under the mit license"),
    ("bsd-2", f"{_REDISTRIBUTE} {_BSD_1_2} {_BSD_AS_IS}"),
    ("bsd-3", f"{_REDISTRIBUTE} {_BSD_1_2} {_BSD_3} {_BSD_AS_IS}"),
    ("bsd", _REDISTRIBUTE),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]


def common_words(a: list, b: list) -> int:
    """Length of the longest common subsequence, a row of the table at a time as the bits of a number."""
    places: dict = {}
    for n, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << n
    row, whole = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & whole
    return len(a) - row.bit_count()


def scan(
    docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, k: int = K,
    drift: int = 2, least: float = 0.75,
) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of each row.

    ``drift``: how far apart merged diagonals may lie; ``least``: the share of a template's words
    that a span must have in order."""
    spark = docs.sparkSession
    words = [alnum_words(t.encode()) for _, t in templates]
    if sum(map(len, words)) > MOST_TEMPLATE_WORDS:
        raise ValueError("too many template words: scan in blocks of templates")
    hashed = split_hashes(words, word_hashes)
    places = [(int(h.view(np.int64)), n, at) for n, w in enumerate(hashed) for at, h in enumerate(runs(w, k))]
    sought = np.unique(np.array([p[0] for p in places], np.int64)) if places else np.zeros(0, np.int64)
    base = [(label, split_hashes([alnum_words(t.encode())], word_hashes)[0]) for label, t in phrases]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            each = [alnum_words(t) for t in texts]
            rows = []
            for text, h in zip(texts, split_hashes(each, word_hashes), strict=True):
                n_base, first, last, labels = 0, None, None, set()
                for label, p in base:
                    hit = np.ones(max(0, len(h) - len(p) + 1), bool)
                    for n, x in enumerate(p):
                        hit &= h[n: len(hit) + n] == x
                    at = np.flatnonzero(hit)
                    if len(at):
                        n_base += len(at)
                        labels.add(label)
                        first = int(at[0]) if first is None else min(first, int(at[0]))
                        last = int(at[-1]) if last is None else max(last, int(at[-1]))
                r = runs(h, k).view(np.int64)
                found = np.flatnonzero(np.isin(r, sought)) if len(r) and len(sought) else np.zeros(0, np.int64)
                votes = [{"at": int(n), "h": int(r[n])} for n in found]
                key = hashlib.blake2b(text, digest_size=16).digest() if votes else None
                rows.append((len(h), n_base, first, last, ",".join(sorted(labels)), votes, key, text if votes else None))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("at", pa.int64()), ("h", pa.int64())])), pa.binary(), pa.binary()]
            columns = [pa.array([r[n] for r in rows], t) for n, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "votes", "key", "text"]
            )

    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = text.schema["doc_id"].dataType.simpleString()
    found = materialise(text.mapInArrow(
        find, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, votes array<struct<at:long,h:long>>, key binary, text binary"
    ), "license")

    # Equal texts vote once: spans belong to texts, not rows.
    voting = found.filter(F.col("key").isNotNull())
    texts = voting.groupBy("key").agg(F.first("votes").alias("votes"), F.first("text").alias("text"))
    table = spark.createDataFrame(places, "h long, template int, place int")
    votes = texts.select("key", F.explode("votes").alias("v")).select("key", "v.at", "v.h").join(F.broadcast(table), "h")
    lines = votes.withColumn("diagonal", F.col("at") - F.col("place")).groupBy("key", "template", "diagonal").agg(
        F.count(F.lit(1)).alias("votes"), F.min("at").alias("begin"), (F.max("at") + k).alias("end")
    )
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > drift).cast("int"), F.lit(0))
    merged = lines.withColumn("new", new).withColumn("line", F.sum("new").over(order)).groupBy("key", "template", "line").agg(
        F.sum("votes").alias("votes"), F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("diagonal").alias("diagonal")
    )
    spans = merged.groupBy("key").agg(F.collect_list(F.struct("template", "begin", "end", "diagonal", "votes")).alias("spans"))
    labels_of = [label for label, _ in templates]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, each in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                w, labels, best = alnum_words(text), set(), 0.0
                for s in each:
                    t = words[s["template"]]
                    begin = max(0, min(s["begin"], s["diagonal"]))
                    part = w[begin: max(s["end"], begin + len(t) + drift)]
                    share = common_words(t, part) / len(t)
                    best = max(best, share)
                    if share >= least:
                        labels.add(labels_of[s["template"]])
                out.append((",".join(sorted(labels)), best))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], ["key", "more", "share"]
            )

    verified = texts.select("key", "text").join(spans, "key").mapInArrow(verify, "key binary, more string, share double")
    out = found.drop("votes", "text").join(verified, "key", "left")
    both = F.array_sort(F.array_distinct(F.filter(F.split(F.concat_ws(",", "base_labels", "more"), ","), lambda x: x != "")))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.when(F.col("more").isNull(), F.col("base_labels")).otherwise(F.array_join(both, ",")).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
