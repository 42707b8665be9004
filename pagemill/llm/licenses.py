"""Licence scans by a positional index of rare tokens, with DataFrame functions only.

Templates are licence notices and the paragraphs of licence bodies; a plain
phrase is a template that is all key phrase. The index posts each template's
words of highest IDF over the whole corpus, with their places. A file's licence
words are looked up there and the postings intersected by relative position:
pairs of a place in the file and a place in a template with the same difference
lie on one placement of the template. A placement that covers enough of the
posted weight is a candidate, and holds if the template's mandatory key phrase
stands at exactly its places. What is bounded is the index of a template, never
the words of a file, so a file may hold any number of licences.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

# Phrases and their labels; templates as (label, text, mandatory key phrase), after the licences' own wording.
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
TEMPLATES = [
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3", "gnu affero general public license"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license"),
    ("boost-1.0", "Distributed under the Boost Software License, Version 1.0", "boost software license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", "redistribution and use in source and binary forms"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", "cc by sa"),
    ("cc0", "CC0 1.0 Universal public domain dedication", "cc0 1 0 universal"),
    ("epl-2.0", "Made available under the terms of the Eclipse Public License 2.0", "eclipse public license"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", "gnu general public license version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "gnu general public license version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    ("lgpl", "This library is free software under the GNU Lesser General Public License", "gnu lesser general public license"),
    ("mit", "Released under the MIT License", "mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License", "mozilla public license"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "gnu affero general public license as published by the free software foundation"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache org licenses license 2 0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License", "without warranties or conditions of any kind"),
    ("boost-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software", "software and accompanying documentation covered by this license"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", "this list of conditions and the following disclaimer"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "either version 2 of the license"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "either version 3 of the license"),
    ("isc", "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE", "negligence or other tortious action"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "gnu lesser general public license"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "this permission notice shall be included in all copies"),
    ("mpl-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "copy of the mpl was not distributed with this file"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
]
#: Words that templates have but that say little; they are indexed only where a key phrase has them.
PLAIN = frozenset("a an any and as at be by can for form from if in is it its may of on one or other the this to under use was with without work made code you will".split())
#: Words of highest IDF that the index posts of a template, and the share of their weight that a placement must cover.
POSTED, COVER = 24, 0.5
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    """A phrase's or template's words."""
    return re.findall(r"[0-9a-z]+", text.lower())


def posting_rows(templates=None, phrases=None) -> list[tuple]:
    """(template, label, base, word, place, rare, key) of the templates, then of the phrases (base): as many rows as they have words that count."""
    listed = [(label, text, key, False) for label, text, key in (TEMPLATES if templates is None else templates)]
    listed += [(label, text, text, True) for label, text in (PHRASES if phrases is None else phrases)]
    rows = []
    for i, (label, text, key, base) in enumerate(listed):
        words, need = words_of(text), words_of(key)
        at = next(j for j in range(len(words)) if words[j : j + len(need)] == need)
        if all(w in PLAIN for w in words):
            raise ValueError(f"no word of {text!r} tells it from any text")
        for place, word in enumerate(words):
            is_key = at <= place < at + len(need)
            if is_key or word not in PLAIN:
                rows.append((i, label, base, word, place, word not in PLAIN, is_key))
    return rows


def reach(rows: list[tuple]) -> int:
    """How far a plain word of a key phrase may stand from a rare word of its template."""
    return max((min(abs(place - p) for t, _, _, _, p, rare, _ in rows if t == template and rare) for template, _, _, _, place, _, _ in rows), default=0)


def places(docs: DataFrame, rows: list[tuple]) -> DataFrame:
    """(doc_id, text_key, n_words, hits) for every row; the texts go no further.

    hits are the (word, place) pairs of the index's rare words, and of plain
    words that key phrases have, where a rare word is near enough to share one.
    """
    rare = sorted({r[3] for r in rows if r[5]})
    plain = sorted({r[3] for r in rows if not r[5]})
    near = reach(rows)
    split = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), SEPARATORS).alias("words"))
    empty = lambda i: (F.get("words", i) == "").cast("long")
    only = F.size("words") == 1
    n = F.size("words") - empty(F.lit(0)) - F.when(only, 0).otherwise(empty(F.size("words") - 1))
    seen = split.withColumn("n_words", n.cast("long"))
    beside = lambda i: F.exists(F.slice("words", F.greatest(i - near, F.lit(0)) + 1, F.lit(2 * near + 1)), lambda w: w.isin(rare))
    tells = lambda w, i: w.isin(rare) | (w.isin(plain) & beside(i)) if plain else w.isin(rare)
    marked = F.transform("words", lambda w, i: F.when(tells(w, i), F.struct(w.alias("word"), (i.cast("long") - empty(F.lit(0))).alias("place"))))
    return seen.select("doc_id", "text_key", "n_words", F.array_compact(marked).alias("hits"))


def placements(hits: DataFrame, n_docs: int, rows: list[tuple], cover: float = COVER, posted: int = POSTED) -> DataFrame:
    """(doc_id, text_key, template, label, base, shift, support): the verified places of templates and phrases; hits is (doc_id, text_key, word, place), each once."""
    spark = hits.sparkSession
    listed = spark.createDataFrame(rows, "template int, label string, base boolean, word string, place int, rare boolean, key boolean")
    found = hits.groupBy("word").agg(F.log(1 + F.lit(float(n_docs)) / F.count_distinct(F.struct("doc_id", "text_key"))).alias("weight"))
    # words that the corpus lacks weigh as if one file had them
    idf = listed.filter("rare").select("word").distinct().join(found, "word", "left").withColumn("weight", F.coalesce("weight", F.log(F.lit(1.0 + n_docs))))
    best = W.partitionBy("template").orderBy(F.desc("weight"), "word", "place")  # over a template's words
    index = listed.filter("rare").join(idf, "word").withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= posted)
    index = cut(index.select("template", "label", "base", "word", F.col("place").alias("at"), "weight"))  # no more rows than the templates have words
    whole = index.groupBy("template").agg(F.sum("weight").alias("total"))
    of_file = ["doc_id", "text_key"]
    met = hits.join(F.broadcast(index), "word").withColumn("shift", F.col("place") - F.col("at"))
    placed = met.groupBy(*of_file, "template", "label", "base", "shift").agg(F.sum("weight").alias("got"))
    likely = placed.join(F.broadcast(whole), "template").withColumn("support", F.least(F.col("got") / F.col("total"), F.lit(1.0))).filter(F.col("support") >= cover)
    keys = listed.filter("key").select("template", "word", F.col("place").alias("at"))
    need = keys.groupBy("template").agg(F.count("*").alias("need"))
    wanted = likely.join(F.broadcast(keys), "template").withColumn("place", F.col("shift") + F.col("at"))
    h, q = hits.alias("h"), wanted.alias("q")
    same = F.col("h.doc_id").eqNullSafe(F.col("q.doc_id")) & (F.col("h.text_key") == F.col("q.text_key")) & (F.col("h.word") == F.col("q.word")) & (F.col("h.place") == F.col("q.place"))
    there = q.join(h, same, "left_semi").groupBy(*of_file, "template", "label", "base", "shift", "support").agg(F.count("*").alias("have"))
    return there.join(F.broadcast(need), ["template"]).filter("have = need").drop("have", "need")


def scan(docs: DataFrame, templates=None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of docs (doc_id, text).

    Words are runs of digits, letters A-Z (lowered) and signs beyond ASCII. n_base
    counts the places of the phrases; first_word and last_word are the smallest
    and largest start of one, null without any. base_labels are the phrases'
    labels, labels also those of verified templates, distinct, sorted and
    comma-joined. score is the largest share of a verified phrase's or
    template's posted weight that stands in its place (1 with a phrase, which is
    whole), else 0. A null text counts as empty: no words, no labels. A file may
    hold any number of licences. Repeated rows stay; an empty table gives no
    rows; other columns play no part.
    """
    rows = posting_rows(templates)
    seen = cut(places(docs, rows))
    hits = cut(seen.filter(F.size("hits") > 0).select("doc_id", "text_key", F.explode("hits").alias("x")).select("doc_id", "text_key", "x.word", "x.place").distinct())
    found = placements(hits, seen.count(), rows)
    start = F.when(F.col("base"), F.col("shift"))
    by_file = found.groupBy("doc_id", "text_key").agg(
        F.count(start).alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base_labels"), F.collect_set("label").alias("labels"), F.max("support").alias("support"),
    )
    s, m = seen.alias("s"), by_file.alias("m")
    met = s.join(m, F.col("s.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("s.text_key") == F.col("m.text_key")), "left")
    listed = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return met.select(
        "s.doc_id", "s.n_words", F.coalesce("m.n_base", F.lit(0).cast("long")).alias("n_base"), "m.first_word", "m.last_word",
        listed("m.base_labels").alias("base_labels"), listed("m.labels").alias("labels"), F.round(F.coalesce("m.support", F.lit(0.0)), 6).alias("score"),
    )
