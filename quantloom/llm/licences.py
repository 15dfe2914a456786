"""Licence scan with a positional rare-token index; DataFrame functions only.

The templates (short notices and passages of licence texts) are indexed by word: template, place in it.
Document frequencies over the whole corpus tell how rare each of their words is.
Of the words that a file shares with a template whose key phrase's words it has, the file's own
rarest ones, and the key phrase's rarest one, are looked up in the index; every hit, moved back by the place
in the template, says where that template would begin. There the template's
other words are intersected with the file's by relative position, weighed by
inverse document frequency, and the template's key phrase must stand whole. As a word of the key phrase
is always among those looked up, no place where the key phrase stands is passed over.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words, upper case counting as letters.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str
    #: Every place counts, and only whole matches are taken.
    base: bool = False


# Wordings of public licences and notices, in lower-case words.
TEMPLATES = (
    Template("gpl", "gnu general public license", "gnu general public license", True),
    Template("apache", "apache license", "apache license", True),
    Template("cc-by", "cc by", "cc by", True),
    Template("mit", "mit license", "mit license", True),
    Template("gpl-2.0", "gnu general public license version 2", "public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3", "public license version 3"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "under the terms of the gnu general public license"),
    Template("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "see the gnu general public license for more details"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "may not use this file except in compliance with the license"),
    Template("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "without warranties or conditions of any kind"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "free of charge to any person obtaining a copy"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "to deal in the software without restriction"),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "in all copies or substantial portions of the software"),
    Template("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "the use or other dealings in the software"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee is hereby granted"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "this permission notice appear in all copies"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "in source and binary forms with or without modification"),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain"),
    Template("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce"),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "if a copy of the mpl was not distributed with this file"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "without any express or implied warranty"),
    Template("bsl-1.0", "boost software license version 1 0", "boost software license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "for any purpose commercial or non commercial and by any means"),
    Template("cc0-1.0", "cc0 1 0 universal", "cc0 1 0 universal"),
    Template("cc-by-4.0", "cc by 4 0", "cc by 4 0"),
    Template("cc-by-sa-4.0", "cc by sa 4 0", "cc by sa 4 0"),
    Template("cc-by-nc-4.0", "cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-nd-4.0", "cc by nd 4 0", "cc by nd 4 0"),
    Template("cc-by-nc-sa-4.0", "cc by nc sa 4 0", "cc by nc sa 4 0"),
)


def words_of(text: Column) -> Column:
    """Lower-case words of a text, null counting as empty. No template word has a letter that a non-ASCII one is lower-cased to."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def rarity(docs: DataFrame, templates: Sequence[Template], *, text_col: str = "text") -> dict[str, float]:
    """Inverse document frequency of each template word over all rows; bounded by the templates' vocabulary."""
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    found = docs.select(F.array_intersect(words_of(F.col(f"`{text_col}`")), F.array(*map(F.lit, vocabulary))).alias("w"))
    rows = found.select(F.explode(F.concat("w", F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    n = {r["w"]: r["n"] for r in rows}
    return {w: math.log((n.get("", 0) + 2) / (n.get(w, 0) + 1)) for w in vocabulary}


def _texts(rows: Sequence[Sequence[str]]) -> Column:
    return F.array(*(F.array(*map(F.lit, r)) for r in rows))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = TEMPLATES, anchors: int = 4, share: float = 0.85) -> DataFrame:
    """``id_col``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score`` of every row.

    A template is looked for from its key phrase's rarest word and the ``anchors`` rarest of its words that the
    file has (equally rare ones by the alphabet), and found where ``share`` of its weight and its whole key phrase
    stand. ``score`` is the largest part of a template's weight that stands where it was looked for, half of it where the key phrase is not
    whole though ``share`` is reached. Null or empty
    texts have no words, no labels and score 0; long texts are read whole, in time linear in the number of places looked at. Repeated rows come out alike,
    an empty table gives an empty result, and other columns are not looked at, whatever their names.
    """
    idf = rarity(docs, templates, text_col=text_col)
    split = [t.text.split() for t in templates]
    keys = [t.key.split() for t in templates]
    places = [next(j for j in range(len(ws)) if ws[j : j + len(k)] == k) for ws, k in zip(split, keys, strict=True)]

    def rarest(words: Sequence[str]) -> list[str]:
        return sorted(set(words), key=lambda w: (-idf[w], w))

    post = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(i).alias("t"), F.lit(j).alias("at")) for i, ws in enumerate(split) for j, w in enumerate(ws)))
    shown = F.array(*(F.struct(F.lit(i).alias("t"), F.array(*map(F.lit, sorted(set(k)))).alias("key"), F.lit(rarest(k)[0]).alias("sure"), F.lit(0 if t.base else anchors).alias("most"), F.array(*map(F.lit, rarest(ws))).alias("ranked")) for i, (t, ws, k) in enumerate(zip(templates, split, keys, strict=True))))
    text_words, vocabulary = _texts(split), F.array(*map(F.lit, sorted({w for ws in split for w in ws})))
    weights = F.array(*(F.array(*(F.lit(max(idf[w], 1e-3)) for w in ws)) for ws in split))
    totals = F.array(*(F.lit(sum(max(idf[w], 1e-3) for w in ws)) for ws in split))
    labels = F.array(*(F.lit(t.label) for t in templates))
    base = F.array(*(F.lit(t.base) for t in templates))
    key_from, key_to = F.array(*map(F.lit, places)), F.array(*(F.lit(j + len(k) - 1) for j, k in zip(places, keys, strict=True)))

    # explode keeps the words from being split anew for every use of them
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.explode(F.array(words_of(F.col(f"`{text_col}`")))).alias("_words"))
    # Within a lambda the intersection is evaluated by compiled code; generated, with the splitting, it is too long a method for the JVM to compile.
    rows = rows.withColumn("_own", F.explode(F.array(F.transform(F.array_intersect("_words", vocabulary), lambda w: w))))

    def has(w: Column) -> Column:
        return F.array_contains("_own", w)

    def looked_up(x: Column) -> Column:
        some = F.slice(F.filter(x["ranked"], has), F.lit(1), x["most"])
        return F.transform(F.array_union(F.array(x["sure"]), some), lambda w: F.struct(w.alias("w"), x["t"].alias("t")))

    none = "array<struct<w:string,t:int>>"
    sought = F.flatten(F.transform(F.filter(shown, lambda x: F.forall(x["key"], has)), looked_up))
    rows = rows.withColumn("_sought", F.explode(F.array(F.when(F.size("_own") > 0, sought).otherwise(F.array().cast(none)))))
    found = F.filter(post, lambda p: F.exists("_sought", lambda s: (s["t"] == p["t"]) & (s["w"] == p["w"])))
    rows = rows.withColumn("_posts", F.explode(F.array(F.when(F.size("_sought") > 0, found).otherwise(F.array().cast("array<struct<w:string,t:int,at:int>>")))))
    rows = rows.withColumn("_rare", F.array_distinct(F.transform("_posts", lambda p: p["w"])))
    hit = F.filter(F.transform("_words", lambda w, i: F.struct(w.alias("w"), i.alias("at"))), lambda s: F.array_contains("_rare", s["w"]))
    # One long for (start, template): distinct longs are hashed, distinct structs compared one by one.
    many = F.lit(len(templates)).cast("long")
    begun = F.flatten(F.transform(hit, lambda h: F.transform(F.filter("_posts", lambda p: (p["w"] == h["w"]) & (p["at"] <= h["at"])), lambda p: (h["at"] - p["at"]) * many + p["t"])))
    begun = F.transform(F.array_distinct(begun), lambda x: F.struct((x % many).cast("int").alias("t"), F.floor(x / many).cast("int").alias("start")))
    rows = rows.withColumn("_begun", F.explode(F.array(F.when(F.size("_posts") > 0, begun).otherwise(F.array().cast("array<struct<t:int,start:int>>")))))

    def stands(c: Column, j: Column) -> Column:
        return F.coalesce(F.get("_words", c["start"] + j) == F.get(F.get(text_words, c["t"]), j), F.lit(False))

    def judged(c: Column) -> Column:
        own = F.get(weights, c["t"])
        got = F.aggregate(F.sequence(F.lit(0), F.size(own) - 1), F.lit(0.0), lambda acc, j: acc + F.when(stands(c, j), F.get(own, j)).otherwise(0.0))
        key = F.forall(F.sequence(F.get(key_from, c["t"]), F.get(key_to, c["t"])), lambda j: stands(c, j))
        return F.struct(c["t"].alias("t"), c["start"].alias("start"), (got / F.get(totals, c["t"])).alias("part"), key.alias("key"))

    rows = rows.withColumn("_seen", F.explode(F.array(F.transform("_begun", judged))))
    rows = rows.withColumn("_base", F.filter("_seen", lambda x: F.get(base, x["t"]) & x["key"]))
    rows = rows.withColumn("_good", F.filter("_seen", lambda x: x["key"] & (F.get(base, x["t"]) | (x["part"] >= share))))

    def named(c: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: F.get(labels, x["t"])))), ",")

    starts = F.transform("_base", lambda x: x["start"])
    part = F.array_max(F.transform("_seen", lambda x: F.when(x["key"] | (x["part"] < share), x["part"]).otherwise(x["part"] / 2)))
    return rows.select(
        F.col("_id").alias(id_col), F.size("_words").cast("long").alias("n_words"), F.size("_base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        named("_base").alias("base_labels"), named("_good").alias("labels"), F.least(F.lit(1.0), F.coalesce(part, F.lit(0.0))).alias("score"),
    )
