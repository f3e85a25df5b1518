"""Licence notices found by Dice's coefficient over word bigrams.

Units of a text (its lines, its paragraphs, and the whole of it) are normalised to lower-case words. A template is a
candidate for a unit only when their numbers of bigrams allow the bound: each template is listed under every size it
can match, so candidates come from an equi-join on the size. Texts and units without any telling word of a template
cannot share enough bigrams with one and are passed over first.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

SIMILARITY = 0.8

# Common licence notices: fixed values.
TEMPLATES: dict[str, str] = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
    "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
    "the specific language governing permissions and limitations under the License.",
    "MIT-line": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
    "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
    "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
    "(at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
    "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring "
    "rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    pairs = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.slice(pairs, F.lit(1), F.size(words) - 1))


def telling_words(templates: Mapping[str, str], similarity: float) -> list[str]:
    """Words of which every unit that matches some template has one.

    A match has at least s / (2 - s) of a template's bigrams. Words are taken, those in most bigrams still needed first,
    until so many bigrams of each template hold one of them that the others are too few for a match. A word of more than
    four letters is looked for inside others, too.
    """

    def told(pair: tuple[str, str], word: str) -> bool:
        return word in pair or len(word) > 4 and any(word in other for other in pair)

    pairs = []
    for text in templates.values():
        words = re.sub(r"[^\w]+|_+", " ", text.lower()).split()
        own = set(zip(words, words[1:]))
        pairs.append((own, len(own) - math.ceil(len(own) * similarity / (2 - similarity) - 1e-9) + 1))
    chosen: list[str] = []
    while True:
        short = [(own, need) for own, need in pairs if sum(any(told(pair, w) for w in chosen) for pair in own) < min(need, len(own))]
        if not short:
            return chosen
        gain = Counter()
        for own, _ in short:
            for pair in own:
                if not any(told(pair, w) for w in chosen):
                    gain.update(set(pair))
        # Among words that help as much, longer ones are rarer in other texts.
        chosen.append(max(gain, key=lambda w: (len(w) > 4, gain[w], len(w), w)))


def template_sizes(spark, templates: Mapping[str, str], similarity: float) -> DataFrame:
    """(size, license, template): each template once for every size at which the bound is possible.

    2 min(a, b) / (a + b) >= s leaves sizes from a s / (2 - s) to a (2 - s) / s: a fixed number of rows.
    """
    raw = spark.createDataFrame(list(templates.items()), "license string, text string")
    own = raw.select("license", bigrams(F.split(normal(F.col("text")), " ")).alias("template"))
    near = (2 - similarity) / similarity
    low = F.ceil(F.size("template") / F.lit(near) - F.lit(1e-9))
    high = F.floor(F.size("template") * F.lit(near) + F.lit(1e-9))
    return own.select("license", "template", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("size"))


def find_licenses(
    docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, similarity: float = SIMILARITY,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, license, dice, units) for every template that some unit of a document matches at ``similarity`` or more.

    ``dice`` is that of the best unit and ``units`` how many different units match. Null, empty and blank texts, and
    units of fewer than two words, match nothing. Rows of one id are read together, those without an id, too, so repeated
    rows change nothing. Texts are read whole however long they are; other columns are not read. An empty table gives an
    empty result.
    """
    sizes = template_sizes(docs.sparkSession, templates, similarity)
    lines = F.split(F.col(text), "\n")
    units = F.array_distinct(F.concat(lines, F.split(F.col(text), r"\n[\s]*\n"), F.array(F.col(text))))
    words_told = telling_words(templates, similarity)

    def telling(column: Column) -> Column:
        found = F.lit(False)
        for word in words_told:
            holds = F.contains(F.lower(column), F.lit(word))
            if len(word) <= 4:
                holds = holds & F.lower(column).rlike(r"(?<![\p{L}\p{N}])" + word + r"(?![\p{L}\p{N}])")
            found = found | holds
        return found

    rows = (
        docs.filter(telling(F.col(text)))
        .select(F.col(doc_id).alias("doc_id"), F.explode(units).alias("unit"))
        .filter(telling(F.col("unit")))
    )
    words = rows.select(
        "doc_id", F.xxhash64("unit").alias("unit"), F.split(normal(F.col("unit")), " ").alias("words")
    ).filter(F.size("words") > 1)
    found = words.select("doc_id", "unit", bigrams(F.col("words")).alias("pairs")).withColumn("size", F.size("pairs"))
    shared = F.size(F.array_intersect("pairs", "template"))
    # The templates are a fixed list, in code or given by the caller: that bounds the broadcast.
    scored = found.join(F.broadcast(sizes), "size").withColumn(
        "dice", F.lit(2.0) * shared / (F.size("pairs") + F.size("template"))
    )
    return (
        scored.filter(F.col("dice") >= similarity)
        .groupBy("doc_id", "license")
        .agg(F.max("dice").alias("dice"), F.count_distinct("unit").alias("units"))
    )
