"""Licence scans (operator 6): windows of words against licence templates, by the Dice coefficient over word bigrams.

All in built-in functions. A window that can't be bettered by cutting its ends begins and ends with a bigram of the template, so
only those are compared; before that, a document is looked at only if it holds an anchor: words are taken from each template until
the bigrams without one are too few to reach the threshold.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
COMMON = {"the", "to", "of", "in", "and", "or", "is", "this", "by", "under", "work", "use", "for", "public"}

# Licence notices and texts by id, in order of preference among equals.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "BSD-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:""",
    "Apache-2.0-text": """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
}

# Headers and passages of licence texts, after the notices in order of preference.
HEADERS = {
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "GPL-2.0-header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "LGPL-2.1-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "AGPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "BSD-3-Clause-text": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "Zlib-text": """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:""",
    "Unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}


def template_bigrams(text: str) -> list[str]:
    w = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Least and most bigrams of a unit that can reach the threshold with a template of `size`: 2 * min / sum."""
    return math.ceil(round(threshold / (2 - threshold) * size, 9)), math.floor(round((2 - threshold) / threshold * size, 9))


def anchors(templates: dict[str, str], threshold: float) -> tuple[list[str], list[str]]:
    """(words, bigrams) of which every unit that matches holds one: of each template, enough to leave too few bigrams without."""
    words: list[str] = []
    pairs: list[str] = []
    for text in templates.values():
        left = [b for b in template_bigrams(text)]
        need = bounds(len(left), threshold)[0]
        left = [b for b in left if not set(b.split()) & set(words) and b not in pairs]
        while len(left) >= need:
            rare = {w for b in left for w in b.split() if len(w) > 7}  # long words are seldom part of other text
            if rare:
                words.append(min(rare, key=lambda w: (-sum(w in b.split() for b in left), -len(w), w)))
                left = [b for b in left if words[-1] not in b.split()]
            else:
                pairs.append(min(left, key=lambda b: (sum(w in COMMON for w in b.split()), -len(b), b)))
                left.remove(pairs[-1])
    return words, pairs


def _let(x: Column, f) -> Column:
    return F.transform(F.array(x), f)[0]


def _windows(big: Column, hits: Column, place: int, text: str, threshold: float) -> Column:
    """For each of the hits (p, b), places of template bigrams, that a match begins with: its best window (dice, place, start, end),
    the last three negated, so that the greatest is the best, the first and the shortest."""
    b = template_bigrams(text)
    low = max(1, bounds(len(b), threshold)[0])
    most = bounds(max(1, len(re.findall("[a-z0-9]+", text.lower())) - 1), threshold)[1]
    mine = F.filter(hits, lambda h: h["b"].isin(b))

    def best(m: Column, h: Column, i: Column) -> Column:
        ends = F.filter(F.slice(m, i + low, F.lit(most - low + 1)), lambda e: e["p"] < h["p"] + most)
        dice = lambda g: 2.0 * F.size(F.array_intersect(g, F.array(*map(F.lit, b)))) / (F.size(g) + len(b))
        grams = lambda e: F.array_distinct(F.slice(big, h["p"] + 1, e["p"] - h["p"] + 1))
        found = F.transform(ends, lambda e: F.struct(_let(grams(e), dice).alias("dice"), F.lit(-place).alias("place"), (-h["p"]).alias("start"), (-e["p"]).alias("end")))
        return F.array_max(F.filter(found, lambda s: s["dice"] >= threshold))

    return _let(mine, lambda m: F.filter(F.transform(m, lambda h, i: best(m, h, i)), lambda s: s.isNotNull()))


def licenses(docs: DataFrame, *, templates: dict[str, str] = TEMPLATES | HEADERS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_notices (windows that match a template), licenses (their ids, sorted, distinct, comma-joined), best and best_dice
    for each row of docs (doc_id, text).

    Windows are runs of words of the whole text, across lines and within them; case and everything but ASCII letters and digits are
    ignored. At a threshold t a window has at most (2 - t) / t times as many bigrams, repeats included, as the template. Of the
    windows that match, the best are taken (by dice, then the template listed first, then the place) that share no word with one
    taken before. A document without a match, null and empty texts included, has 0, '', null and null.
    """
    ids = list(templates)
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    whole, pairs = anchors(templates, threshold)
    tests = [F.contains(low, F.lit(a)) for a in whole]
    tests += [low.rlike("|".join(p.replace(" ", "[^a-z0-9]+") for p in pairs))] if pairs else []
    candidate = reduce(or_, tests)
    known = sorted({b for t in templates.values() for b in template_bigrams(t)})
    bigrams = lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)))
    hits = lambda big: F.filter(F.transform(big, lambda b, i: F.struct(i.alias("p"), b.alias("b"))), lambda h: h["b"].isin(known))
    every = lambda big, h: F.concat(*(_windows(big, h, place, text, threshold) for place, text in enumerate(templates.values())))
    words = F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != "")
    match = _let(words, lambda w: _let(bigrams(w), lambda big: _let(hits(big), lambda h: every(big, h))))
    none = F.array().cast("array<struct<dice:double,place:int,start:int,end:int>>")
    apart = lambda x, y: (x["end"] - 1 > y["start"]) | (y["end"] - 1 > x["start"])
    taken = lambda m: F.aggregate(F.sort_array(m, asc=False), none, lambda acc, x: F.when(F.forall(acc, lambda y: apart(x, y)), F.concat(acc, F.array(x))).otherwise(acc))
    named = docs.select("doc_id", F.coalesce(F.when(candidate, taken(match)), none).alias("m"))
    name = lambda m: F.element_at(F.array(*map(F.lit, ids)), 1 - m["place"])
    best = F.array_max("m")
    return named.select(
        "doc_id",
        F.size("m").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("m", name))), ",").alias("licenses"),
        F.when(F.size("m") > 0, name(best)).alias("best"),
        best["dice"].alias("best_dice"),
    )
