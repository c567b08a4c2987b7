"""Licence scans: normalised text against licence templates by Dice coefficient over word bigrams."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The wording of common licence notices and of short licences.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
        "this work."
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

# A run of a-z, 0-9 and dots with a letter or digit in it; dots at its end are not part of the word.
A_WORD = r"\.*[a-z0-9][a-z0-9.]*"
LEAST_SCORE = 0.8


def normal_words(text: str) -> list[str]:
    """The same normalisation for a template, on the driver."""
    return [w.rstrip(".") for w in re.findall(A_WORD, text.lower())]


def bigrams(text: str) -> list[str]:
    words = normal_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words[:-1], words[1:], strict=True)})


def size_bounds(size: int, least: float = LEAST_SCORE) -> tuple[int, int]:
    """Number of bigrams that a text can have and still reach the score with a template of ``size`` bigrams."""
    low, high = size * least / (2 - least), size * (2 - least) / least
    return int(-(-(low - 1e-9) // 1)), int(high + 1e-9)


def anchors(text: str, least: float = LEAST_SCORE) -> list[str]:
    """Words of a template of which a text must have one to reach the score: without any of them it lacks too many
    bigrams. The longest words come first."""
    grams = bigrams(text)
    needed = size_bounds(len(grams), least)[0]
    chosen, left = [], list(grams)
    for word in sorted(set(normal_words(text)), key=lambda w: (-len(w), w)):
        if len(left) < needed:
            break
        chosen.append(word)
        left = [g for g in left if word not in g.split(" ")]
    return chosen


def _score(found: Column, size: Column, template: list[str]) -> Column:
    return F.size(F.array_intersect(found, F.array(*[F.lit(b) for b in template]))) * 2.0 / (size + len(template))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, list[str]] = TEMPLATES,
    least: float = LEAST_SCORE,
) -> DataFrame:
    """``(doc_id, matches)`` per row: an array of ``(license, score, line)``, best first, then by line and name.

    The units compared are the lines of a text (``\\n``), numbered from 1, and, where there are several, the whole text
    as line 0. A unit is lower-cased and cut into words of a-z, 0-9 and inner dots. Its score with a template is twice
    the distinct bigrams that both have over the sum of their sizes; the unit's size counts repeats. A unit's
    number of words thus tells with which templates it can reach ``least``: the others are not compared, and units
    that fit no template are not even cut into bigrams, nor are texts in which every template lacks too many of its
    words. Each licence counts once per unit, with its best template.
    Null, empty and blank texts, and texts without a match, give an empty array. Null and repeated ids stay.
    Everything runs inside the row, so nothing is shuffled.
    """
    table = [(name, grams) for name, texts in templates.items() for grams in map(bigrams, texts)]
    bounds = [size_bounds(len(grams), least) for _, grams in table]
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))

    def fits(size):
        fit = F.lit(False)
        for low, high in sorted(set(bounds)):
            fit = fit | size.between(low, high)
        return fit

    def sized(line, content):
        size = F.regexp_count(content, F.lit(A_WORD)) - 1
        return F.struct(line.alias("line"), content.alias("text"), size.alias("size"))

    def pairs(content):
        words = F.regexp_extract_all(content, F.lit(A_WORD), F.lit(0))
        bare = F.transform(words, lambda w: F.rtrim(w, F.lit(".")))
        return F.element_at(
            F.transform(
                F.array(bare),
                lambda of: F.slice(F.transform(of, lambda w, i: F.concat_ws(" ", w, F.get(of, i + 1))), 1, F.size(of) - 1),
            ),
            1,
        )

    def compared(unit):
        scored = []
        for name in templates:
            best = [
                F.when(unit["size"].between(*bound), _score(unit["grams"], unit["size"], grams))
                for (owner, grams), bound in zip(table, bounds, strict=True)
                if owner == name
            ]
            score = F.greatest(*best) if len(best) > 1 else best[0]
            scored.append(F.struct(F.lit(name).alias("license"), score.alias("score"), unit["line"].alias("line")))
        return F.filter(F.array(*scored), lambda m: m["score"] >= least)

    lines = F.split("text", "\n")
    whole = F.when(F.size(lines) > 1, F.array(sized(F.lit(0), F.col("text"))))
    none = F.slice(F.array(sized(F.lit(0), F.lit(""))), 1, 0)
    units = F.concat(F.transform(lines, lambda line, i: sized(i + 1, line)), F.coalesce(whole, none))
    has_words = F.lit(False)
    for word in sorted({w for texts in templates.values() for t in texts for w in anchors(t, least)}):
        has_words = has_words | F.col("text").contains(word)
    units = F.when(has_words, units).otherwise(none)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", units.alias("units"))
    rows = rows.select("doc_id", F.filter("units", lambda u: fits(u["size"])).alias("units"))
    grams = F.transform(
        "units", lambda u: F.struct(u["line"].alias("line"), u["size"].alias("size"), pairs(u["text"]).alias("grams"))
    )
    rows = rows.select("doc_id", grams.alias("units"))
    found = rows.select("doc_id", F.flatten(F.transform("units", compared)).alias("matches"))
    ranked = F.transform(
        "matches", lambda m: F.struct((-m["score"]).alias("less"), m["line"].alias("line"), m["license"].alias("license"))
    )
    ordered = F.transform(
        F.sort_array(ranked),
        lambda m: F.struct(m["license"].alias("license"), (-m["less"]).alias("score"), m["line"].alias("line")),
    )
    return found.select("doc_id", ordered.alias("matches"))
