"""Licence scan: units of a text against licence templates by the Dice coefficient over word bigrams.

A unit is a line, or a paragraph of several lines. It is normalised (lower case; all but a-z and digits is a word gap) and
reduced to its set of word bigrams, as 64-bit hashes. With a threshold t, a unit of n bigrams can only match templates
of m bigrams with n * t / (2 - t) <= m <= n * (2 - t) / t; units and templates outside are never compared. A text
without a word of a set that any match must have one of is not taken apart at all. Everything is one expression for each document: no exchange, no Python.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.7

#: Public licence notices, as their authors word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def bigram_set(text: str) -> list[str]:
    """Distinct word bigrams of a template, as the column expression makes them."""
    flat = "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text).split()
    return sorted({f"{a} {b}" for a, b in zip(flat, flat[1:])})


def probe_words(sets: dict[str, list[str]], threshold: float) -> list[str]:
    """Words of which any matching unit has one.

    A match shares at least s = t / 2 * (m + n) of a template's m bigrams, n being m * t / (2 - t) or more. Words are chosen,
    long ones first, until fewer than s bigrams of each template are without one.
    """
    chosen: set[str] = set()
    for grams in sets.values():
        m = len(grams)
        shared = math.ceil(threshold / 2 * (m + m * threshold / (2 - threshold)) - 1e-9)
        rest = [g.split() for g in grams]
        while len(rest := [g for g in rest if not chosen & {*g}]) >= shared:
            touched = Counter(w for g in rest for w in {*g})
            chosen.add(max(sorted(touched), key=lambda w: (len(w) > 4, touched[w])))
    return sorted(chosen)


def scan(documents: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_units (units that match a template), licence, dice (the best match), licences (all, sorted).

    The best match has the highest coefficient, then the first name. Null text or no match: 0, null, null, empty. A unit of
    one word or none has no bigram and matches nothing. Repeated rows each have a row; other columns aren't read.
    """
    sets = {name: bigram_set(text) for name, text in (templates or TEMPLATES).items()}
    sets = {name: grams for name, grams in sets.items() if grams}
    if not sets:
        raise ValueError("no template has a word bigram")
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least, most = min(map(len, sets.values())) * low, max(map(len, sets.values())) * high
    coded = {name: ", ".join(f"xxhash64({', '.join(map(repr, g.split()))})" for g in grams) for name, grams in sets.items()}
    literal = ", ".join("named_struct('name', '{}', 'm', {}, 'grams', array({}))".format(n.replace("'", "\\'"), len(sets[n]), g) for n, g in coded.items())
    lines = F.split("text", "\n")
    paragraphs = F.filter(F.split("text", "\n[ \t\r]*\n"), lambda p: p.contains("\n"))
    units = F.transform(F.concat(lines, paragraphs), lambda u: F.array_remove(F.split(u, "[^a-z0-9]+"), ""))
    sized = F.filter(units, lambda w: F.size(w) > least)  # n words have n - 1 bigrams at most
    grams = F.transform(sized, lambda w: F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.xxhash64(a, b))))
    fit = F.filter(grams, lambda g: (F.size(g) >= least) & (F.size(g) <= most))
    every = ", ".join(dict.fromkeys(", ".join(coded.values()).split(", xxhash64"))).replace(", (", ", xxhash64(")
    best_of = (  # g: bigrams of a unit; c: those that any template has
        f"transform(filter(transform(fit, g -> named_struct('n', size(g), 'c', array_intersect(g, array({every})))), u -> size(u.c) > 0),"
        f" u -> filter(transform(filter(array({literal}), t -> t.m >= u.n * {low!r}D and t.m <= u.n * {high!r}D),"
        " t -> named_struct('dice', 2.0D * size(array_intersect(u.c, t.grams)) / (u.n + t.m), 'name', t.name)),"
        f" x -> x.dice >= {threshold!r}D))"
    )
    probes = probe_words(sets, threshold)
    possible = reduce(or_, [F.col("text").contains(w) for w in probes])
    lowered = documents.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    found = lowered.select("doc_id", F.when(possible, F.col("text")).otherwise(F.lit("")).alias("text")).select("doc_id", fit.alias("fit"))
    found = found.select("doc_id", F.expr(best_of).alias("hits"))
    flat = found.select("doc_id", F.size(F.filter("hits", lambda h: F.size(h) > 0)).cast("long").alias("n_units"), F.flatten("hits").alias("all"))
    top = F.array_sort("all", lambda a, b: F.when(a["dice"] > b["dice"], -1).when(a["dice"] < b["dice"], 1).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    return flat.select("doc_id", "n_units", F.get(top, F.lit(0)).alias("top"), F.array_sort(F.array_distinct("all.name")).alias("licences")).select(
        "doc_id", "n_units", F.col("top.name").alias("licence"), F.col("top.dice").alias("dice"), "licences"
    )
