"""License scans: normalised text against licence templates by Dice coefficient.

A text is looked at line by line and as a whole (a file that is one licence).
A line is normalised (lower case, everything but letters and digits to single
blanks) and becomes the set of its word bigrams; a line of one word has that
word as its only gram.  It matches a template if

    Dice = 2 |A and B| / (|A| + |B|)  >=  threshold.

Size bounds prune first: Dice can reach t only if
|B| t / (2 - t) <= |A| <= |B| (2 - t) / t.  Lines whose number of words can't
give such a set for any template are dropped before any gram is made, the others meet
only the templates within the bounds.

``passages`` looks at every run of words, inside a line or across line breaks, with the
full licence texts beside the notices.  Run and template are bags of bigrams here (a
repeated bigram counts as often as it occurs in both), so the size bounds hold for the length of a run, whatever it
repeats: no run longer than |B| (2 - t) / t bigrams can match.  A run that matches shares
at least need = |B| t / (2 - t) bigrams with the template, so it holds one of any
|B| - need + 1 of them: texts without one of a template's longest |B| - need + 1 bigrams
are not looked at any further.  ``scan`` puts both together.

Everything is DataFrame functions inside one projection: no shuffle, no
Python, no join; the templates are a literal of fixed size.

Defined results: null and empty texts have no lines and no match; of equal
scores the template first by name counts; repeated rows get equal results;
extra columns are kept, a column named like the output is replaced.
"""

from __future__ import annotations

import math
import re
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import free_name

THRESHOLD = 0.8

#: Notices as public licences word them, fixed values: (name, notice).
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
                   "compliance with the License. You may obtain a copy of the License at"),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met:"),
    ("bsd-3-clause", "Released under the BSD 3-Clause License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", "Released under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
            'documentation files (the "Software"), to deal in the Software without restriction, including without '
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
            "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions:"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
    ("public-domain", "This work is in the public domain."),
)


def _normal_words(line: str) -> list[str]:
    return re.sub(r"[^\w]+|_", " ", line.lower()).split()


def grams_of(line: str) -> list[str]:
    """Distinct word bigrams of a normalised line (for the templates and tests)."""
    words = _normal_words(line)
    return sorted({" ".join(p) for p in zip(words, words[1:])} if len(words) > 1 else set(words))


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """Sizes a set must have to reach the threshold with a set of ``size``."""
    t = threshold
    return math.ceil(size * t / (2 - t) - 1e-9), math.floor(size * (2 - t) / t + 1e-9)


def _template_array(templates, threshold: float) -> Column:
    rows = []
    for name, notice in sorted(templates):
        g = grams_of(notice)
        lo, hi = size_bounds(len(g), threshold)
        rows.append(F.struct(F.lit(name).alias("name"), F.lit(len(g)).alias("n"), F.lit(lo).alias("lo"),
                             F.lit(hi).alias("hi"), F.array(*map(F.lit, g)).alias("grams")))
    return F.array(*rows)


def _normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def _gram_set(line: Column) -> Column:
    words = F.split(line, " ")
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.when(F.size(words) > 1, pairs).otherwise(words))


def matches(docs: DataFrame, text: str = "text", out: str = "licenses", threshold: float = THRESHOLD,
            templates=TEMPLATES, only: Column | None = None) -> DataFrame:
    """``docs`` with an array of (line, name, dice), best template of every
    matching line, in line order; line 0 is the text as a whole (if it has
    more than one line).  ``only``: texts that can match at all, if that is known."""
    table = _template_array(templates, threshold)
    sizes = [size_bounds(len(grams_of(n)), threshold) for _, n in templates]
    least = min(lo for lo, _ in sizes) + 1          # a set of n bigrams takes n + 1 words at least
    if any(len(grams_of(n)) == 1 for _, n in templates):
        least = 1
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(body, r"\r\n|\n|\r")
    numbered = F.concat(
        F.when(F.size(lines) > 1, F.array(F.struct(F.lit(0).alias("line"), body.alias("s"))))
        .otherwise(F.array().cast("array<struct<line:int,s:string>>")),
        F.transform(lines, lambda s, i: F.struct((i + 1).alias("line"), s.alias("s"))))
    clean = F.transform(numbered, lambda x: F.struct(x["line"].alias("line"), _normalised(x["s"]).alias("s")))
    # words cost more than bigrams only by repetition: the lower bound holds for all lines
    words = lambda x: F.length(x["s"]) - F.length(F.replace(x["s"], F.lit(" "), F.lit(""))) + 1
    some = F.filter(clean, lambda x: (x["s"] != "") & (words(x) >= least))
    sets = F.transform(some, lambda x: F.struct(x["line"].alias("line"), _gram_set(x["s"]).alias("g")))
    largest = max(hi for _, hi in sizes)
    sets = F.filter(sets, lambda x: F.size(x["g"]) <= largest)

    def score(x):
        n = F.size(x["g"])
        near = F.filter(table, lambda t: (n >= t["lo"]) & (n <= t["hi"]))
        scored = F.transform(near, lambda t: F.struct(
            (F.lit(2.0) * F.size(F.array_intersect(x["g"], t["grams"])) / (n + t["n"])).alias("dice"), t["name"].alias("name")))
        passed = F.filter(scored, lambda s: s["dice"] >= threshold)
        best = F.array_max(F.transform(passed, lambda s: s["dice"]))
        first = F.array_min(F.transform(F.filter(passed, lambda s: s["dice"] == best), lambda s: s["name"]))
        return F.struct(x["line"].alias("line"), first.alias("name"), best.alias("dice"))

    found = F.filter(F.transform(sets, score), lambda m: m["name"].isNotNull())
    return docs.withColumn(out, found if only is None else F.when(only, found).otherwise(F.array().cast(_MATCHES)))


_MATCHES = "array<struct<line:int,name:string,dice:double>>"


@cache
def full_texts() -> tuple[tuple[str, str], ...]:
    """(name, text) of whole licences, from ``license_texts``."""
    return tuple((p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))


def bag_of(notice: str) -> dict[str, int]:
    """Word bigrams of a notice with their numbers."""
    words, out = _normal_words(notice), {}
    for g in map(" ".join, zip(words, words[1:])):
        out[g] = out.get(g, 0) + 1
    return out


def prefix_of(bag: dict[str, int], need: int) -> list[str]:
    """The longest bigrams, so many that the others together are fewer than ``need``:
    a text that shares ``need`` bigrams with the notice holds one of these."""
    left, out = sum(bag.values()), []
    for g in sorted(bag, key=lambda g: (-len(g), g)):
        if left < need:
            break
        out.append(g)
        left -= bag[g]
    return out


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _among(x: str, grams) -> str:
    """SQL: hash look-up of ``x`` among fixed bigrams (of letters, digits and blanks)."""
    return f"{x} IN ({', '.join(repr(g) for g in grams)})"


def _template_runs(occ: str, name: str, notice: str, threshold: float) -> Column:
    """Runs of bigrams of a text (column ``occ``: (g, at) in text order) whose Dice coefficient with
    the notice is ``threshold`` or more: for every start the end of the best score.

    Hits are the notice's bigrams.  A run starts with a hit that has no hit right before it (with one, it
    gets better) or with the notice's first bigram; it ends with a hit."""
    bag = bag_of(notice)
    n, first = sum(bag.values()), next(iter(bag))
    need, hi = size_bounds(n, threshold)
    number = " ".join(f"WHEN {_among('o.g', [g for g, m in bag.items() if m == c])} THEN {c}" for c in sorted(set(bag.values()) - {1}))
    number = f"CASE {number} ELSE 1 END" if number else "1"
    hits = F.expr(f"transform(filter(`{occ}`, o -> {_among('o.g', bag)}), o -> struct(o.g AS g, o.at AS at, {number} AS c))")

    def links(s):
        """(at, back, first): ``back`` is where the same bigram stood, as often as the notice has it, before."""
        def of(x, j):
            back = F.get(s, j - x["c"])
            return F.struct(x["at"].alias("at"), F.coalesce(F.when(back["g"] == x["g"], back["at"]), F.lit(-1)).alias("back"),
                            (x["g"] == first).alias("first"))
        return F.array_sort(F.transform(s, of))

    def balanced(h):
        """Twice the hits less the other bigrams before each hit (``sum``)."""
        return F.transform(h, lambda x, a: F.struct(x["at"].alias("at"), x["back"].alias("back"), x["first"].alias("first"),
                                                    (3 * a - x["at"]).alias("sum")))

    def starts(h):
        def of(x, a):
            before = F.get(h, a - 1)
            # a front part with fewer hits than half of its other bigrams: without it a run scores higher and has the larger Dice
            poor = F.exists(F.slice(h, a + 2, need - 1), lambda y: y["sum"] < x["sum"])
            inside = F.coalesce((before["at"] == x["at"] - 1) & ~x["first"], F.lit(False))
            return F.when((F.get(h, a + (need - 1))["at"] - x["at"] < hi) & ~inside & ~poor, a)
        return F.filter(F.transform(h, of), lambda a: a.isNotNull())

    def best(h, a):
        s = F.get(h, a)["at"]

        def step(b, x):
            size = x["at"] - s + 1
            common = b["common"] + (x["back"] < s).cast("int")
            rank = 3 * common - size - n
            better = (size <= hi) & (2.0 * common >= threshold * (size + n) - 1e-9) & (rank > b["score"])
            return F.struct(common.alias("common"), F.when(better, rank).otherwise(b["score"]).alias("score"),
                            F.when(better, 2.0 * common / (size + n)).otherwise(b["dice"]).alias("dice"),
                            F.when(better, x["at"]).otherwise(b["end"]).alias("end"))

        none = F.struct(F.lit(0).alias("common"), F.lit(-(1 << 30)).alias("score"), F.lit(0.0).alias("dice"), F.lit(-1).alias("end"))
        return F.aggregate(F.slice(h, a + 1, hi), none, step, lambda b: F.struct(
            (-b["score"]).alias("rank"), (-b["dice"]).alias("less"), F.lit(name).alias("name"), s.alias("start"), b["end"].alias("end")))

    def runs(hits):
        found = lambda h: F.filter(F.transform(starts(h), lambda a: best(h, a)), lambda r: r["end"] >= 0)
        return F.when(F.size(hits) >= need, _let(F.array_sort(hits), lambda s: _let(links(s), lambda h: _let(balanced(h), found))))

    return F.coalesce(_let(hits, runs), F.array().cast(_RUNS))


_RUNS = "array<struct<rank:int,less:double,name:string,start:int,end:int>>"


def passages(docs: DataFrame, text: str = "text", out: str = "passages", threshold: float = THRESHOLD,
             templates=None) -> DataFrame:
    """``docs`` with an array of (line, last, name, dice): runs of words that match a
    template, with their first and last line, in text order.  Where runs overlap or touch, the one with
    the most shared less unshared bigrams stays (then the larger Dice, the name, the start)."""
    frame, names = _with_grams(docs, text, threshold, templates)
    return _passages(frame, names, out, threshold, templates).drop(*names)


def _every(templates) -> list[tuple[str, str]]:
    return [(name, notice) for name, notice in sorted(TEMPLATES + full_texts() if templates is None else templates) if bag_of(notice)]


def _with_grams(docs: DataFrame, text: str, threshold: float, templates) -> tuple[DataFrame, list[str]]:
    """``docs`` with the lower-cased text, its bigrams, and those of them that a text
    needs to match any template: as a run (bags), or as a line or a whole (sets)."""
    names = body, grams, near = [free_name(docs, c) for c in ("_body", "_grams", "_near")]
    gate = set()
    for _, notice in _every(templates):
        for bag in (bag_of(notice), dict.fromkeys(bag_of(notice), 1)):
            gate.update(prefix_of(bag, size_bounds(sum(bag.values()), threshold)[0]))
    pairs = _let(F.split(_normalised(F.col(body)), " "), lambda w: F.zip_with(
        F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    frame = docs.withColumn(body, F.lower(F.coalesce(F.col(text), F.lit("")))).withColumn(grams, pairs)
    found = F.expr(f"array_distinct(filter(`{grams}`, g -> {_among('g', sorted(gate))}))") if gate else F.array().cast("array<string>")
    return frame.withColumn(near, found), names


def _passages(frame: DataFrame, names: list[str], out: str, threshold: float, templates) -> DataFrame:
    body, grams, near = names
    occ, found = free_name(frame, "_occ"), free_name(frame, "_runs")
    every = _every(templates)
    firsts = [prefix_of(b, size_bounds(sum(b.values()), threshold)[0]) for b in (bag_of(notice) for _, notice in every)]
    frame = frame.withColumn(occ, F.when(F.size(near) > 0, F.transform(F.col(grams), lambda g, i: F.struct(g.alias("g"), i.alias("at")))))
    own = [F.when(F.expr(f"exists(`{near}`, g -> {_among('g', f)})"), _template_runs(occ, name, notice, threshold))
           .otherwise(F.array().cast(_RUNS)) for (name, notice), f in zip(every, firsts)]
    ranked = F.array_sort(F.flatten(F.array(*own))) if own else F.array().cast(_RUNS)
    kept = _let(ranked, lambda r: F.aggregate(r, F.array().cast(_RUNS), lambda acc, c: F.when(
        F.exists(acc, lambda k: (c["start"] <= k["end"] + 1) & (k["start"] <= c["end"] + 1)), acc).otherwise(F.concat(acc, F.array(c)))))
    frame = frame.withColumn(found, F.when(F.size(near) > 0, kept).otherwise(F.array().cast(_RUNS)))
    words = F.transform(F.split(F.col(body), r"\r\n|\n|\r"), lambda s: _let(_normalised(s), lambda x: F.when(
        x == "", 0).otherwise(F.size(F.split(x, " ")))))
    # lines by the number of words before their end: a word's line is the first that ends behind it
    ends = F.aggregate(words, F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("ends")), lambda a, n: F.struct(
        (a["n"] + n).alias("n"), F.concat(a["ends"], F.array(a["n"] + n)).alias("ends")), lambda a: a["ends"])
    line = lambda e, w: F.size(F.filter(e, lambda x: x <= w)) + 1
    placed = _let(ends, lambda e: F.transform(
        F.array_sort(F.col(found), lambda a, b: a["start"] - b["start"]),
        lambda r: F.struct(line(e, r["start"]).alias("line"), line(e, r["end"] + 1).alias("last"), r["name"].alias("name"), (-r["less"]).alias("dice"))))
    none = F.array().cast("array<struct<line:int,last:int,name:string,dice:double>>")
    return frame.withColumn(out, F.when(F.size(found) > 0, placed).otherwise(none)).drop(occ, found)


def scan(docs: DataFrame, text: str = "text", out: str = "licenses", threshold: float = THRESHOLD) -> DataFrame:
    """``matches`` and, beside them, the ``passages`` that these don't show: not the
    passages inside a line of the same match, nor those over several lines in a text that matches as a whole."""
    frame, names = _with_grams(docs, text, threshold, None)
    extra = free_name(frame, "_passages")
    # a line of one word can't match a notice of several, so a line that matches holds a bigram of the gate
    frame = matches(frame, text, out, threshold, only=F.size(names[2]) > 0)
    frame = _passages(frame, names, extra, threshold, None)
    known = F.col(out)
    new = F.filter(F.col(extra), lambda p: ~F.exists(known, lambda m: (m["name"] == p["name"]) & (
        ((p["line"] == p["last"]) & (m["line"] == p["line"])) | ((p["line"] < p["last"]) & (m["line"] == 0)))))
    both = F.concat(known, F.transform(new, lambda p: F.struct(p["line"].alias("line"), p["name"].alias("name"), p["dice"].alias("dice"))))
    return frame.withColumn(out, F.array_sort(both)).drop(extra, *names)


def matches_sql(threshold: float = THRESHOLD, templates=TEMPLATES) -> str:
    """One row a document, as DuckDB SQL over ``documents`` (see ``op6`` in queries)."""
    rows = ", ".join("('{}', [{}])".format(n, ", ".join("'" + g.replace("'", "''") + "'" for g in grams_of(t)))
                     for n, t in sorted(templates))
    return f"""
WITH t AS (SELECT name, g, len(g) AS n FROM (VALUES {rows}) x(name, g)),
d AS (SELECT row_number() OVER () AS rid, doc_id,
             regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\n|\\r') AS lines, coalesce(text, '') AS body FROM documents),
l AS (SELECT rid, 0 AS line, body AS s FROM d WHERE len(lines) > 1
      UNION ALL SELECT rid, i AS line, lines[i] AS s FROM (SELECT rid, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
w AS (SELECT rid, line, string_split(trim(regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM l),
g AS (SELECT rid, line, CASE WHEN len(w) > 1
             THEN list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) ELSE w END AS g
      FROM w WHERE w <> ['']),
m AS (SELECT rid, line, name, 2.0 * len(list_intersect(g.g, t.g)) / (len(g.g) + t.n) AS dice
      FROM g JOIN t ON len(g.g) * (2 - {threshold}) >= t.n * {threshold} - 1e-6
                   AND len(g.g) * {threshold} <= t.n * (2 - {threshold}) + 1e-6),
b AS (SELECT rid, line, max(dice) AS dice, arg_min(name, (-dice, name)) AS name FROM m WHERE dice >= {threshold} GROUP BY rid, line),
r AS (SELECT rid, count(*) AS n_matches, arg_min(name, (-dice, name)) AS license, max(dice) AS dice,
             string_agg(line || ':' || name, ',' ORDER BY line) AS found FROM b GROUP BY rid)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(n_matches, 0) AS BIGINT) AS n_matches, license,
       round(dice, 6) AS dice, coalesce(found, '') AS found
FROM d LEFT JOIN r USING (rid)"""
