"""Licence scans: Dice coefficient over word bigrams against licence templates.

Every unit of a text - the whole text, its paragraphs, its lines - is normalised
(lower case, runs of letters and digits) and compared with each template by
``2 |A & B| / (|A| + |B|)`` over the sets of word bigrams.  A coefficient of
``t`` needs ``t / (2 - t) <= |A| / |B| <= (2 - t) / t``, so that templates whose
size is out of these bounds are passed over before anything is compared, and
units with too few words for any template are not even cut into bigrams.
Bigrams that no template has are dropped first; a unit left with too few of
them for any template meets none.

Licences of one family differ by a bigram or two, so that a unit names only the
licence that it matches best.  Where it matches several equally well (the words
that two licences share), the text's other units decide; if they name none of
them, all are named.

All of it is DataFrame operations.  Edge cases: null and empty texts, and texts
of fewer than two words, match nothing; rows that share doc_id and text are
treated alike; equal scores are named in the order of their licence ids; extra
columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let, small, spill

# Notices and opening paragraphs of well-known licences, by SPDX id.
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1_2 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
_GNU_LINE = "This work is licensed under the GNU {}General Public License, version {}."
_CC = "This work is licensed under a Creative Commons {} 4.0 International License."

TEMPLATES = (
    ("AGPL-3.0", _GNU_LINE.format("Affero ", "3")),
    *[("AGPL-3.0", _GNU.format(what, ":", "Affero ", ",", "3")) for what in ("program", "library")],
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD),
    ("BSD-2-Clause", _BSD_1_2),
    ("BSD-2-Clause", f"{_BSD} {_BSD_1_2}"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", _BSD),
    ("BSD-3-Clause", _BSD_1_2),
    ("BSD-3-Clause", _BSD_3),
    ("BSD-3-Clause", f"{_BSD} {_BSD_1_2} 3. {_BSD_3}"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", _CC.format("Attribution")),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", _CC.format("Attribution-NonCommercial")),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", _CC.format("Attribution-NonCommercial-NoDerivatives")),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", _CC.format("Attribution-NonCommercial-ShareAlike")),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", _CC.format("Attribution-NoDerivatives")),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", _CC.format("Attribution-ShareAlike")),
    ("GPL-2.0", _GNU_LINE.format("", "2")),
    *[("GPL-2.0", _GNU.format(what, ";", "", ";", "2")) for what in ("program", "library")],
    ("GPL-3.0", _GNU_LINE.format("", "3")),
    *[("GPL-3.0", _GNU.format(what, ":", "", ",", "3")) for what in ("program", "library")],
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", _GNU_LINE.format("Lesser ", "2.1")),
    *[("LGPL-2.1", _GNU.format(what, ";", "Lesser ", ";", "2.1")) for what in ("program", "library")],
    ("LGPL-3.0", _GNU_LINE.format("Lesser ", "3")),
    *[("LGPL-3.0", _GNU.format(what, ":", "Lesser ", ",", "3")) for what in ("program", "library")],
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def bigrams(text: str) -> list[str]:
    w = re.findall(r"[^\W_]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def _units(text):
    lines, paragraphs = F.split(text, "\n"), F.split(text, "\n[\\x20\\x09\\x0D]*\n")
    return F.array_distinct(F.concat(lines, paragraphs, F.array(text)))


def license_matches(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """(doc_id, th, license, score): each licence that a unit of the text matches best, with its best score.

    ``th`` is xxhash64 of the text; rows without a match do not appear.
    """
    known = [(name, b) for name, text in templates if (b := bigrams(text))]
    least = min(threshold / (2 - threshold) * len(b) for _, b in known)
    table = F.array(
        *[F.struct(F.lit(n).alias("license"), F.lit(len(b)).alias("size"), F.array(*map(F.lit, b)).alias("grams")) for n, b in known]
    )
    units = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("th"), F.explode(_units(F.col("text"))).alias("u"))
    w = F.filter(F.split(F.lower("u"), "[^\\p{L}\\p{N}]+"), lambda x: x != "")
    units = units.select("doc_id", "th", w.alias("w")).where(F.size("w") - 1 >= F.lit(least))
    grams = F.array_distinct(F.transform(F.slice("w", 1, F.size("w") - 1), lambda x, i: F.concat_ws(" ", x, F.get("w", i + 1))))
    # what no template has can only count towards a unit's size; rounded down, so that the score itself decides at the bound
    vocabulary = sorted({g for _, b in known for g in b})
    fewest = min(len(b) for _, b in known)
    cut = let(grams, lambda a: F.struct(F.size(a).alias("n"), F.filter(a, lambda g: g.isin(vocabulary)).alias("a")))
    # exploded, so that bigrams are cut once and not for the condition again
    some = let(cut, lambda u: F.filter(F.array(u), lambda x: F.size(x["a"]) >= F.floor(threshold / 2 * (x["n"] + fewest))))
    units = units.select("doc_id", "th", F.explode(some).alias("u")).select("doc_id", "th", "u.n", "u.a")
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    n = F.col("n")
    near = F.filter(table, lambda t: (n >= low * t["size"]) & (n <= high * t["size"]))
    scored = F.transform(
        near, lambda t: F.struct((2.0 * F.size(F.array_intersect("a", t["grams"])) / (n + t["size"])).alias("score"), t["license"].alias("license"))
    )
    # of one unit's matches the best, and what equals it
    good = let(F.filter(scored, lambda s: s["score"] >= threshold), lambda m: F.filter(m, lambda s: s["score"] == F.array_max(m)["score"]))
    tops = units.select("doc_id", "th", good.alias("top")).where(F.size("top") > 0).groupBy("doc_id", "th").agg(F.collect_set("top").alias("tops"))

    def names(top):
        return F.array_distinct(F.transform(top, lambda s: s["license"]))

    sure = F.flatten(F.transform(F.filter("tops", lambda t: F.size(names(t)) == 1), names))
    hits = tops.withColumn("sure", sure).select(
        "doc_id", "th", F.explode(F.flatten(F.filter("tops", lambda t: (F.size(names(t)) == 1) | ~F.arrays_overlap(names(t), F.col("sure"))))).alias("s")
    )
    return hits.groupBy("doc_id", "th", "s.license").agg(F.max("s.score").alias("score"))


def license_report(docs: DataFrame, **how) -> DataFrame:
    """One row per row of ``docs``: doc_id, licenses (ids, sorted and joined), best_license, best_score."""
    hits = license_matches(docs, **how).groupBy("doc_id", "th").agg(
        F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"),
        F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best"),
    )
    hits = spill(hits.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), "licenses", "best"), "licenses")
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"))
    return rows.join(small(hits), rows["doc_id"].eqNullSafe(hits["d"]) & (rows["th"] == hits["h"]), "left").select(
        "doc_id",
        F.coalesce("licenses", F.lit("")).alias("licenses"),
        F.coalesce("best.license", F.lit("")).alias("best_license"),
        F.coalesce(-F.col("best.s"), F.lit(0.0)).alias("best_score"),
    )
