"""Operator 1: licence recognition by sentence rules.

Comment marks are taken off every line, and texts are cut at sentence ends and
at blank lines.  What lies between is one line or several (a wrapped sentence,
perhaps after a title); every run of its lines is a candidate, normalised (A-Z
in lower case, marks and punctuation off, version 2.0 the same as 2) and looked
up in a table of known licence sentences.  Runs that share a line are one
place, whose longest sentence counts.  The identifiers found in a document, in
order, form a sequence; ordered licence rules are matched against it, each
consuming the identifiers it names, longer rules before shorter ones.

Only runs whose normalised length is that of some known sentence become rows,
so long texts cost no more than their lines.  The lookup is an equi join with
the table of sentences, whose size is that of the list below; only known
sentences are shuffled on.

Defined results: a null or empty text has no sentences and no licences; a
document is a row by id and text, rows equal in both share their result; a
licence named twice is listed once, in order of first match; sentences that no
rule uses are counted; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwright.llm.common import row_key, small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# SPDX names and the names that texts give the licences.
NAMES = (
    ("MIT", ("MIT License", "MIT licence")),
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache License, Version 2.0 (the \"License\")", "Apache License 2.0", "Apache 2.0 License")),
    ("BSD-2-Clause", ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License")),
    ("BSD-3-Clause", ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License")),
    ("ISC", ("ISC License",)),
    ("Zlib", ("zlib License",)),
    ("Unlicense", ("Unlicense",)),
    ("BSL-1.0", ("Boost Software License, Version 1.0", "Boost Software License 1.0")),
    ("MPL-2.0", ("Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License, v2.0")),
    ("EPL-1.0", ("Eclipse Public License 1.0", "Eclipse Public License, Version 1.0", "Eclipse Public License v1.0")),
    ("EPL-2.0", ("Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "Eclipse Public License v2.0")),
    ("GPL-2.0-only", ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPLv2")),
    ("GPL-3.0-only", ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPLv3")),
    ("LGPL-2.1-only", ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1")),
    ("LGPL-3.0-only", ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3")),
    ("AGPL-3.0-only", ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3")),
)

# How a text names its licence.
PHRASES = ("Licensed under the {}", "Released under the {}", "Distributed under the {}", "Licensed under {}", "This project is licensed under the {}",
           "This work is licensed under the {}", "This software is licensed under the {}", "This program is licensed under the {}")

# Creative Commons licences, with the versions each came in.
COMMONS = tuple((f"CC-{kind}-{version}", (f"CC {kind} {version}", f"CC-{kind}-{version}", f"Creative Commons {words} {version} International License", f"Creative Commons {words} {version}"))
                for kind, words in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
                                    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
                for version in ("1.0", "2.0", "2.5", "3.0", "4.0")) + (("CC0-1.0", ("CC0 1.0", "CC0 1.0 Universal")),)

# The GNU families, and the versions of each.
GNU = (("GPL", "General", ("2", "3")), ("LGPL", "Lesser General", ("2.1", "3")), ("AGPL", "Affero General", ("3",)))
GNU_TERMS = "you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation"
GNU_LATER = "either version {} of the License, or (at your option) any later version"

# Public licence wording, one identifier a sentence.
SENTENCES = (
    *((f"ref:{name}", phrase.format(title)) for name, titles in (*NAMES, *COMMONS) for title in titles for phrase in PHRASES),
    *((f"name:{name}", name) for name, _ in (*NAMES, *COMMONS)),
    *((f"name:{kind}-{v if '.' in v else v + '.0'}-or-later", f"{kind}-{v if '.' in v else v + '.0'}-or-later") for kind, _, versions in GNU for v in versions),
    ("spdx", "SPDX-License-Identifier"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("as-is", "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("apache-comply", "you may not use this file except in compliance with the License"),
    ("apache-copy", "You may obtain a copy of the License at"),
    ("apache-as-is", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gnu-free", "This program is free software"),
    ("gnu-free", "This library is free software"),
    *((f"{kind}-terms", GNU_TERMS.format(family)) for kind, family, _ in GNU),
    *((f"{kind}-terms", GNU_TERMS.format(family) + ",") for kind, family, _ in GNU),
    *((f"later:{v}", GNU_LATER.format(v)) for v in ("2", "2.1", "3")),
    *((f"{kind}-later:{v}", GNU_TERMS.format(family) + ", " + GNU_LATER.format(v)) for kind, family, versions in GNU for v in versions),
    *((f"{kind}-only:{v}", GNU_TERMS.format(family).replace(" as published", f" version {v} as published")) for kind, family, versions in GNU for v in versions),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-names", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-as-is", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"),
    ("mpl-subject", "This Source Code Form is subject to the terms of the Mozilla Public License, v"),
    ("mpl-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("mpl-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("zlib-as-is", "This software is provided 'as-is', without any express or implied warranty"),
    ("zlib-liable", "In no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("unlicense-free", "This is free and unencumbered software released into the public domain"),
    ("unlicense-grant", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0"),
    ("epl-1", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html".split(". ", 1)[1]),
    ("boost-copy", "(See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("reserved", "All rights reserved"),
)

# Sequences of identifiers, in order of match: whole texts and headers, then tags, then names.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("ref:Apache-2.0", "apache-comply", "apache-copy", "apache-as-is")),
    ("Apache-2.0", ("ref:Apache-2.0", "apache-comply", "apache-copy")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant")),
    ("Unlicense", ("unlicense-free", "unlicense-grant")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("MPL-2.0", ("mpl-subject", "mpl-copy")),
    ("EPL-1.0", ("reserved", "epl-1")),
    ("BSL-1.0", ("ref:BSL-1.0", "boost-copy")),
    *((f"{kind}-{v if '.' in v else v + '.0'}-or-later", ("gnu-free", f"{kind}-terms", f"later:{v}")) for kind, _, versions in GNU for v in versions),
    *((f"{kind}-{v if '.' in v else v + '.0'}-{how}", ("gnu-free", f"{kind}-{tail}:{v}")) for kind, _, versions in GNU for v in versions for how, tail in (("or-later", "later"), ("only", "only"))),
    *((f"{kind}-{v if '.' in v else v + '.0'}-or-later", ("spdx", f"name:{kind}-{v if '.' in v else v + '.0'}-or-later")) for kind, _, versions in GNU for v in versions),
    *((name, ("spdx", f"name:{name}")) for name, _ in (*NAMES, *COMMONS)),
    *((f"{kind}-{v if '.' in v else v + '.0'}-{how}", (f"{kind}-{tail}:{v}",)) for kind, _, versions in GNU for v in versions for how, tail in (("or-later", "later"), ("only", "only"))),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl-subject",)),
    ("Unlicense", ("unlicense-free",)),
    ("EPL-2.0", ("epl-2",)),
    ("EPL-1.0", ("epl-1",)),
    *((name, (f"ref:{name}",)) for name, _ in (*NAMES, *COMMONS)),
    ("proprietary", ("reserved",)),
)

# Lists of sentences up to this length are sent to the executors.
BROADCAST_SENTENCES = 10_000

# Texts whose runs are made at once.
SLICE = 200

# Patterns (RE2) and what replaces them, in order: line breaks, comment marks
# before a line and box marks after it, sentence ends (before white space or the end; a blank line
# then), ``.0`` after a version, and all that is no letter or digit.
STEPS = (
    (r"\r\n?", "\n"),
    (r"(?m)^[^A-Za-z0-9\x{80}-\x{10ffff}\n]+", ""),
    (r"(?m)[ \t]+[^A-Za-z0-9\x{80}-\x{10ffff}\n]+$", ""),
    (r"(?mi)^(?:dnl|rem)(?:[ \t]+|$)", ""),
    (r"[.;:!?]+(?:[\t-\r ]|$)", "\n\n"),
    (r"([0-9])\.0([^0-9.]|$)", r"\1\2"),
    (r"[^A-Za-z0-9\x{80}-\x{10ffff}\n]+", " "),
)


def normalised(texts: pa.Array) -> pa.Array:
    """Normalised lines of each text; a blank one ends a sentence."""
    texts = pc.fill_null(texts, "")
    for pattern, by in STEPS:
        texts = pc.replace_substring_regex(texts, pattern, by)
    return pc.split_pattern(pc.ascii_lower(texts), "\n")


def runs(texts: pa.Array, lengths: np.ndarray):
    """Runs of lines of one of the ``lengths`` (bytes): text, first line, line after the last, and the run itself."""
    lists = normalised(texts)
    n_lines = pc.list_value_length(lists).to_numpy()
    lines = pc.ascii_trim(lists.flatten(), " ")
    size = pc.binary_length(lines).to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(n_lines)), n_lines)
    part = np.cumsum(size == 0)  # lines of one text between the same blank lines
    full = np.flatnonzero(size)
    lines, size, owner, part = lines.take(pa.array(full)), size[full], owner[full], part[full]
    fits = np.zeros(lengths.max(initial=0) + 1, bool)
    fits[lengths] = True
    start, total, out = np.arange(len(full)), size.copy(), []
    n = 1
    while len(start):
        short = total < len(fits)
        start, total = start[short], total[short]
        hit = start[fits[total]]
        out.append((hit, hit + n))
        start, total = start[start + n < len(full)], total[start + n < len(full)]
        same = (owner[start + n] == owner[start]) & (part[start + n] == part[start])
        start, total = start[same], total[same]
        total = total + 1 + size[start + n]
        n += 1
    begin, end = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
    offsets = np.concatenate(([0], np.cumsum(end - begin)))
    picked = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - begin, end - begin)
    words = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lines.take(pa.array(picked, pa.int64())))
    return owner[begin], full[begin], full[end - 1] + 1, pc.binary_join(words, " ")


def _candidates(lengths: np.ndarray):
    def run(batches):
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            owner, begin, end, norm = runs(batch.column("_text").cast(pa.string()), lengths)
            keys = batch.select(["_k1", "_k2"]).take(pa.array(owner))
            yield pa.RecordBatch.from_pydict({"_k1": keys.column(0), "_k2": keys.column(1), "begin": pa.array(begin, pa.int64()),
                                              "end": pa.array(end, pa.int64()), "norm": norm})
    return run


def places(hits) -> list[str]:
    """Identifiers in order, of hits (first line, line after the last, identifier); a line belongs to the longest hit."""
    taken, kept = {}, []
    for begin, end, name in sorted(hits, key=lambda x: (x[0] - x[1], x[0], x[2])):
        if all(taken.get(k, (begin, end)) == (begin, end) for k in range(begin, end)):
            taken.update(dict.fromkeys(range(begin, end), (begin, end)))
            kept.append((begin, name))
    return [name for _, name in sorted(kept)]


def matched(ids: list[str], rules) -> tuple[list[str], int]:
    """Licences of an ordered identifier sequence, and identifiers that no rule uses."""
    left: list[str | None] = list(ids)
    found = []
    for name, want in rules:
        at = 0
        while at + len(want) <= len(left):
            if tuple(left[at:at + len(want)]) == tuple(want):
                found.append((at, name))
                left[at:at + len(want)] = [None] * len(want)
            at += 1
    return list(dict.fromkeys(name for _, name in sorted(found))), sum(x is not None for x in left)


def scan(docs: DataFrame, sentences=SENTENCES, rules=RULES) -> DataFrame:
    """``doc_id``, ``sentence_ids`` (in order), ``licences``, ``n_unused`` for every document."""
    spark = docs.sparkSession
    small_batches(spark)
    norms = pc.binary_join(normalised(pa.array([s for _, s in sentences], pa.string())), " ")
    norms = pc.ascii_trim(pc.replace_substring_regex(norms, " +", " "), " ").to_pylist()
    listed = sorted({(i, n) for (i, _), n in zip(sentences, norms, strict=True) if n})
    known = spark.createDataFrame(listed, "id string, norm string")
    rows = docs.select("doc_id", *row_key(docs), F.col("text").cast("string").alias("_text"))
    lengths = np.array(sorted({len(n.encode()) for _, n in listed}), np.int64)
    each = rows.select("_k1", "_k2", "_text").mapInArrow(_candidates(lengths), "_k1 long, _k2 long, begin long, end long, norm string")
    if len(sentences) <= BROADCAST_SENTENCES:  # a larger list is joined by shuffling
        known = F.broadcast(known)
    found = each.join(known, "norm").groupBy("_k1", "_k2").agg(F.collect_set(F.struct("begin", "end", "id")).alias("hits"))

    @F.pandas_udf("sentence_ids array<string>, licences array<string>, n_unused long")
    def licences(hits: pd.Series) -> pd.DataFrame:
        ids = [places((h["begin"], h["end"], h["id"]) for h in x) for x in hits]
        return pd.DataFrame([(i, *matched(i, rules)) for i in ids], columns=["sentence_ids", "licences", "n_unused"])

    none = F.array().cast("array<string>")
    found = found.select("_k1", "_k2", licences("hits").alias("r"))
    return rows.drop("_text").join(found, ["_k1", "_k2"], "left").select(
        "doc_id", F.coalesce("r.sentence_ids", none).alias("sentence_ids"), F.coalesce("r.licences", none).alias("licences"),
        F.coalesce("r.n_unused", F.lit(0).cast("long")).alias("n_unused"))
