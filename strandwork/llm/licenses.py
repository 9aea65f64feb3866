"""License scans through a positional index of rare licence words.

Each template's words are posted with their positions; a licence is several templates, its paragraphs and usual notices,
so that a text that is cut still has whole ones. A file is looked up in templates of whose key phrases it has all words,
and in each of these by the template's own words: the highest-IDF ones among the file's, and those of the key phrases, so
that no other text in the file takes their places. Each place of such a word and each posting vote for the place where
the template would begin, votes within ``SLACK`` words support one another, and a supported place counts only if the
template's mandatory key phrases stand near it. Coverage is the share of the template's words found in order from that
place.

Base phrases are searched besides: all places where a phrase's words stand consecutively.

Defined results: A-Z is lower-cased; null and empty texts have no words, no labels and score 0. Ties between templates
all count. Repeated rows, null ids and extra columns pass through; texts are read whole.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwork.llm.common import alnum_words, fresh, raw

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Openings of public licences and usual notices, with the phrases that must be present.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ["permission is hereby granted free of charge", "sublicense and or sell"]),
    ("mit", "Released under the MIT License", ["mit license"]),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ["apache license version 2"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ["gnu general public license", "redistribute it and or modify it"]),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license version"]),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["gnu lesser general public license"]),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ["gnu affero general public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ["redistribution and use in source and binary forms"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee is hereby granted"]),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ["mozilla public license"]),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ["free and unencumbered software"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc-by", "Licensed under CC BY 4.0", ["cc by 4"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4"]),
    ("mit", "SPDX-License-Identifier: MIT", ["spdx license identifier mit"]),
    ("apache", "SPDX-License-Identifier: Apache-2.0", ["spdx license identifier apache"]),
    ("gpl", "SPDX-License-Identifier: GPL-3.0", ["spdx license identifier gpl"]),
    # parts of the same, for texts that are cut, and what follows the openings
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ["to any person obtaining a copy of this software and associated documentation"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("isc", "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS", ["the author disclaims all warranties with regard to this software"]),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ["redistributions of source code must retain the above copyright notice"]),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", ["redistributions in binary form must reproduce the above copyright notice"]),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products derived from this software"]),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED", ["this software is provided by the copyright holders and contributors"]),
    ("bsd-4-clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement", ["all advertising materials mentioning features"]),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file", ["bsd style license"]),
    ("bsd", "Licensed under the BSD 3-Clause License", ["bsd 3 clause license"]),
    ("bsd", "Licensed under the BSD 2-Clause License", ["bsd 2 clause license"]),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", ["unless required by applicable law or agreed to in writing", "without warranties or conditions of any kind"]),
    ("apache", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements", ["apache software foundation", "contributor license agreements"]),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details", ["see the gnu general public license"]),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see", ["you should have received a copy of the gnu general public license"]),
    ("lgpl", "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details", ["see the gnu lesser general public license"]),
    ("lgpl", "You should have received a copy of the GNU Lesser General Public License along with this library", ["you should have received a copy of the gnu lesser general public license"]),
    ("lgpl", "under the terms of the GNU Library General Public License as published by the Free Software Foundation", ["gnu library general public license"]),
    ("agpl", "You should have received a copy of the GNU Affero General Public License along with this program", ["you should have received a copy of the gnu affero general public license"]),
    ("gfdl", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation", ["gnu free documentation license"]),
    # further licences
    ("mpl", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License", ["mozilla public license version 1"]),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", ["eclipse public license"]),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution", ["eclipse public license v1"]),
    ("cddl", "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License", ["common development and distribution license"]),
    ("eupl", "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the Licence); You may not use this work except in compliance with the Licence", ["licensed under the eupl"]),
    ("eupl", "This work is licensed under the European Union Public Licence", ["european union public licence"]),
    ("boost", "Distributed under the Boost Software License, Version 1.0", ["boost software license"]),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software", ["to any person or organization obtaining a copy of the software"]),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable"]),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", ["to alter it and redistribute it freely"]),
    ("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted", ["without a written agreement is hereby granted"]),
    ("ncsa", "University of Illinois/NCSA Open Source License", ["ncsa open source license"]),
    ("python", "This LICENSE AGREEMENT is between the Python Software Foundation (PSF), and the Individual or Organization (Licensee) accessing and otherwise using this software", ["python software foundation", "license agreement"]),
    ("artistic", "This package is free software; you can redistribute it and/or modify it under the terms of the Artistic License", ["artistic license"]),
    ("openssl", "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit", ["openssl toolkit"]),
    ("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1", ["sil open font license"]),
    ("ms-pl", "This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software", ["governs use of the accompanying software"]),
    ("json", "The Software shall be used for Good, not Evil", ["shall be used for good not evil"]),
    ("beerware", "As long as you retain this notice you can do whatever you want with this stuff. If we meet some day, and you think this stuff is worth it, you can buy me a beer in return", ["buy me a beer in return"]),
    ("cecill", "This software is governed by the CeCILL license under French law and abiding by the rules of distribution of free software", ["governed by the cecill"]),
    ("sspl", "under the terms of the Server Side Public License, version 1, as published by MongoDB, Inc", ["server side public license"]),
    ("busl", "Use of this software is governed by the Business Source License included in the file", ["business source license"]),
    ("elastic", "you may not use this file except in compliance with the Elastic License", ["elastic license"]),
    ("odbl", "This database is made available under the Open Database License", ["open database license"]),
    ("cc0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", ["dedicated all copyright and related and neighboring rights"]),
    ("cc0", "Licensed under CC0 1.0 Universal", ["cc0 1 0 universal"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial 4"]),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", ["creative commons attribution noncommercial sharealike"]),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", ["creative commons attribution noderivatives"]),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", ["creative commons attribution noncommercial noderivatives"]),
    ("unlicense", "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain", ["dedicate any and all copyright interest in the software"]),
    ("public-domain", "This work has been released into the public domain by its author", ["released into the public domain by"]),
    ("proprietary", "This software is the confidential and proprietary information of its owner. You shall not disclose such confidential information", ["confidential and proprietary information of"]),
    ("proprietary", "Dissemination of this information or reproduction of this material is strictly forbidden unless prior written permission is obtained", ["strictly forbidden unless prior written permission is obtained"]),
    ("proprietary", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential", ["strictly prohibited", "proprietary and confidential"]),
]
#: Short names of licences in tags, and their labels.
TAGS = {
    "BSD-3-Clause": "bsd", "BSD-2-Clause": "bsd", "ISC": "isc", "MPL-2.0": "mpl", "LGPL-2.1": "lgpl", "LGPL-3.0": "lgpl", "AGPL-3.0": "agpl", "Unlicense": "unlicense", "CC0-1.0": "cc0", "CC-BY-4.0": "cc-by",
    "CC-BY-SA-4.0": "cc-by-sa", "CC-BY-NC-4.0": "cc-by-nc", "BSL-1.0": "boost", "Zlib": "zlib", "EPL-2.0": "epl", "EUPL-1.2": "eupl", "CDDL-1.0": "cddl", "PostgreSQL": "postgresql", "OFL-1.1": "ofl", "0BSD": "0bsd",
}
TEMPLATES += [(label, f"SPDX-License-Identifier: {tag}", [" ".join(w.decode() for w in alnum_words(f"SPDX License Identifier {tag}".encode()))]) for tag, label in TAGS.items()]
#: Words looked up a template besides its key phrases'; places that agree to so many words; share of a template's words that must be there.
TOP_WORDS, SLACK, COVERAGE = 12, 3, 0.6


class Index:
    def __init__(self, templates=TEMPLATES):
        self.words = [alnum_words(t.encode()) for _, t, _ in templates]
        self.labels = [label for label, _, _ in templates]
        self.keys = [[alnum_words(k.encode()) for k in keys] for _, _, keys in templates]
        self.needed = [{w for k in keys for w in k} for keys in self.keys]
        df = Counter(w for t in self.words for w in set(t))
        self.idf = {w: math.log((1 + len(templates)) / n) for w, n in df.items()}
        self.postings: list[dict[bytes, list[int]]] = [defaultdict(list) for _ in templates]
        for t, words in enumerate(self.words):
            for q, w in enumerate(words):
                self.postings[t][w].append(q)
        self.by_idf = [sorted(p, key=lambda w: (-self.idf[w], w)) for p in self.postings]

    def lookup(self, words: list[bytes]) -> dict[str, float]:
        """Labels of the verified templates, with their coverage."""
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.idf:
                places[w].append(i)
        found: dict[str, float] = {}
        for t in (t for t, need in enumerate(self.needed) if all(w in places for w in need)):
            rare = [w for w in self.by_idf[t] if w in places][:TOP_WORDS]
            asked = {*rare, *self.needed[t]}
            starts = Counter(p - q for w in asked for q in self.postings[t][w] for p in places[w])
            least = min(2, len(asked))
            for s in starts:
                if sum(starts.get(s + k, 0) for k in range(-SLACK, SLACK + 1)) < least:
                    continue
                share = self.coverage(words, t, s)
                if share >= COVERAGE and share > found.get(self.labels[t], 0) and self.verified(words, t, s):
                    found[self.labels[t]] = share
        return found

    def coverage(self, words: list[bytes], t: int, start: int) -> float:
        """Share of the template's words that follow in order, each within SLACK words of where it should be."""
        p, hit = max(0, start - SLACK), 0
        for w in self.words[t]:
            for k in range(p, min(len(words), p + SLACK + 1 + (SLACK if not hit else 0))):
                if words[k] == w:
                    p, hit = k + 1, hit + 1
                    break
        return hit / len(self.words[t])

    def verified(self, words: list[bytes], t: int, start: int) -> bool:
        a, b = max(0, start - SLACK), start + len(self.words[t]) + 2 * SLACK
        near = b" " + b" ".join(words[a:b]) + b" "
        return all(b" " + b" ".join(k) + b" " in near for k in self.keys[t])


INDEX = Index()
_BASE = [(p.encode().split(), label) for p, label in PHRASES.items()]


def scan_text(text: bytes) -> tuple[int, list[tuple[int, str]], dict[str, float]]:
    """Number of words, base places (word number, label), and the index's labels with their coverage."""
    words = alnum_words(text)
    base = []
    at = -1
    for _ in range(words.count(b"license")):
        at = words.index(b"license", at + 1)
        for phrase, label in _BASE:
            s = at - len(phrase) + 1
            if s >= 0 and words[s : at + 1] == phrase:
                base.append((s, label))
    return len(words), base, INDEX.lookup(words)


#: What a scan gives for each text.
SCAN = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("base_starts", T.ArrayType(T.LongType())),
        T.StructField("base_labels", T.ArrayType(T.StringType())),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("score", T.DoubleType()),
    ]
)


@F.arrow_udf(SCAN)
def _scan(texts: pa.Array) -> pa.Array:
    n, starts, base_labels, labels, score = [], [], [], [], []
    for t in texts.to_pylist():
        words, base, found = scan_text(t)
        own = {label for _, label in base}
        n.append(words)
        starts.append([s for s, _ in base])
        base_labels.append(sorted(own))
        labels.append(sorted(own | set(found)))
        score.append(max([0.5 if own else 0.0, *found.values()]))
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64()]
    return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip((n, starts, base_labels, labels, score), kinds, strict=True)], names=SCAN.names)


_scan = _scan.asNondeterministic()


def scan_licenses(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """docs with a struct of the scan; and its column's name."""
    name = fresh(docs.columns, "licenses")
    return docs.withColumn(name, _scan(raw(F.col(f"`{text}`")))), name


def license_report(docs: DataFrame) -> DataFrame:
    held, name = scan_licenses(docs.select("doc_id", "text"))
    x = F.col(name)
    return held.select(
        "doc_id",
        x["n_words"].alias("n_words"),
        F.size(x["base_starts"]).cast("long").alias("n_base"),
        F.array_min(x["base_starts"]).alias("first_word"),
        F.array_max(x["base_starts"]).alias("last_word"),
        F.array_join(x["base_labels"], ",").alias("base_labels"),
        F.array_join(x["labels"], ",").alias("labels"),
        x["score"].alias("score"),
    )


def place_report(docs: DataFrame) -> DataFrame:
    """What the base phrases find, without the index's labels and scores."""
    return license_report(docs).drop("labels", "score")


#: The same rows of the base phrases in DuckDB's SQL.
PLACE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
a AS (SELECT *, list_filter(range(1, len(words) + 1), lambda i: words[i] = 'license') AS ends FROM w),
p AS (SELECT *, list_filter(ends, lambda i: i > 1 AND words[i - 1] = 'mit') AS mit, list_filter(ends, lambda i: i > 1 AND words[i - 1] = 'apache') AS apache,
             list_filter(ends, lambda i: i > 2 AND words[i - 1] = 'public' AND words[i - 2] = 'general') AS gpl FROM a),
s AS (SELECT *, list_concat(list_transform(list_concat(mit, apache), lambda i: i - 2), list_transform(gpl, lambda i: i - 3)) AS starts FROM p)
SELECT doc_id, len(words)::BIGINT AS n_words, len(starts)::BIGINT AS n_base, list_min(starts) AS first_word, list_max(starts) AS last_word,
       concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels
FROM s
"""
