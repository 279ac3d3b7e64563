import re
import textwrap

import numpy as np
from pyspark.sql import functions as F

from sievemill.llm import license_scan as ls
from sievemill.llm import queries

NOTICES = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}


def test_every_notice_is_found_and_little_else(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r["doc_id"], r["line"]): r["family"] for r in queries.op8_licenses(spark, sf).collect()}
    lines = {(r["doc_id"], k): x for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for k, x in enumerate((r["text"] or "").split("\n"))}
    for place, line in lines.items():
        if line.strip() in NOTICES:
            assert got[place] == NOTICES[line.strip()]
    odd = [p for p in got if not re.search("licen[sc]e|rights reserved", lines[p], re.I)]
    assert len(odd) <= len(lines) / 200 and all(got[p] == ls.UNKNOWN for p in odd)


def test_other_licences_are_unknown_and_long_lines_are_read(docs, prose):
    rows = [
        (1, "Licensed under the Wombat License, version 3"), (2, prose(900, 1) + " Released under the MIT License " + prose(900, 2)), (3, prose(50, 3) + "\n\n\nLicensed under CC BY-SA 4.0"), (4, None), (5, ""), (6, "She had a driving licence"), (7, "\n"),
        (8, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"), (8, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"), (None, "Licensed under the ISC License"),
    ]
    got = sorted((str(r["doc_id"]), r["line"], r["family"], r["confirmed"]) for r in ls.scan(docs(rows, "line")).collect())
    assert got == sorted([("1", 0, "unknown", False), ("2", 0, "MIT", True), ("3", 3, "CC-BY-SA-4.0", True), ("8", 0, "MIT", True), ("8", 0, "MIT", True), ("None", 0, "ISC", True)])
    assert ls.scan(docs([])).count() == 0


def test_batch_scores_equal_single_ones(docs, prose):
    model = ls.classifier()
    text = prose(130, 5) + " Licensed under the Apache License, Version 2.0 " + prose(20, 6)
    h = ls.hash_of(ls._words(text))
    a, b = model.windows(h, np.zeros(len(h), bool))
    assert a[0] == 0 and b[-1] == len(h) and all(x <= y for x, y in zip(a[1:], b[:-1]))
    found = set(model.notices(h, a, b).tolist())
    cut = 1 / (1 + np.exp(-model.cut))
    assert found == {i for i in range(len(a)) if model.probabilities(h[a[i] : b[i]])[0] >= cut}
    spark_hash = docs([(1, text)]).select(ls.word_hashes(F.col("text")).alias("w")).first()["w"]
    assert np.asarray(spark_hash, np.int64).view(np.uint64).tolist() == h.tolist()


GPL = "{} is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
#: In the licences of two, three and four clauses alike, so it names none.
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
NEITHER = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
APACHE = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"


def test_headers_wrapped_over_lines(docs, prose):
    heads = [(GPL.format("This program"), "GPL-3.0"), (GPL.format("Wombat"), "GPL-3.0"), (BSD, "unknown"), (NEITHER, "BSD-3-Clause"), (MIT, "MIT"), (APACHE, "Apache-2.0")]
    rows = []
    for k, (head, _) in enumerate(heads):
        for n, mark in enumerate(("", "# ", " * ")):
            lines = [f"{mark}{x}" for x in textwrap.wrap(head, 72 - len(mark))]
            rows.append((10 * k + n, "\n".join([f"{mark}{prose(8, k)}", mark, *lines, mark, f"{mark}{prose(8, 50 + k)}"])))
    got = {}
    for r in ls.scan(docs(rows)).collect():
        got.setdefault(r["doc_id"], []).append((r["line"], r["family"]))
    for k, (_, family) in enumerate(heads):
        for n in range(3):
            found = got[10 * k + n]
            assert {f for _, f in found} == {family} and min(found)[0] in (2, 3), (rows[3 * k + n], found)


def test_lines_beside_a_notice_do_not_rename_it(docs, prose):
    rows = [(1, "Released under the MIT License.\n" + "An " * 40), (2, prose(9, 1) + "\nThis work is licensed under the GNU General Public License, version 3.\n" + prose(9, 2))]
    assert {tuple(r)[:3] for r in ls.scan(docs(rows)).collect()} == {(1, 0, "MIT"), (2, 1, "GPL-3.0")}


def test_neighbours_of_the_families_are_unknown(docs, prose):
    others = [
        "Licensed under the Apache License, Version 1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License 2.0", "Licensed under the BSD 2-Clause License", "Licensed under CC BY 3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License", "This work is licensed under the GNU General Public License, version 1", "Licensed under CC BY-ND 4.0", "This library is licensed under the GNU Lesser General Public License, version 2.1",
    ]
    rows = [(i, x) for i, x in enumerate(others)] + [(100 + i, f"{prose(12, i)}\n{x}\n{prose(9, 50 + i)}") for i, x in enumerate(others)]
    got = [tuple(r) for r in ls.scan(docs(rows)).collect()]
    assert {(r[2], r[5]) for r in got} == {("unknown", False)} and len({r[0] for r in got}) >= 0.9 * len(rows)


def test_own_notices_are_confirmed(docs, prose):
    own = [(f, t) for f, some in ls.TEMPLATES.items() for t in some]
    rows = list(enumerate([t for _, t in own] + [f"{prose(10, i)}. {t}. {prose(10, 90 + i)}" for i, (_, t) in enumerate(own)]))
    got = {(r["doc_id"], r["family"]) for r in ls.scan(docs(rows)).collect()}
    shared = [t for f, t in own if not any(all(f" {p} " in f" {' '.join(ls._words(t))} " for p in key) for key in ls.KEYS[f])]
    assert len(shared) <= 4  # passages that other licences hold too
    for i, (f, t) in enumerate(own * 2):
        assert (i, "unknown" if t in shared else f) in got, (t, [g for g in got if g[0] == i])
