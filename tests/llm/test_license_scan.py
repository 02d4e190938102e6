import random

import pytest

from tessera.llm import license_scan

BACKGROUND = [" ".join(random.Random(i).choices(["the", "of", "ention", "ther", "anti", "version", "hand", "work", "use"], k=20)) for i in range(300)]


@pytest.fixture(scope="module")
def model():
    return license_scan.fit(BACKGROUND)


def test_held_out_variants(model):
    rng = random.Random(99)
    right = total = 0
    for family, notices in license_scan.NOTICES.items():
        for notice in notices:
            for _ in range(5):
                words = [w for w in license_scan.word_list(notice) if rng.random() > 0.05 or len(notice) < 45]
                words = rng.choices(["some", "other", "text"], k=3) + words
                total += 1
                right += model.predict(words, 0.5, 0.6)[0] == family
    assert right >= 0.95 * total
    for text in [*BACKGROUND, *license_scan.MISUSES, "the library has a license to sell drinks"]:
        assert model.predict(license_scan.word_list(text), 0.5, 0.6)[0] == license_scan.UNKNOWN


def _segments(lines, telling):
    """Restated with loops."""
    words, out = [license_scan.word_list(x) for x in lines], []
    for i, w in enumerate(words):
        at = [0] if len(w) <= 80 else range(0, len(w) - 40, 40)
        out += [(i, i, w[k : k + 80]) for k in at]
    for i in range(len(words)):
        n = 0
        while n < 6 and i + n < len(words) and 0 < len(words[i + n]) <= 30:
            n += 1
        if n > 1:
            out.append((i, i + n - 1, [x for w in words[i : i + n] for x in w][:80]))
    return [s for s in out if set(s[2]) & set(telling)]


def _slow_scan(text, model):
    segments = _segments((text or "").split("\n"), model.telling)
    found = set()
    for a, b, words in segments:
        family, p, like = model.predict(words, 0.5, 0.6)
        if family != license_scan.UNKNOWN:
            found.add((a, b, family, round(p, 4), round(like, 4)))
    rank = lambda f: (-f[4], f[1] - f[0], f[0], -f[3])
    return len(segments), sorted(f for f in found if not any(o[2] == f[2] and o[0] <= f[1] and f[0] <= o[1] and rank(o) < rank(f) for o in found))


def test_columns_match_plain_python(spark, model):
    rng = random.Random(1)
    texts = [None, "", "\n\n", "x\nReleased under the MIT License.\n", "Licensed under CC BY-NC 4.0.", "ALL RIGHTS RESERVED", "Über Licensed Apache, oui", "He lost his license.", "word " * 200_000 + "Released under the MIT License. " + "word " * 100]
    pool = [t for v in license_scan.NOTICES.values() for t in v] + license_scan.MISUSES + BACKGROUND[:10] + ["", "license"]
    texts += ["\n".join(rng.choices(pool, k=rng.randrange(1, 6))) for _ in range(60)]
    for notice in rng.sample(pool[:40], 12):
        words = (" ".join(BACKGROUND[:2]) + " " + notice).split()
        texts.append("\n".join("# " + " ".join(words[k : k + 9]) for k in range(0, len(words), 9)))
    got = license_scan.license_scan(spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "doc_id long, text string, c string"), model).collect()
    assert len(got) == len(texts)
    for r in got:
        n, want = _slow_scan(texts[r.doc_id], model)
        assert r.n_paragraphs == len((texts[r.doc_id] or "").split("\n")) and r.scored == n
        assert [(f.line, f["last"], f.family) for f in r.found] == [w[:3] for w in want]
        assert all(abs(f.probability - w[3]) < 2e-3 and abs(f.likeness - w[4]) < 2e-3 for f, w in zip(r.found, want))


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell",
    "bsd": "/* Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are\n * met:\n *\n",
    "gpl": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.",
    "agpl": "// This program is free software: you can redistribute it and/or modify it under\n// the terms of the GNU Affero General Public License as published by the Free\n// Software Foundation, either version 3 of the License, or any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "epl-2.0": "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/",
    "apache-2.0": "-- Licensed under the Apache License, Version 2.0 (the \"License\");\n-- you may not use this file except in compliance with the License.",
}


def test_wrapped_notices_and_tags(spark, model):
    rows = list(WRAPPED.items()) + [("mit", "x = 1  # SPDX-License-Identifier: MIT"), ("agpl", "SPDX-License-Identifier: AGPL-3.0-or-later"), ("cc-by-nd", "Licensed under CC BY-ND 4.0."), (None, ("ordinary words in a long line public domain rights " * 430).strip()), (None, "waived rights law author extent possible copyright related cc0 work under all")]
    got = {r.doc_id: {f.family for f in r.found} for r in license_scan.license_scan(spark.createDataFrame([(i, f"Some text before.\n{t}\nand after it\n") for i, (_, t) in enumerate(rows)], "doc_id long, text string"), model).collect()}
    for i, (family, text) in enumerate(rows):
        assert got[i] == ({family} if family else set()), (text, got[i])


def test_calibration_holds_on_notices_outside_of_the_model():
    """The calibrated probability of what is judged a family, for families' notices that the model has not seen."""
    import numpy as np

    all_of, hits, sure = license_scan.NOTICES, [], []
    try:
        license_scan.NOTICES = {f: own[:-1] if len(own) > 2 else own for f, own in all_of.items()}
        apart = license_scan.fit(BACKGROUND)
    finally:
        license_scan.NOTICES = all_of
    for f, own in all_of.items():
        if len(own) > 2:
            z = np.array(apart.bias) + sum(np.array(apart.weights.get(g, [0.0] * len(apart.bias))) for g in license_scan.grams(license_scan.word_list(own[-1])))
            z = z / apart.temperature
            z[-1] += apart.offset
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            hits.append(apart.classes[int(p.argmax())] in (f, license_scan.UNKNOWN))
            sure.append(p.max())
    assert np.mean(hits) >= np.mean(sure) - 0.25


def test_planted_lines_of_documents(spark):
    """Precision and recall on all lines of the table."""
    planted = {"This work is licensed under the GNU General Public License, version 3.": "gpl", "All rights reserved.": "reserved", "Released under the MIT License.": "mit", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under the Apache License, Version 2.0.": "apache-2.0"}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = {(r.doc_id, k, planted[x]) for r in docs.collect() for k, x in enumerate((r.text or "").split("\n")) if x in planted}
    got = {(r.doc_id, f.line, f.family) for r in license_scan.license_scan(docs, license_scan.train(docs)).collect() for f in r.found}
    assert len(want) > 10 and got == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert license_scan.license_scan(docs, license_scan.train(docs)).count() == 0


def test_no_notice_is_passed_over_where_licence_words_are_common():
    words = sorted({w for own in license_scan.NOTICES.values() for t in own for w in license_scan.word_list(t)})
    hot = [" ".join(random.Random(i).choices(["plain", "text", "code", "line"], k=12) + [words[(7 * i + k) % len(words)] for k in range(3)]) for i in range(1500)]
    model = license_scan.fit(hot, rounds=5)
    rng = random.Random(3)
    for t in (t for own in model.templates for t, _ in own):
        for _ in range(20):
            kept = rng.sample(t, next(k for k in range(len(t) + 1) if round(k / len(t), 4) >= 0.6))
            assert set(kept) & set(model.telling), t
