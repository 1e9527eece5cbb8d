import re

import numpy as np
import pytest

from tests.llm.conftest import EDGES
from tripweave.llm import licences
from tripweave.llm.licence_texts import TEMPLATES
from tripweave.llm.queries import op2_licences

SF = "/root/testdata/sf0.01"


def plain_words(text):
    return re.findall("[a-z]+|[0-9]+", re.sub(r"([a-z])v([0-9])", r"\1 v \2", text.lower()))


def plain_paragraphs(text):
    """Numbers and texts of what lines without a letter or digit separate."""
    parts, lines = [[]], (text or "").split("\n")
    for i, line in enumerate(lines):
        if 0 < i < len(lines) - 1 and not any(c.isalnum() for c in line):
            parts.append([])
        else:
            parts[-1].append(line)
    return [(k, "\n".join(p)) for k, p in enumerate(parts) if plain_words("\n".join(p))]


LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
AGPL = """/* This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU Affero General Public License as published
 * by the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version. */"""
MIT = """Permission is hereby granted, free of charge, to any
person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the
Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute"""


def test_families_and_unknown(docs_of):
    parts = {
        "MIT": "Copyright notice. Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "Apache-2.0": "Some prose. Licensed under the Apache License, Version 2.0. More prose.",
        "GPL": "This work is licensed under the GNU General Public License, version 3.",
        "LGPL": "hello GNU Lesser General Public License version 3 hello",
        "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
        "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "unknown": "You need a license plate for the car.",
    }
    text = "\n\n".join(["first line without any", *parts.values(), "", "last"])
    found = licences.scan_licences(docs_of([(1, text), (2, "nothing here"), *[r[:2] for r in EDGES]], clashes=True)).orderBy("paragraph").collect()
    assert [(r.doc_id, r.paragraph) for r in found] == [(1, i + 1) for i in range(len(parts))]
    assert [r.family for r in found] == list(parts)
    assert [r.confirmed for r in found] == [f != "unknown" for f in parts]
    assert all(0 < r.probability <= 1 and 0 <= r.similarity <= 1 for r in found)


@pytest.mark.parametrize(("family", "notice"), [("LGPL", LGPL), ("AGPL", AGPL), ("MIT", MIT)])
def test_a_wrapped_notice_is_one_paragraph(docs_of, family, notice):
    text = f"some title\n \t\n{notice}\n *\nand then other words"
    found = licences.scan_licences(docs_of([(1, text), (2, notice.replace("\n", "\r\n"))])).orderBy("doc_id").collect()
    assert [(r.doc_id, r.paragraph, r.family, r.confirmed) for r in found] == [(1, 1, family, True), (2, 0, family, True)]


def test_marks_of_letters_and_digits(docs_of):
    marks = [("Released under GPLv3.", "GPL"), ("LGPLv2.1 or later", "LGPL"), ("AGPLv3", "AGPL"), ("MPLv2", "MPL-2.0"), ("under the GPLv2, see there", "GPL"), ("Licensing terms apply", "unknown")]
    found = licences.scan_licences(docs_of([(i, t) for i, (t, _) in enumerate(marks)])).orderBy("doc_id").collect()
    assert [(r.doc_id, r.family) for r in found] == [(i, f) for i, (_, f) in enumerate(marks)]


def test_edges(docs_of):
    docs = docs_of(EDGES, clashes=True)
    assert licences.scan_licences(docs).count() == 0
    assert licences.scan_licences(docs.limit(0)).count() == 0
    twice = docs_of([(None, "SPDX-License-Identifier: MIT"), (4, "SPDX-License-Identifier: MIT"), (4, "SPDX-License-Identifier: MIT"), (5, "\n" * 50_000 + "x")])
    assert [(r.family, r.confirmed) for r in licences.scan_licences(twice).collect()] == [("MIT", True)] * 3


def test_query_scores_like_the_model_and_stays_native(spark, monkeypatch):
    """Every paragraph of every text, scored from the weights alone; similarity and confirmation too."""
    models = []
    fit = licences.LicenceModel.fit
    monkeypatch.setattr(licences.LicenceModel, "fit", classmethod(lambda cls, others, keys: models.append(fit(others, keys)) or models[-1]))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scanned = licences.scan_licences(docs)
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "NestedLoop", "Cartesian"))
    found, model = scanned.collect(), models[0]
    runs = lambda w: {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
    templates = {f: [runs(plain_words(t)) for t in own] for f, own in TEMPLATES.items()}
    wanted = {}
    for i, t in docs.select("doc_id", "text").collect():
        for k, part in plain_paragraphs(t):
            w = plain_words(part)
            z = model.bias.copy()
            for g in {" ".join(w[a : a + n]) for n in (1, 2, 3) for a in range(len(w) - n + 1)}:
                z += model.features.get(g, 0)
            p = np.exp(z / model.temperature - (z / model.temperature).max())
            p /= p.sum()
            best = int(np.argmax(p[:-1]))
            sure = p[best] >= 0.5 and p[best] >= p[-1]
            family = model.classes[best] if sure else licences.UNKNOWN
            if sure or any(s in part.lower() for s in licences.STEMS):
                own = runs(w)
                like = max((len(r & own) / min(len(r), len(own)) for r in templates.get(family, [])), default=0.0)
                wanted[(i, k)] = (family, p[best] if sure else p[-1], like, sure and like >= 0.6)
    assert {(r.doc_id, r.paragraph) for r in found} == set(wanted) and len(found) > 10
    for r in found:
        family, p, like, confirmed = wanted[(r.doc_id, r.paragraph)]
        assert (r.family, r.confirmed) == (family, confirmed)
        assert r.probability == pytest.approx(p, rel=1e-6) and r.similarity == pytest.approx(like)
    assert op2_licences(spark, SF).count() == len(found)


def test_every_gram_of_the_model_has_a_key():
    common = [["the", "of", "software", "license"]] * 100 + [["other"]]
    keys = licences.choose_keys(common)
    assert not {"the", "of", "software"} & keys and {"license", "gpl", "mozilla", "permission"} <= keys
    model = licences.LicenceModel.fit(common, keys)
    assert all(set(g.split()) & keys for g in model.features)


def test_templates_are_recognised_and_calibrated():
    model = licences.LicenceModel.fit([["the", "cat", "sat"], ["une", "phrase"]], licences.choose_keys([]))
    right = [model.classes[int(model.probabilities(t).argmax())] == f for f, own in TEMPLATES.items() for t in own]
    assert np.mean(right) > 0.95
    assert model.probabilities("plain zebra")[-1] == model.probabilities("")[-1] > 0.4
