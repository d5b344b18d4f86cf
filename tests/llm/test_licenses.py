from edge import ROWS, Planted, documents, empty
from millrace.llm import licenses as s


def _rows(n=120):
    p, rows, want = Planted(6), [], {}
    notes = {
        "Apache-2.0": "This file is licensed under the Apache License, Version 2.0.",
        "MIT": "Released under the MIT License.",
        "GPL": "This work is licensed under the GNU General Public License, version 3.",
        "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
        "CC-BY-SA": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Proprietary": "Copyright (c) 2011 Some House. All rights reserved.",
    }
    families = list(notes)
    for k in range(n):
        lines = [p.text(40) for _ in range(3)]
        if k % 4 == 0:
            family = families[k // 4 % len(families)]
            lines.insert(k % 3, notes[family])
            want[k] = (family, k % 3)
        if k % 5 == 1:
            lines.append("The general public was free to enter, and his driving license stayed valid.")
        rows.append((k, "\n".join(lines), None))
    return rows, want


def test_families_are_found_and_ordinary_lines_left(spark):
    rows, want = _rows()
    got = {r["doc_id"]: r for r in s.scan(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    for k, _, _ in rows:
        if k in want:
            assert (got[k]["families"], got[k]["places"]) == ([want[k][0]], [want[k][1]]), k
            assert got[k]["licensed"] and got[k]["chances"][0] >= s.CERTAIN
        else:
            assert not got[k]["licensed"] and got[k]["families"] == []


def test_held_out_variants():
    p = Planted(1)
    model = s.fit([p.text(40) for _ in range(400)])
    held = s.examples([p.text(40) for _ in range(200)], seed=99)
    right = sum((max(model.find(words), key=lambda x: x[1])[0] if model.find(words) else s.UNKNOWN) == s.FAMILIES[k] for words, k in held)
    assert right / len(held) > 0.93
    assert model.find(s._words("some words about a licence for fishing in the general area")) == []


def _found(model, line):
    return [f for f, _, sure in model.find(s._words(line)) if sure]


NAMED = {
    "SPDX-License-Identifier: Zlib": [], "SPDX-License-Identifier: EPL-2.0": [], "Eclipse Public License, version 2.0": [], "European Union Public License, version 3": [],
    "SPDX-License-Identifier: GPL-2.0-only": ["GPL"], "GNU GENERAL PUBLIC LICENSE Version 3": ["GPL"], "GNU Lesser General Public License, version 2.1": ["LGPL"],
    "MIT License": ["MIT"], "SPDX-License-Identifier: MIT": ["MIT"], "SPDX-License-Identifier: Apache-2.0": ["Apache-2.0"], "GNU Affero General Public License, version 3": ["AGPL"],
}
#: Licences that nothing here was trained on.
STRANGE = ["Q Public License", "Sleepycat License", "IBM Public License", "Vim License", "NCSA", "Beerware", "Nokia Open Source License", "Ruby License", "OSL-3.0", "AFL-3.0", "CECILL-2.1", "LPPL-1.3c", "Watcom-1.0", "Xnet", "UPL-1.0", "Intel Open Source License", "JSON License", "Zend-2.0", "SISSL", "RPL-1.5"]


def test_licences_are_told_apart_by_their_names():
    p = Planted(3)
    model = s.fit([p.text(20) for _ in range(800)])
    assert {line: _found(model, line) for line in NAMED} == NAMED


def test_unknown_licences_stay_unknown():
    """Of licences never trained on, hardly one is taken for a known one; held-out wordings of known ones are found."""
    p = Planted(4)
    model = s.fit([p.text(20) for _ in range(800)])
    strange = [w.format(x, "2.0") for x in STRANGE for w in (*s.NAMED, *s.IDENTIFIED)]
    assert sum(bool(_found(model, line)) for line in strange) <= 0.02 * len(strange)
    assert sum(bool(model.find(s._words(line))) for line in strange) <= 0.1 * len(strange)
    notes = {"This project is licensed under the MIT license.": "MIT", "Code is licensed under the Apache License, Version 2.0": "Apache-2.0", "Distributed and released under the BSD 3-clause license": "BSD", "All files are subject to the terms of the Mozilla Public License, v. 2.0.": "MPL-2.0", "You may use it, licensed under CC BY-SA 4.0, freely": "CC-BY-SA"}
    right = [(_found(model, line), f) for line, f in notes.items()]
    assert sum(got == [f] for got, f in right) >= 0.9 * len(right), right


def test_frequent_notices_are_found():
    """However often a notice stands in the documents."""
    p = Planted(7)
    notes = {"This work has been dedicated to the public domain.": "CC0", "This is free and unencumbered software released into the public domain.": "CC0", "Confidential and proprietary: unauthorized copying of this file, via any medium, is strictly prohibited.": "Proprietary"}
    for note, family in notes.items():
        model = s.fit([note if k % 30 == 0 else p.text(12) for k in range(1_500)])
        assert [(f, sure) for f, _, sure in model.find(s._words(note))] == [(family, True)]


def test_wrapped_notices(spark):
    """Headers broken over lines, with comment signs or without, beside ordinary lines and after blank ones."""
    p = Planted(8)
    notes = {
        "GPL": ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version 3 of the License."],
        "LGPL": ["This library is free software; you can redistribute it and/or", "modify it under the terms of the GNU Lesser General Public License."],
        "BSD": ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions are met:"],
    }
    rows, want = [], {}
    for k in range(48):
        family = [*notes, None][k % 4]
        lines = [p.text(9) for _ in range(3)]
        if family:
            lines += ([""] if k % 8 < 4 else []) + [("# " if k % 3 else "") + x for x in notes[family]]
            want[k] = (family, lines.index(next(x for x in lines if x.endswith(notes[family][0]))))
        rows.append((k, "\n".join([*lines, p.text(9)]), None))
    for r in s.scan(documents(spark, rows)).collect():
        assert list(zip(r["families"], r["places"])) == ([want[r["doc_id"]]] if r["doc_id"] in want else []), r


def test_templates_confirm():
    assert s.overlap(s._words("Licensed under the Apache License, Version 2.0"), "Apache-2.0") == 1
    assert s.overlap(s._words("the apache helicopter landed"), "Apache-2.0") < s.OVERLAP
    assert [len(x) for x in s.runs(["w"] * 130)] == [60, 60, 60, 40]


def test_edges(spark):
    model = s.fit(["some plain words here"] * 20)
    assert s.scan_with(documents(spark), model).count() == len(ROWS)
    assert s.scan_with(empty(spark), model).collect() == [] and s.scan(empty(spark)).collect() == []
    got = s.scan(documents(spark)).collect()
    assert len(got) == len(ROWS) and not any(r["licensed"] for r in got)
