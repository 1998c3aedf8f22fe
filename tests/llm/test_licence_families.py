import math

from gramsieve.llm import licence_texts, licences

NOTICES = [
    ("Licensed under the MIT License.", "MIT"), ("This software is released under the MIT License.", "MIT"),
    ("Released under the BSD License.", "BSD"), ("Licensed under the BSD 2-Clause License.", "BSD-2-Clause"), ("Distributed under the New BSD License", "BSD-3-Clause"),
    ("Licensed under CC0 1.0.", "CC0-1.0"), ("Released under the Apache License.", "Apache"), ("Released under the Apache License, Version 2.0.", "Apache-2.0"),
    ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("Licensed under CC BY-NC-SA 3.0.", "CC-BY-NC-SA-3.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("Licensed under the GNU Affero General Public License v3.0", "AGPL-3.0"), ("Licensed under the LGPL v2.1", "LGPL-2.1"), ("Licensed under the GPL, version 2", "GPL-2.0"),
    ("Released under the ISC License", "ISC"), ("Available under the Eclipse Public License 2.0", "EPL-2.0"), ("# SPDX-License-Identifier: Zlib", "Zlib"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"), ("All rights reserved.", "LicenseRef-All-Rights-Reserved"),
    ("All rights reserved.\nprose\nReleased under the ISC License", "ISC"),
    ("Released under the Foo License.", None), ("Mit.", None), ("the license of the public library", None),
]


def model(n):
    """Frequencies as in prose with some notices: a share of the documents holds each word."""
    share = {"the": 0.5, "of": 0.5, "this": 0.3, "under": 0.2, "is": 0.3, "mit": 0.1, "license": 0.05, "licensed": 0.03, "released": 0.02, "public": 0.05, "version": 0.02, "work": 0.05}
    hashes = {w: int(licences.tokens(w.encode())[0].view("int64")[0]) for w in share}
    return licences.Model({hashes[w]: math.floor(s * n) for w, s in share.items()}, n)


def test_families_versions_and_wordings():
    m = model(10_000)
    for text, name in NOTICES:
        assert m.scan(text.encode())[0] == name, (text, m.scan(text.encode()))


def test_whole_texts_beat_their_near_variants():
    m, t = model(10_000), licence_texts
    for name, text in (("BSD-2-Clause", t._BSD + t._BSD_1 + t._BSD_2 + t._BSD_END), ("BSD-3-Clause", t._BSD + t._BSD_1 + t._BSD_2 + t._BSD_3 + t._BSD_END), ("ISC", t._ISC + t._ISC_IF + t._ISC_END), ("MIT", t._MIT + t._MIT_REST + t._AS_IS + t._MIT_END)):
        words = ("Copyright (c) 2020, Jane Roe\n\n" + text).split(" ")
        wrapped = "\n".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12))
        assert m.scan(wrapped.encode())[0] == name, (name, m.scan(wrapped.encode()))


def test_one_header_at_several_corpus_sizes():
    headers = ["This work is licensed under the GNU General Public License, version 3. (c) John Smith", "Copyright 2020. Licensed under the Apache License, Version 2.0.", "Acme widgets: this software is released under the MIT License. (c) Smith"]
    for text in headers:
        found = [model(n).scan(text.encode(), 0.3) for n in (1_000, 10_000, 10_000_000)]
        assert len({f[0] for f in found}) == 1 and found[0][0], (text, found)
        assert max(f[1] for f in found) - min(f[1] for f in found) < 1e-6, (text, found)
