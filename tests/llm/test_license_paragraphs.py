import numpy as np
import pytest

from cipherledger.llm import license_scan as S

PROSE = "the house of the man and the dog is in the town where they live with a friend"
NOTICES = {
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights",
    "BSD": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n    http://www.apache.org/licenses/LICENSE-2.0",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


@pytest.fixture(scope="module")
def scanner(spark):
    return S.train(spark.createDataFrame([(i, f"{PROSE} wort{i}\n\n{PROSE[::-1]} {i}") for i in range(40)], "doc_id long, text string"))


def test_wrapped_notices(scanner):
    for family, notice in NOTICES.items():
        text = f"{PROSE}\n\n{notice}\n\n{PROSE}"
        hits = [h for h in scanner.scan(text) if h[2] == family]
        assert hits, family
        a, b = hits[0][:2]
        assert text[a:b] in notice


#: Written once as a test and not used to choose frames, names or settings; the README has the result.
HELD_OUT = {
    "MIT": ["Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.", "Dual purpose tool, MIT.", "Der Quelltext ist unter der MIT-Lizenz frei verfügbar.", "Este paquete usa la licencia MIT"],
    "Apache-2.0": ["All contributions are accepted under Apache 2 terms (Apache License 2.0).", "El código fuente está cubierto por la Apache License, Version 2.0", "Unless required by applicable law, software distributed under the Apache License is distributed on an AS IS basis"],
    "GPL-3.0": ["You should have received a copy of the GNU General Public License version 3 along with this program.", "kopieren erlaubt gemäß GPLv3", "The firmware is free software, GPL-3.0-or-later", "logiciel libre, GNU GPL v3"],
    "GPL-2.0": ["This driver is GPL v2 like the kernel itself", "The module may be used and distributed according to the terms of the GNU General Public License version 2"],
    "LGPL": ["The runtime library is LGPL, so linking is fine", "GNU Lesser General Public License for more details"],
    "AGPL-3.0": ["Hosted versions must follow the GNU Affero General Public License", "server code: AGPL-3.0"],
    "BSD": ["governed by a BSD-style license", "Three-clause BSD applies to all files here", "libre sous licence BSD"],
    "MPL-2.0": ["Files carry the Mozilla Public License header", "MPL 2.0 applies to modified files"],
    "ISC": ["Copyright (c) Jane Roe. ISC License."],
    "CC0": ["The data set is in CC0, no attribution is needed", "waived worldwide through CC0 1.0 Universal"],
    "EPL": ["This plug-in is made available under the Eclipse Public License"],
    "CC-BY": ["Figures are reusable under a Creative Commons Attribution 4.0 licence", "Text: CC BY 4.0, photographers as named"],
    "CC-BY-SA": ["Wiki content is available under Creative Commons Attribution-ShareAlike 4.0", "contenido bajo CC BY-SA 4.0"],
    "CC-BY-NC": ["Slides may be shared under CC BY-NC 4.0"],
    "unknown": ["This module uses the Artistic License 2.0", "Published under the CeCILL licence", "See the enclosed license agreement before use", "Licensed under the Fantasy Font License"],
    None: ["The restaurant waited months for its license to serve wine", "A licensed plumber fixed the pipe", "Mit dem Zug fährt er nach Hause", "The Apache people lived in the southwest", "We watched the lunar eclipse in public", "He teaches at MIT and lives nearby", "The band released a new version of the song", "La licencia de caza cuesta mucho", "Sie hat die Lizenz zum Fliegen verloren", "The court granted permission to appeal", "the isc of the house and the dog"],
}


def held_out(scanner):
    """``(right among those given a family, all given one, right among those of a family, all of one, notices missed, false alarms)``."""
    given = right = of_family = missed = alarms = 0
    for want, texts in HELD_OUT.items():
        for t in texts:
            got = scanner.classify(t)
            name = got[0] if got else None
            known = name not in (None, "unknown")
            given += known
            right += known and name == want
            of_family += want not in (None, "unknown")
            missed += want is not None and name is None
            alarms += want is None and name is not None
    return right, given, of_family, missed, alarms


def test_held_out_notices(scanner):
    right, given, of_family, missed, alarms = held_out(scanner)
    assert right / given >= 0.8 and right / of_family >= 0.6, (right, given, of_family, missed, alarms)
    assert missed <= 8 and alarms <= 4, (missed, alarms)


def test_odd_paragraphs(scanner):
    assert scanner.classify(PROSE) is None and scanner.scan(None) == [] and scanner.scan("") == [] and scanner.scan("\n \n") == []
    twice = scanner.scan("License: BSD\n\nLicense: BSD")
    assert [x[2] for x in twice] == ["BSD", "BSD"] and twice[0][3] == twice[1][3]


def test_scan_is_brute_force(scanner):
    """The skipped lines are those that the whole model calls ordinary."""
    rng = np.random.default_rng(0)
    pool = [w for n in NOTICES.values() for w in n.split()] + PROSE.split() + [w for t in (*S.UNKNOWN, *S.ORDINARY) for w in t.split()]
    for _ in range(400):
        line = " ".join(rng.choice(pool, rng.integers(1, 20)))
        found = set(S.grams(line))
        z = scanner.bias + sum((scanner.weights[g] for g in sorted(found & scanner.weights.keys())), np.zeros(len(scanner.bias)))
        p = np.exp((z - z.max()) / scanner.heat)
        name = scanner.names[int(p.argmax())]
        p = p / p.sum()
        if name not in ("unknown", "ordinary") and not (p.max() >= S.CERTAIN and scanner.confirmed(name, found) >= S.CONFIRM):
            name = "unknown"
        got = scanner.classify(line)
        assert (got[0] if got else "ordinary") == name
