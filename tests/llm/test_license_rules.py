"""The license scan on notices as they are found in the wild, and its base places against a plain search."""
import random
import re

from colloquy.llm import license_scan as L
from colloquy.llm import queries
from colloquy.llm.license_rules import RULES

#: (text, label it must get)
NOTICES = [
    ("// SPDX-License-Identifier: Apache-2.0", "apache"), ("# SPDX-License-Identifier: MIT", "mit"),
    ("/* SPDX-License-Identifier: GPL-2.0-only */", "gpl"), ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl"),
    ("SPDX-License-Identifier: AGPL-3.0-or-later", "agpl"), ("SPDX-License-Identifier: BSD-2-Clause", "bsd"),
    ("SPDX-License-Identifier: MPL-2.0", "mpl"), ("SPDX-License-Identifier: EPL-2.0", "epl"), ("SPDX-License-Identifier: ISC", "isc"),
    ("SPDX-License-Identifier: BSL-1.0", "boost"), ("SPDX-License-Identifier: CC0-1.0", "cc0"), ("SPDX-License-Identifier: Unlicense", "unlicense"),
    ('license = "Apache-2.0"', "apache"), ('"license": "BSD-3-Clause",', "bsd"), ("License: MIT", "mit"), ("License :: OSI Approved :: MIT License", "mit"),
    ("This project is MIT licensed.", "mit"), ("Dual licensed, GPLv3 or commercial", "gpl"), ("Licensed under the GNU GPL version 2", "gpl"),
    ("Permission is hereby granted, free of charge, to any person obtaining\n * a copy of this software and associated files", "mit"),
    ("The above copyright notice and this permission notice shall be included in\nall copies or substantial portions of the Software.", "mit"),
    ("Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following\n# conditions are met:", "bsd"),
    ("Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\");\n you may not use this file except in compliance with the License.", "apache"),
    ("Licensed to the Apache Software Foundation (ASF) under one or more\ncontributor license agreements.", "apache"),
    ("http://www.apache.org/licenses/LICENSE-2.0", "apache"),
    ("you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by", "gpl"),
    ("You should have received a copy of the GNU Lesser General Public\n// License along with this library", "lgpl"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0.", "mpl"),
    ("are made available under the terms of the Eclipse Public License v1.0", "epl"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted", "isc"),
    ("Distributed under the Boost Software License, Version 1.0.", "boost"),
    ("In no event will the authors be held liable for any damages\narising from the use of this software.", "zlib"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", "wtfpl"), ("https://creativecommons.org/publicdomain/zero/1.0/", "cc0"),
    ("http://creativecommons.org/licenses/by-nc-nd/4.0/", "cc-by-nc-nd"), ("https://creativecommons.org/licenses/by-sa/3.0/deed.en", "cc-by-sa"),
    ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "cc-by-nc-sa"), ("released under CC BY 4.0", "cc-by"),
    ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "ofl"),
    ("made available under the Open Database License: http://opendatacommons.org/licenses/odbl/1.0/", "odbl"),
    ("This code is released into the public domain", "public-domain"), ("it under the same terms as Perl itself.", "artistic"),
    ("Unauthorized copying of this file, via any medium is strictly prohibited", "proprietary"), ("Business Source License 1.1", "busl"),
    ("subject to the terms of the\n * Common Development and Distribution License (the \"License\")", "cddl"), ("licensed under the EUPL, Version 1.2", "eupl"),
    ("Server Side Public License, version 1", "sspl"), ("the CreativeML Open RAIL-M license", "openrail"),
    ("with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts", "gfdl"), ("The PostgreSQL License", "postgresql"),
    # forms no rule was written for
    ("you may use it as you like, no strings attached", "public-domain"), ("Lizenz: MIT-Lizenz", "mit"),
]
PLAIN = ["The museum opens at nine, admission is free of charge.", "Wir fahren mit der Bahn, Lizenz hin oder her.", "a public library in the domain of science",
         "She asked for permission to use the copy machine.", "the source of this river must not be misrepresented", "Python 2.0 was a release; gpl", "The driving licence is valid.",
         "no warranty for the weather", "He got his fishing license in May.", "apache helicopters, boost engines, ruby rings, elastic bands, php and eclipse of the sun"]


def test_recall_on_notices():
    found = [label in L.scan_text(f"Some words before.\n{text}\nand some after")[5].split(",") for text, label in NOTICES]
    assert sum(found) / len(found) >= 0.9, [n for n, ok in zip(NOTICES, found) if not ok]
    assert all(found[:-2])


def test_plain_texts_get_no_label():
    wrong = [(t, L.scan_text(t)[5]) for t in PLAIN if L.scan_text(t)[5]]
    assert wrong in ([], [(PLAIN[5], "gpl")])  # the bare acronym is a name


def test_rules_are_many_valid_and_their_keywords_follow_from_them():
    assert sum(map(len, RULES.values())) >= 200 and len(RULES) >= 45
    for label, rules in RULES.items():
        for keyword, priority, confidence, rule in rules:
            L.expression(rule)
            assert 0 < priority <= 100 and 0 < confidence <= 1 and keyword == keyword.lower(), (label, rule)


def _base(text):
    """Places of the base phrases in the words, by the contract."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for phrase, label in L.BASE.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    return (len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at})))


def test_base_places_match_a_plain_search(spark):
    rng = random.Random(3)
    parts = ["GNU", "General", "public", "license", "Apache", "cc", "BY", "mit", "licensed", "é", "x1", "Lizenz"]
    for _ in range(500):
        text = "".join(rng.choice(parts) + rng.choice([" ", "\n", "-", ", ", "_", ""]) for _ in range(rng.randint(0, 30)))
        got = L.scan_text(text)
        assert got[:5] == _base(text), text
        assert set(filter(None, got[4].split(","))) <= set(got[5].split(",")) and 0 <= got[6] <= 1 and (got[6] > 0) == bool(got[5])
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op5_license_scan(spark, sf).collect()
    assert len(rows) == len(texts)
    assert all((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == _base(texts[r["doc_id"]]) for r in rows)
    twice = L.scan(spark.createDataFrame([(1, NOTICES[0][0])] * 2, "doc_id long, text string")).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
