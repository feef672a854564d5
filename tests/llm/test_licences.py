"""Licence scan on texts written by hand: whole sentences, templates, gaps and denials."""

import pytest
from pyspark.sql import functions as F

from evidentia.llm import licences

MIT = """MIT License

Copyright (c) 2021 Ann Other, Inc.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
"""
ENDORSE = """3. Neither the name of Ann Other nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {}General Public License as published by
the Free Software Foundation, either version {} of the License, or
(at your option) any later version.
"""
TEXTS = {
    MIT: "MIT", APACHE: "Apache-2.0", BSD.format(ENDORSE): "BSD-3-Clause", BSD.format(""): "BSD-2-Clause", GPL.format("", 3): "GPL-3.0-or-later", GPL.format("", 2): "GPL-2.0-or-later",
    GPL.format("Affero ", 3): "AGPL-3.0-or-later", GPL.format("Lesser ", "2.1").replace("program", "library"): "LGPL-2.1-or-later",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "All rights reserved.": "all-rights-reserved", "The software is distributed under the terms of the MIT license.": "MIT",
    "This software is distributed under the terms of the MIT license.": "MIT", "This package is dual licensed under the GPL v3 or later.": "GPL-3.0-or-later",
    "Our library is made available under the GNU LGPL version 2.1.": "LGPL-2.1", "This dataset is released under Creative Commons BY-SA 4.0 International License.": "CC-BY-SA-4.0",
    "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause", "// SPDX-License-Identifier: GPL-2.0-or-later\nint main;": "GPL-2.0-or-later", "This code is licensed under the 3-clause BSD license.": "BSD-3-Clause",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "MPL-2.0", "Mozilla Public License Version 2.0": "MPL-2.0",
    "This is free and unencumbered software released into the public domain.": "Unlicense", "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
    "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991": "GPL-2.0", "GNU Affero General Public License\nVersion 3, 19 November 2007": "AGPL-3.0",
    "Apache License\nVersion 2.0, January 2004": "Apache-2.0", "The MIT License (MIT)": "MIT", "Hello there\nReleased under the MIT License.\nAnd more words without an end": "MIT",
    # denials, mentions and near misses are no licences
    "This project is not licensed under the MIT License.": "", "We thought about the MIT License, but chose none.": "", "He was granted a license to drive.": "", "No rights reserved.": "",
    "The Apache License, Version 2.0, is a licence that many projects use.": "", "Unlike software released under the MIT License, this is secret.": "", "Permission to enter was refused.": "",
    "Redistribution is forbidden.": "", "It is not true that all rights reserved means anything.": "", "": "", None: "",
    # a foreign sentence between two of a rule, and two licences of one text
    MIT.replace("MIT License\n", "MIT License\n\nAll rights reserved.\n"): "MIT,all-rights-reserved",
    "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.": "CC-BY-NC-4.0,MIT",
}


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for c in ("sentences", "ids", "ruled", "marked", "n_unknown"):
        df = df.withColumn(c, F.lit(7))
    return [r for r in licences.scan_licences(df).orderBy("doc_id").collect()]


def test_texts_written_by_hand(spark):
    got = scanned(spark, TEXTS)
    assert len(got) == len(TEXTS) >= 40
    wrong = {t: r.licenses for (t, want), r in zip(TEXTS.items(), got, strict=True) if r.licenses != want}
    assert not wrong


def test_sentences_of_a_licence_are_counted_as_such(spark):
    mit, apache, denied, gap = scanned(spark, [MIT, APACHE, "This project is not licensed under the MIT License.", MIT.replace("MIT License\n", "MIT License\n\nAll rights reserved.\n")])
    assert mit.sentence_ids == "MITTitle,Copyright,MITGrant,MITNotice,MITAsIs,MITLiable" and mit.n_unruled == 1 and mit.n_unknown == 0
    assert apache.n_unruled == 0 and apache.n_unknown == 0
    assert denied.n_unknown == 1 and denied.sentence_ids == ""
    assert gap.n_unruled == 1  # the copyright notice


def test_rules_name_known_sentences():
    used = {i for _, ids in licences.RULES for i in ids}
    assert used <= set(licences.KNOWN.values()) and set(licences.KNOWN.values()) - used <= {"Copyright"}


@pytest.mark.parametrize("sentence", sorted(licences.SENTENCES))
def test_known_sentences_are_templates(sentence):
    assert sentence == " ".join(sentence.split()) and sentence == sentence.lower()
