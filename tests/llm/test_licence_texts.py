"""Licence notices as they are in their original texts: wrapped, reflowed on one line and behind comment marks."""

import pytest

from segmill.llm import licenses

GPL = """This program is free software{mark} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version {version} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
LESSER = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software."""
MIT_WARRANTY = """

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD_WARRANTY = """

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""
#: Beginnings of whole licence texts.
WHOLE = [
    ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n"),
    ("GPL-3.0-only", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n\n  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n"),
    ("GPL-2.0-only", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n                            Preamble\n\n  The licenses for most software are designed to take away your\nfreedom to share and change it.  By contrast,\n"),
    ("LGPL-2.1-only", "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\n                            Preamble\n\n  The licenses for most software are designed to take away your\nfreedom to share and change it.  By contrast,\n"),
    ("AGPL-3.0-only", "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n                            Preamble\n\n  The GNU Affero General Public License is a free, copyleft license for\nsoftware and other kinds of works, specifically designed to ensure\ncooperation with the community in the case of network server software.\n"),
]
CC = "This work is licensed under a Creative Commons\nAttribution{more} 4.0 International License."
NOTICES = [
    ("GPL-3.0-or-later", GPL.format(mark=":", version=3)), ("GPL-3.0-or-later", GPL.format(mark=";", version=3)),
    ("GPL-2.0-or-later", GPL.format(mark=";", version=2)), ("GPL-2.0-or-later", GPL.format(mark=":", version=2)),
    ("Apache-2.0", APACHE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("MIT", "MIT License\n\n" + MIT), ("MIT", MIT),
    ("BSD-2-Clause", BSD2), ("BSD-3-Clause", BSD3), ("ISC", ISC), ("MPL-2.0", MPL),
    ("CC-BY-4.0", CC.format(more="")), ("CC-BY-NC-4.0", CC.format(more="-NonCommercial")), ("CC-BY-SA-4.0", CC.format(more="-ShareAlike")),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright\nand related or neighboring rights to this work."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "Licensed under the GNU General Public License version 3."),
    ("GPL-2.0-only", "Licensed under the GNU General Public License version 2."), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT license."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *[(name, f"SPDX-License-Identifier: {name}") for name in licenses.TAGS],
    ("LGPL-2.1-or-later", LESSER), ("LGPL-2.1-or-later", LESSER.split("\n\n")[0]), ("AGPL-3.0-or-later", GPL.format(mark=":", version=3).replace("GNU General", "GNU Affero General")), ("LGPL-3.0-or-later", GPL.format(mark=":", version=3).replace("GNU General", "GNU Lesser General")),
    ("EPL-2.0", "This program and the accompanying materials are made available under\nthe terms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/"), ("Zlib", ZLIB),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials\nare made available under the terms of the Eclipse Public License v1.0\nwhich accompanies this distribution, and is available at\nhttp://www.eclipse.org/legal/epl-v10.html"),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2 or – as soon they will be approved by\nthe European Commission - subsequent versions of the EUPL (the \"Licence\");\nYou may not use this work except in compliance with the Licence."), ("EUPL-1.2", "Licensed under the EUPL, Version 1.2."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."), ("Artistic-2.0", "Licensed under the Artistic License 2.0."),
    ("Artistic-2.0", "(1)  You are permitted to use the Standard Version and create and use\nModified Versions for any purpose without restriction, provided that\nyou do not Distribute the Modified Version."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted."), ("CC-BY-NC-SA-4.0", CC.format(more="-NonCommercial-ShareAlike")), ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("MIT", MIT + MIT_WARRANTY), ("MIT-0", MIT.split(", subject")[0] + "." + MIT_WARRANTY), ("BSD-2-Clause", BSD2 + BSD_WARRANTY), ("BSD-3-Clause", BSD3 + BSD_WARRANTY),
]
HOLDER = "Copyright 2020 The Authors\n\n"
#: Notices that the fixed table opens with, so that a line of copyright may stand before them without a full stop.
OPENED = (LESSER[:20], GPL[:20], APACHE[:20], MIT[:20], BSD2[:20], ISC[:20])


def commented(text, mark):
    return "\n".join(f"{mark} {line}".rstrip() for line in text.split("\n"))


def ways(text):
    yield from (text, " ".join(text.split()), *(commented(text, m) for m in ("#", "//", " *")), "/* " + text + " */")
    if text.startswith(OPENED):
        yield from (HOLDER + text, commented(HOLDER + text, "#"), " ".join((HOLDER + text).split()))


def test_whole_texts(spark):
    rows = [(k, text) for k, (_, text) in enumerate(WHOLE)]
    got = {r["doc_id"]: r["licences"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: [name] for k, (name, _) in enumerate(WHOLE)}


def test_original_notices(spark):
    rows = [(k, t, name) for k, (name, t) in enumerate((name, way) for name, text in NOTICES for way in ways(text))]
    got = {r["doc_id"]: r["licences"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, name string").select("doc_id", "text")).collect()}
    assert [(t, got[k]) for k, t, name in rows if got[k] != [name]] == []


@pytest.mark.parametrize("text", ["SPDX-License-Identifier: BSD-4-Clause\n\nMIT", "SPDX-License-Identifier: MIT OR Apache-2.0", "It is free software: you can copy it.", "A file; you may not use this file except on Mondays."])
def test_no_notice(spark, text):
    assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["licences"] == []
