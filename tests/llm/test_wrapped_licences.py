"""Licence sentences that are wrapped, or cut at an abbreviation."""

import pytest

from lorekeep.llm import licences

BSD3 = """Copyright (c) 1994, 2008 Google Inc. All rights reserved.
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
3. Neither the name of Google Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.

You should have received a copy of the GNU General Public License
along with this program.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""


@pytest.mark.parametrize("mark", ["", "// ", " * "])
def test_wrapped_texts_are_whole(mark):
    rec = licences.Recogniser()
    for text, want, ids in (
        (BSD3, "BSD-3-Clause", ["BsdRedistribution", "BsdSource", "BsdBinary", "BsdEndorse", "BsdWarranty"]),
        (GPL, "GPL-3.0-or-later", ["GplFree", "GplHope", "GplReceived"]),
        (APACHE, "Apache-2.0", ["ApacheReference", "ApacheMayNot", "ApacheObtain", "ApacheBasis", "ApacheSee"]),
    ):
        for lines in (text.splitlines(), " ".join(text.split()).replace(" ", "\n").splitlines()):
            seq, found = rec.scan("\n".join(mark + x for x in lines))
            assert [f[0] for f in found] == [want]
            assert [x for x in seq if x not in licences.BETWEEN] == ids


def test_gap_ends_before_another_statement():
    rec = licences.Recogniser()
    opened = "Neither the name of the rose\nwas known to him.\n"
    assert [f[0] for f in rec.scan(opened + GPL + BSD3)[1]] == ["GPL-3.0-or-later", "BSD-3-Clause"]
    assert rec.scan(opened * 3000 + "No word of this is reserved.")[1] == []
    long_name = "Neither the name of " + "Anna, Bert, Carl, Dora, " * 300 + "\n" * 3 + "nor the names of its contributors may be used to endorse or promote products"
    assert rec.scan(long_name)[0] == ["BsdEndorse"]
