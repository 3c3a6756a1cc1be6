"""Known licences.  FIXED VALUES: the public texts of short licences and the
names under which notices give the others."""

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted"""

ISC_TERMS = """, provided that the above copyright notice and this permission notice appear in all copies."""

ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

TEXTS = {
    "MIT": MIT,
    "MIT with title": "MIT License\n\n" + MIT,
    "ISC": ISC_GRANT + ISC_TERMS + "\n\n" + ISC_WARRANTY,
    "ISC with title": "ISC License\n\n" + ISC_GRANT + ISC_TERMS + "\n\n" + ISC_WARRANTY,
    "0BSD": ISC_GRANT + ".\n\n" + ISC_WARRANTY,
    "Zlib": ZLIB,
}

_BSD_CLAUSES = ["""Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer.""", """Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
                """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""]

_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _bsd(clauses: int, mark: str) -> str:
    listed = [f"{mark.format(k + 1)} {c}" for k, c in enumerate(_BSD_CLAUSES[:clauses])]
    return "\n\n".join(["""Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:""", *listed, _BSD_WARRANTY])


# Whole texts which are looked up without regard to their line breaks, besides TEXTS: (identifier, title, text).
MORE_TEXTS = [(f"BSD-{n}-Clause", f"BSD {n}-Clause License", _bsd(n, mark)) for n in (2, 3) for mark in ("{}.", "*")]
MORE_TEXTS += [("0BSD", "Zero-Clause BSD", TEXTS["0BSD"]), ("0BSD", "BSD Zero Clause License", TEXTS["0BSD"]),
               ("MIT", "The MIT License", MIT), ("MIT", "The MIT License (MIT)", MIT), ("Zlib", "zlib License", ZLIB)]

# Names in notices, by SPDX identifier.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "MIT": ["MIT License", "MIT"],
    "ISC": ["ISC License", "ISC"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "MPL-2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPL-3.0"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0"],
    "CC0-1.0": ["CC0 1.0", "CC0-1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "CC-BY-4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "CC-BY-NC-4.0"],
    "Unlicense": ["Unlicense"],
}

NOTICES = ["Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}",
           "This work is licensed under {}", "This work is licensed under the {}", "Distributed under the {}",
           "SPDX-License-Identifier: {}"]

# Spellings that count as the same, as word endings (pattern, replacement).
SPELLINGS = [
    (r"licenc(e|es|ed|ing|ee|or)([ \n]|$)", r"licens\1\2"),
    (r"is(e|ed|es|ing|ation|ations)([ \n]|$)", r"iz\1\2"),
    (r"our(|s|ed|able|ably)([ \n]|$)", r"or\1\2"),
    (r"dgement(|s)([ \n]|$)", r"dgment\1\2"),
    (r"ogue(|s)([ \n]|$)", r"og\1\2"),
    (r"tre(|s)([ \n]|$)", r"ter\1\2"),
]
