"""Licence templates: identifier to notices. The wording is that
of the licences and of the notices in common use."""

TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy
        of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
        WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
        FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
        TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
        THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not
        use this file except in compliance with the License. You may obtain a copy of
        the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License
        is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
        KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under
        the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details. You should have received a copy of the GNU General Public License
        along with this program. If not, see https://www.gnu.org/licenses/.""",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        """This work is licensed under a Creative Commons Attribution-NonCommercial 4.0
        International License.""",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        """This work is licensed under a Creative Commons Attribution-ShareAlike 4.0
        International License.""",
    ],
    "BSD-2-Clause": [
        """Redistribution and use in source and binary forms, with or without
        modification, are permitted provided that the following conditions are met:
        Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. Redistributions in binary
        form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided
        with the distribution.""",
    ],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any
        purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies.""",
    ],
    "Unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone
        is free to copy, modify, publish, use, compile, sell, or distribute this
        software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means.""",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
    ],
}


_BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. 2. Redistributions in binary
form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with
the distribution."""
_BSD_3 = """ 3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this
software without specific prior written permission."""
_BSD_END = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS
IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS
OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN
IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _add(identifier: str, *notices: str) -> None:
    held = TEMPLATES.setdefault(identifier, [])
    held += [n for n in notices if n not in held]


def _short(identifier: str, name: str, tags=("",)) -> None:
    """The usual one-line notices of a licence, and its SPDX tags."""
    starts = ("Released under the", "Licensed under the", "This project is licensed under the", "This work is licensed under the")
    _add(identifier, *[f"{start} {name}." for start in starts], *[f"SPDX-License-Identifier: {identifier}{t}" for t in tags])


def _gnu(identifier: str, kind: str, version: str) -> None:
    """The file notices of the GNU licences, of one version or of later ones too."""
    either = f"either version {version} of the License, or (at your option) any later version."
    for which in (either, f"version {version} of the License."):
        start = f"""you can redistribute it and/or modify it under the terms of the GNU {kind} as
        published by the Free Software Foundation; {which} This program is distributed in the hope that
        it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more
        details. You should have received a copy of the GNU {kind} along with this program"""
        _add(
            identifier, f"This program is free software: {start}. If not, see https://www.gnu.org/licenses/.",
            f"This program is free software; {start}; if not, write to the Free Software Foundation, Inc., 51 Franklin"
            " Street, Fifth Floor, Boston, MA 02110-1301 USA.",
        )


_short("MIT", "MIT License")
_short("Apache-2.0", "Apache License, Version 2.0")
_short("BSD-2-Clause", "BSD 2-Clause License")
_short("BSD-3-Clause", "BSD 3-Clause License")
_short("ISC", "ISC License")
_short("Unlicense", "Unlicense")
_short("MPL-1.1", "Mozilla Public License, version 1.1")
_short("MPL-2.0", "Mozilla Public License, version 2.0")
for _family, _kind, _versions in (
    ("GPL", "General Public License", ("1.0", "2.0", "3.0")), ("AGPL", "Affero General Public License", ("3.0",)),
    ("LGPL", "Lesser General Public License", ("2.1", "3.0")), ("LGPL", "Library General Public License", ("2.0",)),
):
    _short(_family, f"GNU {_kind}")  # of no stated version
    for _version in _versions:
        _written = _version.removesuffix(".0")
        for _form in (_written, _version) if _written != _version else (_version,):
            for _later in ("", " or later", ", or any later version"):
                _short(f"{_family}-{_version}", f"GNU {_kind}, version {_form}{_later}", ("", "-only", "-or-later", "+"))
        _gnu(f"{_family}-{_version}", _kind, _written)
for _code, _long in (
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
    ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
):
    for _version, _kind in (("4.0", "International"), ("3.0", "Unported")):
        _add(
            f"CC-{_code}-{_version}", f"Licensed under CC {_code} {_version}.",
            f"This work is licensed under a Creative Commons {_long} {_version} {_kind} License.",
            f"This work is licensed under CC {_code} {_version}.", f"SPDX-License-Identifier: CC-{_code}-{_version}",
        )
_add("BSD-2-Clause", _BSD, _BSD + _BSD_END)
_add("BSD-3-Clause", _BSD + _BSD_3, _BSD + _BSD_3 + _BSD_END)
_add("ISC", TEMPLATES["ISC"][0] + """ THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA
OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""")
_add("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
If a copy of the MPL was not distributed with this file, You can obtain one at
https://mozilla.org/MPL/2.0/.""")
_add("CC0-1.0", "SPDX-License-Identifier: CC0-1.0", "This work is dedicated to the public domain under CC0 1.0.",
     "Licensed under CC0 1.0.", "This work is licensed under CC0 1.0 Universal.", """To the extent possible under law, the
author(s) have dedicated all copyright and related and neighboring rights to this
software to the public domain worldwide. This software is distributed without any
warranty. You should have received a copy of the CC0 Public Domain Dedication along
with this software. If not, see http://creativecommons.org/publicdomain/zero/1.0/.""")
