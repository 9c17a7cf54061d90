"""License templates as data: (label, text). The texts are public ones, without their title and copyright lines."""

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above "
    "copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(what: str, kind: str) -> str:
    return (
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License as published by the Free Software Foundation, either version 3 of the "
        f"License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR "
        f"A PARTICULAR PURPOSE. See the GNU {kind} General Public License for more details. You should have received a copy of the GNU {kind} General Public License along with this {what}. If not, see "
        "https://www.gnu.org/licenses/"
    )


#: Bodies and long notices, compared as sets of words.
BODIES: tuple[tuple[str, str], ...] = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject "
        "to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY,
    ),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("gpl", _gnu("program", "")),
    ("lgpl", _gnu("library", "Lesser")),
    ("agpl", _gnu("program", "Affero")),
    ("bsd-2-clause", _BSD_START + _BSD_END),
    ("bsd-3-clause", _BSD_START + _BSD_NAME + _BSD_END),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all "
        'copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE '
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
        "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone "
        "to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice "
        "may not be removed or altered from any source distribution.",
    ),
    (
        "boost",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, "
        "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    ),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights"),
)

_CC = (
    ("cc-by", "", "Attribution"), ("cc-by-sa", "SA", "Attribution ShareAlike"), ("cc-by-nc", "NC", "Attribution NonCommercial"), ("cc-by-nd", "ND", "Attribution NoDerivatives"),
    ("cc-by-nc-sa", "NC SA", "Attribution NonCommercial ShareAlike"), ("cc-by-nc-nd", "NC ND", "Attribution NonCommercial NoDerivatives"),
)

#: Short notices: all their words, in this order, with few words between them and none that would name another license.
NOTICES: tuple[tuple[str, str], ...] = (
    ("mit", "under the MIT License"),
    ("mit", "SPDX License Identifier MIT"),
    ("apache", "under the Apache License"),
    ("apache", "SPDX License Identifier Apache 2.0"),
    ("gpl", "under the GNU General Public License"),
    ("gpl", "GNU GPL"),
    ("gpl", "SPDX License Identifier GPL"),
    ("lgpl", "GNU Lesser General Public License"),
    ("lgpl", "GNU LGPL"),
    ("agpl", "GNU Affero General Public License"),
    ("agpl", "GNU AGPL"),
    ("bsd-2-clause", "BSD 2 Clause License"),
    ("bsd-3-clause", "BSD 3 Clause License"),
    ("bsd", "under the BSD License"),
    ("isc", "under the ISC License"),
    ("mpl", "under the Mozilla Public License"),
    ("epl", "under the Eclipse Public License"),
    ("boost", "Boost Software License"),
    ("cc0", "CC0 1.0"),
    ("cc0", "Creative Commons Zero"),
    ("public-domain", "released into the public domain"),
    *((label, f"CC BY {code} {version}") for label, code, _ in _CC for version in ("2.0", "2.5", "3.0", "4.0")),
    *((label, f"Creative Commons {name} {version}") for label, _, name in _CC for version in ("2.0", "2.5", "3.0", "4.0")),
    ("gfdl", "GNU Free Documentation License"),
    ("proprietary", "All rights reserved"),
)

#: Words that make another license of a notice, so they may not stand between its words.
OTHERWISE = frozenset(b"nc nd sa noncommercial non noderivatives no sharealike share lesser library affero free documentation not isn wasn t never without".split())

#: Words that a block must hold to count for the label, as the rest may be shared with another license.
MUST = {"lgpl": {b"lesser"}, "agpl": {b"affero"}, "bsd-3-clause": {b"endorse", b"promote"}, "boost": {b"reproduce", b"execute"}, "isc": {b"fee"}}

#: A found label hides these where their places overlap, as it is the more specific one.
HIDES = {
    "lgpl": {"gpl"}, "agpl": {"gpl"}, "gfdl": {"gpl"}, "bsd-3-clause": {"bsd-2-clause", "bsd"}, "bsd-2-clause": {"bsd"}, "cc-by-sa": {"cc-by"}, "cc-by-nc": {"cc-by"}, "cc-by-nd": {"cc-by"},
    "cc-by-nc-sa": {"cc-by", "cc-by-nc", "cc-by-sa"}, "cc-by-nc-nd": {"cc-by", "cc-by-nc", "cc-by-nd"}, "unlicense": {"public-domain"}, "cc0": {"public-domain"},
}
