"""Texts of well-known licences and notices, by SPDX id; the long ones are files in ``license_files``."""

from pathlib import Path

_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_SHORT = (
    ("MIT", _GRANT),
    ("MIT", "MIT License\n\n" + _GRANT),
    ("MIT", "The MIT License (MIT)\n\n" + _GRANT),
    ("MIT", "The MIT License\n\n" + _GRANT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("ISC", "The ISC License\n\n" + _ISC),
    ("BSD-2-Clause", "\n\n".join((_BSD_HEAD, _BSD_1, _BSD_2, _BSD_END))),
    ("BSD-2-Clause", "\n\n".join(("BSD 2-Clause License", _BSD_HEAD, _BSD_1, _BSD_2, _BSD_END))),
    ("BSD-3-Clause", "\n\n".join((_BSD_HEAD, _BSD_1, _BSD_2, _BSD_3, _BSD_END))),
    ("BSD-3-Clause", "\n\n".join(("BSD 3-Clause License", _BSD_HEAD, _BSD_1, _BSD_2, _BSD_3, _BSD_END))),
    ("BSD-3-Clause", "\n\n".join(("The BSD 3-Clause License", _BSD_HEAD, _BSD_1, _BSD_2, _BSD_3, _BSD_END))),
    ("notice:MIT", "Released under the MIT License."),
    ("notice:Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("notice:GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("notice:CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)

#: Where a text's instructions begin, which copies of it may lack; in each text the first that occurs.
_ENDS = ("END OF TERMS AND CONDITIONS", "Exhibit A - Source Code Form License Notice", "=======================================================================\n\nCreative Commons is not a party", "For more information, please refer to")
#: Headings that copies of a text may lack.
_HEADS = ("zlib License", "Zero-Clause BSD", "Boost Software License - Version 1.0 - August 17th, 2003", "Attribution-ShareAlike 4.0 International", "Creative Commons Legal Code")


def _forms(text: str) -> list[str]:
    """A text as it is, without its heading, and each of these without its instructions."""
    out = [text]
    for h in _HEADS:
        if text.startswith(h):
            out.append(text[len(h) :])
    for end in _ENDS:
        if end in text:
            keep = end if end.isupper() else ""
            return [*out, *(t[: t.index(end)] + keep for t in out)]
    return out


def known() -> list[tuple[str, str]]:
    """(license_id, text) of every form of every known text, read on the driver."""
    files = sorted((Path(__file__).parent / "license_files").glob("*.txt"))
    return [*_SHORT, *((f.stem, t) for f in files for t in _forms(f.read_text(encoding="utf-8")))]


KNOWN = known()
