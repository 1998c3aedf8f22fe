"""Notices of the common licences under SPDX names, written from the licences: their names in the usual wordings, the titles
that the long texts open with, the notices that the licences themselves ask for, and the short texts whole.

A notice that names a family without its version stands under the family (``FAMILIES``), which isn't an SPDX name.
"""

from __future__ import annotations

#: How works say that they stand under a licence.
WORDINGS = (
    "Licensed under {}.", "Released under {}.", "Distributed under {}.", "Available under {}.", "Published under {}.",
    "This work is licensed under {}.", "This software is released under {}.", "This project is licensed under the terms of {}.",
    "This program is distributed under {}.", "This file is licensed under {}, see LICENSE for details.", "License: {}",
)
_GNU = {"GPL": ("General Public License", ("1.0", "2.0", "3.0")), "LGPL": ("Lesser General Public License", ("2.1", "3.0")), "AGPL": ("Affero General Public License", ("1.0", "3.0"))}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}

#: Families and the names that they go by without a version.
FAMILIES = {
    "Apache": ("the Apache License",),
    "BSD": ("the BSD License",),
    "Artistic": ("the Artistic License",),
    "MPL": ("the Mozilla Public License",),
    "EPL": ("the Eclipse Public License",),
    "CDDL": ("the Common Development and Distribution License",),
    "EUPL": ("the European Union Public Licence",),
    "GFDL": ("the GNU Free Documentation License",),
    "CC": ("a Creative Commons License",),
    **{k: (f"the GNU {name}", f"the GNU {k}", f"the {k}", f"the {k} license") for k, (name, _) in _GNU.items()},
    **{f"CC-{k}": (f"CC {k}", f"a Creative Commons {name} License") for k, name in _CC.items()},
}

_NAMES = {
    "0BSD": ("the Zero-Clause BSD License", "the BSD Zero Clause License", "the 0BSD License"),
    "Apache-1.1": ("the Apache Software License, Version 1.1", "the Apache License 1.1"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License v2", "the Apache License 2.0", "Apache-2.0"),
    "Artistic-1.0": ("the Artistic License 1.0",),
    "Artistic-2.0": ("the Artistic License 2.0",),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the Simplified BSD License", "the two-clause BSD License", "the FreeBSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the New BSD License", "the Modified BSD License", "the Revised BSD License", "the three-clause BSD License"),
    "BSD-4-Clause": ("the BSD 4-Clause License", "the Original BSD License"),
    "BSL-1.0": ("the Boost Software License, Version 1.0", "the Boost License"),
    "CC0-1.0": ("CC0 1.0", "the Creative Commons Zero License", "the Creative Commons CC0 1.0 Universal Public Domain Dedication"),
    "CDDL-1.0": ("the Common Development and Distribution License, Version 1.0", "the CDDL 1.0"),
    "CDDL-1.1": ("the Common Development and Distribution License, Version 1.1", "the CDDL 1.1"),
    "ISC": ("the ISC License",),
    "LGPL-2.0": ("the GNU Library General Public License, version 2", "the GNU Library General Public License", "the LGPL v2"),
    "MIT": ("the MIT License", "the Expat License"),
    "MS-PL": ("the Microsoft Public License",),
    "OFL-1.1": ("the SIL Open Font License, Version 1.1", "the SIL Open Font License"),
    "ODbL-1.0": ("the Open Database License", "the Open Data Commons Open Database License v1.0"),
    "PSF-2.0": ("the Python Software Foundation License Version 2", "the PSF License"),
    "Unlicense": ("the Unlicense",),
    "WTFPL": ("the WTFPL", "the Do What The Fuck You Want To Public License"),
    "X11": ("the X11 License",),
    "Zlib": ("the zlib License", "the zlib/libpng License"),
}
for _k, _long, _versions in (("MPL", "Mozilla Public License", ("1.1", "2.0")), ("EPL", "Eclipse Public License", ("1.0", "2.0")), ("EUPL", "European Union Public Licence", ("1.1", "1.2")), ("GFDL", "GNU Free Documentation License", ("1.1", "1.2", "1.3"))):
    _NAMES |= {f"{_k}-{v}": (f"the {_long}, version {v}", f"{_k} {v}") for v in _versions}
for _k, (_long, _versions) in _GNU.items():
    for _v in _versions:
        _s = _v.removesuffix(".0")
        _NAMES[f"{_k}-{_v}"] = (f"the GNU {_long}, version {_s}", f"the GNU {_long} v{_v}", f"the GNU {_k} v{_s}", f"the {_k} v{_v}", f"the {_k} v{_s}", f"the {_k}, version {_s}", f"the {_k}v{_s}", f"{_k} {_v}")
for _k, _long in _CC.items():
    for _v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        _kind = "International" if _v == "4.0" else "Unported" if _v == "3.0" else "Generic"
        _NAMES[f"CC-{_k}-{_v}"] = (f"CC {_k} {_v}", f"a Creative Commons {_long} {_v} {_kind} License", f"the Creative Commons {_long} {_v} License")

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
_MIT_REST = ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
_MIT_END = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_1 = ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_AD = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. "
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_IF = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_APACHE = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_UNLICENSE = "This is free and unencumbered software released into the public domain."

#: Notices that licences ask for, their short texts whole, and the titles of long texts.
_TEXTS = [
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", _APACHE + " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", _MIT), ("MIT", "The MIT License"), ("MIT", "Released under the MIT License."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("MIT", _MIT + _MIT_REST + _AS_IS + _MIT_END),
    ("X11", _MIT + _MIT_REST + _AS_IS + _MIT_END + " Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium."),
    ("BSD", _BSD),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", _BSD + _BSD_1 + _BSD_2 + _BSD_END), ("BSD-3-Clause", _BSD + _BSD_1 + _BSD_2 + "3. " + _BSD_3 + _BSD_END), ("BSD-4-Clause", _BSD + _BSD_1 + _BSD_2 + _BSD_AD + "4. " + _BSD_3 + _BSD_END),
    ("Artistic", "The Artistic License Preamble"), ("Artistic-2.0", "The Artistic License 2.0"),
    ("0BSD", _ISC + "."), ("0BSD", _ISC + "." + _ISC_END), ("ISC", _ISC + _ISC_IF), ("ISC", _ISC + _ISC_IF + _ISC_END),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("Unlicense", _UNLICENSE), ("Unlicense", _UNLICENSE + " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"), ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"), ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"), ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GFDL-1.1", "GNU Free Documentation License Version 1.1, March 2000"), ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"), ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1"), ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-1.0", "Eclipse Public License - v 1.0"), ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CDDL-1.0", "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0"), ("CDDL-1.1", "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.1"),
    ("OFL-1.1", "SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007"),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at http://scripts.sil.org/OFL"),
]
_NOTICE = "{} is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License"
for _k, _long, _v, _s in (("GPL-1.0", "General Public License", "1", "This program"), ("GPL-2.0", "General Public License", "2", "This program"), ("GPL-3.0", "General Public License", "3", "This program"), ("LGPL-2.0", "Library General Public License", "2", "This library"), ("LGPL-2.1", "Lesser General Public License", "2.1", "This library"), ("LGPL-3.0", "Lesser General Public License", "3", "This library"), ("AGPL-3.0", "Affero General Public License", "3", "This program")):
    _said = _NOTICE.format(_s, _long, _v)
    _TEXTS += [(_k, _said), (_k, _said + ", or (at your option) any later version."), (_k, _said.replace("either version", "version") + ".")]

_NAMED = [(k, n) for k, names in (_NAMES | FAMILIES).items() for n in names]
#: (name, text): the texts, and every name of a licence in one of the wordings.
TEMPLATES = tuple(sorted({*_TEXTS, *((k, WORDINGS[i % len(WORDINGS)].format(n)) for i, (k, n) in enumerate(_NAMED)), ("MIT", "SPDX-License-Identifier: MIT")}))
#: (name, text): every name in all other wordings, alone and as an SPDX tag.
VARIANTS = tuple(sorted({*((k, w.format(n)) for k, n in _NAMED for w in WORDINGS), *((k, n.removeprefix("the ")) for k, n in _NAMED if k in _NAMES), *((k, f"SPDX-License-Identifier: {k}{end}") for k in _NAMES for end in (("", "-only", "-or-later") if k.split("-")[0] in _GNU else ("",)))} - {*TEMPLATES}))
#: Wordings without a name: a line closer to them names no licence that a template holds, and so says nothing.
NAMELESS = tuple(w.format(n) for n in ("the License", "a License", "the Public License", "the Software License", "this License, Version 2.0") for w in WORDINGS) + ("SPDX-License-Identifier:",)
#: A reservation, which counts where no licence is found.
RESERVED = (("LicenseRef-All-Rights-Reserved", "All rights reserved."),)
