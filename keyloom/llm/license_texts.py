"""What headers and licence files say, by SPDX identifier. Short licences are whole (their body from the
title, or the first words, to the end), of long ones there is the title, the start and the notice for source files."""

from __future__ import annotations

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the '
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so"
)
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_NOTICE = "provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_ADS = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED "
    "OF THE POSSIBILITY OF SUCH DAMAGE."
)
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."


def _gnu(name: str, version: str, date: str, start: str) -> tuple[str, ...]:
    """Title and start, and the notice for source files, of a licence of that family."""
    later = "published by the Free Software Foundation, either version {0} of the License, or (at your option) any later version.".format(version)
    without = f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
    notice = f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as {later}"
    return (
        f"This work is licensed under the GNU {name}, version {version}",
        f"GNU {name} Version {version}",
        f"GNU {name} Version {version}, {date} {_VERBATIM}",
        f"GNU {name} Version {version}, {date} {_VERBATIM} {start}",
        notice,
        f"{notice} {without}",
    )


_CC_TITLE = "Creative Commons {0} 4.0 International"


def _cc(short: str, name: str) -> tuple[str, ...]:
    return (
        f"Licensed under CC {short} 4.0",
        f"This work is licensed under a Creative Commons {name} 4.0 International License",
        f"{_CC_TITLE.format(name)} Public License By exercising the Licensed Rights, You accept and agree to be bound by the terms and conditions of this Creative Commons {name} 4.0 International Public License",
    )


TEMPLATES: dict[str, tuple[str, ...]] = {
    "0BSD": (f"{_ISC_GRANT}. {_ISC_END}", "BSD Zero Clause License"),
    "AGPL-3.0": _gnu("Affero General Public License", "3", "19 November 2007", "Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
        'Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, '
        'and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.',
    ),
    "Artistic-2.0": (
        "The Artistic License 2.0",
        "The Artistic License 2.0 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed.",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', f"{_BSD_START} {_BSD_END}", _BSD_START),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', f"{_BSD_START} 3. {_BSD_NAMES} {_BSD_END}", f"{_BSD_START} 3. {_BSD_NAMES}"),
    "BSD-4-Clause": ('BSD 4-Clause "Original" License', f"{_BSD_START} {_BSD_ADS} 4. {_BSD_NAMES} {_BSD_END}"),
    "BSL-1.0": (
        "Boost Software License - Version 1.0 - August 17th, 2003",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
        "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license "
        '(the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so',
    ),
    "CC-BY-4.0": _cc("BY", "Attribution"),
    "CC-BY-NC-4.0": _cc("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-NC-ND-4.0": _cc("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _cc("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-ND-4.0": _cc("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-SA-4.0": _cc("BY-SA", "Attribution-ShareAlike"),
    "CC0-1.0": (
        "Released under CC0 1.0",
        "CC0 1.0 Universal",
        "This work is dedicated to the public domain under CC0 1.0 Universal",
        "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP.",
    ),
    "CDDL-1.0": ("COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License."),
    "EPL-2.0": (
        "Eclipse Public License - v 2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        'Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT\'S ACCEPTANCE OF THIS AGREEMENT.',
    ),
    "EUPL-1.2": ("EUROPEAN UNION PUBLIC LICENCE v. 1.2", "Licensed under the EUPL, Version 1.2", 'This European Union Public Licence (the "EUPL") applies to the Work (as defined below) which is provided under the terms of this Licence.'),
    "GPL-2.0": _gnu("General Public License", "2", "June 1991", "Preamble The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software"),
    "GPL-3.0": _gnu("General Public License", "3", "29 June 2007", "Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    "ISC": ("ISC License", "Licensed under the ISC License", f"{_ISC_GRANT}, {_ISC_NOTICE} {_ISC_END}", f"{_ISC_GRANT}, {_ISC_NOTICE}"),
    "LGPL-2.1": (
        *_gnu("Lesser General Public License", "2.1", "February 1999", "This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1."),
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": _gnu("Lesser General Public License", "3", "29 June 2007", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    "LicenseRef-Proprietary": ("All rights reserved",),
    "MIT": ("Released under the MIT License", "The MIT License", "MIT License", _MIT_GRANT, f"{_MIT_GRANT}, subject to the following conditions: {_MIT_NOTICE}", f"{_MIT_GRANT}, subject to the following conditions: {_MIT_NOTICE} {_AS_IS}"),
    "MIT-0": ("MIT No Attribution", f"{_MIT_GRANT}. {_AS_IS}"),
    "MPL-2.0": (
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.',
    ),
    "OFL-1.1": (
        "This Font Software is licensed under the SIL Open Font License, Version 1.1",
        "SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007",
        "SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007 PREAMBLE The goals of the Open Font License (OFL) are to stimulate worldwide development of collaborative font projects",
    ),
    "PostgreSQL": (
        "The PostgreSQL License",
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
    ),
    "WTFPL": ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", f"DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004 {_VERBATIM}"),
    "Zlib": (
        "zlib License",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
}
