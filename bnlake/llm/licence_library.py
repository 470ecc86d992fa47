"""Templates of the licence scan: (licence, text), several of each licence.

``licence_texts`` holds the public full texts, without their copyright lines;
below are the usual short statements, SPDX tags and multi-line file headers.
"""

from __future__ import annotations

from functools import lru_cache
from importlib import resources

# Licences by their SPDX name, and the names they go by in statements.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "MIT": ("MIT License",),
    "ISC": ("ISC License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "MPL-1.1": ("Mozilla Public License, version 1.1",),
    "MPL-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License 2.0"),
    "GPL-1.0": ("GNU General Public License, version 1",),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPLv3"),
    "LGPL-2.0": ("GNU Library General Public License, version 2",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPLv3"),
    "EPL-2.0": ("Eclipse Public License 2.0",),
    "BSL-1.0": ("Boost Software License, Version 1.0",),
    "Zlib": ("zlib License",),
    "Unlicense": ("Unlicense",),
    "NCSA": ("University of Illinois NCSA Open Source License",),
    "OFL-1.1": ("SIL Open Font License, Version 1.1",),
    "GFDL-1.2": ("GNU Free Documentation License, Version 1.2",),
    "GFDL-1.3": ("GNU Free Documentation License, Version 1.3",),
    "CC0-1.0": ("CC0 1.0", "Creative Commons Zero v1.0 Universal"),
}
STATEMENTS = ("Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.")
CC_KINDS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
            "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
GNU_VERSIONS = (("GPL", "2"), ("GPL", "3"), ("LGPL", "2.1"), ("LGPL", "3"), ("AGPL", "3"))
GNU_HEADER = """This program is free software{s} you can redistribute it and/or modify it under the terms of the {name} as published by
the Free Software Foundation{v}

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.

You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""
HEADERS = (
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""),
    ("Apache-2.0", """Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file
distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache
License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
)


def _short() -> list[tuple[str, str]]:
    out = [(licence, s.format(name)) for licence, names in NAMES.items() for name in names for s in STATEMENTS]
    out += [(licence, f"SPDX-License-Identifier: {licence}") for licence in NAMES]
    for licence in ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"):
        out += [(licence, f"SPDX-License-Identifier: {licence}-{how}") for how in ("only", "or-later")]
    for kind, words in CC_KINDS.items():
        for version, port in CC_VERSIONS.items():
            licence = f"CC-{kind}-{version}"
            out += [(licence, f"Licensed under CC {kind} {version}."), (licence, f"SPDX-License-Identifier: {licence}"),
                    (licence, f"This work is licensed under a Creative Commons {words} {version} {port} License.")]
    return out


def _gnu_headers() -> list[tuple[str, str]]:
    out = []
    for short, version in GNU_VERSIONS:
        licence = f"{short}-{version if '.' in version else version + '.0'}"
        for said in (f", either version {version} of the License, or (at your option) any later version.", f", version {version} of the License."):
            out.append((licence, GNU_HEADER.format(s=":", name=GNU[short], v=said)))
    return out


@lru_cache(maxsize=1)
def full_texts() -> tuple[tuple[str, str], ...]:
    folder = resources.files("bnlake.llm") / "licence_texts"
    files = sorted((f for f in folder.iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return tuple((f.name[:-4], f.read_text(encoding="utf-8")) for f in files)


def library(statements: tuple[tuple[str, str], ...]) -> tuple[tuple[str, str], ...]:
    """The given statements, the usual short forms and headers, and the full texts."""
    return (*statements, *_short(), *HEADERS, *_gnu_headers(), *full_texts())
