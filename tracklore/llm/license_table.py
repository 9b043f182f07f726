"""Known licence sentences and the ordered rules made of them: fixed values."""

from __future__ import annotations

# Sentences of public licences and of their usual notices, by identifier.
SENTENCES = {
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-limits": "See the License for the specific language governing permissions and limitations under the License.",
    "gnu-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gnu-library-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gnu-fitness": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense-header": "This is free and unencumbered software released into the public domain.",
    "unlicense-grant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "cc0-waiver": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "rights-reserved": "All rights reserved.",
}

# A licence's family, and the names that notices call it by.
LICENCES = {
    "Apache-2.0": ("permissive", ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"]),
    "MIT": ("permissive", ["MIT License", "MIT"]),
    "BSD-2-Clause": ("permissive", ["BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"]),
    "BSD-3-Clause": ("permissive", ["BSD 3-Clause License", "New BSD License", "BSD-3-Clause"]),
    "ISC": ("permissive", ["ISC License", "ISC"]),
    "0BSD": ("permissive", ["0BSD"]),
    "Zlib": ("permissive", ["zlib License", "Zlib"]),
    "BSL-1.0": ("permissive", ["Boost Software License, Version 1.0", "BSL-1.0"]),
    "Unlicense": ("public domain", ["Unlicense"]),
    "CC0-1.0": ("public domain", ["CC0 1.0 Universal", "CC0 1.0", "CC0-1.0"]),
    "CC-BY-4.0": ("permissive", ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY-4.0"]),
    "CC-BY-SA-4.0": ("copyleft", ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"]),
    "CC-BY-NC-4.0": ("non-commercial", ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"]),
    "CC-BY-ND-4.0": ("no derivatives", ["Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0"]),
    "MPL-2.0": ("weak copyleft", ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0"]),
    "GPL-2.0": ("copyleft", ["GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0", "GPL-2.0-only"]),
    "GPL-3.0": ("copyleft", ["GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0", "GPL-3.0-only"]),
    "GPL-2.0-or-later": ("copyleft", ["GPL-2.0-or-later"]),
    "GPL-3.0-or-later": ("copyleft", ["GPL-3.0-or-later"]),
    "LGPL-2.1-or-later": ("weak copyleft", ["LGPL-2.1-or-later"]),
    "LGPL-3.0-or-later": ("weak copyleft", ["LGPL-3.0-or-later"]),
    "AGPL-3.0": ("copyleft", ["GNU Affero General Public License, version 3", "AGPL-3.0"]),
    "AGPL-3.0-or-later": ("copyleft", ["AGPL-3.0-or-later"]),
    "proprietary": ("proprietary", []),
}

# How one-sentence notices begin. Each goes with every name, with and
# without "the".
OPENINGS = [
    "Licensed under",
    "Released under",
    "Distributed under",
    "Published under",
    "Available under",
    "Provided under the terms of",
    "This work is licensed under",
    "This file is licensed under",
    "This project is licensed under",
    "This software is licensed under",
    "This program is licensed under",
    "This document is licensed under",
    "This software is released under",
    "This project is released under",
]

# Licence, kind of work, name of the GNU licence, version and full name of
# the notices that share one form.
GNU = [
    ("GPL-2.0-or-later", "program", "GNU General Public License", "2"),
    ("GPL-3.0-or-later", "program", "GNU General Public License", "3"),
    ("LGPL-2.1-or-later", "library", "GNU Lesser General Public License", "2.1"),
    ("LGPL-3.0-or-later", "library", "GNU Lesser General Public License", "3"),
    ("AGPL-3.0-or-later", "program", "GNU Affero General Public License", "3"),
]

# A licence holds where these sentences follow each other in this order.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("0BSD", ["0bsd-grant", "isc-warranty"]),
    ("Apache-2.0", ["apache-header", "apache-use", "apache-copy", "apache-warranty", "apache-limits"]),
    ("MPL-2.0", ["mpl-header", "mpl-copy"]),
    ("Unlicense", ["unlicense-header", "unlicense-grant"]),
    ("Zlib", ["zlib-warranty", "zlib-liability", "zlib-grant"]),
    ("CC0-1.0", ["cc0-waiver"]),
    ("proprietary", ["rights-reserved"]),
]


def sentence_table() -> list[tuple[str, str]]:
    """(identifier, sentence) of all known sentences; an identifier may have several."""
    table = list(SENTENCES.items())
    for licence, (_, names) in LICENCES.items():
        for name in names:
            table.append((f"notice {licence}", f"SPDX-License-Identifier: {name}"))
            table += [(f"notice {licence}", f"{start} {the}{name}.") for start in OPENINGS for the in ("", "the ")]
    for licence, work, name, version in GNU:
        terms = f"under the terms of the {name} as published by the Free Software Foundation"
        for colon in (";", ":"):
            for either in (", either", "; either"):
                table.append(
                    (
                        f"grant {licence}",
                        f"This {work} is free software{colon} you can redistribute it and/or modify it {terms}{either} "
                        f"version {version} of the License, or (at your option) any later version.",
                    )
                )
        table.append((f"details {name}", f"See the {name} for more details."))
    return table


def rule_table() -> list[tuple[str, list[str]]]:
    """(licence, identifiers in their order) of all rules."""
    rules = list(RULES)
    rules += [(licence, [f"notice {licence}"]) for licence, (_, names) in LICENCES.items() if names]
    for licence, work, name, _ in GNU:
        hope = "gnu-hope" if work == "program" else "gnu-library-hope"
        rules.append((licence, [f"grant {licence}", hope, "gnu-fitness", f"details {name}"]))
    return rules
