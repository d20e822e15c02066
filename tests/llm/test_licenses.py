"""Notices of licences that are easily taken for each other."""

import pytest

from lineloom.llm import license_scan

GNU = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU {}General Public License as\npublished by the Free Software Foundation, either version {} of the\nLicense, or (at your option) any later version."
BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice.\n\n2. Redistributions in binary form must reproduce the above copyright notice.\n\n{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"."
NOTICES = {
    "AGPL-3.0": [GNU.format("Affero ", "3"), "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n\nCopyright (C) 2007 Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "GPL-3.0": [GNU.format("", "3"), "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "SPDX-License-Identifier: GPL-3.0-only"],
    "GPL-2.0": [GNU.format("", "2").replace("software:", "software;"), "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n", "// SPDX-License-Identifier: GPL-2.0+"],
    "LGPL-2.1": [GNU.format("Lesser ", "2.1").replace("program", "library"), "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "LGPL-3.0": [GNU.format("Lesser ", "3").replace("program", "library"), "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"],
    "BSD-2-Clause": ["BSD 2-Clause License\n\n" + BSD.format(""), BSD.format(""), "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License\n\n" + BSD.format("3. Neither the name of the copyright holder nor the names of its contributors may be used.\n\n"), BSD.format("Neither the name of the holder may be used to endorse products.\n\n"), "Licensed under the BSD 3-Clause License."],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal", "SPDX-License-Identifier: MIT", "Released under the MIT License."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC"],
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.', "Apache License\nVersion 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.", "Mozilla Public License Version 2.0"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-3.0": ["This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "Licensed under CC BY 3.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
}
BODY = "\n\nint main() {\n    return other_things(1, 2, 3);\n}\n" + "words of a long file that follow it and say other things\n" * 30


@pytest.mark.parametrize(("licence", "notice"), [(k, n) for k, ns in NOTICES.items() for n in ns])
def test_the_right_licence_plain_in_comments_and_before_a_body(licence, notice):
    scanner = license_scan.Scanner()
    comment = "\n".join(" * " + line for line in notice.split("\n"))
    hashes = "\n".join("# " + line for line in notice.split("\n"))
    for text in (notice, notice + BODY, "/*\n" + comment + "\n */" + BODY, hashes + BODY):
        assert scanner.scan(text)[0] == licence, text[:200]


@pytest.mark.parametrize("text", ["This project is not licensed under the terms of the MIT license.", "It is no longer released under the MIT License.", "This work is not licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: Own-1.0", "This work is licensed under the GNU General Public License, version 7."])
def test_no_licence(text):
    assert license_scan.Scanner().scan(text)[0] is None
