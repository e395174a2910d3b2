"""Notices as they are met in files, none of them a template, with their family; and text that has licence words but no licence."""

NOTICES = [
    ("mit", "Copyright (c) 2019 Jane Doe. This package is open source under the MIT license"),
    ("mit", "MIT licensed. See the file COPYING."),
    ("mit", "Die Software steht unter der MIT-Lizenz, siehe MIT License in der Datei LICENSE."),
    ("mit", "# Permission is hereby granted, free of charge, to any person obtaining a\n# copy of this software and associated documentation files, to deal in\n# the Software without restriction, including without limitation the rights to use"),
    ("mit", "The above copyright notice and this permission notice shall be\nincluded in all copies or substantial portions of the Software."),
    ("apache", "This library is licensed under the Apache 2.0 License."),
    ("apache", "Code: Apache-2.0"),
    ("apache", "Licensed to the Foundation under one or more agreements, under the Apache License, Version 2.0 (the License)"),
    ("apache", "// you may not use this file except in compliance with the License.\n// You may obtain a copy of the License at\n//     http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "Distributed under GPLv3 or later."),
    ("gpl", " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version."),
    ("gpl", "You should have received a copy of the GNU General Public License\nalong with this program.  If not, see <https://www.gnu.org/licenses/>."),
    ("gpl", "The plugin is released under the GPL version 2, like the host program itself."),
    ("gpl", "licensed under GNU General Public License v2"),
    ("lgpl", "The core library may be linked freely; it is under the GNU Lesser General Public License."),
    ("lgpl", "# SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("lgpl", "Bindings are available under LGPL v2.1 only"),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
    ("agpl", "The server is AGPLv3"),
    ("agpl", "it under the terms of the GNU Affero General Public License as\npublished by the Free Software Foundation, either version 3 of the\nLicense, or (at your option) any later version."),
    ("bsd", "Licensing: BSD 3-Clause"),
    ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"),
    ("bsd", "Use of this source code is governed by a BSD-style license: the new BSD license, found in the LICENSE file."),
    ("bsd", "// SPDX-License-Identifier: BSD-2-Clause"),
    ("isc", "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
    ("isc", "This module is under the ISC license"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("mpl", "The add-on is covered by the MPL 2.0"),
    ("epl", "All rights reserved. This program and the accompanying materials\nare made available under the terms of the Eclipse Public License v1.0\nwhich accompanies this distribution, and is available online"),
    ("boost", "Use, modification and distribution are subject to the Boost Software License, Version 1.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc0", "To the extent possible under law, the authors have waived all copyright\nand related or neighboring rights to this work."),
    ("cc0", "docs: CC0 1.0"),
    ("cc-by-nc", "Content: CC BY-NC 4.0"),
    ("cc-by-nc", "Text and images are under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "CC BY-SA 4.0"),
    ("cc-by-sa", "Text ist unter der Lizenz CC BY-SA 3.0 verfügbar"),
    ("cc-by-nc-sa", "Este obra está bajo una licencia Creative Commons: CC BY-NC-SA 4.0"),
    ("cc-by", "Cet article est mis à disposition sous licence CC BY 4.0"),
    ("cc-by", "Except where otherwise noted, this site is under a Creative Commons Attribution 4.0\nInternational License"),
    ("ofl", "This Font Software is licensed under the SIL Open Font License,\nVersion 1.1. This license is copied below, and is also available online"),
]
PLAIN = [
    "You must hold a valid license to hunt deer in this state.", "She took liberties with the text, by poetic licence.", "The general public was free to modify the statue.", "He works at MIT and she at the Apache reservation.", "Er kam mit dem Fahrrad und mit seinem Hund.",
    "Redistribution of income is a question of public policy.", "Creative people and the House of Commons met on Monday.", "The software is free of charge for schools.", "Permission to use the hall was granted by the council.", "A copy of the notice hangs in the hall, under the clock.",
    "The eclipse of 1999 was seen in public places.", "Version 2.0 of the map shows the source of the river.", "By nature he was a creative commoner.", "The permit was attributed to a share of the derivatives market.", "All copies of the book have been sold.",
    "La licence de musique dure trois ans.", "El carnet y la licencia de obras se piden en el ayuntamiento.", "Die Lizenz für den Verein wurde vom Verband erteilt.", "His pilot license was issued in 1987.", "The clause of the contract about the source was removed.",
    "Boost your sales with our software.", "Mozilla and Eclipse are foundations.", "The gnu is a large antelope.", "We distribute food under the terms of the agreement with the city.", "The zero of the function lies at 1.0.", "Nc and sa are abbreviations of two states.", "",
]
#: Notices of several licences, addresses, clauses, and licences of no listed family, with all that they name.
SEVERAL = [
    ({"mit", "apache"}, "SPDX-License-Identifier: MIT OR Apache-2.0"),
    ({"mit", "apache"}, "Dual licensed under the MIT License and the Apache License, Version 2.0."),
    ({"mit", "apache"}, "Licensed under either of Apache License, Version 2.0 or MIT license at your option."),
    ({"gpl", "bsd"}, "SPDX-License-Identifier: GPL-2.0-only OR BSD-3-Clause"),
    ({"mit", "cc-by"}, "The code is under the MIT license, the documentation under CC BY 4.0."),
    ({"apache", "cc-by-sa"}, "Content: CC BY-SA 4.0, code: Apache-2.0"),
    ({"gpl", "mpl"}, "This file is available under the GNU General Public License version 2 or the Mozilla Public License, version 2.0."),
    ({"gpl", "lgpl"}, "GNU Lesser General Public License or GNU General Public License"),
    ({"mpl", "gpl", "lgpl"}, "SPDX-License-Identifier: (MPL-2.0 OR GPL-2.0-or-later OR LGPL-2.1-or-later)"),
    ({"bsd", "isc"}, "Released under the BSD 2-Clause License or the ISC License, Copyright 2020"),
    ({"mit"}, "https://opensource.org/licenses/MIT"),
    ({"cc-by"}, "http://creativecommons.org/licenses/by/4.0/"),
    ({"cc-by-nc-sa"}, "https://creativecommons.org/licenses/by-nc-sa/4.0/"),
    ({"mit"}, "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ({"unknown"}, "EUPL-1.2"),
    ({"unknown"}, "GNU FDL 1.3"),
    (set(), "The license fee for the software was paid by the university."),
]
