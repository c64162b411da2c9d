"""Licence notices as files have them: wrapped, in comments."""

import textwrap

from conftest import make

from furlong.llm import licences


def test_wrapped_notices(spark):
    gnu = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    clause = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    texts = {
        "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "GPL-3.0": gnu.format("program", "General Public License", 3),
        "GPL-2.0": gnu.format("program", "General Public License", 2),
        "LGPL-3.0": gnu.format("library", "Lesser General Public License", 3),
        "AGPL-3.0": gnu.format("program", "Affero General Public License", 3),
        "BSD-2-Clause": bsd,
        "BSD-3-Clause": bsd + "\n\n" + clause,
        "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    }
    rows, want = [], {}
    for family, text in texts.items():
        for mark in ("", " * ", "# "):
            paras = [textwrap.fill(t, 72) for t in ("Some file of a project.", *text.split("\n\n"), "It goes on.")]
            want[len(rows)] = family
            rows.append((len(rows), "\n".join((mark + x).rstrip() for x in "\n\n".join(paras).split("\n"))))
    got = {r.doc_id: ",".join(h.family for h in r.hits) for r in licences.scan(make(spark, rows), licences.train()).collect()}
    assert got == want
