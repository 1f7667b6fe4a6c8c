"""License scan: MinHash bands over overlapping windows retrieve notices, exact containment verifies them.

A notice is a set of five-word shingles.  Windows of about as many shingles
slide over every whole text; their MinHash values, in bands of one row, are
looked up among the notices' bands: five-word shingles are rare enough for one
row to be selective.  With ``BANDS`` bands a window whose similarity to a
notice is 0.6 shares one with a probability of 0.9999, and one of 0.88, the
least for an unchanged notice at any place, of 1 - 1e-9.  For every text and notice retrieved, all shingles of the notice in
the text are located; places no further apart than the notice is long form an
occurrence, which counts if it holds at least ``threshold`` of the notice's
distinct shingles.

Null, empty and short texts hold no notice; repeated rows give repeated
results; columns other than id and text are ignored.  The notices, a bounded
list of at least five words each, are a parameter: by default sentences that
declare a license, and whole bodies and headers of licenses.  What is found in a
text does not depend on the texts that share its batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_batches
from .tokens import Words, groups, stream

SIZE = 5
THRESHOLD = 0.8
BANDS = 10
MOST_NOTICES = 5000

# Bodies and headers of licenses.
_PERMISSION = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software'), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = "THE SOFTWARE IS PROVIDED 'AS IS', WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ENDORSEMENT = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS 'AS IS' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_END = "THE SOFTWARE IS PROVIDED 'AS IS' AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_WARRANTY = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
BODIES = [
    ("MIT", f"{_PERMISSION} {_AS_IS}"),
    ("BSD-2-Clause", f"{_REDISTRIBUTION} {_DISCLAIMER}"),
    ("BSD-3-Clause", f"{_REDISTRIBUTION} {_ENDORSEMENT} {_DISCLAIMER}"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_END}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the 'License'); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an 'AS IS' BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0-or-later", f"{_GPL}, either version 3 of the License, or (at your option) any later version. This program {_WARRANTY}"),
    ("GPL-2.0-or-later", f"{_GPL}; either version 2 of the License, or (at your option) any later version. This program {_WARRANTY}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the 'Software') to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
]

# Sentences by which texts declare their license.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-or-later", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "made available under the terms of the Eclipse Public License 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]


NOTICES += BODIES


def window_for(shingles: int) -> int:
    """Window length for a notice of so many shingles: exact up to 16, then in steps of an eighth."""
    size = 16
    while size < shingles:
        size += max(1, size // 8)
    return shingles if shingles <= 16 else size


class Notices:
    """The bands of all notices by window length, and their shingle sets."""

    def __init__(self, notices: list[tuple[str, str]]):
        if len(notices) > MOST_NOTICES:
            raise ValueError(f"more than {MOST_NOTICES} notices")
        self.names = [n for n, _ in notices]
        w = Words([t for _, t in notices])
        if (w.counts < SIZE).any():
            raise ValueError(f"a notice has fewer than {SIZE} words")
        grams, bounds = w.shingles(SIZE)
        self.sets = [np.unique(grams[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.factors = stream(41, BANDS) | np.uint64(1)
        #: By window length and band: notices by their least hash, and which upper halves of hashes occur.
        self.windows: dict[int, list[dict[int, list[int]]]] = {}
        for k, s in enumerate(self.sets):
            tables = self.windows.setdefault(window_for(len(s)), [{} for _ in range(BANDS)])
            for band, low in enumerate(self.hashed(s)):
                tables[band].setdefault(int(low.min()), []).append(k)
        self.halves = {}
        for size, tables in self.windows.items():
            self.halves[size] = np.zeros((BANDS, 1 << 16), bool)
            for band, table in enumerate(tables):
                self.halves[size][band, [v >> 16 for v in table]] = True

    def hashed(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        """A 32-bit hash of every shingle for each band; one product serves two bands."""
        for i in range(0, BANDS, 2):
            with np.errstate(over="ignore"):
                both = grams * self.factors[i]
                both ^= both >> np.uint64(32)
                both *= self.factors[i + 1]
                both ^= both >> np.uint64(29)
            halves = both.view(np.uint32).reshape(-1, 2)
            yield np.ascontiguousarray(halves[:, 0])
            yield np.ascontiguousarray(halves[:, 1])

    def retrieve(self, grams: np.ndarray) -> set[tuple[int, int]]:
        """(window start, notice) of all windows that share a band with a notice."""
        out: set[tuple[int, int]] = set()
        largest = max(self.windows)
        for band, m in enumerate(self.hashed(grams)):
            reach = 1  # m: the least of ``reach`` hashes from each place on
            while True:
                for size, tables in self.windows.items():
                    rest = size - reach
                    if not (reach <= size < 2 * reach and len(m) > rest):
                        continue
                    n, step = len(m) - rest, max(1, size // 8)
                    low = np.minimum(m[:n:step], m[rest::step][: -(-n // step)]) if rest else m[::step]
                    for i in np.flatnonzero(self.halves[size][band][low >> np.uint32(16)]):
                        for k in tables[band].get(int(low[i]), ()):
                            out.add((int(i) * step, k))
                    if step > 1 and (n - 1) % step:  # the last window counts whatever the step
                        for k in tables[band].get(int(min(m[n - 1], m[n - 1 + rest])), ()):
                            out.add((n - 1, k))
                if 2 * reach > largest or len(m) <= reach:
                    break
                m, reach = np.minimum(m[:-reach], m[reach:]), 2 * reach
        return out

    def occurrences(self, grams: np.ndarray, k: int, threshold: float) -> list[tuple[int, int]]:
        """(first, last) shingle of each occurrence of notice ``k`` in one text."""
        wanted = self.sets[k]
        places = np.flatnonzero(np.isin(grams, wanted))
        out = []
        for run in np.split(places, np.flatnonzero(np.diff(places) > len(wanted) + SIZE - 1) + 1):
            if len(run) and len(np.unique(grams[run])) >= threshold * len(wanted) - 1e-9:
                out.append((int(run[0]), int(run[-1])))
        return out


def _scan(notices: list[tuple[str, str]], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Notices(notices)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in groups([len(t or "") for t in texts]):
                grams, bounds = Words(texts[lo:hi]).shingles(SIZE)
                found: list[dict[tuple[str, int, int], None]] = [{} for _ in range(hi - lo)]
                pairs = set()
                for start, k in known.retrieve(grams) if len(grams) else ():
                    # a window may reach into the next text, whose notice it may be
                    size = window_for(len(known.sets[k]))
                    first, last = (int(np.searchsorted(bounds, p, "right")) - 1 for p in (start, min(start + size, len(grams)) - 1))
                    pairs |= {(d, k) for d in range(first, last + 1)}
                # no window fits into a group of fewer shingles: its few texts are verified for every such notice
                short = [k for k, s in enumerate(known.sets) if len(grams) < window_for(len(s))]
                pairs |= {(int(d), k) for d in np.flatnonzero(np.diff(bounds)) for k in short}
                for d, k in pairs:
                    for a, b in known.occurrences(grams[bounds[d] : bounds[d + 1]], k, threshold):
                        found[d][known.names[k], a, b + SIZE] = None
                rows = [sorted(f, key=lambda x: (x[1], x[2], x[0])) for f in found]
                yield pa.record_batch(
                    [keys.slice(lo, hi - lo), pa.array([[dict(zip(("license", "first_word", "end_word"), x, strict=True)) for x in r] for r in rows], pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32())])))],
                    ["doc_id", "found"],
                )

    return run


def license_matches(docs: DataFrame, notices: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and all occurrences, as (license, first_word, end_word), of every text."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan(notices or NOTICES, threshold), "doc_id long, found array<struct<license:string,first_word:int,end_word:int>>")


def license_report(docs: DataFrame, notices: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the number of licenses, their names, and the occurrences as text."""
    names = F.array_sort(F.array_distinct(F.col("found.license")))
    return license_matches(docs, notices, threshold).select(
        "doc_id", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"),
        F.expr("array_join(transform(found, x -> concat_ws(':', x.license, x.first_word, x.end_word)), ',')").alias("spans"),
    )
