"""License scans: blocks of a text are compressed with every template as a raw dictionary, and winners are read word by word."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import documents, map_arrow, texts

# Wording of public licenses (whole, where they are short) and of the notices that stand for the long ones.
AS_IS = "this software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. in no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
BSD = "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
FREE = "is free software: you can redistribute it and/or modify it under the terms of the gnu"
HOPE = "is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. see the gnu"
TEMPLATES = {
    "mit": "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"software\"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software. the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    "mit-notice": "released under the mit license. licensed under the mit license. this project is licensed under the terms of the mit license.",
    "isc": "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. the software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. in no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.",
    "0bsd": "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. the software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.",
    "bsd-2-clause": f"{BSD} {AS_IS}",
    "bsd-3-clause": f"{BSD} neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {AS_IS}",
    "bsd-notice": "use of this source code is governed by a bsd-style license that can be found in the license file. released under the bsd license.",
    "zlib": "this software is provided 'as-is', without any express or implied warranty. in no event will the authors be held liable for any damages arising from the use of this software. permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: the origin of this software must not be misrepresented; you must not claim that you wrote the original software. if you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. this notice may not be removed or altered from any source distribution.",
    "bsl-1.0": "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"software\") to use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works of the software, and to permit third-parties to whom the software is furnished to do so, all subject to the following: the copyright notices in the software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the software, in whole or in part, and all derivative works of the software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "wtfpl": "everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "apache-2.0": "licensed under the apache license, version 2.0 (the \"license\"); you may not use this file except in compliance with the license. you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0 unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis, without warranties or conditions of any kind, either express or implied. see the license for the specific language governing permissions and limitations under the license.",
    "gpl-3.0": f"this program {FREE} general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version. this program {HOPE} general public license for more details. you should have received a copy of the gnu general public license along with this program. if not, see https://www.gnu.org/licenses/.",
    "gpl-2.0": "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; either version 2 of the license, or (at your option) any later version. this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. see the gnu general public license for more details. you should have received a copy of the gnu general public license along with this program; if not, write to the free software foundation, inc., 51 franklin street, fifth floor, boston, ma 02110-1301 usa.",
    "agpl-3.0": f"this program {FREE} affero general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version. this program {HOPE} affero general public license for more details. you should have received a copy of the gnu affero general public license along with this program. if not, see https://www.gnu.org/licenses/.",
    "lgpl-2.1": "this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation; either version 2.1 of the license, or (at your option) any later version. this library is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. see the gnu lesser general public license for more details.",
    "gpl-3.0-notice": "this work is licensed under the gnu general public license, version 3.",
    "gpl-2.0-notice": "this work is licensed under the gnu general public license, version 2.",
    "lgpl-notice": "this library is licensed under the gnu lesser general public license, version 3.",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at http://mozilla.org/mpl/2.0/.",
    "epl-2.0": "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
    "cc0-1.0": "to the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. this work is dedicated to the public domain under the cc0 1.0 universal public domain dedication.",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4.0 international license. licensed under cc by 4.0.",
    "cc-by-sa-4.0": "this work is licensed under a creative commons attribution-sharealike 4.0 international license. licensed under cc by-sa 4.0.",
    "cc-by-nc-4.0": "this work is licensed under a creative commons attribution-noncommercial 4.0 international license. licensed under cc by-nc 4.0.",
    "unlicense": "this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. in jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software. for more information, please refer to http://unlicense.org/.",
    "all-rights-reserved": "all rights reserved. copyright. no part of this publication may be reproduced without permission.",
}
TRIGGER = r"licen[sc]e|copyright|all rights reserved|public domain|redistribut|hereby granted|creative commons|merchantability"
#: A neighbouring line joins a block if at least this share of its words are license words.
NEIGHBOUR_SHARE = 0.6
#: A winner is confirmed if the differing words are at most this share of the block's.
MOST_DIFFERENT = 0.34
LEVEL = 3
#: Words of a template in a row (or a whole sentence of three) that make a notice inside a longer text.
LEAST_SPAN, LEAST_SENTENCE = 5, 3


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9.\-/]*[a-z0-9]", text.lower())


def lower(text: str) -> str:
    """Lower case with every letter at its place (a few letters become two in lower case and stay as they are)."""
    small = text.lower()
    return small if len(small) == len(text) else "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))


@lru_cache(1)
def templates() -> dict[str, tuple]:
    """For each template: its words, the distinct ones, a compressor with its text as raw dictionary."""
    out = {}
    for name, text in TEMPLATES.items():
        words = words_of(text)
        raw = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out[name] = words, frozenset(words), zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_checksum=False, write_content_size=False, write_dict_id=False)
    return out


@lru_cache(1)
def vocabulary() -> frozenset:
    return frozenset().union(*(t[1] for t in templates().values()))


def blocks(text: str) -> Iterator[tuple[int, str]]:
    """(place, lines) of candidate blocks: lines with a trigger, grown over neighbours that are mostly license words."""
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, line))
        at += len(line) + 1
    trigger = re.compile(TRIGGER)

    def related(k: int) -> bool:
        words = words_of(lines[k][1])
        return bool(words) and sum(w in vocabulary() for w in words) >= NEIGHBOUR_SHARE * len(words)

    last = -1
    for k, (place, line) in enumerate(lines):
        if k <= last or not trigger.search(line.lower()):
            continue
        first = last_line = k
        while first - 1 > last and related(first - 1):
            first -= 1
        while last_line + 1 < len(lines) and related(last_line + 1):
            last_line += 1
        last = last_line
        yield lines[first][0], "\n".join(x for _, x in lines[first : last_line + 1])


def different_words(block: list[str], template: list[str]) -> int:
    """Words of the block that are not in the template, and words of the template left out between ones that are."""
    match = SequenceMatcher(None, block, template, autojunk=False).get_matching_blocks()[:-1]
    if not match:
        return len(block)
    skipped = sum(b.b - (a.b + a.size) for a, b in zip(match, match[1:]))
    return len(block) - sum(m.size for m in match) + skipped


def scan_block(text: str) -> tuple[str | None, float, float, int, int]:
    """License or None, its size reduction, the next best one's, words, differing words.

    Templates are ranked by how much smaller the block becomes with them; the best three are compared word by word,
    and the one with the fewest differences wins (on ties, the higher ranked), if these are few enough.
    """
    words = words_of(text)
    data = " ".join(words).encode()
    if not words:
        return None, 0.0, 0.0, 0, 0
    alone = len(zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False).compress(data))
    ranked = sorted(((1 - len(t[2].compress(data)) / alone, name) for name, t in templates().items()), key=lambda x: (-x[0], x[1]))
    best = min(range(3), key=lambda k: (different_words(words, templates()[ranked[k][1]][0]), k))
    gain, name = ranked[best]
    differing = different_words(words, templates()[name][0])
    confirmed = gain > 0 and differing <= MOST_DIFFERENT * len(words)
    return name if confirmed else None, gain, ranked[1 if best == 0 else 0][0], len(words), differing


@lru_cache(1)
def short_sentences() -> frozenset:
    """Whole sentences of templates that are shorter than LEAST_SPAN."""
    found = (tuple(words_of(part)) for text in TEMPLATES.values() for part in re.split(r"[.;:](?:\s|$)", text))
    return frozenset(x for x in found if LEAST_SENTENCE <= len(x) < LEAST_SPAN)


def aligned_span(words: list[str], at: int, template: list[str]) -> tuple[int, int, int]:
    """(score, first, end) of the words around the one at `at` that fit the template best: a word that fits counts one, one that differs takes two."""
    match = SequenceMatcher(None, words, template, autojunk=False).get_matching_blocks()[:-1]
    own = next((k for k, m in enumerate(match) if m.a <= at < m.a + m.size), None)
    if own is None:
        return 0, at, at
    score, ends = match[own].size, []
    for step in (-1, 1):
        best, total, edge, k = 0, 0, own, own
        while 0 <= k + step < len(match):
            a, b = (match[k], match[k + 1]) if step > 0 else (match[k - 1], match[k])
            k += step
            total += match[k].size - 2 * (b.a - a.a - a.size + b.b - a.b - a.size)
            if total > best:
                best, edge = total, k
        score += best
        ends.append(edge)
    return score, match[ends[0]].a, match[ends[1]].a + match[ends[1]].size


def notices(block: str) -> Iterator[tuple[int, str]]:
    """(place, text) of the spans around triggers inside a block that fit a template, wherever lines and sentences end."""
    found = list(re.finditer(r"[a-z0-9.\-/]*[a-z0-9]", lower(block)))
    words = [m.group() for m in found]
    reach, last, starts = max(len(t[0]) for t in templates().values()), 0, [m.start() for m in found]
    for trigger in re.finditer(TRIGGER, lower(block)):
        at = max(0, bisect_right(starts, trigger.start()) - 1)
        if at < last:
            continue
        low = max(last, at - reach)
        near = words[low : at + reach]
        score, first, end = max((aligned_span(near, at - low, t[0]) for t in templates().values()), key=lambda x: x[0], default=(0, 0, 0))
        if score >= LEAST_SPAN or tuple(near[first:end]) in short_sentences():
            last = low + end
            yield found[low + first].start(), block[found[low + first].start() : found[last - 1].end()]


def scanned(text: str) -> Iterator[tuple]:
    """(place, block, *scan_block) of the candidate blocks; one that is not confirmed whole gives the notices inside, if there are any."""
    for place, block in blocks(text):
        whole = scan_block(block)
        inside = [] if whole[0] else [(place + at, own, *scan_block(own)) for at, own in notices(block)]
        yield from [x for x in inside if x[2]] or [(place, block, *whole)]


FIELDS = [("block_start", pa.int64()), ("block", pa.string()), ("license", pa.string()), ("reduction", pa.float64()), ("next_reduction", pa.float64()), ("block_words", pa.int64()), ("different_words", pa.int64())]
KINDS = "doc_id long, block_start long, block string, license string, reduction double, next_reduction double, block_words long, different_words long"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row for each candidate block (or for each notice inside one that is no license as a whole): its place (in characters) and text, license (null where none is confirmed),
    size reductions of the winner and of the best other template, words, differing words.

    Whole texts are scanned; texts without a trigger word (null and empty ones too) have no row. Only the three templates with the
    greatest size reductions are compared word by word. Ties go to the name that sorts first. Repeated rows repeat; a null doc_id stays
    null; other columns are not read; an empty table gives no rows.
    """
    candidates = docs.select("doc_id", "text").where(F.lower("text").rlike(TRIGGER))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), texts(b), strict=True):
                rows.extend((doc_id, *x) for x in scanned(text.decode("utf-8", "replace")))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, k) for c, (_, k) in zip(columns[1:], FIELDS, strict=True))], names=["doc_id", *(f for f, _ in FIELDS)])

    return map_arrow(candidates, run, KINDS)


def op4_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate blocks of all documents and their licenses; cases as in `scan_licenses`."""
    return scan_licenses(documents(spark, sf_dir))


QUERIES = {"op4_license_compression": op4_license_compression}
SQL: dict[str, str] = {}
