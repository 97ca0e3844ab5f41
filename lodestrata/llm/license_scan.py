"""License scans: base phrases, and an exact containment join of text blocks with license templates.

A token is two words that stand one after the other, so a block that holds a template's tokens
holds its wording and not just its words. Template tokens are ordered by how many documents hold
them, rarest first. A block that holds at least a share t of a template's n distinct tokens holds
one of its first n - ceil(t n) + 1 tokens (prefix filter); a block with fewer distinct tokens than
needed (length filter) and a match too late in a template's order to leave enough tokens (positional
filter) are dropped before the exact count.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

# Phrases of the base rules with their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Wordings of public licenses and notices, with labels; marks are blanks, as in the words of a text.
TEMPLATES = (
    ("released under the mit license", "mit"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
        "and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
        "mit",
    ),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache",
    ),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty "
        "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details "
        "you should have received a copy of the gnu general public license along with this program",
        "gpl",
    ),
    ("under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0"),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to "
        "the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages "
        "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
        "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
        "arising in any way out of the use of this software even if advised of the possibility of such damage",
        "bsd",
    ),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that", "bsd"),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
        "isc",
    ),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        "zlib",
    ),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("no part of this publication may be reproduced distributed or transmitted in any form or by any means", "all-rights-reserved"),
)
SHARE = 0.9
#: Blocks are windows of the text at every half of their length; a template is sought in the shortest that are twice as long as it.
BLOCKS = (64, 256, 512)


def block_of(template: str) -> int:
    return next(b for b in BLOCKS if 2 * len(template.split()) <= b)

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased: runs of digits, a-z and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split(b" ") if text else []


def _words(text):
    return [w for w in words(text) if w]


def tokens(ws: list[bytes]) -> list[tuple[bytes, bytes]]:
    """Every two neighbouring words."""
    return list(zip(ws, ws[1:]))


def phrase_places(ws: list[bytes], phrases=PHRASES) -> list[tuple[int, str]]:
    """(word index, label) of every place where a phrase's words stand one after another."""
    line, out = b" " + b" ".join(ws) + b" ", []
    for phrase, label in phrases:
        key = b" " + phrase.encode() + b" "
        at = line.find(key)
        while at >= 0:
            out.append((line.count(b" ", 0, at), label))
            at = line.find(key, at + 1)
    return sorted(out)


def document_frequency(df: DataFrame, text_col: str = "text", templates=TEMPLATES) -> dict[str, int]:
    """In how many documents each template token (two words, a blank between) occurs, over all documents; as many rows as such tokens."""
    vocab = {p for t, _ in templates for p in tokens(t.encode().split())}
    starts = {a for a, _ in vocab}

    def make():
        def run(keys, texts):
            n: dict[tuple[bytes, bytes], int] = {}
            for t in texts:
                ws = _words(t)
                for p in () if starts.isdisjoint(ws) else vocab.intersection(zip(ws, ws[1:])):
                    n[p] = n.get(p, 0) + 1
            return {"token": [b" ".join(p).decode() for p in n], "n": list(n.values())}

        return run

    rows = map_texts(df, [], text_col, make, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {b" ".join(p).decode(): 0 for p in vocab} | {r["token"]: r["n"] for r in rows}


class Matcher:
    """Templates and blocks as sets of tokens in one order, rarest first over the whole corpus."""

    def __init__(self, frequency: dict[str, int], templates=TEMPLATES, share: float = SHARE):
        self.rank = {tuple(t.encode().split()): i for i, t in enumerate(sorted(frequency, key=lambda t: (frequency[t], t)))}
        self.templates, self.prefix = [], {b: {} for b in BLOCKS}
        for i, (text, label) in enumerate(templates):
            held = sorted(set(tokens(text.encode().split())), key=self.rank.__getitem__)
            need = math.ceil(share * len(held) - 1e-9)
            self.templates.append((frozenset(held), need, label))
            for pos, t in enumerate(held[: len(held) - need + 1]):
                self.prefix[block_of(text)].setdefault(t, []).append((i, pos))
        self.least = {b: min((self.templates[i][1] for at in p.values() for i, _ in at), default=0) for b, p in self.prefix.items()}

    def blocks(self, ws: list[bytes]) -> list[tuple[int, int, str, float]]:
        """(first word, words, label, containment) of each block and template that meet the threshold."""
        out, every = [], tokens(ws)
        for size, prefix in self.prefix.items():
            if prefix.keys().isdisjoint(every):
                continue
            half = size // 2
            for start in range(0, max(1, len(ws) - half), half):
                block = set(every[start : start + size - 1])
                if prefix.keys().isdisjoint(block):
                    continue
                mine = sorted(self.rank.keys() & block, key=self.rank.__getitem__)
                out += [(start, min(size, len(ws) - start), label, c) for label, c in self._in_block(mine, block, prefix)] if len(mine) >= self.least[size] else []
        return sorted(out)

    def _in_block(self, mine: list[bytes], block: set[bytes], prefix: dict):
        """(label, containment); ``mine`` holds the block's template tokens in order.

        Of a template's tokens before its first match at ``pos``, and of the block's before ``q``,
        none can match, so no more than min(left in the template, left in the block) do.
        """
        seen = set()
        for q, t in enumerate(mine):
            for i, pos in prefix.get(t, ()):
                if i in seen:
                    continue
                seen.add(i)
                held, need, label = self.templates[i]
                if len(mine) < need or min(len(held) - pos, len(mine) - q) < need:
                    continue
                if (n := len(held & block)) >= need:
                    yield label, n / len(held)


def scan(df: DataFrame, frequency: dict[str, int], id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES, share: float = SHARE) -> DataFrame:
    """(id_col, n_words, places, blocks), one row per row.

    places: array of (word, label) for every base phrase; blocks: array of (word, words, label,
    containment) for every window and template at or above ``share``. A null or empty text has
    neither; repeated rows and null ids stay; an empty table gives no rows; other columns are
    ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(frequency)
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        m = Matcher(shared.value, templates, share)
        last = {p.split()[-1].encode() for p, _ in phrases}

        def run(keys, texts):
            n, places, blocks = [], [], []
            for t in texts:
                ws = _words(t)
                n.append(len(ws))
                places.append([] if last.isdisjoint(ws) else [{"word": i, "label": x} for i, x in phrase_places(ws, phrases)])
                blocks.append([{"word": a, "words": b, "label": x, "containment": c} for a, b, x, c in m.blocks(ws)])
            return {id_col: keys[0], "n_words": n, "places": places, "blocks": blocks}

        return run

    return map_texts(df, [F.col(id_col)], text_col, make, f"`{id_col}` {kind}, n_words long, places array<struct<word:long,label:string>>, blocks array<struct<word:long,words:long,label:string,containment:double>>")
