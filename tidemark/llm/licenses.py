"""License scans: templates with optional and replaceable regions, compiled into automata over words."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keyed

#: Phrases that are looked for word by word, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Parts of the templates below (license wording, fixed values).
_EITHER, _LATER = "<<beginOptional>>either<<endOptional>>", "<<beginOptional>>of the license<<endOptional>> <<beginOptional>>or at your option any later version<<endOptional>>"
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice "
    "this list of conditions and the following disclaimer <<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
    "and or other materials provided with the distribution"
)
_BSD_END = (
    'this software is provided by <<var;name="holder";words="1-8">> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed '
    'in no event shall <<var;name="holder";words="1-8">> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits '
    "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)

#: Label and template. Labels of whole texts and notices end in -text or -notice or name a version; the others are short mentions. Markup: <<beginOptional>> ... <<endOptional>> for words that may be absent,
#: <<var;name="...";words="a-b">> for a to b words of any kind. All other wording is mandatory, word for word.
TEMPLATES = (
    ("mit", 'released under the MIT license'),
    ("mit", 'licensed under the <<beginOptional>>terms of the<<endOptional>> MIT license'),
    (
        "mit",
        'permission is hereby granted free of charge to any person obtaining a copy of <<var;name="object";words="1-8">> '
        "<<beginOptional>>and associated documentation files<<endOptional>> <<beginOptional>>the software<<endOptional>> to deal in",
    ),
    ("apache-2.0", "licensed under the <<beginOptional>>terms of the<<endOptional>> apache license <<beginOptional>>version<<endOptional>> 2.0"),
    (
        "gpl-3.0",
        '<<beginOptional>>this <<var;name="work";words="1-3">> is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> '
        "<<beginOptional>>GNU<<endOptional>> general public license <<beginOptional>>as published by the free software foundation<<endOptional>> version 3",
    ),
    ("gpl-2.0", "licensed under the <<beginOptional>>GNU<<endOptional>> general public license version 2"),
    ("cc-by-nc-4.0", "licensed under <<beginOptional>>a<<endOptional>> CC BY-NC 4.0"),
    ("cc-by-4.0", "licensed under <<beginOptional>>a<<endOptional>> CC BY 4.0"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ),
    ("copyright-notice", 'copyright <<beginOptional>>c<<endOptional>> <<var;name="holder";words="1-8">> all rights reserved'),
    ("copyright-notice", 'c <<var;name="holder";words="1-8">> all rights reserved'),
    # notices that name a license and its version
    ("gpl-3.0", f"under the terms of the GNU general public license as published by the free software foundation {_EITHER} version 3 {_LATER}"),
    ("gpl-2.0", f"under the terms of the GNU general public license as published by the free software foundation {_EITHER} version 2 {_LATER}"),
    ("lgpl-3.0", f"under the terms of the GNU lesser general public license as published by the free software foundation {_EITHER} version 3 {_LATER}"),
    ("lgpl-2.1", f"under the terms of the GNU lesser general public license as published by the free software foundation {_EITHER} version 2.1 {_LATER}"),
    ("agpl-3.0", f"under the terms of the GNU affero general public license as published by the free software foundation {_EITHER} version 3 {_LATER}"),
    ("mpl-2.0", "subject to the terms of the mozilla public license <<beginOptional>>version<<endOptional>> <<beginOptional>>v<<endOptional>> 2.0"),
    (
        "apache-2.0-notice",
        "licensed under the apache license version 2.0 <<beginOptional>>the license<<endOptional>> you may not use this <<var;name=\"work\";words=\"1-3\">> except in compliance with the license "
        "you may obtain a copy of the license at <<var;name=\"place\";words=\"1-10\">> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    # whole texts: conditions and disclaimer are mandatory, names and numbering are not
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of <<var;name=\"object\";words=\"1-8\">> <<beginOptional>>and associated documentation files<<endOptional>> <<beginOptional>>the software<<endOptional>> "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
        "furnished to do so subject to the following conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the "
        "<<var;name=\"holder\";words=\"1-8\">> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    ("bsd-2-text", f"{_BSD} {_BSD_END}"),
    (
        "bsd-3-text",
        f"{_BSD} <<beginOptional>>3<<endOptional>> neither the name of <<var;name=\"holder\";words=\"1-8\">> nor the names of its contributors may be used to endorse or promote products derived from this software "
        f"without specific prior written permission {_BSD_END}",
    ),
    (
        "isc-text",
        "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and <<var;name=\"holder\";words=\"1-8\">> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var;name=\"holder\";words=\"1-8\">> "
        "be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in "
        "connection with the use or performance of this software",
    ),
)

_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MARK = re.compile(r"<<(.*?)>>", re.S)


def text_words(text: str | None) -> list[bytes]:
    """Words of a text: runs of digits, letters a-z (A-Z lowered) and characters beyond ASCII, as UTF-8."""
    return (text or "").encode().translate(_WORD).split()


@dataclass
class Automaton:
    """States 0 to n; a move on a word goes to the next state, `skips` are moves without a word, `anys` moves on any word."""

    label: str
    moves: list[tuple[bytes, int] | None] = field(default_factory=list)
    anys: list[int | None] = field(default_factory=list)
    skips: list[list[int]] = field(default_factory=list)
    anchor: bytes = b""
    closed: list[frozenset[int]] = field(default_factory=list)

    def state(self) -> int:
        self.moves.append(None)
        self.anys.append(None)
        self.skips.append([])
        return len(self.moves) - 1

    def close(self) -> None:
        """The states that each state reaches without a word, itself among them."""
        for s in range(len(self.moves)):
            seen, todo = {s}, [s]
            while todo:
                for t in self.skips[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            self.closed.append(frozenset(seen))

    def spans(self, ws: list[bytes]) -> list[tuple[int, int]]:
        """First and last word of each accepted run: for each end the shortest run, runs that overlap an earlier one left out."""
        goal, out, free = len(self.moves) - 1, [], 0
        now: dict[int, int] = {}  # state: latest start
        for i, w in enumerate(ws):
            for s in self.closed[0]:
                now[s] = i
            then: dict[int, int] = {}
            for s, start in now.items():
                if start < free:
                    continue
                m = self.moves[s]
                for t in (m[1] if m and m[0] == w else None, self.anys[s]):
                    if t is not None:
                        for u in self.closed[t]:
                            if then.get(u, -1) < start:
                                then[u] = start
            if goal in then:
                out.append((then.pop(goal), i))
                free, then = i + 1, {}
            now = then
        return out


def compile_template(label: str, markup: str) -> Automaton:
    """An automaton whose accepted word runs are the template's wordings; its anchor is the longest mandatory run."""
    a = Automaton(label)
    at, opened, runs, run = a.state(), [], [], []
    for k, part in enumerate(_MARK.split(markup)):
        if k % 2 == 0:
            for w in text_words(part):
                nxt = a.state()
                a.moves[at] = (w, nxt)
                at = nxt
                if not opened:
                    run.append(w)
            continue
        runs.append(run)
        run = []
        if part == "beginOptional":
            nxt = a.state()
            a.skips[at].append(nxt)
            opened.append(at)
            at = nxt
        elif part == "endOptional":
            if not opened:
                raise ValueError(f"endOptional without a begin: {markup}")
            nxt = a.state()
            a.skips[at].append(nxt)
            a.skips[opened.pop()].append(nxt)
            at = nxt
        elif m := re.search(r'^var;.*words="(\d+)-(\d+)"', part):
            low, high = int(m[1]), int(m[2])
            ways = []
            for n in range(high):
                if n >= low:
                    ways.append(at)
                nxt = a.state()
                a.anys[at] = nxt
                at = nxt
            nxt = a.state()
            for s in [*ways, at]:
                a.skips[s].append(nxt)
            at = nxt
        else:
            raise ValueError(f"unknown markup {part!r}")
    if opened:
        raise ValueError(f"beginOptional without an end: {markup}")
    runs.append(run)
    a.anchor = b" " + b" ".join(max(runs, key=len)) + b" "
    if a.anchor == b"  ":
        raise ValueError(f"a template needs mandatory words: {markup}")
    a.close()
    return a


def scan(text: str | None, base: Sequence[tuple[bytes, str]], automata: Sequence[Automaton]) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score and the spans (label, first, last)."""
    ws = text_words(text)
    line = b" " + b" ".join(ws) + b" "
    starts, labels, spans = [], set(), []
    for phrase, label in base:
        at, before, k = line.find(phrase), 0, 0
        while at >= 0:
            k, before = k + line.count(b" ", before, at), at  # blanks before a hit number its word
            starts.append(k)
            spans.append((label, k, k + phrase.count(b" ") - 2))
            labels.add(label)
            at = line.find(phrase, at + 1)
    own = set(labels)
    for a in automata:
        if a.anchor in line:
            for first, last in a.spans(ws):
                spans.append((a.label, first, last))
                own.add(a.label)
    covered = {k for _, first, last in spans for k in range(first, last + 1)}
    return (
        len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(own)),
        len(covered) / len(ws) if ws else 0.0, [{"label": x, "first": f, "last": z} for x, f, z in sorted(spans, key=lambda s: (s[1], s[2], s[0]))],
    )


FIELDS = ("n_words long", "n_base long", "first_word long", "last_word long", "base_labels string", "labels string", "score double", "spans array<struct<label:string,first:int,last:int>>")


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", base: Sequence[tuple[str, str]] = BASE, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """key with n_words, n_base, first_word, last_word, base_labels, labels, score (share of words in spans) and spans.

    Null and empty texts have no words: counts and score 0, labels empty strings, first and last null.
    """
    phrases = [(b" " + b" ".join(text_words(p)) + b" ", label) for p, label in base]
    automata = [compile_template(label, markup) for label, markup in templates]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))]
    names = [x.split(" ")[0] for x in FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t, phrases, automata) for t in batch.column(1).to_pylist()]
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["key", *names])

    schema = keyed(docs.schema[key].dataType, ", ".join(FIELDS))
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """license_scan() of all documents: a row each, repeated rows and copies too; null and empty texts as it says. Only doc_id and text are read."""
    return license_scan(documents(spark, sf_dir)).drop("spans")
