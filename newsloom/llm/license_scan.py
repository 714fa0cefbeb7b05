"""License scans: ordered signature rules with a keyword gate and interval suppression.

Texts become words (ASCII letters lower-cased, digits, every non-ASCII character); rules are regular
expressions over the words joined by one space, so punctuation and line breaks never matter. A rule
runs only on documents that hold all of its keywords. Detections are taken in order of priority
(then start, then longer first); one that lies inside an accepted interval is suppressed, so
"gnu lesser general public license" does not also report the GPL, and a version hides its family.

Base labels are the places where the three contract phrases stand; they are never suppressed.

Defined results: a null text is empty: no words, no labels, nulls for first and last word, score 0.
Equal rows get equal results, other columns are not read, and texts are scanned whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import documents, slices, small_batches

BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
BASE_SCORE = 0.95

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern
    keywords: frozenset[bytes]
    priority: int
    score: float


#: Families: label, the names it goes by, its SPDX spellings. Names are regular expressions over words.
FAMILIES: list[tuple[str, list[str], list[str]]] = [
    ("mit", ["mit license", "mit licence", "mit x11 license", "expat license", "license mit"], ["mit"]),
    ("mit-0", ["mit no attribution(?: license)?", "mit 0 license"], ["mit 0"]),
    ("isc", ["isc license", "isc licence"], ["isc"]),
    ("apache-1.1", ["apache software license version 1 1", "apache license(?: version)? 1 1"], ["apache 1 1"]),
    ("apache-2.0", ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache license v2 0", "asl 2 0"], ["apache 2 0"]),
    ("apache", ["apache license", "apache software license"], []),
    ("bsd-2-clause", ["bsd 2 clause(?: license)?", "2 clause bsd(?: license)?", "simplified bsd license", "freebsd license"], ["bsd 2 clause"]),
    ("bsd-3-clause", ["bsd 3 clause(?: license)?", "3 clause bsd(?: license)?", "new bsd license", "modified bsd license", "revised bsd license"], ["bsd 3 clause"]),
    ("bsd-4-clause", ["bsd 4 clause(?: license)?", "4 clause bsd(?: license)?", "original bsd license"], ["bsd 4 clause"]),
    ("bsd", ["bsd license", "bsd style license", "bsd licence"], ["0bsd"]),
    ("gpl-1.0", ["gnu general public license version 1", "gpl version 1", "gplv1"], ["gpl 1 0(?: only| or later)?"]),
    ("gpl-2.0", ["gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) 2", "gnu gpl (?:version |v)2", "gpl (?:version|v) 2", "gplv2", "gpl 2"], ["gpl 2 0(?: only| or later)?"]),
    ("gpl-3.0", ["gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) 3", "gnu gpl (?:version |v)3", "gpl (?:version|v) 3", "gplv3", "gpl 3"], ["gpl 3 0(?: only| or later)?"]),
    ("gpl", ["gnu general public license", "gnu gpl", "gpl license", "general public license"], []),
    ("lgpl-2.1", ["gnu lesser general public license(?: either)? (?:version|v) 2 1", "lgpl (?:version |v)?2 1", "lgplv2 1"], ["lgpl 2 1(?: only| or later)?"]),
    ("lgpl-3.0", ["gnu lesser general public license(?: either)? (?:version|v) 3", "lgpl (?:version |v)?3", "lgplv3"], ["lgpl 3 0(?: only| or later)?"]),
    ("lgpl", ["gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl license"], []),
    ("agpl-3.0", ["gnu affero general public license(?: either)? (?:version|v) 3", "agpl (?:version |v)?3", "agplv3"], ["agpl 3 0(?: only| or later)?"]),
    ("agpl", ["gnu affero general public license", "affero general public license", "gnu agpl"], []),
    ("fdl", ["gnu free documentation license", "gfdl"], ["gfdl 1 [123](?: only| or later)?"]),
    ("mpl-1.1", ["mozilla public license(?: version| v)? 1 1", "mpl 1 1"], ["mpl 1 1"]),
    ("mpl-2.0", ["mozilla public license(?: version| v)? 2 0", "mpl 2 0"], ["mpl 2 0"]),
    ("mpl", ["mozilla public license"], []),
    ("epl-1.0", ["eclipse public license(?: version| v)? 1 0", "epl 1 0"], ["epl 1 0"]),
    ("epl-2.0", ["eclipse public license(?: version| v)? 2 0", "epl 2 0"], ["epl 2 0"]),
    ("epl", ["eclipse public license"], []),
    ("cddl", ["common development and distribution license", "cddl license"], ["cddl 1 [01]"]),
    ("eupl", ["european union public licence", "european union public license"], ["eupl 1 [012]"]),
    ("artistic-2.0", ["artistic license 2 0", "artistic license version 2"], ["artistic 2 0"]),
    ("artistic", ["artistic license", "perl artistic license"], ["artistic 1 0"]),
    ("zlib", ["zlib license", "zlib libpng license"], ["zlib"]),
    ("boost", ["boost software license"], ["bsl 1 0"]),
    ("python", ["python software foundation license", "psf license"], ["python 2 0", "psf 2 0"]),
    ("ruby", ["ruby license"], ["ruby"]),
    ("php", ["php license"], ["php 3 01"]),
    ("wtfpl", ["do what the fuck you want to public license"], ["wtfpl"]),
    ("unlicense", ["the unlicense", "unlicense org"], ["unlicense"]),
    ("cc0-1.0", ["cc0 1 0(?: universal)?", "creative commons zero", "cc0 public domain dedication"], ["cc0 1 0"]),
    ("public-domain", ["released into the public domain", "dedicated to the public domain", "public domain dedication", "placed in the public domain"], []),
    ("ofl-1.1", ["sil open font license(?: version 1 1)?", "open font license"], ["ofl 1 1"]),
    ("odbl", ["open database license", "open data commons open database license"], ["odbl 1 0"]),
    ("odc-by", ["open data commons attribution license"], ["odc by 1 0"]),
    ("pddl", ["public domain dedication and license"], ["pddl 1 0"]),
    ("ms-pl", ["microsoft public license"], ["ms pl"]),
    ("ms-rl", ["microsoft reciprocal license"], ["ms rl"]),
    ("postgresql", ["postgresql license", "postgresql licence"], ["postgresql"]),
    ("openssl", ["openssl license", "dual openssl and ssleay license"], ["openssl"]),
    ("busl-1.1", ["business source license(?: 1 1)?"], ["busl 1 1"]),
    ("sspl-1.0", ["server side public license"], ["sspl 1 0"]),
    ("elastic-2.0", ["elastic license(?: 2 0)?"], ["elastic 2 0"]),
    ("openrail", ["open responsible ai license", "openrail(?: m)?(?: license)?", "creativeml open rail m"], []),
    ("all-rights-reserved", ["all rights reserved"], []),
    ("proprietary", ["proprietary license", "proprietary and confidential", "end user license agreement"], []),
]
#: Sentences and notices of licences, and further names; one rule each.
SIGNATURES: list[tuple[str, str]] = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("mit", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("mit", "opensource org licenses mit"),
    ("x11", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose(?: and)?(?: without fee)? is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "neither the names? of (?:[^ ]+ ){1,12}?nor the names of (?:its|their|other) contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-3-clause", "opensource org licenses bsd 3 clause"),
    ("bsd-2-clause", "opensource org licenses bsd 2 clause"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache org licenses license 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "opensource org licenses apache 2 0"),
    ("apache-1.1", "this product includes software developed by the apache (?:software foundation|group)"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "you should have received a copy of the gnu general public license along with"),
    ("gpl-2.0", "gnu org (?:old )?licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", "gnu org licenses gpl 3 0"),
    ("gpl", "gnu org (?:copyleft|licenses) gpl html"),
    ("gpl-3.0", "opensource org licenses gpl 3 0"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license along with"),
    ("lgpl-2.1", "gnu org licenses old licenses lgpl 2 1"),
    ("lgpl-3.0", "gnu org licenses lgpl 3 0"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with"),
    ("agpl-3.0", "gnu org licenses agpl 3 0"),
    ("gnu-license-text", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("fdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("fdl", "gnu org licenses fdl"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", "mozilla org mpl 2 0"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2.0", "made available under the terms of the eclipse public license(?: v| version)? 2 0"),
    ("epl-1.0", "made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "eclipse org legal epl 2 0"),
    ("epl-1.0", "eclipse org legal epl v10"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("eupl", "licensed under the eupl"),
    ("eupl", "lizenziert unter der eupl"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0"),
    ("cc0-1.0", "waived all copyright and related or neighbou?ring rights to"),
    ("public-domain-mark", "creativecommons org publicdomain mark 1 0"),
    ("public-domain", "gemeinfrei im sinne des urheberrechts"),
    ("public-domain", "this work is in the public domain"),
    ("wtfpl", "you just do what the fuck you want to"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("boost", "boost org license 1 0"),
    ("ofl-1.1", "this font software is licensed under the sil open font license"),
    ("ofl-1.1", "scripts sil org ofl"),
    ("python", "psf is making python available to licensee on an as is basis"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "this product includes cryptographic software written by eric young"),
    ("php", "this product includes php software freely available from"),
    ("vim", "vim is charityware"),
    ("vim", "vim license"),
    ("beerware", "the beer ?ware license"),
    ("beerware", "you can buy me a beer in return"),
    ("json", "the software shall be used for good not evil"),
    ("curl", "curl license"),
    ("ncsa", "university of illinois ncsa open source license"),
    ("unicode", "unicode inc license agreement data files and software"),
    ("unicode", "unicode license v3"),
    ("blueoak-1.0.0", "blue oak model license"),
    ("upl-1.0", "universal permissive license"),
    ("afl", "academic free license"),
    ("osl", "open software license"),
    ("cpl-1.0", "common public license"),
    ("ipl-1.0", "ibm public license"),
    ("sissl", "sun industry standards source license"),
    ("qpl", "q public license"),
    ("lppl", "latex project public license"),
    ("sleepycat", "sleepycat license"),
    ("w3c", "w3c software (?:and document )?notice and license"),
    ("zpl", "zope public license"),
    ("apsl", "apple public source license"),
    ("rpsl", "realnetworks public source license"),
    ("rpl", "reciprocal public license"),
    ("nasa", "nasa open source agreement"),
    ("ecl-2.0", "educational community license"),
    ("efl", "eiffel forum license"),
    ("lpl", "lucent public license"),
    ("ntp", "ntp license"),
    ("simpl", "simple public license"),
    ("watcom", "sybase open watcom public license"),
    ("intel", "intel open source license"),
    ("nokia", "nokia open source license"),
    ("mulanpsl", "mulan permissive software license"),
    ("cecill", "cecill free software license"),
    ("cecill", "licence cecill"),
    ("ogl-uk", "open government licence"),
    ("ogl-uk", "contains public sector information licensed under"),
    ("dl-de-by", "datenlizenz deutschland namensnennung"),
    ("dl-de-zero", "datenlizenz deutschland zero"),
    ("etalab", "licence ouverte(?: open licence)?"),
    ("cdla-permissive", "community data license agreement permissive"),
    ("cdla-sharing", "community data license agreement sharing"),
    ("fal", "free art license"),
    ("fal", "licence art libre"),
    ("dsl", "design science license"),
    ("opl", "open publication license"),
    ("odbl", "opendatacommons org licenses odbl"),
    ("odc-by", "opendatacommons org licenses by"),
    ("pddl", "opendatacommons org licenses pddl"),
    ("llama", "llama [0-9]+ (?:[0-9]+ )?community license"),
    ("gemma", "gemma terms of use"),
    ("openrail", "bigscience (?:bloom )?(?:open )?rail"),
    ("openrail", "bigcode openrail m"),
    ("qwen", "qwen license agreement"),
    ("qwen", "tongyi qianwen license agreement"),
    ("deepseek", "deepseek license agreement"),
    ("stability", "stability ai community license"),
    ("falcon", "falcon [0-9]+b tii license"),
    ("mistral-research", "mistral ai research license"),
    ("mistral-non-production", "mistral ai non production license"),
    ("nvidia-open-model", "nvidia open model license"),
    ("commons-clause", "commons clause license condition"),
    ("commons-clause", "the license does not grant to you the right to sell the software"),
    ("polyform-noncommercial", "polyform noncommercial license"),
    ("polyform-small-business", "polyform small business license"),
    ("polyform-shield", "polyform shield license"),
    ("polyform-strict", "polyform strict license"),
    ("fsl", "functional source license"),
    ("confluent", "confluent community license"),
    ("timescale", "timescale license"),
    ("rsal", "redis source available license"),
    ("cockroach", "cockroach(?:db)? community license"),
    ("parity", "parity public license"),
    ("prosperity", "prosperity public license"),
    ("hippocratic", "hippocratic license"),
    ("anti-996", "anti 996 license"),
    ("busl-1.1", "mariadb business source license"),
    ("proprietary", "this document is confidential and proprietary"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "this software is the confidential and proprietary information of"),
    ("proprietary", "for internal use only do not distribute"),
    ("all-rights-reserved", "no part of this (?:publication|book|document|work|article) may be reproduced"),
    ("all-rights-reserved", "reproduction in whole or in part without (?:written )?permission is prohibited"),
    ("all-rights-reserved", "may not be published broadcast rewritten or redistributed"),
    ("all-rights-reserved", "tous droits réservés"),
    ("all-rights-reserved", "alle rechte vorbehalten"),
    ("all-rights-reserved", "todos los derechos reservados"),
    ("all-rights-reserved", "tutti i diritti riservati"),
    ("all-rights-reserved", "todos os direitos reservados"),
    ("mit", "unter der mit lizenz"),
    ("mit", "sous licence mit"),
    ("mit", "bajo la licencia mit"),
    ("apache", "unter der apache lizenz"),
    ("apache", "sous licence apache"),
    ("apache", "bajo la licencia apache"),
    ("gpl", "licence publique générale gnu"),
    ("gpl", "licencia pública general de gnu"),
    ("gpl", "gnu allgemeine öffentliche lizenz"),
    ("cc", "this work is licensed under a creative commons"),
    ("cc", "this article is distributed under the terms of the creative commons"),
    ("cc", "dieses werk ist lizenziert unter einer creative commons"),
    ("cc", "cette œuvre est mise à disposition selon les termes de la licence creative commons"),
    ("cc", "esta obra está bajo una licencia de creative commons"),
    ("cc", "creative commons license"),
]
#: Creative Commons: the elements of its licences, the words they are spelled with, and its versions.
CC_ELEMENTS = [("by", "by", "attribution"), ("by-sa", "by sa", "attribution share ?alike"), ("by-nd", "by nd", "attribution no ?deriv(?:ative)?s?"), ("by-nc", "by nc", "attribution non ?commercial"), ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?")]
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
_GRANT = r"(?:licen[sc]ed|released|distributed|available|published|provided)(?: to you)? under (?:the )?(?:terms of )?(?:the )?"
_NOT_KEYS = {b"the", b"of", b"to", b"and", b"by", b"what", b"you", b"a", b"in", b"as"}


def _keywords(pattern: str) -> frozenset[bytes]:
    """The plain words that any match must hold: whole ones outside optional or alternative parts.

    A part that begins or ends inside a word takes that word with it.
    """
    plain = re.sub(r"\((?:\?:)?((?:[^()]|\([^()]*\))*)\)\??|\[[^]]*\][+*?]?", lambda m: _gap(m[1]), pattern)
    plain = re.sub(r"\S* \?\S*", " ", plain)
    return frozenset(w.encode() for w in plain.split() if re.fullmatch(r"[a-z0-9]{2,}", w)) - _NOT_KEYS


def _gap(part: str | None) -> str:
    """What stands for a removed part: marks that stick to a neighbouring word unless a space of every alternative parts them."""
    options = (part or "").split("|")
    return ("" if all(o.startswith(" ") for o in options) else "\0") + " " + ("" if all(o.endswith(" ") for o in options) else "\0")


def _rule(label: str, pattern: str, priority: int, score: float) -> Rule:
    written = pattern.encode().decode("latin-1")  # texts are matched byte by byte
    return Rule(label, re.compile(rf"(?<= )(?:{written})(?= )"), _keywords(pattern), priority, score)


def rules() -> list[Rule]:
    """All rules in order: SPDX tags, grants by name, full names, then bare names. More specific families come first."""
    out = []
    for label, names, tags in FAMILIES:
        exact = any(c.isdigit() for c in label)
        out += [_rule(label, f"spdx license identifier {t}", 0, 1.0) for t in tags]
        out += [_rule(label, _GRANT + n, 1 if exact else 3, 0.95) for n in names]
        out += [_rule(label, n, 2 if exact else 4, 0.8) for n in names]
    out += [_rule(label, text, 1 if len(text.split()) >= 6 else 3, 0.9) for label, text in SIGNATURES]
    for short, tag, words in CC_ELEMENTS:
        for v in CC_VERSIONS:
            label = f"cc-{short}-{v.replace(' ', '.')}"
            out.append(_rule(label, f"cc {tag} {v}", 1, 0.95))
            out.append(_rule(label, f"creative commons {words} {v}(?: international| unported| generic)?", 1, 0.95))
            out.append(_rule(label, f"creativecommons org licenses {tag} {v}", 1, 1.0))
        out.append(_rule(f"cc-{short}", f"creative commons {words}(?: license)?", 4 - len(tag.split()) // 2, 0.8))
        out.append(_rule(f"cc-{short}", f"cc {tag}(?: license)?", 5 - len(tag.split()) // 2, 0.7))
    return sorted(out, key=lambda r: r.priority)


class Scanner:
    def __init__(self) -> None:
        self.rules = rules()
        self.by_key: dict[bytes, list[int]] = {}
        self.ungated: list[int] = []
        frequency: dict[bytes, int] = {}
        for r in self.rules:
            for k in r.keywords:
                frequency[k] = frequency.get(k, 0) + 1
        for i, r in enumerate(self.rules):  # each rule waits for its rarest keyword
            if r.keywords:
                self.by_key.setdefault(min(r.keywords, key=lambda k: (frequency[k], k)), []).append(i)
            else:
                self.ungated.append(i)
        self.keys = frozenset(self.by_key)
        self.base = [(f" {p} ".encode(), frozenset(p.encode().split()), label) for p, label in BASE]

    def detect(self, joined: str, present: set[bytes]) -> list[tuple[int, int, Rule]]:
        """(start, end, rule) of what stays, in order of acceptance."""
        found = []
        for i in sorted({i for k in self.keys & present for i in self.by_key[k]} | set(self.ungated)):
            r = self.rules[i]
            if r.keywords <= present:
                found += [(r.priority, m.start(), -m.end(), i) for m in r.pattern.finditer(joined)]
        out: list[tuple[int, int, Rule]] = []
        begins: list[int] = []  # accepted intervals that lie in no other, in order: their ends ascend too
        ends: list[int] = []
        for _, start, minus, i in sorted(found):
            k = bisect_right(begins, start)
            if k and ends[k - 1] >= -minus:
                continue
            out.append((start, -minus, self.rules[i]))
            k = bisect_left(begins, start)
            covered = k
            while covered < len(ends) and ends[covered] <= -minus:
                covered += 1
            begins[k:covered], ends[k:covered] = [start], [-minus]
        return out

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
        words = text.translate(_FOLD).split()
        present = set(words)
        base = [x for x in self.base if x[1] <= present]
        if not base and self.keys.isdisjoint(present) and not self.ungated:
            return len(words), 0, None, None, "", "", 0.0
        joined = b" " + b" ".join(words) + b" "
        starts: list[int] = []
        base_labels, score = set(), 0.0
        for phrase, _, label in base:
            at = joined.find(phrase)
            seen, upto = 0, 0
            while at >= 0:
                seen += joined.count(b" ", upto, at)
                upto = at
                starts.append(seen)
                base_labels.add(label)
                score = BASE_SCORE
                at = joined.find(phrase, at + 1)
        kept = self.detect(joined.decode("latin-1"), present)
        labels = base_labels | {r.label for _, _, r in kept}
        score = max([score, *(r.score for _, _, r in kept)])
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score


_SCANNER: list[Scanner] = []
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _SCANNER:
        _SCANNER.append(Scanner())
    tool = _SCANNER[0]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    for whole in batches:
        for batch in slices(whole, "body"):
            cols = list(zip(*[tool.scan(x.as_py() or b"") for x in batch.column("body")], strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])


def license_scan(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body")).mapInArrow(scan_batches, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


QUERIES = {"op7_license_scan": query}
