"""License scans by ordered signature rules, in SQL functions only.

A text becomes its words; the few that are keywords decide which rules are tried at all. Rules are
regular expressions over words (titles, tags, notices, addresses, signature sentences). Detections
that lie inside a detection of the same or a higher rank are suppressed by one sweep over their
starts. Everything happens inside the row: no shuffle, no Python.

Defined results: NULL counts as the empty text, which has no words and score 0; repeated rows get
equal results; a text of any length is scanned whole; other columns are not read. Overlapping
places of different rules all count; places of one rule do not overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.common import ascii_lower

# The contract's phrases and labels, fixed values.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_V = "(?:version |v )?"
#: label: (keyword, titles as word expressions, words of its tag). A title is the longest first.
TITLES: dict[str, tuple[str, list[str], str]] = {
    "gpl-1.0": ("1", [f"gnu general public license {_V}1(?: 0)?", "gpl ?v? ?1(?: 0)?"], "gpl 1 0(?: only| or later)?"),
    "gpl-2.0": ("gnu|gpl|gplv2", [f"gnu general public license {_V}2(?: 0)?", "gnu gpl v? ?2(?: 0)?", "gpl 2(?: 0)?", "gplv2"], "gpl 2 0(?: only| or later)?"),
    "gpl-3.0": ("gnu|gpl|gplv3", [f"gnu general public license {_V}3(?: 0)?", "gnu gpl v? ?3(?: 0)?", "gpl 3(?: 0)?", "gplv3"], "gpl 3 0(?: only| or later)?"),
    "lgpl-2.0": ("gnu|lgpl", [f"gnu library general public license(?: {_V}2(?: 0)?)?"], "lgpl 2 0(?: only| or later)?"),
    "lgpl-2.1": ("gnu|lgpl|lgplv2", [f"gnu lesser general public license {_V}2 1", "lgpl 2 1", "lgplv2 1"], "lgpl 2 1(?: only| or later)?"),
    "lgpl-3.0": ("gnu|lgpl|lgplv3", [f"gnu lesser general public license {_V}3(?: 0)?", "lgpl 3(?: 0)?", "lgplv3"], "lgpl 3 0(?: only| or later)?"),
    "agpl-3.0": ("gnu|agpl|agplv3|affero", [f"gnu affero general public license(?: {_V}3(?: 0)?)?", "affero general public license", "agpl 3(?: 0)?", "agplv3"], "agpl 3 0(?: only| or later)?"),
    "gfdl-1.3": ("gnu|gfdl", [f"gnu free documentation license(?: {_V}1 [123])?"], "gfdl 1 3(?: only| or later)?"),
    "apache-1.1": ("apache", [f"apache (?:software )?license {_V}1 1"], "apache 1 1"),
    "apache-2.0": ("apache", [f"apache (?:software )?license {_V}2(?: 0)?", "apache 2(?: 0)? license", "apache license 2(?: 0)?"], "apache 2 0"),
    "mit-0": ("mit", ["mit no attribution(?: license)?", "mit 0 license"], "mit 0"),
    "mit": ("mit|expat", ["expat license", "mit x11 license", "mit open source license"], "mit"),
    "x11": ("x11", ["x11 license", "x consortium license"], "x11"),
    "bsd-0-clause": ("bsd|0bsd", ["0bsd license", "zero clause bsd(?: license)?", "bsd zero clause(?: license)?"], "0bsd"),
    "bsd-2-clause": ("bsd|freebsd", ["(?:bsd )?2 clause bsd(?: license)?", "bsd 2 clause(?: license)?", "simplified bsd license", "freebsd license"], "bsd 2 clause"),
    "bsd-3-clause": ("bsd", ["3 clause bsd(?: license)?", "bsd 3 clause(?: license)?", "new bsd license", "modified bsd license", "revised bsd license"], "bsd 3 clause"),
    "bsd-4-clause": ("bsd", ["4 clause bsd(?: license)?", "bsd 4 clause(?: license)?", "original bsd license"], "bsd 4 clause"),
    "mpl-1.1": ("mozilla|mpl", [f"mozilla public license {_V}1 1", "mpl 1 1"], "mpl 1 1"),
    "mpl-2.0": ("mozilla|mpl", [f"mozilla public license {_V}2(?: 0)?", "mpl 2(?: 0)?"], "mpl 2 0"),
    "epl-1.0": ("eclipse|epl", [f"eclipse public license {_V}1(?: 0)?", "epl 1 0"], "epl 1 0"),
    "epl-2.0": ("eclipse|epl", [f"eclipse public license {_V}2(?: 0)?", "epl 2 0"], "epl 2 0"),
    "cddl-1.0": ("cddl|distribution", ["common development and distribution license(?: version)?(?: 1 0)?", "cddl 1 0"], "cddl 1 0"),
    "cpl-1.0": ("common", ["common public license(?: version)?(?: 1 0)?"], "cpl 1 0"),
    "ipl-1.0": ("ibm", ["ibm public license(?: version)?(?: 1 0)?"], "ipl 1 0"),
    "eupl-1.2": ("eupl|european", ["european union public licen[cs]e(?: v ?1 [12])?", "eupl 1 [12]"], "eupl 1 [12]"),
    "artistic-1.0": ("artistic", ["artistic license 1(?: 0)?"], "artistic 1 0(?: perl)?"),
    "artistic-2.0": ("artistic", ["artistic license 2(?: 0)?"], "artistic 2 0"),
    "bsl-1.0": ("boost", ["boost software license(?: version)?(?: 1 0)?"], "bsl 1 0"),
    "busl-1.1": ("business", ["business source license(?: version)?(?: 1 1)?"], "busl 1 1"),
    "sspl-1.0": ("sspl|server", ["server side public license(?: version| v)?(?: 1)?", "sspl"], "sspl 1 0"),
    "elastic-2.0": ("elastic", ["elastic license(?: version)?(?: 2(?: 0)?)?"], "elastic 2 0"),
    "isc": ("isc", ["isc license", "internet systems consortium license"], "isc"),
    "zlib": ("zlib", ["zlib license", "zlib libpng license"], "zlib"),
    "libpng": ("libpng", ["libpng license"], "libpng(?: 2 0)?"),
    "openssl": ("openssl", ["openssl license"], "openssl"),
    "curl": ("curl", ["curl license"], "curl"),
    "ftl": ("freetype", ["freetype (?:project )?license"], "ftl"),
    "ijg": ("ijg|jpeg", ["independent jpeg group license"], "ijg"),
    "ncsa": ("ncsa|illinois", ["university of illinois ncsa open source license", "ncsa license"], "ncsa"),
    "psf-2.0": ("python", ["python software foundation license(?: version)?(?: 2)?"], "(?:psf|python) 2 0"),
    "php-3.01": ("php", ["php license(?: version)?(?: 3 01)?"], "php 3 01"),
    "ruby": ("ruby", ["ruby license", "ruby s license"], "ruby"),
    "vim": ("vim", ["vim license"], "vim"),
    "w3c": ("w3c", ["w3c software (?:notice and )?license"], "w3c"),
    "unicode": ("unicode", ["unicode (?:inc )?license agreement", "unicode terms of use"], "unicode dfs 2016"),
    "unlicense": ("unlicense", ["the unlicense", "unlicense org"], "unlicense"),
    "wtfpl": ("wtfpl", ["do what the fuck you want to public license", "wtfpl"], "wtfpl"),
    "beerware": ("beerware|beer", ["beer ?ware license"], "beerware"),
    "postgresql": ("postgresql", ["postgresql licen[cs]e"], "postgresql"),
    "ofl-1.1": ("ofl|sil", ["sil open font license(?: version)?(?: 1 1)?", "ofl 1 1"], "ofl 1 1"),
    "odbl-1.0": ("odbl|database", ["open (?:data commons open )?database license(?: v ?1 0)?", "odbl"], "odbl 1 0"),
    "odc-by-1.0": ("commons", ["open data commons attribution license(?: v ?1 0)?"], "odc by 1 0"),
    "pddl-1.0": ("pddl|domain", ["public domain dedication and license(?: v ?1 0)?", "pddl"], "pddl 1 0"),
    "cc0-1.0": ("cc0", ["cc0 1 0(?: universal)?", "cc0 public domain dedication", "cc0"], "cc0 1 0"),
    "cc-by-nc-nd": ("cc|creative", [r"cc by nc nd(?: \d(?: \d)?)?", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: \d \d)?"], r"cc by nc nd \d \d"),
    "cc-by-nc-sa": ("cc|creative", [r"cc by nc sa(?: \d(?: \d)?)?", r"creative commons attribution non ?commercial share ?alike(?: \d \d)?"], r"cc by nc sa \d \d"),
    "cc-by-nc": ("cc|creative", [r"cc by nc(?: \d(?: \d)?)?", r"creative commons attribution non ?commercial(?: \d \d)?"], r"cc by nc \d \d"),
    "cc-by-nd": ("cc|creative", [r"cc by nd(?: \d(?: \d)?)?", r"creative commons attribution no ?deriv(?:ative)?s(?: \d \d)?"], r"cc by nd \d \d"),
    "cc-by-sa": ("cc|creative", [r"cc by sa(?: \d(?: \d)?)?", r"creative commons attribution share ?alike(?: \d \d)?"], r"cc by sa \d \d"),
    "cc-by-4.0": ("cc|creative", ["cc by 4(?: 0)?", "creative commons attribution 4 0"], "cc by 4 0"),
    "cc-by-3.0": ("cc|creative", ["cc by 3(?: 0)?", "creative commons attribution 3 0"], "cc by 3 0"),
    "ms-pl": ("microsoft", ["microsoft public license"], "ms pl"),
    "ms-rl": ("microsoft", ["microsoft reciprocal license"], "ms rl"),
    "osl-3.0": ("osl|open", ["open software license(?: version| v)?(?: 3 0)?", "osl 3 0"], "osl 3 0"),
    "afl-3.0": ("academic", ["academic free license(?: version| v)?(?: 3 0)?"], "afl 3 0"),
    "ecl-2.0": ("educational", ["educational community license(?: version)?(?: 2 0)?"], "ecl 2 0"),
    "mulan-psl-2.0": ("mulan", ["mulan permissive software license(?: v ?2)?", "mulan psl v ?2"], "mulanpsl 2 0"),
    "openrail-m": ("openrail|bigscience", ["bigscience (?:open )?rail license", "openrail m license"], "openrail m?"),
    "llama-2": ("llama", ["llama 2 community license(?: agreement)?"], "llama 2"),
}

#: label: (keywords that must all be there, sentence). Sentences by which a full text or a notice is known.
SENTENCES: list[tuple[str, list[str], str]] = [
    ("mit", ["permission", "hereby"], "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", ["software", "warranty"], "the software is provided as is without warranty of any kind express or implied"),
    ("isc", ["permission", "hereby"], "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", ["redistribution", "binary"], "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", ["endorse", "promote"], "neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", ["advertising", "acknowledgement"], "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("apache-2.0", ["compliance", "license"], "you may not use this file except in compliance with the license"),
    ("apache-2.0", ["asf", "license"], "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", ["distributed", "license"], "distributed under the license is distributed on an as is basis"),
    ("gpl-or-later", ["redistribute", "gnu"], "you can redistribute it and or modify it under the terms of the gnu (?:lesser |library |affero )?general public license as published by the free software foundation"),
    ("gpl-or-later", ["option", "later"], r"either version \d(?: \d)? of the license or at your option any later version"),
    ("gpl", ["merchantability", "gnu"], "see the gnu (?:lesser |library |affero )?general public license for more details"),
    ("gpl-3.0", ["propagate", "verbatim"], "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("mpl-2.0", ["source", "mozilla"], r"this source code form is subject to the terms of the mozilla public license v ?\d \d"),
    ("mpl-1.1", ["contents", "mozilla"], "the contents of this file are subject to the mozilla public license"),
    ("epl", ["accompanying", "eclipse"], "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl-1.0", ["contents", "common"], "the contents of this file are subject to the terms of the common development and distribution license"),
    ("unlicense", ["unencumbered", "domain"], "this is free and unencumbered software released into the public domain"),
    ("zlib", ["altered", "misrepresented"], "the origin of this software must not be misrepresented"),
    ("zlib", ["altered", "marked"], "altered source versions must be plainly marked as such"),
    ("bsl-1.0", ["boost", "distributed"], "distributed under the boost software license"),
    ("cc0-1.0", ["waived", "copyright"], "has waived all copyright and related or neighboring rights"),
    ("cc-by", ["creative", "commons"], "licensed under a creative commons attribution"),
    ("public-domain", ["domain", "public"], "(?:released|placed|dedicated|is) (?:in |into |to )?(?:the )?public domain"),
    ("proprietary", ["rights", "reserved"], "all rights reserved"),
    ("proprietary", ["confidential", "proprietary"], "(?:confidential and proprietary|proprietary and confidential)"),
    ("openssl", ["openssl", "toolkit"], "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ofl-1.1", ["font", "sil"], "this font software is licensed under the sil open font license"),
    ("psf-2.0", ["python", "agreement"], "this license agreement is between the python software foundation"),
    ("gfdl-1.3", ["invariant", "gnu"], "with no invariant sections no front cover texts and no back cover texts"),
    ("wtfpl", ["fuck", "want"], "you just do what the fuck you want to"),
    ("beerware", ["beer", "stuff"], "you think this stuff is worth it you can buy me a beer"),
    ("artistic-2.0", ["artistic", "terms"], "under the (?:terms of the )?artistic license 2 0"),
    ("perl", ["perl", "terms"], "under the same terms as perl itself"),
]

_GRANT = "(?:licensed|released|distributed|published|available|provided|covered) under (?:the )?(?:terms of )?(?:the )?(?:an? )?"
REFERENCE, TAG, NOTICE, SENTENCE = 1, 2, 3, 4
_SURE = {REFERENCE: 0.6, TAG: 0.95, NOTICE: 0.9, SENTENCE: 1.0}


def rules() -> list[tuple[str, int, bool, list[list[str]], str]]:
    """(label, rank, is base, keywords, expression over words). Keywords: one of each inner list has to
    be among the words. In order: base phrases, titles, tags, notices, sentences."""
    out = [(label, REFERENCE, True, [[w] for w in phrase.split()], phrase) for phrase, label in BASE.items()]
    for label, (keys, titles, tag) in TITLES.items():
        one = keys.split("|")
        out += [(label, REFERENCE, False, [one], t) for t in titles]
        out.append((label, TAG, False, [["spdx"]], f"spdx license identifier {tag}"))
        out.append((label, NOTICE, False, [one, ["under"]], f"{_GRANT}(?:{'|'.join(titles)})"))
    for phrase, label in BASE.items():
        out.append((label, NOTICE, False, [[w] for w in phrase.split()] + [["under"]], f"{_GRANT}{phrase}"))
    return out + [(label, SENTENCE, False, [[k] for k in keys], s) for label, keys, s in SENTENCES]


def _numbered(expression: str) -> str:
    """The expression over a text in which `#` and its number follow every word."""
    out = expression.replace(".{1,80}?", r"(?:[^#]+#\d+ ){1,12}?[^#]+").replace(" ?", "(?:#\\d+ )?")
    marked, i = [], 0
    while i < len(out):
        if out[i] == " " and not out[:i].endswith(r"#\d+"):
            marked.append(r"#\d+ ")
        else:
            marked.append(out[i])
        i += 1
    return r"(?<![^ ])(?:" + "".join(marked) + r")#\d+(?![^ ])"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rule_sql() -> str:
    def one(label: str, rank: int, base: bool, keys: list[list[str]], expression: str) -> str:
        groups = ", ".join("array(" + ", ".join(map(_quoted, sorted(k))) + ")" for k in keys)
        return (
            f"named_struct('label', {_quoted(label)}, 'rank', {rank}, 'base', {str(base).lower()}, "
            f"'sure', {_SURE[rank]}D, 'keys', array({groups}), 're', {_quoted(_numbered(expression))})"
        )

    return "array(" + ", ".join(one(*r) for r in rules()) + ")"


def _keyword_pattern() -> str:
    """All keywords as one expression, by first letter."""
    by: dict[str, list[str]] = {}
    for k in sorted({k for r in rules() for group in r[3] for k in group}):
        by.setdefault(k[0], []).append(k[1:])
    return "(?<![^ ])(?:" + "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in by.items()) + ")(?![^ ])"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, n_detections (those that were not suppressed)."""
    plain = F.trim(F.regexp_replace(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    words = docs.select(F.col("doc_id"), plain.alias("_plain"))
    words = words.select(
        "doc_id",
        F.expr("IF(_plain = '', 0L, CAST(length(_plain) - length(replace(_plain, ' ', '')) + 1 AS BIGINT))").alias("n_words"),
        F.expr(f"array_distinct(regexp_extract_all(_plain, {_quoted(_keyword_pattern())}, 0))").alias("_found"),
        "_plain",
    )
    tried = words.withColumn(
        "_tried",
        F.expr(f"filter(IF(size(_found) = 0, array(), {_rule_sql()}), r -> forall(r.keys, k -> arrays_overlap(k, _found)))"),
    )
    numbered = tried.select(
        "doc_id",
        "n_words",
        "_tried",
        F.expr("IF(size(_tried) = 0, '', array_join(transform(split(_plain, ' '), (w, i) -> concat(w, '#', i)), ' '))").alias("_numbered"),
    )
    detections = F.expr(
        "array_sort(flatten(transform(_tried, r -> transform(regexp_extract_all(_numbered, r.re, 0), m -> named_struct("
        "'start', CAST(regexp_extract(m, '#([0-9]+)', 1) AS INT), "
        "'last', CAST(regexp_extract(m, '#([0-9]+)$', 1) AS INT), "
        "'rank', r.rank, 'label', r.label, 'base', r.base, 'sure', r.sure)))), "
        "(a, b) -> CASE WHEN a.start != b.start THEN a.start - b.start WHEN a.last != b.last THEN b.last - a.last "
        "WHEN a.rank != b.rank THEN b.rank - a.rank WHEN a.label < b.label THEN -1 WHEN a.label > b.label THEN 1 ELSE 0 END)"
    )
    # along the starts, the largest end so far per least rank tells whether a detection lies inside another
    reach = ", ".join(f"'e{k}', greatest(s.e{k}, IF(d.rank >= {k}, d.last, -1))" for k in range(1, 5))
    inside = "CASE d.rank " + " ".join(f"WHEN {k} THEN s.e{k}" for k in range(1, 5)) + " END >= d.last"
    sweep = (
        "aggregate(_all, named_struct('e1', -1, 'e2', -1, 'e3', -1, 'e4', -1, 'labels', CAST(array() AS ARRAY<STRING>), "
        f"'sure', 0D, 'n', 0L), (s, d) -> named_struct({reach}, "
        f"'labels', IF({inside}, s.labels, array_union(s.labels, array(d.label))), "
        f"'sure', IF({inside}, s.sure, greatest(s.sure, d.sure)), 'n', IF({inside}, s.n, s.n + 1)))"
    )
    found = numbered.select("doc_id", "n_words", detections.alias("_all"))
    found = found.select("doc_id", "n_words", F.expr("filter(_all, d -> d.base)").alias("_base"), F.expr(sweep).alias("_kept"))
    base = "array_distinct(transform(_base, d -> d.label))"
    return found.select(
        "doc_id",
        "n_words",
        F.expr("CAST(size(_base) AS BIGINT)").alias("n_base"),
        F.expr("CAST(array_min(transform(_base, d -> d.start)) AS BIGINT)").alias("first_word"),
        F.expr("CAST(array_max(transform(_base, d -> d.start)) AS BIGINT)").alias("last_word"),
        F.expr(f"array_join(array_sort({base}), ',')").alias("base_labels"),
        F.expr(f"array_join(array_sort(array_union({base}, _kept.labels)), ',')").alias("labels"),
        F.expr("_kept.sure").alias("score"),
        F.expr("_kept.n").alias("n_detections"),
    )
