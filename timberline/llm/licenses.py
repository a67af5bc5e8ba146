"""License scans by ordered signature rules, on Spark's own functions only.

Rules are regexes over the words of a text, made from hand-written names and
phrases.  Each begins with a literal keyword; a text is looked at only if it
holds a keyword's stem, a rule only where its keyword stands, and then on the
few words that follow.  Detections are ordered by start, longest first, then by
the rule's priority; one that lies within an earlier one is suppressed.

Contract (op8): words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing
A-Z; base phrases count at every place; base labels always stay.

Edge cases: null or empty text has no words and no labels (''), score 0, first
and last word null; ties of a place go to the rule with the smaller priority,
then label; repeated rows are each scanned; other columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: label, SPDX identifier as words, names as word regexes (the first word literal).
FAMILIES = (
    ("mit", "mit", ("mit", "expat")),
    ("apache-2", "apache 2 0", ("apache license version 2( 0)?", "apache( license)? 2( 0)?", "apache software license( version| v)?( 2| v2)( 0)?")),
    ("apache-1.1", "apache 1 1", ("apache( software)? license( version| v)?( 1| v1) 1",)),
    ("gpl-2", "gpl 2 0( only| or later)?", ("gnu general public license( version| v)?( 2| v2)( 0)?", "gplv2", "gpl( version| v)?( 2| v2)( 0)?")),
    ("gpl-3", "gpl 3 0( only| or later)?", ("gnu general public license( version| v)?( 3| v3)( 0)?", "gplv3", "gpl( version| v)?( 3| v3)( 0)?")),
    ("gpl", "gpl", ("gnu general public license", "gnu gpl", "gpl")),
    ("lgpl-2.1", "lgpl 2 1( only| or later)?", ("gnu lesser general public license( version| v)?( 2| v2) 1", "lgpl( version| v)?( 2| v2) 1")),
    ("lgpl-3", "lgpl 3 0( only| or later)?", ("gnu lesser general public license( version| v)?( 3| v3)( 0)?", "lgplv3", "lgpl( version| v)?( 3| v3)( 0)?")),
    ("lgpl", "lgpl", ("gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl")),
    ("agpl-3", "agpl 3 0( only| or later)?", ("gnu affero general public license( version| v)?( 3| v3)( 0)?", "agplv3", "agpl( version| v)?( 3| v3)( 0)?")),
    ("agpl", "agpl", ("gnu affero general public license", "gnu agpl", "agpl")),
    ("bsd-2", "bsd 2 clause", ("bsd 2 clause", "two clause bsd", "simplified bsd", "freebsd")),
    ("bsd-3", "bsd 3 clause", ("bsd 3 clause", "three clause bsd", "new bsd", "modified bsd", "revised bsd")),
    ("bsd-4", "bsd 4 clause", ("bsd 4 clause", "four clause bsd", "original bsd")),
    ("bsd", "bsd", ("bsd style", "bsd")),
    ("isc", "isc", ("isc", "internet systems consortium")),
    ("mpl-1.1", "mpl 1 1", ("mozilla public license( version| v)?( 1| v1) 1", "mpl 1 1")),
    ("mpl-2", "mpl 2 0", ("mozilla public license( version| v)?( 2| v2)( 0)?", "mpl 2( 0)?")),
    ("epl-1", "epl 1 0", ("eclipse public license( version| v)?( 1| v1)( 0)?", "epl 1( 0)?")),
    ("epl-2", "epl 2 0", ("eclipse public license( version| v)?( 2| v2)( 0)?", "epl 2( 0)?")),
    ("cddl", "cddl 1 [01]", ("common development and distribution license( 1 [01])?", "cddl")),
    ("artistic-2", "artistic 2 0", ("artistic license 2( 0)?", "perl artistic")),
    ("boost-1", "bsl 1 0", ("boost software license( version| v)?( 1| v1)( 0)?", "boost software")),
    ("zlib", "zlib", ("zlib", "zlib libpng")),
    ("unlicense", "unlicense", ("unlicense",)),
    ("wtfpl", "wtfpl", ("wtfpl",)),
    ("psf-2", "psf 2 0|python 2 0", ("python software foundation license( version| v)?( 2| v2)", "psf")),
    ("ofl-1.1", "ofl 1 1", ("sil open font license( version| v)?( 1| v1) 1", "open font license")),
    ("cc0", "cc0 1 0", ("cc0", "creative commons zero", "cc zero")),
    ("cc-by", "cc by [1-4] [05]", ("creative commons attribution", "cc by")),
    ("cc-by-sa", "cc by sa [1-4] [05]", ("creative commons attribution share ?alike", "cc by sa")),
    ("cc-by-nd", "cc by nd [1-4] [05]", ("creative commons attribution no ?deriv(s|atives)", "cc by nd")),
    ("cc-by-nc", "cc by nc [1-4] [05]", ("creative commons attribution non ?commercial", "cc by nc")),
    ("cc-by-nc-sa", "cc by nc sa [1-4] [05]", ("creative commons attribution non ?commercial share ?alike", "cc by nc sa")),
    ("cc-by-nc-nd", "cc by nc nd [1-4] [05]", ("creative commons attribution non ?commercial no ?deriv(s|atives)", "cc by nc nd")),
    ("odbl", "odbl 1 0", ("open database license", "odbl")),
    ("public-domain", "public domain", ("public domain",)),
)
#: Phrases around a name: regex, priority, weight. Where N begins the phrase, its first word is the keyword.
PHRASES = (
    ("N licen[sc]e", 2, 0.7),
    ("licensed under( the)?( terms of the)? N( licen[sc]e)?", 1, 0.95),
    ("released under( the)?( terms of the)? N( licen[sc]e)?", 1, 0.95),
    ("distributed under( the)?( terms of the)? N( licen[sc]e)?", 1, 0.95),
    ("available under( the)?( terms of the)? N( licen[sc]e)?", 1, 0.9),
    ("under( the)?( terms of the)? N( licen[sc]e)", 2, 0.85),
    ("license N( licen[sc]e)?", 3, 0.6),
)
#: Rules by themselves: label, regex, priority, weight.
SINGLE = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 0, 1.0),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 0, 1.0),
    ("bsd", "redistribution and use in source and binary forms with or without modification", 0, 1.0),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license", 0, 1.0),
    ("public-domain", "dedicated to the public domain", 1, 0.9),
    ("public-domain", "released into the public domain", 1, 0.9),
    ("proprietary", "all rights reserved", 4, 0.3),
    ("cc-by-nc", "cc by nc", 3, 0.9),
    # notices
    ("apache-2", "compliance with the license you may obtain a copy of the license at( http| https)?( www)? apache org licenses license 2 0", 0, 1.0),
    ("apache-2", "apache org licenses license 2 0", 1, 0.95),
    ("gpl-2", "either version 2 of the license or at your option any later version", 1, 0.8),
    ("gpl-3", "either version 3 of the license or at your option any later version", 1, 0.8),
    ("gpl", "received a copy of the gnu general public license along with this (program|software|library)", 0, 0.95),
    ("lgpl", "received a copy of the gnu lesser general public license along with this (program|software|library)", 0, 0.95),
    ("agpl", "received a copy of the gnu affero general public license along with this (program|software)", 0, 0.95),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 1, 0.8),
    ("mpl-2", "subject to the terms of the mozilla public license( v)?( 2| v2) 0", 0, 1.0),
    ("mpl-1.1", "subject to the mozilla public license version 1 1", 0, 1.0),
    ("epl-1", "available under the terms of the eclipse public license v1 0", 0, 1.0),
    ("epl-2", "available under the terms of the eclipse public license 2 0", 0, 1.0),
    ("cddl", "subject to the terms of the common development and distribution license", 0, 1.0),
    ("mit", "copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0, 1.0),
    ("isc", "copyright notice and this permission notice appear in all copies", 0, 1.0),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0, 1.0),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", 0, 0.9),
    ("bsd-3", "derived from this software without specific prior written permission", 0, 0.95),
    ("boost-1", "obtaining a copy of the software and accompanying documentation covered by this license", 0, 1.0),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications", 0, 1.0),
    ("unlicense", "free and unencumbered software released into the public domain", 0, 1.0),
    ("proprietary", "proprietary and confidential all rights reserved", 3, 0.6),
    ("proprietary", "reproduced( distributed or transmitted)? in any form or by any means without the prior written permission", 3, 0.6),
    ("proprietary", "licensed not sold", 3, 0.5),
    # titles of license texts
    ("apache-2", "apache license version 2 0 january 2004", 0, 1.0),
    ("gpl-2", "gnu general public license version 2 june 1991", 0, 1.0),
    ("gpl-3", "gnu general public license version 3 29 june 2007", 0, 1.0),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999", 0, 1.0),
    ("lgpl-3", "gnu lesser general public license version 3 29 june 2007", 0, 1.0),
    ("agpl-3", "gnu affero general public license version 3 19 november 2007", 0, 1.0),
    ("gfdl", "gnu free documentation license", 0, 0.9),
    ("boost-1", "boost software license version 1 0 august 17th 2003", 0, 1.0),
    ("ofl-1.1", "sil open font license version 1 1 26 february 2007", 0, 1.0),
    ("wtfpl", "what the fuck you want to public license", 0, 1.0),
    ("eupl", "european union public licen[sc]e", 0, 0.9),
    ("ms-pl", "microsoft public license", 0, 0.9),
    ("ms-rl", "microsoft reciprocal license", 0, 0.9),
    ("cpl-1", "common public license( version)?( 1 0)?", 0, 0.9),
    ("ipl-1", "ibm public license( version)?( 1 0)?", 0, 0.9),
    ("qpl", "q public license", 0, 0.9),
    ("afl", "academic free license", 0, 0.9),
    ("osl", "open software license", 0, 0.9),
    ("ecl-2", "educational community license( version)?( 2 0)?", 0, 0.9),
    ("ncsa", "university of illinois ncsa open source license", 0, 0.95),
    ("openssl", "openssl license", 0, 0.9),
    ("php", "php license( version 3 0?1)?", 0, 0.9),
    ("ruby", "ruby license", 0, 0.8),
    ("vim", "vim license", 0, 0.8),
    ("w3c", "w3c software( notice and)? license", 0, 0.9),
    ("sspl-1", "server side public license", 0, 0.9),
    ("bsl-1.1", "business source license( version)?( 1 1)?", 0, 0.9),
    ("elastic-2", "elastic license( version)? 2( 0)?", 0, 0.9),
    ("polyform-noncommercial", "polyform noncommercial license", 0, 0.9),
    ("openrail", "open rail( [ms])? license", 0, 0.9),
    ("openrail", "openrail( [ms])? license", 0, 0.9),
    ("gpl-cpe", "gpl( v?2)?( 0)? with( the)? classpath exception", 0, 0.9),
    ("mulan-2", "mulan permissive software license", 0, 0.9),
    ("0bsd", "zero clause bsd license", 0, 0.9),
    ("blueoak-1", "blue oak model license", 0, 0.9),
    ("cecill", "cecill( [abc])? licen[sc]e", 0, 0.9),
    ("upl-1", "universal permissive license", 0, 0.9),
    # addresses
    ("cc0", "creativecommons org publicdomain zero( 1 0)?", 0, 0.95),
    ("cc-by", "creativecommons org licenses by( [1-4] [05])?", 1, 0.95),
    ("cc-by-sa", "creativecommons org licenses by sa( [1-4] [05])?", 0, 0.95),
    ("cc-by-nd", "creativecommons org licenses by nd( [1-4] [05])?", 0, 0.95),
    ("cc-by-nc", "creativecommons org licenses by nc( [1-4] [05])?", 0, 0.95),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa( [1-4] [05])?", 0, 0.95),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd( [1-4] [05])?", 0, 0.95),
    ("cc-by", "licensed under a creative commons attribution( [1-4] [05])?( international| unported)? license", 0, 1.0),
    ("odbl", "opendatacommons org licenses odbl", 0, 0.95),
    ("unlicense", "unlicense org", 1, 0.9),
    ("mpl-2", "mozilla org mpl( mpl)?( 2 0)?( licen[sc]e)", 1, 0.9),
    # in few words
    ("gpl-2", "gplv2 only licen[sc]ed?", 1, 0.7),
    ("gpl", "gpl licen[sc]ed", 1, 0.7),
    ("mit", "mit licen[sc]ed", 1, 0.7),
    ("bsd", "bsd licen[sc]ed", 1, 0.7),
    ("apache-2", "apache 2( 0)? licen[sc]ed", 1, 0.7),
    ("proprietary", "commercial licen[sc]e (required|only)", 3, 0.5),
)
#: Stems of the keywords; a text without any holds no rule and no base phrase.
PREFILTER = r"(?i)licen[sc]|cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by|cc0|creative|gpl|permission|redistribution|public[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+domain|rights[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+reserved|under[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|free[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+software|spdx"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    key: str
    pattern: str
    label: str
    priority: int
    weight: float


def _rule(label: str, pattern: str, priority: int, weight: float) -> Rule:
    return Rule(pattern.split(" ")[0].split("(")[0], pattern, label, priority, weight)


def rules() -> list[Rule]:
    out = [_rule(label, pattern, priority, weight) for label, pattern, priority, weight in SINGLE]
    for label, spdx, names in FAMILIES:
        out.append(_rule(label, f"spdx license identifier ({spdx})", 0, 1.0))
        for name in names:
            out += [_rule(label, phrase.replace("N", name, 1) if phrase.startswith("N") else phrase.replace("N", f"({name})", 1), priority, weight) for phrase, priority, weight in PHRASES]
    return out


#: Words of the longest rule: what a rule has to see from its first word on.
WINDOW_WORDS = max(len(r.pattern.split(" ")) for r in rules())


def words_of(text: Column) -> Column:
    """The words of a text, as an array."""
    return F.filter(F.split(F.regexp_replace(F.translate(text, _UPPER, _LOWER), SEPARATOR, " "), " "), lambda w: w != "")


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _base_places(phrase: str) -> str:
    """SQL: where the words of a phrase begin, in the array words."""
    p = phrase.split(" ")
    return f"filter(starts, i -> words[i] = '{p[0]}' AND " + " AND ".join(f"get(words, i + {j}) = '{w}'" for j, w in enumerate(p) if j) + ")"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base places and labels, all labels, and score of every row."""
    table = rules()
    keys = sorted({r.key for r in table})
    rule_array = "array(" + ",".join(f"named_struct('key','{r.key}','pattern',{_sql('^(' + r.pattern + ')(?: |$)')},'label','{r.label}','priority',{r.priority},'weight',{r.weight}D)" for r in table) + ")"
    maybe = F.coalesce(F.col("text"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), maybe)
    rows = rows.select("doc_id", F.regexp_count("text", F.lit(_ANY_WORD)).cast("long").alias("n_words"), F.when(F.col("text").rlike(PREFILTER), words_of(F.col("text"))).alias("words"))
    starts = F.expr("CASE WHEN size(words) > 0 THEN sequence(0, size(words) - 1) END")
    rows = rows.withColumn("starts", starts)
    rows = rows.withColumn("base", F.expr("CASE WHEN starts IS NOT NULL THEN array(" + ",".join(_base_places(p) for p, _ in BASE) + ") END"))
    key_list = ",".join(f"'{k}'" for k in keys)
    places = f"filter(starts, i -> words[i] IN ({key_list}))"
    at_place = f"""transform(filter({rule_array}, r -> r.key = words[i] AND rlike(w, r.pattern)), r ->
        named_struct('start', i, 'neg_end', -(i + size(split(regexp_extract(w, r.pattern, 1), ' '))), 'priority', r.priority, 'label', r.label, 'weight', r.weight))"""
    with_window = f"flatten(transform(transform({places}, i -> named_struct('i', i, 'w', array_join(slice(words, i + 1, {WINDOW_WORDS}), ' '))), p -> {at_place.replace('(w,', '(p.w,').replace('words[i]', 'words[p.i]').replace(' i,', ' p.i,').replace('(i +', '(p.i +')}))"
    rows = rows.withColumn("found", F.expr(f"CASE WHEN starts IS NOT NULL THEN array_sort({with_window}) END"))
    fold = """aggregate(found, named_struct('upto', -1, 'labels', cast(array() as array<string>), 'weight', 0D), (acc, x) ->
        CASE WHEN -x.neg_end <= acc.upto THEN acc ELSE named_struct('upto', -x.neg_end, 'labels', array_union(acc.labels, array(x.label)), 'weight', greatest(acc.weight, x.weight)) END)"""
    rows = rows.withColumn("kept", F.expr(f"CASE WHEN size(found) > 0 THEN {fold} END"))
    labels = F.expr("array_compact(array(" + ",".join(f"CASE WHEN size(base[{k}]) > 0 THEN '{label}' END" for k, (_, label) in enumerate(BASE)) + "))")
    every = F.expr("flatten(base)")
    return rows.select(
        "doc_id",
        "n_words",
        F.greatest(F.coalesce(F.size(every), F.lit(0)), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.coalesce(F.array_join(F.array_sort(labels), ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join(F.array_sort(F.array_union(labels, F.coalesce(F.col("kept.labels"), F.expr("cast(array() as array<string>)")))), ","), F.lit("")).alias("labels"),
        F.greatest(F.coalesce(F.col("kept.weight"), F.lit(0.0)), F.when(F.size(every) > 0, F.lit(0.9)).otherwise(F.lit(0.0))).alias("score"),
    )


def _duck_rules() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quote(r.key)}, {quote('^(' + r.pattern + ')(?: |$)')}, {quote(r.label)}, {r.priority}, {r.weight})" for r in rules())


ORACLE_SQL = f"""
WITH rules(key, pattern, label, priority, weight) AS (VALUES {_duck_rules()}
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), p AS (SELECT rid, w, unnest(range(0, len(w))) AS i FROM d
), b AS (
  SELECT rid, i, label FROM p, (VALUES {", ".join(f"('{p}', '{label}')" for p, label in BASE)}) AS base(phrase, label)
  WHERE w[i + 1] = string_split(phrase, ' ')[1] AND list_slice(w, i + 1, i + len(string_split(phrase, ' '))) = string_split(phrase, ' ')
), bb AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM b GROUP BY rid
), k AS (SELECT rid, i, array_to_string(list_slice(w, i + 1, i + {WINDOW_WORDS}), ' ') AS t, w[i + 1] AS key FROM p WHERE w[i + 1] IN (SELECT key FROM rules)
), f AS (
  SELECT rid, i AS s, i + len(string_split(regexp_extract(t, pattern, 1), ' ')) AS e, priority, label, weight FROM k JOIN rules USING (key) WHERE regexp_matches(t, pattern)
), g AS (
  SELECT *, max(e) OVER (PARTITION BY rid ORDER BY s, e DESC, priority, label, weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM f
), h AS (SELECT rid, list(DISTINCT label) AS labels, max(weight) AS weight FROM g WHERE upto IS NULL OR e > upto GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(bb.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bb.labels, []), coalesce(h.labels, [])))), ','), '') AS labels,
  CAST(greatest(coalesce(h.weight, 0), CASE WHEN n_base > 0 THEN 0.9 ELSE 0 END) AS DOUBLE) AS score
FROM d LEFT JOIN bb USING (rid) LEFT JOIN h USING (rid)
"""
