"""License scans: sentences, normalised, are mapped to known licence-sentence identifiers, and the
sequence of identifiers of a text is matched against ordered licence rules. Column expressions only."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.spread import pick

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Normalised sentences of public licence notices and their identifiers.
SENTENCES = (
    ("ApacheRef", "licensed under the apache license version 2 0"),
    ("ApacheRef", "released under the apache license version 2 0"),
    ("ApacheHead", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("ApacheCopy", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("ApacheCopy", "you may obtain a copy of the license at"),
    ("ApacheCopy", "you may obtain a copy of the license at https www apache org licenses license 2 0"),
    ("ApacheAsIs", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("ApacheEnd", "see the license for the specific language governing permissions and limitations under the license"),
    ("MITRef", "released under the mit license"),
    ("MITRef", "licensed under the mit license"),
    ("MITRef", "this project is licensed under the mit license"),
    ("MITGrant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("MITNotice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MITAsIs", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("MITNoLiability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("ISCGrant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("GPL2Ref", "this work is licensed under the gnu general public license version 2"),
    ("GPL3Ref", "this work is licensed under the gnu general public license version 3"),
    ("GPL3Ref", "licensed under the gnu general public license version 3"),
    ("LGPL3Ref", "licensed under the gnu lesser general public license version 3"),
    ("AGPL3Ref", "licensed under the gnu affero general public license version 3"),
    ("GPL2Grant", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("GPL3Grant", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GPLHope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GPLMore", "see the gnu general public license for more details"),
    ("GPLCopy", "you should have received a copy of the gnu general public license along with this program"),
    ("BSDGrant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSDSource", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BSDBinary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("BSDNames", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSDRef3", "licensed under the 3 clause bsd license"),
    ("BSDRef2", "licensed under the 2 clause bsd license"),
    ("MPL2Ref", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("CCBYRef", "licensed under cc by 4 0"),
    ("CCBYSARef", "licensed under cc by sa 4 0"),
    ("CCBYNCRef", "licensed under cc by nc 4 0"),
    ("CC0Ref", "licensed under cc0 1 0"),
    ("UnlicenseFree", "this is free and unencumbered software released into the public domain"),
)
# Ordered rules, longer ones first; a rule's identifiers follow each other among the recognised sentences.
RULES = (
    ("Apache-2.0", ("ApacheHead", "ApacheCopy", "ApacheAsIs", "ApacheEnd")),
    ("MIT", ("MITGrant", "MITNotice", "MITAsIs", "MITNoLiability")),
    ("BSD-3-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDNames")),
    ("BSD-2-Clause", ("BSDGrant", "BSDSource", "BSDBinary")),
    ("GPL-3.0-or-later", ("GPL3Grant", "GPLHope", "GPLMore", "GPLCopy")),
    ("GPL-2.0-or-later", ("GPL2Grant", "GPLHope", "GPLMore", "GPLCopy")),
    ("GPL-3.0-or-later", ("GPL3Grant",)),
    ("GPL-2.0-or-later", ("GPL2Grant",)),
    ("Apache-2.0", ("ApacheHead",)),
    ("Apache-2.0", ("ApacheRef",)),
    ("MIT", ("MITGrant", "MITNotice")),
    ("MIT", ("MITRef",)),
    ("ISC", ("ISCGrant",)),
    ("GPL-2.0", ("GPL2Ref",)),
    ("GPL-3.0", ("GPL3Ref",)),
    ("LGPL-3.0", ("LGPL3Ref",)),
    ("AGPL-3.0", ("AGPL3Ref",)),
    ("BSD-3-Clause", ("BSDRef3",)),
    ("BSD-2-Clause", ("BSDRef2",)),
    ("MPL-2.0", ("MPL2Ref",)),
    ("CC-BY-4.0", ("CCBYRef",)),
    ("CC-BY-SA-4.0", ("CCBYSARef",)),
    ("CC-BY-NC-4.0", ("CCBYNCRef",)),
    ("CC0-1.0", ("CC0Ref",)),
    ("Unlicense", ("UnlicenseFree",)),
)


def sentences(text: Column) -> Column:
    """Sentences end at a line break, or at ``.``, ``!``, ``?`` or ``;`` before white space; each in lower case with single spaces between runs of letters and digits."""
    broken = F.split(F.regexp_replace(text, r"([.!?;])[ \t\r]+", "$1\n"), r"\n+")
    plain = F.transform(broken, lambda s: F.trim(F.regexp_replace(F.translate(s, UPPER, LOWER), "[^0-9a-z]+", " ")))
    return F.filter(plain, lambda s: s != "")


def identifiers(text: Column, known: tuple[tuple[str, str], ...] = SENTENCES) -> Column:
    """The identifiers of the recognised sentences in order, as ``,A,B,``; ``,`` if there are none.

    A known sentence may lie in several neighbouring sentences of the text: published notices are wrapped, and
    have ``;`` and ``v. 2`` inside. From each sentence on the longest known one is taken.
    """
    names = F.create_map(*[F.lit(x) for name, sentence in known for x in (sentence, name)])
    longest = sorted((sentence for _, sentence in known), key=len, reverse=True)
    any_known = "\n(" + "|".join("[ \n]".join(map(re.escape, s.split(" "))) for s in longest) + ")(?=\n)"
    lines = F.concat(F.lit("\n"), F.array_join(sentences(text), "\n"), F.lit("\n"))
    found = F.transform(F.regexp_extract_all(lines, F.lit(any_known), F.lit(1)), lambda s: F.translate(s, "\n", " "))
    return F.concat(F.lit(","), F.array_join(F.transform(found, lambda s: F.concat(F.element_at(names, s), F.lit(","))), ""))


def scan(df: DataFrame, known: tuple[tuple[str, str], ...] = SENTENCES, rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES) -> DataFrame:
    """``doc_id``, ``n_sentences`` (recognised), ``licenses`` (in order of first match, joined by ``,``; empty if none) for every row.

    Each rule takes the runs of identifiers it matches, so a shorter rule cannot count them again. Null and
    empty texts have no sentences; repeated rows are scanned like any other; other columns are ignored.
    """
    seq = pick(df, "doc_id", "text").select(F.col("doc_id"), F.coalesce(identifiers(F.col("text"), known), F.lit(",")).alias("seq"))
    # the two commas between neighbours let runs of one rule follow each other
    taken = reduce(lambda c, r: F.replace(c, F.lit("," + ",,".join(r[1]) + ","), F.lit(f"<{r[0]}>")), rules, F.replace("seq", F.lit(","), F.lit(",,")))
    return seq.select(
        "doc_id",
        (F.length("seq") - F.length(F.replace("seq", F.lit(","), F.lit(""))) - 1).cast("long").alias("n_sentences"),
        F.array_join(F.array_distinct(F.regexp_extract_all(taken, F.lit("<([^>]+)>"), F.lit(1))), ",").alias("licenses"),
    )


def scan_sql(table: str = "documents", known: tuple[tuple[str, str], ...] = SENTENCES, rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES) -> str:
    """The scan in DuckDB SQL, sentence by sentence: known sentences that go on over a cut, as in wrapped notices, it does not find."""
    values = ", ".join(f"('{s}', '{n}')" for n, s in known)
    taken = "replace(seq, ',', ',,')"
    for name, ids in rules:
        taken = f"replace({taken}, ',{',,'.join(ids)},', '<{name}>')"
    return f"""
with known(sentence, name) as (values {values}),
d as (select row_number() over () as r, doc_id, text from {table}),
cut as (select r, unnest(string_split(regexp_replace(text, '([.!?;])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10))) as s, generate_subscripts(string_split(regexp_replace(text, '([.!?;])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10)), 1) as i from d),
hit as (select r, i, name from (select r, i, trim(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '[^0-9a-z]+', ' ', 'g')) as s from cut) join known on s = sentence),
seqs as (select r, ',' || string_agg(name, ',' order by i) || ',' as seq, count(*) as n from hit group by r),
full_seq as (select doc_id, coalesce(seq, ',') as seq, coalesce(n, 0) as n from d left join seqs using (r)),
done as (select doc_id, n, regexp_extract_all({taken}, '<([^>]+)>', 1) as l from full_seq)
select doc_id, cast(n as bigint) as n_sentences, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') as licenses from done"""
