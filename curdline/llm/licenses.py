"""Licence scans by sentence rules: known sentences become identifiers, sequences of identifiers match rules.

A text is cut into sentences at marks that end one and at blank lines. A sentence is normalised (ASCII letters,
digits and +, lower case, single spaces) and looked up among the known ones; if it is none, each of its lines is, as
a notice may follow a line without a full stop. A copyright line counts by its first and last words, whatever names
and years stand between. A wording that has a mark inside is known by its parts, each a sentence: the part that
names the version decides, not the part before it. What is found, in order, is the document's identifier sequence.
Rules are tried in their order, longer ones first: one matches where its identifiers follow each other in the
sequence, with no other identifier between, and uses them up, so the sentences of a full licence text do not count
again for a short notice.

Cases: null or empty text: no sentence. Sentences repeated: each counts; a licence is named once. Known sentences
that no rule uses are kept in the sequence and named ``unknown``. Null doc_id and repeated rows: rows of their own.
Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifier and wording of known licence sentences.
SENTENCES = (
    ("mit_notice", "Released under the MIT License."),
    ("mit_notice", "Licensed under the MIT License."),
    ("mit_notice", "This project is licensed under the MIT License."),
    ("mit_title", "The MIT License (MIT)"),
    ("mit_title", "MIT License"),
    ("mit_grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and '
     'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
     'limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the '
     'Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit_condition", "The above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the Software."),
    ("as_is", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
     "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("apache_notice", "Licensed under the Apache License, Version 2.0."),
    ("apache_notice", "Released under the Apache License, Version 2.0."),
    ("apache_header", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("apache_comply", "you may not use this file except in compliance with the License."),
    ("apache_copy", "You may obtain a copy of the License at"),
    ("gpl3_notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl3_notice", "Licensed under the GNU General Public License, version 3."),
    ("gpl_free", "This program is free software;"),
    ("gpl3_later", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
     "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl2_later", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
     "by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("gpl_terms", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
     "by the Free Software Foundation;"),
    ("agpl_terms", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
     "by the Free Software Foundation;"),
    ("agpl3_later", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
     "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("library_free", "This library is free software;"),
    ("lgpl_terms", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
     "by the Free Software Foundation;"),
    ("version2_later", "either version 2 of the License, or (at your option) any later version."),
    ("version2_1_later", "either version 2.1 of the License, or (at your option) any later version."),
    ("version3_later", "either version 3 of the License, or (at your option) any later version."),
    ("mpl2_terms", "This Source Code Form is subject to the terms of the Mozilla Public License, v."),
    ("isc_grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("zlib_grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, "
     "and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("bsd_grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met:"),
    ("bsd_source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
     "following disclaimer."),
    ("bsd_binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
     "following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd_names", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
     "products derived from this software without specific prior written permission."),
    ("bsd_notice", "Licensed under the BSD License."),
    ("cc_by_nc_notice", "Licensed under CC BY-NC 4.0."),
    ("cc_by_nc_notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc_by_notice", "Licensed under CC BY 4.0."),
    ("cc_by_notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc_by_sa_notice", "Licensed under CC BY-SA 4.0."),
    ("all_rights", "All rights reserved."),
)
#: Licences and the identifier sequences that state them, in the order in which they are tried.
RULES = (
    ("MIT", ("mit_title", "mit_grant", "mit_condition", "as_is")),
    ("MIT", ("mit_grant", "mit_condition", "as_is")),
    ("MIT", ("mit_grant", "mit_condition")),
    ("Apache-2.0", ("apache_header", "apache_comply", "apache_copy")),
    ("Apache-2.0", ("apache_header", "apache_comply")),
    ("GPL-3.0-or-later", ("gpl_free", "gpl3_later")),
    ("GPL-3.0-or-later", ("gpl_free", "gpl_terms", "version3_later")),
    ("GPL-2.0-or-later", ("gpl_free", "gpl2_later")),
    ("GPL-2.0-or-later", ("gpl_free", "gpl_terms", "version2_later")),
    ("AGPL-3.0-or-later", ("gpl_free", "agpl3_later")),
    ("AGPL-3.0-or-later", ("gpl_free", "agpl_terms", "version3_later")),
    ("LGPL-2.1-or-later", ("library_free", "lgpl_terms", "version2_1_later")),
    ("LGPL-3.0-or-later", ("library_free", "lgpl_terms", "version3_later")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("BSD", ("bsd_grant",)),
    ("MPL-2.0", ("mpl2_terms",)),
    ("ISC", ("isc_grant",)),
    ("Unlicense", ("unlicense",)),
    ("Zlib", ("zlib_grant",)),
    ("MIT", ("mit_notice",)),
    ("Apache-2.0", ("apache_notice",)),
    ("GPL-3.0", ("gpl3_notice",)),
    ("BSD", ("bsd_notice",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_notice",)),
    ("CC-BY-4.0", ("cc_by_notice",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_notice",)),
    ("proprietary", ("all_rights",)),
)
# First and last words of a normalised copyright line, whose years and names vary, and its identifier.
COPYRIGHT_LINE = ("copyright ", " all rights reserved", "all_rights")
# a mark before white space, or a blank line, ends a sentence
ENDS = r"([.!?:;])[ \t\r\n]+|[ \t\r]*\n[ \t\r]*\n[ \t\r\n]*"
NOT_KEPT = "[^A-Za-z0-9+]+"


def plain(sentence: str) -> str:
    """The normal form of a known sentence."""
    kept = "".join(c if c.isascii() and (c.isalnum() or c == "+") else " " for c in sentence)
    return " ".join(kept.lower().split())


def normalised(sentence: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(sentence, NOT_KEPT, " ")))


def known_sentences() -> dict[str, str]:
    """Normal form to identifier. A wording that the marks would cut is an error: its parts are sentences of their own."""
    import re

    for name, text in SENTENCES:
        if re.search(ENDS, text):
            raise ValueError(f"a mark cuts the wording of {name}: {text}")
    return {plain(text): name for name, text in SENTENCES}


def identifiers(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order."""
    table = F.create_map(*[F.lit(x) for pair in known_sentences().items() for x in pair])
    first, last, line_name = map(F.lit, COPYRIGHT_LINE)
    # \x01 ends a sentence; a text that holds one itself is cut there, too
    sentences = F.split(F.regexp_replace(text, ENDS, "$1\x01"), "\x01")

    def known(words: Column) -> Column:
        def of_normal(x: Column) -> Column:
            return F.coalesce(F.element_at(table, x), F.when(F.startswith(x, first) & F.endswith(x, last), line_name))

        return F.get(F.transform(F.array(normalised(words)), of_normal), 0)

    def of_sentence(s: Column) -> Column:
        lines = F.filter(F.transform(F.split(s, "\n"), known), lambda x: x.isNotNull())
        # a sentence of one line that is not known has no other line to look up
        whole = F.array_compact(F.array(known(s)))
        return F.when(F.contains(s, F.lit("\n")), F.get(F.filter(F.array(whole, lines), lambda x: F.size(x) > 0), 0)).otherwise(whole)

    found = F.transform(sentences, of_sentence)
    return F.flatten(F.filter(found, lambda x: x.isNotNull()))


def matched(sequence: Column) -> tuple[list[Column], Column]:
    """For each rule whether it matches, and what the rules leave; ``sequence`` holds each identifier as `` id ``."""
    found = []
    for _, rule in RULES:
        wanted = "".join(f"<{i}>" for i in rule)
        found.append(F.contains(sequence, F.lit(wanted)))
        sequence = F.replace(sequence, F.lit(wanted), F.lit("|"))
    return found, sequence


def licences(documents: DataFrame) -> DataFrame:
    """doc_id, sentences, licences of the documents with a known sentence.

    ``sentences`` are the identifiers in order, ``licences`` the names of the matching rules in the rules' order, each
    once, or ``unknown``; both as text joined by single spaces.
    """
    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), identifiers(F.coalesce("text", F.lit(""))).alias("found")
    ).filter("size(found) > 0")
    held = rows.select("doc_id", "found", F.array_join(F.transform("found", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "").alias("sequence"))
    hits, _ = matched(F.col("sequence"))
    names = F.array_distinct(F.array_compact(F.array(*[F.when(h, F.lit(n)) for h, (n, _) in zip(hits, RULES, strict=True)])))
    return held.select(
        "doc_id", F.array_join("found", " ").alias("sentences"),
        F.when(F.size(names) > 0, F.array_join(names, " ")).otherwise("unknown").alias("licences"),
    )
