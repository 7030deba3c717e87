"""License scan: known phrases, and an exact set-similarity join of text blocks with license templates.

Everything is built from DataFrame functions. A text is cut into blocks that overlap by half and hold a template's words at least twice, so
any run of as many words lies whole in some block; longer templates have longer blocks. A block matches a template if it holds at least ``threshold`` of the template's
distinct words. The words of the templates are ordered by their document frequency in all documents, rarest first. A block can
only match if it holds one of the template's rarest words (prefix filter), if it has enough template words at all (length
filter), and if the words that stand after the first common one suffice on both sides (positional filter); what is left is
counted exactly. The templates are a parameter of bounded size, so they stand in the expressions, and documents never move.
"""

from __future__ import annotations

from functools import reduce
from math import ceil
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # between words, before A-Z are lower-cased
BLOCK = 64
THRESHOLD = 0.8

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices that licenses ask their users to give, and license texts: (label, family, words that a match must hold, text).
# Of the templates of a family, a block matches only the best: variants differ by a word, and the longer one holds the shorter.
TEMPLATES = (
    ("gpl-3", "gpl", "gnu 3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", "gpl", "gnu 2", "this work is licensed under the gnu general public license version 2"),
    ("gpl-notice", "gpl-notice", "gnu", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("apache-2", "apache", "apache", "licensed under the apache license version 2 0"),
    ("cc-by-4", "cc", "cc by", "licensed under cc by 4 0"),
    ("cc-by-nc-4", "cc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4", "cc", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc-sa-4", "cc", "cc by nc sa", "licensed under cc by nc sa 4 0"),
    ("mit", "mit", "mit", "released under the mit license"),
    ("mit-text", "mit-text", "permission charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
     "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
     "software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc-text", "isc-text", "permission fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
     "permission notice appear in all copies"),
    ("bsd", "bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("no-warranty", "no-warranty", "warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular "
     "purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of "
     "or in connection with the software or the use or other dealings in the software"),
    ("reserved", "reserved", "reserved", "all rights reserved no part of this publication may be reproduced"),
)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, A_TO_Z, A_TO_Z.lower())


def words_of(text: Column) -> Column:
    """Words of a text in their own case; lower-casing A-Z later gives the words of the lower-cased text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BETWEEN), lambda w: w != "")


def template_sets(templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    return [(label, sorted(set(text.split()))) for label, _, _, text in templates]


def block_of(text: str) -> int:
    """Words of a block for a template: the power of two that holds it twice, at least ``BLOCK``."""
    return max(BLOCK, 1 << (2 * len(text.split()) - 1).bit_length())


def by_block(templates=TEMPLATES) -> dict[int, list]:
    """Families by the block length that their longest template needs; variants are compared within one block."""
    longest: dict[str, int] = {}
    for _, family, _, text in templates:
        longest[family] = max(longest.get(family, 0), block_of(text))
    out: dict[int, list] = {}
    for t in templates:
        out.setdefault(longest[t[1]], []).append(t)
    return out


def frequencies(documents: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """Documents that hold each template word, counted over all documents; as many rows as the templates have words."""
    vocabulary = sorted({w for _, words in template_sets(templates) for w in words})
    found = documents.select(F.explode(F.array_intersect(F.transform(words_of(F.lower("text")), lower_ascii), F.array(*map(F.lit, vocabulary)))).alias("word"))
    return {w: 0 for w in vocabulary} | {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}


def phrase_places(words: Column, phrases=PHRASES) -> list[tuple[str, Column]]:
    """(label, starts) of each phrase; words are lower-cased."""
    def at_start(own: list[str]):
        return lambda i: reduce(and_, [F.get(words, i + k) == w for k, w in enumerate(own)])

    out = []
    for phrase, label in phrases.items():
        own = phrase.split()
        at = F.filter(F.sequence(F.lit(0), F.size(words) - len(own)), at_start(own))
        out.append((label, F.when(F.size(words) >= len(own), at).otherwise(F.array().cast("array<int>"))))
    return out


def matches(words: Column, frequency: dict[str, int], templates=TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """Array of (label, block, containment) of a text's blocks that match; words are lower-cased."""
    return F.concat(*[block_matches(words, frequency, own, threshold, block) for block, own in by_block(templates).items()])


def block_matches(words: Column, frequency: dict[str, int], templates, threshold: float, block: int) -> Column:
    """Matches of templates whose blocks have one length."""
    rank = {w: k for k, w in enumerate(sorted(frequency, key=lambda w: (frequency[w], w)))}
    ranks = F.create_map(*[x for w, k in rank.items() for x in (F.lit(w), F.lit(k))])
    sets = [(label, sorted(rank[w] for w in own)) for label, own in template_sets(templates)]
    need = {label: ceil(threshold * len(own) - 1e-9) for label, own in sets}
    prefix = sorted({r for label, own in sets for r in own[:len(own) - need[label] + 1]})
    rare = F.array(*[F.lit(w) for w, k in rank.items() if k in set(prefix)])
    half = block // 2
    # Block k covers the words from k * half on; a word lies in block i // half and in the one before.
    at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(rare, F.get(words, i)))
    blocks = F.array_distinct(F.flatten(F.transform(at, lambda i: F.filter(F.array(F.floor(i / half), F.floor(i / half) - 1), lambda k: k >= 0))))

    def of_block(k: Column) -> Column:
        own = F.slice(words, (k * half + 1).cast("int"), block)
        known = F.array_sort(F.filter(F.transform(F.array_distinct(own), lambda w: F.element_at(ranks, w)), lambda r: r.isNotNull()))
        return F.struct(k.alias("block"), known.alias("known"))

    must = {label: [rank[w] for w in signs.split()] for label, _, signs, _ in templates}
    family = {label: name for label, name, _, _ in templates}

    def of_template(b: Column, label: str, own: list[int]) -> Column:
        least, size = need[label], len(own)
        first = F.array_min(F.array_intersect(b["known"], F.array(*map(F.lit, own[:size - least + 1]))))  # rarest common word within the prefix
        behind_block = F.size(b["known"]) - F.array_position(b["known"], first)
        behind_own = size - F.array_position(F.array(*map(F.lit, own)), first)
        common = F.size(F.array_intersect(b["known"], F.array(*map(F.lit, own))))
        possible = (F.size(b["known"]) >= least) & first.isNotNull() & (F.least(behind_block, behind_own) + 1 >= least)
        for r in must[label]:
            possible = possible & F.array_contains(b["known"], r)
        shared = F.when(possible, common).otherwise(0)
        order = F.struct((shared / F.lit(float(size))).alias("containment"), F.lit(size).alias("size"), F.lit(label).alias("label"), b["block"].alias("block"))
        return F.when(shared >= least, order)

    def best(b: Column) -> Column:
        """Of every family the variant with the largest containment, then the most words."""
        each = [F.array_max(F.filter(F.array(*[of_template(b, label, own) for label, own in sets if family[label] == name]), lambda m: m.isNotNull())) for name in dict.fromkeys(family.values())]
        return F.filter(F.array(*each), lambda m: m.isNotNull())

    found = F.flatten(F.transform(F.transform(blocks, of_block), best))
    return F.transform(found, lambda m: F.struct(m["label"].alias("label"), m["block"].alias("block"), m["containment"].alias("containment")))


def scan(documents: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, places (label, starts) of phrases and matches (label, block, containment) of every whole text.

    A null or empty text has no words and empty arrays; repeated rows are scanned alike; ties in frequency are broken by the word;
    an empty table gives no rows; columns other than doc_id and text are not read. Texts of any length are scanned whole.
    """
    frequency = frequencies(documents, templates)
    rare = sorted(frequency, key=lambda w: (frequency[w], w))
    order = {w: k for k, w in enumerate(rare)}
    signs = set(phrase.split()[0] for phrase in phrases)
    for _, own in template_sets(templates):
        own = sorted(own, key=order.get)
        signs.update(own[:len(own) - ceil(threshold * len(own) - 1e-9) + 1])
    text = F.lower("text")
    # Lower-casing all letters keeps every word of A-Z and digits, so a text without any of the signs has no phrase and no match.
    worth = F.arrays_overlap(words_of(text), F.array(*map(F.lit, sorted(signs))))
    base = documents.select("doc_id", words_of(F.col("text")).alias("_plain"), worth.alias("_worth"))
    base = base.select("doc_id", F.size("_plain").cast("long").alias("n_words"), F.when(F.col("_worth"), F.transform("_plain", lower_ascii)).otherwise(F.array().cast("array<string>")).alias("_words"))
    words = F.col("_words")
    places = F.array(*[F.struct(F.lit(label).alias("label"), at.alias("starts")) for label, at in phrase_places(words, phrases)])
    places = F.when(F.size(words) > 0, places).otherwise(F.array().cast("array<struct<label:string,starts:array<int>>>"))
    found = F.when(F.size(words) > 0, matches(words, frequency, templates, threshold)).otherwise(F.array().cast("array<struct<label:string,block:bigint,containment:double>>"))
    return base.select("doc_id", "n_words", F.filter(places, lambda p: F.size(p["starts"]) > 0).alias("places"), found.alias("matches"))


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """Phrases and license notices in all documents; a phrase scores 1, else the largest containment of a match."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    starts = F.flatten(F.col("places.starts"))
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    both = F.array_sort(F.array_union(F.col("places.label"), F.col("matches.label")))
    return found.select("doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"),
                        F.array_max(starts).cast("long").alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
                        F.when(F.size(starts) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.col("matches.containment")), F.lit(0.0))).alias("score"))


def sql(phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same rows without any filter: every block against every template."""
    length = {t[0]: block for block, own in by_block(templates).items() for t in own}
    own = ", ".join(f"('{label}', '{family}', {must.split()!r}, {words!r}, {ceil(threshold * len(words) - 1e-9)}, {length[label]})"
                    for (label, family, must, _), (_, words) in zip(templates, template_sets(templates)))
    blocks = " UNION ALL ".join(
        f"SELECT rid, {b} AS length, k, list_distinct(words[k * {b // 2} + 1 : k * {b // 2} + {b}]) AS part FROM (SELECT rid, words, unnest(range((len(words) + {b // 2 - 1}) // {b // 2})) AS k FROM texts)"
        for b in sorted(set(length.values())))
    hits = " UNION ALL ".join(
        f"SELECT rid, '{label}' AS label, i FROM placed WHERE " + " AND ".join(f"words[i + {k + 1}] = '{w}'" for k, w in enumerate(phrase.split()))
        for phrase, label in phrases.items())
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{A_TO_Z}', '{A_TO_Z.lower()}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
placed AS (SELECT rid, words, unnest(range(len(words))) AS i FROM texts),
hits AS ({hits}),
templates(label, family, must, own, least, length) AS (VALUES {own}),
blocks AS ({blocks}),
variants AS (SELECT rid, k, label, family, len(own) AS size, len(list_intersect(part, own)) / len(own)::DOUBLE AS containment
    FROM blocks JOIN templates USING (length) WHERE len(list_intersect(part, own)) >= least AND list_has_all(part, must)),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid, k, family ORDER BY containment DESC, size DESC, label DESC) AS place FROM variants) WHERE place = 1),
by_base AS (SELECT rid, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hits GROUP BY rid),
by_match AS (SELECT rid, max(containment) AS best FROM found GROUP BY rid),
by_both AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM hits UNION SELECT rid, label FROM found) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(b.labels, '') AS base_labels,
    coalesce(a.labels, '') AS labels, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM texts LEFT JOIN by_base b USING (rid) LEFT JOIN by_match USING (rid) LEFT JOIN by_both a USING (rid)
"""
