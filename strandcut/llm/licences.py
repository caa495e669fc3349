"""Operator 4: licence scan by a positional index of the rare words of whole licence texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandcut.llm.common import ascii_lower, stored
from strandcut.llm.registry import query, table

#: What stands between words.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


#: Words of a template that are looked up, how many must agree on a place, and how far they may drift apart.
RARE, NEED, DRIFT = 12, 6, 32


@dataclass(frozen=True)
class Name:
    """A label given wherever a phrase stands, words separated by blanks."""

    label: str
    phrase: str
    base: bool = False


@dataclass(frozen=True)
class Template:
    """A licence text, as words, and the key phrases of it that no copy may lack."""

    label: str
    keys: tuple[str, ...]
    text: str


# Base phrases and their labels, and names of further licences.
NAMES = (
    Name("gpl", "gnu general public license", base=True),
    Name("apache", "apache license", base=True),
    Name("cc-by", "cc by", base=True),
    Name("mit", "mit license", base=True),
    Name("agpl", "gnu affero general public license"),
    Name("lgpl", "gnu lesser general public license"),
    Name("mpl", "mozilla public license"),
    Name("cc0", "cc0 1 0 universal"),
)

# The wording of licences and licence notices, with their key phrases.
TEMPLATES = (
    Template(
        "mit", ("permission is hereby granted", "shall be included in all copies"),
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the software the "
        "software is provided as is without warranty of any kind express or implied including but not limited to the "
        "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the "
        "authors or copyright holders be liable for any claim damages or other liability whether in an action of "
        "contract tort or otherwise arising from out of or in connection with the software or the use or other dealings "
        "in the software",
    ),
    Template(
        "isc", ("permission to use copy modify", "the author disclaims all warranties"),
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies the software "
        "is provided as is and the author disclaims all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness in no event shall the author be liable for any special direct "
        "indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether "
        "in an action of contract negligence or other tortious action arising out of or in connection with the use or "
        "performance of this software",
    ),
    Template(
        "bsd", ("redistribution and use in source and binary forms", "retain the above copyright notice"),
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met redistributions of source code must retain the above copyright notice this list "
        "of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright "
        "notice this list of conditions and the following disclaimer in the documentation and or other materials "
        "provided with the distribution",
    ),
    Template(
        "apache", ("except in compliance with the license",),
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
        "the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by "
        "applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific "
        "language governing permissions and limitations under the license",
    ),
    Template(
        "gpl", ("terms of the gnu general public license",),
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version 3 of the license or at your option "
        "any later version this program is distributed in the hope that it will be useful but without any warranty "
        "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general "
        "public license for more details you should have received a copy of the gnu general public license along with "
        "this program",
    ),
    Template(
        "unlicense", ("free and unencumbered software",),
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish "
        "use compile sell or distribute this software either in source code form or as a compiled binary for any "
        "purpose commercial or non commercial and by any means",
    ),
    Template(
        "zlib", ("must not be misrepresented",),
        "this software is provided as is without any express or implied warranty in no event will the authors be held "
        "liable for any damages arising from the use of this software permission is granted to anyone to use this "
        "software for any purpose including commercial applications and to alter it and redistribute it freely subject "
        "to the following restrictions the origin of this software must not be misrepresented you must not claim that "
        "you wrote the original software altered source versions must be plainly marked as such and must not be "
        "misrepresented as being the original software this notice may not be removed or altered from any source "
        "distribution",
    ),
    Template(
        "mpl", ("the terms of the mozilla public license",),
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at",
    ),
)


def split_words(text: Column) -> Column:
    """Words in order, as written."""
    return F.array_remove(F.split(text, GAP), "")


def word_counts(docs: DataFrame, words: Sequence[str], text_col: str = "text") -> dict[str, int]:
    """In how many documents each of the few ``words`` stands."""
    wanted = F.array(*[F.lit(w) for w in words])
    seen = docs.select(F.array_intersect(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), GAP), wanted).alias("w"))
    found = seen.select(F.explode("w").alias("w")).groupBy("w").count().collect()
    return {**dict.fromkeys(words, 0), **{r["w"]: r["count"] for r in found}}


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def places_in(phrase: str, text: str) -> list[int]:
    """Where the words of ``phrase`` stand in ``text``, counted in words."""
    part, words = phrase.split(), text.split()
    return [i for i in range(len(words) - len(part) + 1) if words[i:i + len(part)] == part]


def rarest(template: Template, counts: Mapping[str, int], rare: int = RARE) -> list[str]:
    """The template's words that the fewest documents hold, of those that any holds; the first on a tie."""
    words = [w for w in dict.fromkeys(template.text.split()) if counts[w]]
    return sorted(words, key=lambda w: counts[w])[:rare]


def scan_licences(
    docs: DataFrame, *, names: Sequence[Name] = NAMES, templates: Sequence[Template] = TEMPLATES,
    rare: int = RARE, need: int = NEED, drift: int = DRIFT, text_col: str = "text", keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Licence names and texts of every document: places, labels and a score.

    The index holds the postings (template, place) of each template's ``rare``
    words of the highest inverse document frequency, counted over all of
    ``docs``. A hit of such a word, and one of a key phrase, says where the
    template would begin: file place less template place. Hits whose
    beginnings lie within ``drift`` words of each other meet (in one of the
    windows of twice that width, each of which overlaps the next). A template's
    label is given where at least ``need`` of its words and all its key phrases
    meet; changed, left out or added words cost only their own hits, and
    phrases scattered over a text do not meet. Names are looked up at their
    rarest word. ``score`` is 1 with any name, else the largest share of
    ``rare`` words that meet with a key phrase.

    Null and empty texts have no words, empty labels and score 0; the table may
    be empty and rows may repeat (equal texts are one group of hits). At most
    62 - ``rare`` key phrases to a template, 62 templates. Texts are read twice,
    to count and to find; what is found is written to the shared folder.
    Columns: ``keep``, then n_words, n_base, first_word, last_word, base_labels, labels, score.
    """
    phrases = list(dict.fromkeys([n.phrase for n in names] + [k for t in templates for k in t.keys]))
    vocabulary = sorted({w for p in phrases for w in p.split()} | {w for t in templates for w in t.text.split()})
    counts = word_counts(docs, vocabulary, text_col)
    pick = {p: min(enumerate(p.split()), key=lambda x: (counts[x[1]], x[0])) for p in phrases}
    anchors = sorted({word for _, word in pick.values()})
    postings: dict[str, list[tuple[int, int, int]]] = {}
    for t, template in enumerate(templates):
        for bit, word in enumerate(rarest(template, counts, rare)):
            for q in places_in(word, template.text):
                postings.setdefault(word, []).append((t, bit, q))

    raw = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(raw)
    may = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in anchors])
    no_places = F.array().cast("array<int>")
    based = docs.select(
        *keep, F.when(may, F.sha2(raw.cast("binary"), 256)).alias("__text"), F.size(split_words(raw)).cast("bigint").alias("n_words"),
        # Lower-cased words are only needed where an indexed word can stand.
        F.when(may, split_words(ascii_lower(raw))).otherwise(F.array().cast("array<string>")).alias("__words"),
    )

    def standing(words: Sequence[str]) -> Column:
        at = F.sequence(F.lit(0), F.size("__words") - 1)
        return F.when(F.size("__words") > 0, F.filter(at, lambda i: F.get("__words", i).isin(words))).otherwise(no_places)

    def starts(phrase: str) -> Column:
        at, _ = pick[phrase]
        return F.transform(
            F.filter("__hits", lambda i: _all([
                F.coalesce(F.get("__words", i - at + j) == w, F.lit(False)) for j, w in enumerate(phrase.split())
            ]) & (i >= at)),
            lambda i: (i - at).cast("bigint"),
        )

    def vote(t: int | Column, bit: int | Column, begin: Column) -> Column:
        return F.struct(
            F.lit(t).cast("int").alias("t"), F.lit(bit).cast("int").alias("bit"), begin.cast("bigint").alias("begin")
        )

    col = {p: f"__p{i}" for i, p in enumerate(phrases)}
    found = based.withColumn("__hits", standing(anchors)).select(
        *keep, "__text", "n_words", "__words", *[starts(p).alias(c) for p, c in col.items()]
    )
    any_key = reduce(lambda a, b: a | b, [F.size(col[k]) > 0 for t in templates for k in t.keys], F.lit(False))

    def key_votes(places: str, t: int, bit: int, q: int) -> Column:
        return F.transform(places, lambda p: vote(t, bit, p - q))

    votes = [
        key_votes(col[k], t, rare + i, q)
        for t, x in enumerate(templates) for i, k in enumerate(x.keys) for q in places_in(k, x.text)
    ]
    if postings:
        index = F.create_map(*[
            c for w, at in postings.items()
            for c in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(b).alias("b"), F.lit(q).alias("q")) for t, b, q in at]))
        ])
        votes.append(F.flatten(F.transform(
            standing(sorted(postings)),
            lambda i: F.transform(F.element_at(index, F.get("__words", i)), lambda e: vote(e["t"], e["b"], i - e["q"])),
        )))
    # Only beside a key phrase can hits tell anything.
    all_votes = F.concat(*votes) if votes else F.lit(None)
    kind = "array<struct<t:int,bit:int,begin:bigint>>"
    base = F.concat(*[F.col(col[n.phrase]) for n in names if n.base])

    def labels(some: Sequence[Name]) -> Column:
        return F.array_compact(F.array(*[F.when(F.size(col[n.phrase]) > 0, n.label) for n in some]))

    narrow = stored(found.select(
        *keep, "__text", "n_words", base.alias("__places"), labels([n for n in names if n.base]).alias("__base"),
        labels(names).alias("__names"), F.when(any_key, all_votes).otherwise(F.lit(None)).cast(kind).alias("__votes"),
    ), "licence-hits")

    shares = (1 << rare) - 1
    one = F.lit(1).cast("bigint")
    met = (
        narrow.where(F.col("__votes").isNotNull()).select("__text", F.inline("__votes"))
        .select("__text", "t", "bit", F.explode(F.array(*[
            F.floor(F.col("begin") / drift) + side for side in (0, 1)
        ])).alias("window"))
        .groupBy("__text", "t", "window").agg(F.bit_or(F.call_function("shiftleft", one, F.col("bit"))).alias("bits"))
        .withColumn("n", F.bit_count(F.col("bits").bitwiseAND(F.lit(shares))))
    )
    keyed = [((1 << len(t.keys)) - 1) << rare for t in templates]
    all_keys = F.element_at(F.array(*[F.lit(k).cast("bigint") for k in keyed]), F.col("t") + 1)
    given = F.element_at(F.array(*[F.lit(t.label) for t in templates]), F.col("t") + 1)
    texts = met.where((F.col("bits") > shares) & (F.col("n") > 0)).groupBy("__text").agg(
        F.collect_set(F.when((F.col("n") >= need) & (F.col("bits").bitwiseAND(all_keys) == all_keys), given)).alias("__given"),
        (F.max("n") / rare).alias("__share"),
    )
    without = narrow.where(F.col("__votes").isNull()).withColumns({
        "__given": F.array().cast("array<string>"), "__share": F.lit(0.0)})
    rows = without.unionByName(narrow.where(F.col("__votes").isNotNull()).join(texts, "__text", "left"), allowMissingColumns=True)

    def listed(array: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(array)), ",")

    return rows.select(
        *keep, "n_words", F.size("__places").cast("bigint").alias("n_base"),
        F.array_min("__places").alias("first_word"), F.array_max("__places").alias("last_word"),
        listed(F.col("__base")).alias("base_labels"),
        listed(F.concat("__names", F.coalesce("__given", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("__names") > 0, 1.0).otherwise(F.coalesce("__share", F.lit(0.0))).alias("score"),
    )


def _sql_places(phrase: str) -> str:
    words = phrase.split()
    checks = " AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(words))
    return f"list_filter(range(1, len(w) + 1), lambda i: {checks})"


def _sql() -> str:
    phrases = list(dict.fromkeys([n.phrase for n in NAMES] + [k for t in TEMPLATES for k in t.keys]))
    n = {p: f"p{i}" for i, p in enumerate(phrases)}
    base = " || ".join(n[x.phrase] for x in NAMES if x.base)
    words = ", ".join(f"({t}, {q}, '{w}')" for t, x in enumerate(TEMPLATES) for q, w in enumerate(x.text.split()))
    keys = " UNION ALL ".join(
        f"SELECT rid, {t}, {RARE + i}, unnest({n[k]}) - 1 - {q} FROM p"
        for t, x in enumerate(TEMPLATES) for i, k in enumerate(x.keys) for q in places_in(k, x.text)
    )
    of = ", ".join(f"({t}, '{x.label}', {len(x.keys)})" for t, x in enumerate(TEMPLATES))

    def listed(some):
        return "[" + ", ".join(f"CASE WHEN len({n[x.phrase]}) > 0 THEN '{x.label}' END" for x in some) + "]"

    def joined(labels):
        return f"array_to_string(list_sort(list_distinct({labels})), ',')"

    gap = GAP.replace("[", "[^", 1)
    return f"""
WITH t AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{gap}') AS w
  FROM documents),
p AS MATERIALIZED (SELECT rid, doc_id, len(w) AS n_words, {", ".join(f"{_sql_places(x)} AS {n[x]}" for x in phrases)} FROM t),
voc(t, q, word) AS (VALUES {words}),
cnt AS (
  SELECT word, count(*) AS c FROM (SELECT DISTINCT rid, unnest(regexp_extract_all(lower(text), '{gap}')) AS word FROM t)
  WHERE word IN (SELECT word FROM voc) GROUP BY 1),
anc AS (
  SELECT t, word, row_number() OVER (PARTITION BY t ORDER BY c, q) - 1 AS bit
  FROM (SELECT t, word, min(q) AS q FROM voc GROUP BY 1, 2) JOIN cnt USING (word)
  QUALIFY bit < {RARE}),
post AS (SELECT voc.t, voc.q, voc.word, anc.bit FROM voc JOIN anc ON voc.t = anc.t AND voc.word = anc.word),
pos AS (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS place FROM t),
votes(rid, t, bit, start) AS (
  SELECT rid, t, bit, place - q FROM pos JOIN post USING (word) UNION ALL {keys}),
met AS (
  SELECT rid, t, win, count(DISTINCT bit) FILTER (bit < {RARE}) AS n, count(DISTINCT bit) FILTER (bit >= {RARE}) AS k
  FROM (SELECT *, unnest([floor(start / {DRIFT}), floor(start / {DRIFT}) + 1]) AS win FROM votes) GROUP BY 1, 2, 3),
texts AS (
  SELECT rid, list(label) FILTER (n >= {NEED} AND k = keys) AS given, max(n) / {RARE} AS share
  FROM met JOIN (VALUES {of}) AS o(t, label, keys) USING (t) WHERE k > 0 AND n > 0 GROUP BY 1)
SELECT doc_id, n_words, len({base}) AS n_base, list_min({base}) - 1 AS first_word, list_max({base}) - 1 AS last_word,
  {joined(listed([x for x in NAMES if x.base]))} AS base_labels,
  {joined(f"list_concat({listed(NAMES)}, coalesce(given, []))")} AS labels,
  CASE WHEN {" OR ".join(f"len({n[x.phrase]}) > 0" for x in NAMES)} THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM p LEFT JOIN texts USING (rid)
"""


@query("op4_license_scans", _sql())
def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))
