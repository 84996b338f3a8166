"""License scans by diagonal voting, on DataFrame operations alone.

All rolling K-word grams of the texts are joined to their positions in license templates. A gram at word p of
a text and word t of a template votes for diagonal p - t. Neighbouring diagonals merge to a span, which
reaches from where the template begins on the diagonal of its first vote to where it ends on that of its last.
The span's words are compared with the template's one by one, and it counts if their edit similarity is enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, let, text_of, words_of, written

#: Words of a gram: a span of eight words or more that is near its template has four of them in a row, but for sizes 10, 11 and 15, where it has three.
K, NEAR = 3, 0.8
#: Diagonals of one span: each within a template's length divided by this from the next.
SLACK = 4
#: Each template's distinct words by letters, so that edits of words are edits of letters; FOREIGN is any other word.
ALPHABET, FOREIGN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "?"
#: Bits of the two tables that pass over grams of no template before they are joined.
SIEVE_BITS = 16
#: What stands between words once A-Z are lower-cased.
SEPARATORS = "\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F"
#: Phrases whose words name a license, with its label.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Openings of public license notices, with their labels.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software",
    ),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def scan_words(text: Column) -> Column:
    return words_of(ascii_lower(text), SEPARATORS)


def phrase_places(words: Column) -> Column:
    """Array of (at, label), one for each place of a phrase."""

    def ends(word: Column, i: Column) -> Column:
        kinds = None
        for phrase, label in PHRASES:
            *before, _ = phrase.split()
            fits = None
            for j, w in enumerate(before):
                same = F.get(words, i - len(before) + j) == w
                fits = same if fits is None else fits & same
            found = F.struct((i - len(before)).alias("at"), F.lit(label).alias("label"))
            kinds = F.when(fits, found) if kinds is None else kinds.when(fits, found)
        return F.when(word == "license", kinds)

    return F.filter(F.transform(words, ends), lambda x: x.isNotNull())


def template_grams(templates: tuple = TEMPLATES, k: int = K) -> list[tuple[str, int, int]]:
    """(gram, template, t) for each gram of each template."""
    return [(" ".join(w[t : t + k]), n, t) for n, (_, text) in enumerate(templates) for w in [text.split()] for t in range(len(w) - k + 1)]


def _letters(text: str) -> tuple[list[str], str]:
    """A template's distinct words, in the order of their letters, and the template by letters."""
    vocabulary = [*dict.fromkeys(text.split())]
    if len(vocabulary) > len(ALPHABET):
        raise ValueError("a template may have 62 distinct words")
    return vocabulary, "".join(ALPHABET[vocabulary.index(w)] for w in text.split())


def _sql_rows(rows: list[tuple], columns: str) -> str:
    value = lambda x: "array(" + ", ".join(map(value, x)) + ")" if isinstance(x, list) else f"'{x}'" if isinstance(x, str) else str(x)
    return f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)} AS t({columns})"


def _sieve(docs: DataFrame, grams: list[str]) -> tuple[Column, Column]:
    """Two tables of bits, by the lowest bits of a gram's hash and the next ones."""
    pairs = docs.sparkSession.sql(_sql_rows([(*g.split(" "),) for g in grams], ", ".join(f"w{j}" for j in range(K))))
    found = [r[0] for r in pairs.select(F.xxhash64(*pairs.columns)).collect()]  # as many rows as the templates have words
    size = 1 << SIEVE_BITS
    tables = []
    for shift in (0, SIEVE_BITS):
        bits = [0] * size
        for h in found:
            bits[(h >> shift) & (size - 1)] = 1
        tables.append(F.from_json(F.lit(str(bits)), "array<tinyint>"))
    return tables[0], tables[1]


def scanned(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """Rows (doc_id, mark, n_words, places, hits, w), one for each row of docs, written out: hits are (p, gram) of the grams that a template may have, w the words where there are any."""
    low, high = _sieve(docs, [g for g, *_ in template_grams(templates)])
    words = docs.select("doc_id", F.xxhash64(text_of()).alias("mark"), scan_words(text_of()).alias("w"))
    w, mask = F.col("w"), F.lit((1 << SIEVE_BITS) - 1).cast("bigint")
    hashed = lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(K)))
    in_sieve = lambda h: (F.get(low, h.bitwiseAND(mask).cast("int")) == 1) & (F.get(high, F.shiftright(h, SIEVE_BITS).bitwiseAND(mask).cast("int")) == 1)
    at = F.filter(F.sequence(F.lit(0), F.size(w) - K), lambda i: let(hashed(i), in_sieve))
    hits = F.when(F.size(w) >= K, F.transform(at, lambda i: F.struct(i.alias("p"), F.concat_ws(" ", *(F.get(w, i + j) for j in range(K))).alias("gram")))).otherwise(F.expr("cast(array() as array<struct<p: int, gram: string>>)"))
    rows = words.select("doc_id", "mark", F.size("w").cast("long").alias("n_words"), let(w, phrase_places).alias("places"), hits.alias("hits"), "w")
    return written(rows.withColumn("w", F.when(F.size("hits") > 0, F.col("w"))))


def template_spans(found: DataFrame, templates: tuple = TEMPLATES, slack: int = SLACK) -> DataFrame:
    """Rows (doc_id, mark, label, first_word, last_word, similarity), one for each span of scanned rows; mark tells texts with one id apart.

    similarity: 1 - edits / words of the longer of template and span. A span that reaches beyond the text is cut there.
    """
    spark = found.sparkSession
    known = F.broadcast(spark.sql(_sql_rows(template_grams(templates), "gram, template, t")))  # as many rows as the templates have words
    kinds = [(n, label, len(text.split()), *_letters(text)) for n, (label, text) in enumerate(templates)]
    kinds = F.broadcast(spark.sql(_sql_rows(kinds, "template, label, words, vocabulary, letters")))
    by = ["doc_id", "mark", "template"]
    # Rows that repeat both id and text vote alike, and once.
    votes = found.where("w IS NOT NULL").select("doc_id", "mark", F.explode("hits").alias("x")).select("doc_id", "mark", "x.*")
    votes = votes.join(known, "gram").select(*by, (F.col("p") - F.col("t")).alias("diagonal"), F.struct("p", "t").alias("at"))
    votes = votes.groupBy(*by, "diagonal").agg(F.min("at").alias("first"), F.max("at").alias("last")).join(kinds, "template")
    order = W.partitionBy(*by).orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > F.floor(F.col("words") / slack)).cast("int")
    votes = votes.withColumn("apart", F.coalesce(apart, F.lit(0))).withColumn("span", F.sum("apart").over(order))
    spans = votes.groupBy(*by, "span", "label", "words", "vocabulary", "letters").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    texts = found.where("w IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "w").dropDuplicates(["_id", "_mark"])
    spans = spans.join(texts, spans["doc_id"].eqNullSafe(texts["_id"]) & (spans["mark"] == texts["_mark"]))
    first = F.greatest(F.lit(0), F.col("first.p") - F.col("first.t"))
    last = F.least(F.size("w"), F.col("last.p") - F.col("last.t") + F.col("words")) - 1
    spans = spans.select("doc_id", "mark", "label", "words", "vocabulary", "letters", "w", first.alias("first_word"), last.alias("last_word"))
    length = F.col("last_word") - F.col("first_word") + 1
    letter = lambda x: F.substring(F.lit(FOREIGN + ALPHABET), (F.array_position("vocabulary", x) + 1).cast("int"), F.lit(1))
    own = F.array_join(F.transform(F.slice("w", F.col("first_word") + 1, length), letter), "")
    return spans.select("doc_id", "mark", "label", "first_word", "last_word", (1 - F.levenshtein(own, F.col("letters")) / F.greatest("words", length)).alias("similarity"))


def scan(docs: DataFrame, near: float = NEAR) -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one for each row of docs.

    Null and empty texts have no words and no labels; texts are read whole. Of rows that repeat an id each is scanned by
    itself; an empty table gives none. score: 1 where a phrase stands, else the best span's similarity,
    else 0. Other columns are not read.
    """
    found = scanned(docs)
    spans = template_spans(found).groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    spans = spans.agg(F.array_compact(F.collect_set(F.when(F.col("similarity") >= near, F.col("label")))).alias("more"), F.max("similarity").alias("best"))
    joined = found.join(spans, found["doc_id"].eqNullSafe(spans["_id"]) & (found["mark"] == spans["_mark"]), "left")
    at, base = F.transform("places", lambda x: x["at"].cast("long")), F.array_sort(F.array_distinct(F.transform("places", lambda x: x["label"])))
    labels = F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.greatest(F.coalesce("best", F.lit(0.0)), F.lit(0.0)))
    return joined.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )


def _quoted(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


#: The same scan in DuckDB, which joins the grams themselves.
SCAN_SQL = rf"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM words),
phrases(phrase, n, label) AS (VALUES {_quoted((p, len(p.split()), x) for p, x in PHRASES)}),
places AS (SELECT doc_id, i, label FROM spots JOIN phrases ON w[i + n] = 'license' AND list_aggregate(w[i + 1:i + n], 'string_agg', ' ') = phrase),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_distinct(list(label)) AS labels FROM places GROUP BY 1),
templates(template, label, tw, vocabulary, letters) AS (
    SELECT n, label, string_split(text, ' '), string_split(vocabulary, ' '), letters
    FROM (VALUES {_quoted((n, x, t, " ".join(_letters(t)[0]), _letters(t)[1]) for n, (x, t) in enumerate(TEMPLATES))}) AS v(n, label, text, vocabulary, letters)),
tgrams AS (SELECT template, t, list_aggregate(tw[t + 1:t + {K}], 'string_agg', ' ') AS gram FROM (SELECT *, unnest(range(len(tw) - {K - 1})) AS t FROM templates)),
grams AS (SELECT doc_id, i, list_aggregate(w[i + 1:i + {K}], 'string_agg', ' ') AS gram FROM spots WHERE i <= len(w) - {K}),
votes AS (SELECT doc_id, template, i AS p, t, i - t AS diagonal FROM grams JOIN tgrams USING (gram)),
lines AS (SELECT doc_id, template, diagonal FROM votes GROUP BY ALL),
cuts AS (SELECT l.*, coalesce((diagonal - lag(diagonal) OVER o > len(tw) // {SLACK})::int, 0) AS apart FROM lines l JOIN templates USING (template) WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
runs AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM cuts),
ends AS (SELECT doc_id, template, span, arg_min(p - t, p * 1000 + t) AS a, arg_max(p - t, p * 1000 + t) AS b FROM votes JOIN runs USING (doc_id, template, diagonal) GROUP BY ALL),
windows AS (SELECT doc_id, template, greatest(0, a) AS a, least(len(w), b + len(tw)) AS b FROM ends JOIN templates USING (template) JOIN words USING (doc_id)),
spans AS (
    SELECT doc_id, label, 1 - levenshtein(list_aggregate(list_transform(w[a + 1:b], lambda x: substr('{FOREIGN}{ALPHABET}', coalesce(list_position(vocabulary, x), 0) + 1, 1)), 'string_agg', ''), letters) / greatest(len(tw), b - a)::double AS similarity
    FROM windows JOIN templates USING (template) JOIN words USING (doc_id)),
more AS (SELECT doc_id, list(DISTINCT label) FILTER (similarity >= {NEAR}) AS labels, max(similarity) AS best FROM spans GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE greatest(coalesce(best, 0.0), 0.0) END::double AS score
FROM words LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)"""
