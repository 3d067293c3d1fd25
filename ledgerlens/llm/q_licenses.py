"""Query: licence scans."""

from __future__ import annotations

from . import licenses
from .common import table
from .registry import register

#: fixed values: phrases of the contract and their labels
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: fixed values: opening notices of public licences
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache org"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
              "as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
]
THRESHOLD = 0.9

WORDS_SQL = (r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {WORDS_SQL.format("coalesce(text, '')")} AS ws FROM documents),
p(phrase, label) AS (VALUES {', '.join(f"({str(p.split(' '))}, '{n}')" for p, n in PHRASES)}),
places AS (SELECT k, i AS place, label FROM (SELECT k, ws, unnest(range(0, len(ws))) AS i FROM d) JOIN p ON ws[i + 1] = phrase[1] AND ws[i + 1:i + len(phrase)] = phrase),
base AS (SELECT k, count(*) AS n, min(place) AS f, max(place) AS l, list_sort(list_distinct(list(label))) AS labels FROM places GROUP BY k),
t0(label, body) AS (VALUES {', '.join(f"('{n}', '{t}')" for n, t in TEMPLATES)}),
t1 AS (SELECT label, {WORDS_SQL.format('body')} AS tw FROM t0),
t AS (SELECT label, list_distinct(tw) AS tokens, CAST(greatest(4, pow(2, ceil(log2(len(tw))))) AS INT) AS w FROM t1),
b AS (SELECT k, w, list_distinct(ws[s + 1:s + 2 * w]) AS held FROM (
  SELECT k, ws, w, unnest(range(0, len(ws), w)) AS s FROM d, (SELECT DISTINCT w FROM t))),
m AS (SELECT k, label, len(list_intersect(held, tokens)) / len(tokens)::DOUBLE AS c FROM b JOIN t USING (w)
  WHERE len(list_intersect(held, tokens)) >= ceil(len(tokens) * {THRESHOLD}::DOUBLE - 1e-9)),
found AS (SELECT k, list_distinct(list(label)) AS labels, max(c) AS best FROM m GROUP BY k)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(f AS BIGINT) AS first_word, CAST(l AS BIGINT) AS last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, found.labels))), ','), '') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base USING (k) LEFT JOIN found USING (k)
"""


@register("op13_license_scan", OP13_SQL)
def op13_license_scan(spark, sf_dir):
    """Licence labels of every document."""
    templates = spark.createDataFrame(TEMPLATES, "label string, text string")
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), templates, PHRASES, THRESHOLD)
