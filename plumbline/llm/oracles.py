"""SQL that gives the rows of the registered queries, where SQL can express them."""

from __future__ import annotations

_OP5 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""

_OP4 = r"""
WITH t AS (SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM t GROUP BY source),
w AS (SELECT *, [3, 1, 2][(n - 1) % 3 + 1] AS weight, source_size * 2 AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
    - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (ORDER BY most::DOUBLE / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT source, source_size, least(most::DOUBLE, max(level) OVER () * weight) AS target FROM l),
p AS (SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
      CAST(coalesce(sum(size) OVER (PARTITION BY t.source ORDER BY ('0x' || md5(concat_ws(' ', CAST(doc_id AS VARCHAR), text))[1:15])::BIGINT,
        doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM t JOIN g ON t.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
       + least(size, greatest(budget - (budget // source_size) * source_size - before, 0)) END AS taken FROM p
"""

_OP2 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#') AS body,
    replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#'), ': ', ':\ ') AS head FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(head) + length(body) + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_OP3 = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^ 	-
]+') AS words FROM t),
g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS p, words FROM w WHERE len(words) > 2),
h AS (SELECT doc_id, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] AS gram FROM g),
r AS (SELECT doc_id, p FROM h QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
c AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
d AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM l WHERE regexp_matches(line, '[^ 	-
]') GROUP BY doc_id),
m AS (SELECT t.doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[ 	-
]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(d.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
        coalesce(d.n, 0) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z]+', '', 'g')) AS n_capitals,
        length(text) - length(replace(text, '!', '')) AS n_exclamations
      FROM t JOIN w USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN d USING (doc_id)),
v AS (SELECT doc_id, stratum, unnest([
        {ratio: 'symbols', value: coalesce(n_symbols / nullif(word_chars, 0), 0)},
        {ratio: 'dup_lines', value: coalesce(n_dup_lines / nullif(n_lines, 0), 0)},
        {ratio: 'repeats', value: coalesce(n_repeat_words / nullif(n_words, 0), 0)},
        {ratio: 'capitals', value: coalesce(n_capitals / nullif(word_chars, 0), 0)},
        {ratio: 'exclamations', value: coalesce(n_exclamations / nullif(word_chars, 0), 0)}], recursive := true) FROM m),
good AS (SELECT v.* FROM v SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) q USING (doc_id)),
k AS (SELECT unnest([0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.175, 0.15, 0.125, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03]::DOUBLE[]) AS cutoff),
n AS (SELECT stratum, ratio, cutoff, count(*) AS good, count(*) FILTER (WHERE value > cutoff) AS rejected FROM good, k GROUP BY ALL),
b AS (SELECT stratum, ratio, cutoff, good, rejected,
        list_sum([exp(lgamma(good + 1) - lgamma(j + 1) - lgamma(good - j + 1) + j * ln(0.01) + (good - j) * ln(0.99)) FOR j IN range(0, rejected + 1)]) AS tail
      FROM n),
s AS (SELECT *, bool_and(tail <= 0.05 / 5 / (SELECT count(DISTINCT stratum) FROM n)) OVER (PARTITION BY stratum, ratio ORDER BY cutoff DESC) AS holds FROM b),
x AS (SELECT stratum, ratio, min(cutoff) AS cutoff FROM s WHERE holds GROUP BY ALL),
f AS (SELECT DISTINCT doc_id FROM v JOIN x USING (stratum, ratio) WHERE value > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND doc_id NOT IN (SELECT doc_id FROM f) AS kept FROM m
"""

_OP6 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w),
b AS (SELECT doc_id, i, CASE WHEN words[i] = 'gnu' AND words[i + 1] = 'general' AND words[i + 2] = 'public' AND words[i + 3] = 'license' THEN 'gpl'
        WHEN words[i] = 'apache' AND words[i + 1] = 'license' THEN 'apache' WHEN words[i] = 'cc' AND words[i + 1] = 'by' THEN 'cc-by'
        WHEN words[i] = 'mit' AND words[i + 1] = 'license' THEN 'mit' END AS label FROM p),
base AS (SELECT doc_id, count(*) AS n, min(i) - 1 AS a, max(i) - 1 AS z, list_sort(list(DISTINCT label)) AS labels FROM b WHERE label IS NOT NULL GROUP BY 1),
t AS (SELECT row_number() OVER () AS template, label, string_split(notice, ' ') AS words, need FROM (VALUES
  ('mit', 'this project is released under the terms of the mit license', 'mit'),
  ('mit', 'permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software', 'granted'),
  ('apache', 'licensed under the apache license version 2 0', 'apache'),
  ('apache', 'you may not use this file except in compliance with the license you may obtain a copy of the license at', 'compliance'),
  ('gpl', 'this work is licensed under the gnu general public license version 3', 'gnu'),
  ('gpl', 'this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation', 'gnu'),
  ('agpl', 'it under the terms of the gnu affero general public license as published by the free software foundation', 'affero'),
  ('lgpl', 'under the terms of the gnu lesser general public license as published by the free software foundation', 'lesser'),
  ('bsd', 'redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met', 'redistribution'),
  ('bsd', 'redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer', 'redistributions'),
  ('bsd', 'use of this source code is governed by a bsd style license that can be found in the license file', 'bsd'),
  ('isc', 'permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted', 'fee'),
  ('zlib', 'this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages', 'authors'),
  ('boost', 'distributed under the boost software license version 1 0', 'boost'),
  ('cc-by', 'licensed under a creative commons attribution 4 0 international license', 'attribution'),
  ('cc-by-nc', 'licensed under cc by nc 4 0', 'nc'),
  ('cc-by-nc', 'licensed under a creative commons attribution noncommercial 4 0 international license', 'noncommercial'),
  ('cc-by-nd', 'licensed under cc by nd 4 0', 'nd'),
  ('cc-by-nd', 'licensed under a creative commons attribution noderivatives 4 0 international license', 'noderivatives'),
  ('cc-by-sa', 'licensed under cc by sa 4 0', 'sa'),
  ('cc-by-sa', 'text is available under the creative commons attribution sharealike license additional terms may apply', 'sharealike'),
  ('cc0', 'to the extent possible under law the author has waived all copyright and related or neighboring rights to this work', 'waived'),
  ('mpl', 'this source code form is subject to the terms of the mozilla public license', 'mozilla'),
  ('epl', 'this program and the accompanying materials are made available under the terms of the eclipse public license', 'eclipse'),
  ('cddl', 'the contents of this file are subject to the terms of the common development and distribution license', 'development'),
  ('artistic', 'you can redistribute it and or modify it under the terms of the artistic license', 'artistic'),
  ('ofl', 'this font software is licensed under the sil open font license version 1 1', 'sil'),
  ('psf', 'this software is licensed under the python software foundation license version 2', 'python'),
  ('public-domain', 'this is free and unencumbered software released into the public domain', 'unencumbered'),
  ('public-domain', 'this work has been placed in the public domain by its author', 'placed')) AS t(label, notice, need)),
tg AS (SELECT template, label, words AS tw, need, j, words[j] || ' ' || words[j + 1] || ' ' || words[j + 2] AS gram
       FROM (SELECT *, unnest(range(1, len(words) - 1)) AS j FROM t)),
g AS (SELECT doc_id, i, words, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM p WHERE i + 2 <= len(words)),
h AS (SELECT doc_id, template, label, tw, need, i, j, list_filter(range(greatest(j - 3, 1), least(j + 5, len(tw)) + 1), lambda x: x BETWEEN j AND j + 2
        OR (i + x - j - 1 > 0 AND words[i + x - j - 1] = tw[x]) OR (i + x - j > 0 AND words[i + x - j] = tw[x]) OR (i + x - j + 1 > 0 AND words[i + x - j + 1] = tw[x])) AS seen
      FROM g JOIN tg USING (gram)),
v AS (SELECT doc_id, template, label, tw, need, i - j AS diagonal, min(i) AS first, max(i) AS last, list_distinct(flatten(list(seen))) AS seen FROM h GROUP BY ALL),
n AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > 3, false) AS apart FROM v),
k AS (SELECT *, sum(apart::INT) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS cluster FROM n),
m AS (SELECT doc_id, template, label, tw, need, cluster, min(first) AS first, max(last) + 2 AS last, list_distinct(flatten(list(seen))) AS seen FROM k GROUP BY ALL),
s AS (SELECT doc_id, list(DISTINCT label) AS labels, max(len(seen) / len(tw)) AS share FROM m WHERE len(seen) / len(tw) >= 0.8
      AND last - first + 1 <= len(tw) * 1.5 AND len(list_filter(range(1, len(tw) + 1), lambda x: tw[x] = need AND NOT list_contains(seen, x))) = 0 GROUP BY 1)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(s.labels, [])))), ','), '') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN s USING (doc_id)
"""

_OP11 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT DISTINCT doc_id, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] || ' ' || words[p + 3] AS gram
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 2)) AS p FROM w WHERE len(words) > 3)
      UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 3),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
l AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM l JOIN c p ON p.doc_id = a JOIN c q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE e.b > r.root),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(c.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN c USING (doc_id)
"""

_OP12 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS documents, CAST(sum(len(terms)) AS BIGINT) AS total FROM d),
t AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM t, s GROUP BY term, documents),
v AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // total)))) AS BIGINT) AS score
      FROM t JOIN f USING (term) JOIN i USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER b AS INTEGER) AS rank, doc_id, score FROM v WHERE score > 0
WINDOW b AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER b <= 10
"""

ORACLES: dict[str, str] = {
    "op2_reply_trees": _OP2,
    "op3_certified_cutoffs": _OP3,
    "op4_budget_cut": _OP4,
    "op5_block_naming": _OP5,
    "op6_diagonal_votes": _OP6,
    "op11_minhash_bands": _OP11,
    "op12_dual_tree": _OP12,
}
