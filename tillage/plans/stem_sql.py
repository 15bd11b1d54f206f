"""DuckDB twin of ``functions/stemming``: the same published rules as a chain of subqueries over distinct words."""

from __future__ import annotations

from tillage.functions.stemming import (
    AFTER_STEP_1A, DOUBLES, FIRST_REGION, LI_ENDING, NEXT_REGION, SHORT_SYLLABLE, STEP_2, STEP_3, STEP_4, WHOLE_WORDS, ending,
)


def _of(table: dict[str, str], col: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def _inside(names) -> str:
    return ", ".join(f"'{x}'" for x in names)


def stem_sql(words: str) -> str:
    """A query giving (word, stem) for the distinct lower-case ``word``s of the query ``words``."""
    cut = "w[:length(w) - length(x)]"
    steps = [
        "SELECT word, regexp_replace(regexp_replace(word, '^''|(''s''|''s|'')$', ''), '(^|[aeiouy])y', '\\1Y', 'g') AS w FROM {}",
        f"SELECT *, length(regexp_extract(w, '{FIRST_REGION}', 1)) AS h FROM {{}}",
        "SELECT word, w, CASE WHEN h = 0 THEN length(w) ELSE h END AS p1, "
        f"CASE WHEN h = 0 THEN 0 ELSE length(regexp_extract(w[h + 1:], '{NEXT_REGION}', 1)) END AS h FROM {{}}",
        "SELECT word, w, p1, CASE WHEN h = 0 THEN length(w) ELSE p1 + h END AS p2, regexp_extract(w, '(sses|ied|ies|us|ss|s)$', 1) AS x FROM {}",
        "SELECT word, p1, p2, CASE WHEN x = 'sses' THEN w[:length(w) - 2] WHEN x IN ('ied', 'ies') THEN w[:length(w) - (CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)] "
        "WHEN x = 's' AND regexp_matches(w, '[aeiouy].+s$') THEN w[:length(w) - 1] ELSE w END AS w FROM {}",
        f"SELECT *, w IN ({_inside(AFTER_STEP_1A)}) AS done, w AS kept, regexp_extract(w, '(eedly|ingly|edly|eed|ing|ed)$', 1) AS x FROM {{}}",
        f"SELECT *, x IN ('ed', 'edly', 'ing', 'ingly') AND regexp_matches({cut}, '[aeiouy]') AS gone FROM {{}}",
        f"SELECT word, p1, p2, done, kept, gone, CASE WHEN x IN ('eed', 'eedly') AND length({cut}) >= p1 THEN {cut} || 'ee' WHEN gone THEN {cut} ELSE w END AS w FROM {{}}",
        "SELECT word, p1, p2, done, kept, CASE WHEN NOT gone THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' "
        f"WHEN regexp_matches(w, '({'|'.join(DOUBLES)})$') THEN w[:length(w) - 1] "
        f"WHEN p1 >= length(w) AND regexp_matches(w, '{SHORT_SYLLABLE}') THEN w || 'e' ELSE w END AS w FROM {{}}",
        "SELECT word, p1, p2, done, kept, CASE WHEN regexp_matches(w, '.[^aeiouy][yY]$') THEN w[:length(w) - 1] || 'i' ELSE w END AS w FROM {}",
        f"SELECT *, regexp_extract(w, '{ending(STEP_2)}', 1) AS x FROM {{}}",
        f"SELECT word, p1, p2, done, kept, CASE WHEN x <> '' AND length({cut}) >= p1 AND (x <> 'ogi' OR w LIKE '%logi') "
        f"AND (x <> 'li' OR regexp_matches(w, '[{LI_ENDING}]li$')) THEN {cut} || {_of(STEP_2, 'x')} ELSE w END AS w FROM {{}}",
        f"SELECT *, regexp_extract(w, '{ending(STEP_3)}', 1) AS x FROM {{}}",
        f"SELECT word, p1, p2, done, kept, CASE WHEN x <> '' AND length({cut}) >= p1 AND (x <> 'ative' OR length({cut}) >= p2) "
        f"THEN {cut} || {_of(STEP_3, 'x')} ELSE w END AS w FROM {{}}",
        f"SELECT *, regexp_extract(w, '{ending(STEP_4)}', 1) AS x FROM {{}}",
        f"SELECT word, p1, p2, done, kept, CASE WHEN x <> '' AND length({cut}) >= p2 AND (x <> 'ion' OR regexp_matches({cut}, '[st]$')) THEN {cut} ELSE w END AS w FROM {{}}",
        f"SELECT word, done, kept, CASE WHEN w LIKE '%e' AND (length(w) - 1 >= p2 OR (length(w) - 1 >= p1 AND NOT regexp_matches(w[:length(w) - 1], '{SHORT_SYLLABLE}'))) "
        "OR w LIKE '%ll' AND length(w) - 1 >= p2 THEN w[:length(w) - 1] ELSE w END AS w FROM {}",
        f"SELECT word, CASE WHEN length(word) <= 2 OR regexp_matches(word, '\\p{{{{N}}}}') THEN word ELSE coalesce({_of(WHOLE_WORDS, 'word')}, "
        "CASE WHEN done THEN kept END, replace(w, 'Y', 'y')) END AS stem FROM {}",
    ]
    query = f"(SELECT DISTINCT word FROM ({words}))"
    for step in steps:
        query = f"({step.format(query)})"
    return query
