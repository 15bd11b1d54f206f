"""Stemming, stored postings, trigram lists and touched-partition merges."""

import contextlib
import io
import os
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillage.functions.stemming import with_stems
from tillage.functions.text import query_lexemes
from tillage.operators import changes as ch
from tillage.operators.filters import contains_ci
from tillage.operators.merge import KeyedTable
from tillage.operators.search import (
    Postings, TrigramIndex, is_stored, pattern_grams, query_stems, stem_matches, stemmed_lexemes, stored_folder,
)

# Words and stems of the published sample vocabulary and the rules' own examples.
SAMPLE = """
consign:consign consigned:consign consigning:consign consignment:consign consist:consist consisted:consist consistency:consist consistent:consist
consistently:consist consisting:consist consists:consist consolation:consol consolations:consol consolatory:consolatori console:consol consoled:consol
consoling:consol consolingly:consol consonant:conson conspicuous:conspicu conspicuously:conspicu conspiracy:conspiraci conspirator:conspir
conspire:conspir constable:constabl constancy:constanc constant:constant knack:knack knackeries:knackeri knavish:knavish kneaded:knead kneel:kneel
kneeling:kneel knees:knee knell:knell knelt:knelt knightly:knight knitting:knit knives:knive knobs:knob knock:knock knots:knot generate:generat
general:general communism:communism arsenal:arsenal skies:sky dying:die hopping:hop hoping:hope falling:fall failing:fail filing:file happy:happi
sky:sky say:say by:by cry:cri ties:tie cries:cri gas:gas this:this gaps:gap kiwis:kiwi bed:bed agreed:agre feed:feed relational:relat
conditional:condit rational:ration valenci:valenc digitizer:digit conformabli:conform radicalli:radic differentli:differ vileli:vile
analogousli:analog vietnamization:vietnam predication:predic operator:oper feudalism:feudal decisiveness:decis hopefulness:hope callousness:callous
formaliti:formal sensitiviti:sensit sensibiliti:sensibl triplicate:triplic formative:format formalize:formal electriciti:electr electrical:electr
hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin adjustable:adjust defensible:defens irritant:irrit
replacement:replac adjustment:adjust dependent:depend adoption:adopt homologou:homologou activate:activ angulariti:angular homologous:homolog
effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll seeds:seed seed:seed yes:yes youth:youth boy:boy
playing:play enjoyed:enjoy proceedings:proceed inning:inning innings:inning luxuriated:luxuri sized:size abl:abl relies:reli rely:reli apple:appl
being:be a1ing:a1ing organization:organ national:nation
"""


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


# --- stemming ------------------------------------------------------------------------

def porter2(word):
    """A second implementation: a cursor over the letters, no regular expressions."""
    def vowel(c):
        return c in "aeiouy"

    def region(w, start):
        for i in range(start + 1, len(w)):
            if not vowel(w[i]) and vowel(w[i - 1]):
                return i + 1
        return len(w)

    def short_end(w):
        if len(w) == 2:
            return vowel(w[0]) and not vowel(w[1])
        return len(w) > 2 and not vowel(w[-3]) and vowel(w[-2]) and not vowel(w[-1]) and w[-1] not in "wxY"

    def longest(w, table):
        return max((x for x in table if w.endswith(x)), key=len, default="")
    whole = dict(skis="ski", skies="sky", dying="die", lying="lie", tying="tie", idly="idl", gently="gentl", ugly="ugli", early="earli",
                 only="onli", singly="singl", **{x: x for x in "sky news howe atlas cosmos bias andes".split()})
    if len(word) <= 2 or any(c.isnumeric() for c in word):
        return word
    if word in whole:
        return whole[word]
    w = ""
    for c in word:
        w += "Y" if c == "y" and (not w or vowel(w[-1])) else c
    p1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), region(w, 0))
    p2 = region(w, p1)
    x = longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if x == "sses":
        w = w[:-2]
    elif x in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif x == "s" and any(map(vowel, w[:-2])):
        w = w[:-1]
    if w in ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"):
        return w
    x = longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if x in ("eed", "eedly"):
        w = w[:len(w) - len(x)] + "ee" if len(w) - len(x) >= p1 else w
    elif x and any(map(vowel, w[:-len(x)])):
        w = w[:-len(x)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdfgmnprt":
            w = w[:-1]
        elif p1 >= len(w) and short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and not vowel(w[-2]):
        w = w[:-1] + "i"
    two = dict(tional="tion", enci="ence", anci="ance", abli="able", entli="ent", izer="ize", ization="ize", ational="ate", ation="ate", ator="ate",
               alism="al", aliti="al", alli="al", fulness="ful", ousli="ous", ousness="ous", iveness="ive", iviti="ive", biliti="ble", bli="ble",
               ogi="og", fulli="ful", lessli="less", li="")
    x = longest(w, two)
    if x and len(w) - len(x) >= p1 and (x != "ogi" or w[-4:-3] == "l") and (x != "li" or w[-3:-2] in tuple("cdeghkmnrt")):
        w = w[:-len(x)] + two[x]
    three = dict(tional="tion", ational="ate", alize="al", icate="ic", iciti="ic", ical="ic", ful="", ness="", ative="")
    x = longest(w, three)
    if x and len(w) - len(x) >= (p2 if x == "ative" else p1):
        w = w[:-len(x)] + three[x]
    x = longest(w, "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split())
    if x and len(w) - len(x) >= p2 and (x != "ion" or w[-4:-3] in ("s", "t")):
        w = w[:-len(x)]
    if w.endswith("e") and (len(w) - 1 >= p2 or len(w) - 1 >= p1 and not short_end(w[:-1])) or w.endswith("ll") and len(w) - 1 >= p2:
        w = w[:-1]
    return w.replace("Y", "y")


def stems_of(spark, words):
    return {r.word: r.stem for r in with_stems(spark.createDataFrame([(w,) for w in words], "word string"), "word").collect()}


def test_stems_of_the_sample_vocabulary(spark):
    want = dict(x.split(":") for x in SAMPLE.split())
    assert stems_of(spark, want) == want
    assert {w: porter2(w) for w in want} == want


def test_stems_match_a_second_implementation(spark):
    rng = np.random.default_rng(3)
    roots = ["hop", "hope", "rat", "commun", "gener", "arsen", "y", "yoyo", "bay", "app", "luxuri", "trou", "log", "e", "sky", "exc", "é", "中文", "bead", "oxy"]
    ends = ["", "s", "es", "ies", "ied", "ed", "edly", "ing", "ingly", "eed", "eedly", "y", "ly", "li", "logi", "ness", "fulness", "ational", "tional", "ative",
            "ization", "izer", "ement", "ment", "ent", "ion", "sion", "e", "le", "ll", "us", "ss", "sses", "iveness", "biliti", "lessli", "ogi", "iciti", "ical"]
    words = {r + a + b for r in roots for a in ends for b in ("", *ends[:12])}
    words |= {"".join(rng.choice(list("aeiouybdglnrstvwx"), int(rng.integers(1, 11)))) for _ in range(4000)} | {"a1ing", "2s", "³s"}
    got = stems_of(spark, words)
    assert {w: s for w, s in got.items() if s != porter2(w)} == {}


def test_null_words_have_no_stem_and_filters_stay_above(spark):
    df = with_stems(spark.createDataFrame([("seeds",), (None,)], "word string"), "word")
    assert [tuple(r) for r in df.orderBy("word").collect()] == [(None, None), ("seeds", "seed")]
    assert df.where("stem = 'seed'").count() == 1  # planned at once, not by repeating every rule


TEXTS = [
    (1, "The farmer relied on seeds; seeding is reliable."), (2, "Relying on a seed"), (3, None), (4, ""), (5, "the of and"),
    (6, "SEED relies 100% on it_"), (7, "seed " * 500 + "rely"), (8, "Über die Straße: seeds"), (9, r"a back\\slash 100%"), (10, "xx"),
]


@pytest.fixture()
def texts(spark):
    return spark.createDataFrame(TEXTS, "id long, body string").withColumn("kind", F.when(F.col("id") % 2 == 0, "Seed lot").otherwise("other"))


@pytest.fixture()
def folder(tmp_path):
    return f"{tmp_path}/{uuid.uuid4().hex}"


def expected_stems(text):
    return sorted({porter2(w) for w in query_lexemes(text or "")})


def test_stemmed_lexemes_keep_every_row(spark, texts):
    got = {r.id: r.lexemes for r in stemmed_lexemes(texts, "id", F.col("body")).collect()}
    assert got == {i: expected_stems(t) for i, t in TEXTS}


@pytest.mark.parametrize("query", ["seeds", "rely seed", "reliable seeding", "the", "", "nowhere seed", "strasse", "Straße"])
def test_postings_agree_with_the_scan(spark, texts, folder, query):
    postings = Postings(folder, buckets=8).write(texts, "id", F.col("body"))
    asked = query_stems(spark, query)
    want = [i for i, t in TEXTS if asked and set(asked) <= set(expected_stems(t))]
    assert sorted(r.id for r in postings.search(spark, query).collect()) == want
    assert sorted(r.id for r in stem_matches(texts, "id", F.col("body"), query).collect()) == want


def test_search_reads_only_the_buckets_of_its_terms(spark, texts, folder):
    postings = Postings(folder, buckets=8).write(texts, "id", F.col("body"))
    plan = plan_of(postings.search(spark, "seeds"))
    assert re.findall(r"PartitionFilters: \[.*bucket#\d+ (?:IN|=) ?", plan) and "body" not in plan
    assert is_stored(spark, folder, "terms") and not is_stored(spark, folder + "-none", "terms")


def test_empty_table_has_empty_postings(spark, texts, folder):
    postings = Postings(folder, buckets=4).write(texts.limit(0), "id", F.col("body"))
    assert postings.search(spark, "seed").count() == 0


@pytest.mark.parametrize("text,grams", [
    ("Seed", ["eed", "see"]), ("ab", []), ("a_b%cd", []), ("abc%xyz", ["abc", "xyz"]), (r"10\%0", ["0%0", "10%"]), (r"a\\b\_c", ["\\b_", "a\\b", "b_c"]),
    (r"a\bc", ["\\bc", "a\\b"]), ("", []),
])
def test_pattern_grams(text, grams):
    assert pattern_grams(text) == sorted(grams)


@pytest.mark.parametrize("text", ["seed", "SEED", "eed%rel", "s_ed", "ee", "100\\%", "k\\\\slash", "straße", "nothing here", "%", "lot", "seed lot"])
def test_trigram_search_agrees_with_contains(spark, texts, folder, text):
    index = TrigramIndex(folder, ("body", "kind"), buckets=8).write(texts, "id")
    want = sorted(r.id for r in texts.where(contains_ci(["body", "kind"], text)).collect())
    assert sorted(r.id for r in index.search(spark, text).select("id").collect()) == want


def test_trigram_search_reads_only_candidates_folders(spark, texts, folder):
    index = TrigramIndex(folder, ("body",), buckets=8).write(texts, "id")
    plan = plan_of(index.search(spark, "Straße"))
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ = \d", plan)


def test_stored_folder_follows_the_files(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(5).write.parquet(path)
    one = stored_folder(spark.read.parquet(path), "x")
    assert one == stored_folder(spark.read.parquet(path), "x")
    spark.range(5, 9).write.mode("append").parquet(path)
    assert stored_folder(spark.read.parquet(path), "x") != one


# --- touched partitions --------------------------------------------------------------

def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_merge_rewrites_only_touched_folders(spark, folder):
    cur = spark.createDataFrame([(i, i * 10, f"d{i}") for i in range(200)], "id long, qty long, note string")
    table = KeyedTable(folder, ("id",), parts=16).create(cur)
    before = files(folder)
    chg = spark.createDataFrame([(3, 1, 1), (3, 2, 2), (500, 7, 1)], "id long, qty long, seq long")
    job = lambda old, new: ch.upsert(old, new, ["id"], ["qty"], ["seq"])
    want = sorted(map(tuple, job(cur, chg).collect()), key=str)
    parts = table.merge(chg, job)
    assert sorted(map(tuple, table.read(spark).select("id", "qty", "note").collect()), key=str) == want
    after = files(folder)
    kept = {f for f in before if not any(f"/part={p}/" in f for p in parts)}
    assert len(parts) <= 2 and kept <= after and len(kept) >= len(before) - 2 and not (before - kept) & after
    assert table.merge(chg.limit(0), job) == [] and files(folder) == after


def test_merge_refuses_a_job_that_empties_a_folder(spark, folder):
    table = KeyedTable(folder, ("id",), parts=4).create(spark.range(20))
    with pytest.raises(ValueError):
        table.merge(spark.range(3, 4), lambda old, new: old.limit(0))
    assert table.read(spark).count() == 20


def test_backfill_and_patch_on_touched_folders(spark, folder):
    cur = spark.createDataFrame([(i, None if i % 3 else "set") for i in range(60)], "id long, code string")
    table = KeyedTable(folder, ("id",), parts=8).create(cur)
    look = spark.createDataFrame([(4, "new"), (6, "other")], "id long, value string")
    table.merge(look, lambda old, new: ch.backfill_from(old, new, "id", "id", {"code": "value"}))
    got = {r.id: r.code for r in table.read(spark).collect()}
    assert got == {i: "new" if i == 4 else None if i % 3 else "set" for i in range(60)}


def test_indexes_cut_texts_once_and_store_no_copy_of_the_lists(spark, tmp_path, monkeypatch):
    """The trigrams were cut a second time for their counts, the tokens stored twice."""
    from tillage.operators import search
    df = spark.createDataFrame([(1, "relying relies rely abcabcabc"), (1, "rely"), (2, "rely"), (3, None), (4, "ab"), (None, "rely")], "doc_id long, text string")
    stored, kept = [], search.cut_lineage
    monkeypatch.setattr(search, "cut_lineage", lambda x: stored.append(x.columns) or kept(x))
    postings = Postings(f"{tmp_path}/p", 4).write(df, "doc_id", F.col("text"))
    trigrams = TrigramIndex(f"{tmp_path}/t", ("text",), 4).write(df, "doc_id")
    assert stored == [["id", "word"], ["word", "n_rows", "stem"]]
    for index in (postings, trigrams):
        lists = spark.read.parquet(f"{index.path}/lists")
        terms = {(r.term, r.n) for r in spark.read.parquet(f"{index.path}/terms").collect()}
        assert terms == {(r.term, r["count"]) for r in lists.groupBy("term").count().collect()}
    assert ("reli", 3) in {(r.term, r["count"]) for r in spark.read.parquet(f"{postings.path}/lists").groupBy("term").count().collect()}
