"""Licenses, URLs, quality and benchmark leaks against plain versions and planted cases."""

import random
import re

from hazardframe.llm import decontaminate, licenses, quality, queries, urls

DATA = "/root/testdata/sf0.001"


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_base(text):
    w = plain_words(text)
    places = [(i, label) for phrase, label in licenses.PHRASES.items()
              for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


def test_license_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    got = queries.QUERIES["op7_license_spans"](spark, DATA).collect()
    want = sorted((d.doc_id, *plain_base(d.text)) for d in docs)
    assert sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_license_spans(spark):
    mit = licenses.NOTICES[0][1]
    cut = mit.replace(" free of charge", "").replace("documentation", "the new documentation")
    rows = [(1, f"x y {mit} z"), (2, f"a {cut} b"), (3, "permission is hereby granted to nobody"), (4, None), (4, ""),
            (None, "Under the MIT License under the mit license"), (6, "CC BY-NC, cc_by_nc"), (6, "CC BY-NC, cc_by_nc"), (7, "mit " * 50_000)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, labels string")
    got = licenses.scan(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert by[1].labels == "mit" and by[1].score == 1 and by[1].n_base == 0
    assert by[2].labels == "mit" and 0.6 <= by[2].score < 1
    assert by[3].labels == "" and by[4].labels == "" and by[7].labels == ""
    for r in got:
        text = next(t for k, t in rows if k == r.doc_id and len(plain_words(t)) == r.n_words)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(text)
    assert licenses.scan(df.limit(0)).count() == 0


def test_urls(spark):
    pages = [(1, "http://x.Example.COM/en/1#a", None), (2, "https://example.com/de", '<link rel="canonical" href="https://example.com/en/z">'),
             (3, "http://a.org/1", '<meta http-equiv=refresh content="0;url=http://b.org/2">'),
             (4, "http://b.org/2#frag", "<link href='/3' rel='canonical'/>"), (5, "http://b.org/3", '<link rel=canonical href=http://b.net/fr/9>'),
             (6, "http://c.org/", '<link rel=canonical href=http://b.net/es/1>'), (7, "http://c.org/x", '<link rel=canonical href=http://c.org/>'),
             (8, "http://c.org/x", '<link rel=canonical href=http://www.example.com/en/>'), (9, None, "<p>"), (10, "nothing", ""),
             (10, "nothing", ""), (11, "http://net/fr/?q", ""), (12, "http://mynet/fr/", ""), (13, "http://h?x://y/z", None)]
    df = spark.createDataFrame([(*p, "v") for p in pages], "page_id long, url string, html string, verdict string")
    got = {r.page_id: r for r in urls.judge(df, urls.edges(df)).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("x.example.com", "/en/1", "example.com/en/", "block")
    assert got[2].rule == "com/" and got[2].verdict == "allow"
    assert [got[i].verdict for i in (3, 4, 5)] == ["block"] * 3 and got[3].rule is None
    assert [got[i].verdict for i in (6, 7, 8)] == ["allow"] * 3
    assert (got[9].host, got[9].path, got[9].verdict) == ("", "", "allow") and got[10].host == ""
    assert got[11].verdict == "block" and got[12].rule is None and (got[13].host, got[13].path) == ("h", "")
    assert urls.judge(df, urls.edges(df)).count() == len(pages)
    assert urls.judge(df.limit(0), urls.edges(df.limit(0))).count() == 0


def plain_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again = set(), 0
    for line in text.split("\n"):
        again += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = {g for g in grams if grams.count(g) > 1} if len(words) < 400 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    covered = {j for i, g in enumerate(grams) if g in many for j in range(i, i + 8)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), n < 20 or 100 * len(covered) > 30 * n)


def test_quality_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = queries.QUERIES["op6_quality_ratio"](spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        assert plain_quality(docs[r.doc_id]) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert not (r.kept and r.base_failed)
    judged = [(r.kept, labels[r.doc_id]) for r in got if r.doc_id in labels and not r.base_failed]
    assert sum(k == bool(q) for k, q in judged) >= 0.95 * len(judged)


def test_quality_odd_rows(spark):
    text = "a\x1cb é\u00a0x\n\n \n \ny\ny\ny " + "w1 w2 w3 w4 w5 w6 w7 w8 " * 3
    rows = [(1, None), (1, ""), (None, text), (3, text), (3, text), (4, "word " * 30_000), (5, " ".join(map(str, range(300))))]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    got = quality.score(df, model).collect()
    assert len(got) == len(rows)
    for r in got:
        want = {plain_quality(t) for k, t in rows if k == r.doc_id}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) in want
    assert quality.keep_good(df, model).columns == df.columns
    assert quality.score(df.limit(0), quality.fit(df.limit(0), labels.limit(0))).count() == 0


def plain_score(text, model):
    import numpy as np
    return quality.Model.score(model, next(quality._measured([text], model.bits, {}))[1]) if text else np.nan


def sentence(rng, n=24):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def test_leaks(spark):
    rng = random.Random(2)
    filler = lambda: sentence(rng, 60)
    asked = "While Tom has 3 apples and 12 pears, the friend Mary has 5 kg of rice. How many apples and pears does Tom have in all"
    other = asked.replace("Tom", "Ann").replace("3", "71").replace("12", "4.5").replace("Mary", "Peter").replace("5 kg", "9 lbs")
    plain = sentence(rng)
    bench = [(1, asked, 0), (2, plain, 0), (2, plain, 0), (3, plain + " z", 0), (4, None, 0), (5, "", 0), (6, "two words", 0)]
    rows = [(10, f"{filler()} {asked} {filler()}"), (11, f"{filler()}. {other}. {filler()}"),
            (12, other.replace("does Ann", "does Bob")), (13, f"{filler()} {' '.join(plain.split()[:9])} {filler()}"),
            (14, " ".join(plain.split()[:14])), (15, plain.upper()), (16, None), (17, ""), (None, plain), (18, "Two words"), (19, "two words more"),
            (20, filler()), (20, plain), (21, "5 " * 30_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long")
    items = spark.createDataFrame(bench, "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, items).collect()}
    assert {k for k in got} == {(10, 1), (11, 1), (14, 2), (14, 3), (15, 2), (15, 3), (None, 2), (None, 3), (18, 6), (20, 2), (20, 3)}
    assert got[10, 1].changed_slots == 0 and got[11, 1].changed_slots > 4 and got[15, 2].n_matched == got[15, 2].n_windows
    left = decontaminate.remove(docs, items)
    assert sorted(r.doc_id for r in left.collect()) == [12, 13, 16, 17, 19, 21] and left.columns == docs.columns
    assert decontaminate.leaks(docs.limit(0), items).count() == 0 == decontaminate.leaks(docs, items.limit(0)).count()


def test_texts_without_a_key_leak_by_themselves(spark):
    rng = random.Random(4)
    item, good = sentence(rng, 30), sentence(rng, 30)
    rows = [(None, item, 1), (None, good, 2), (7, good, 3), (None, None, 4), (8, item, 5), (None, item, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = decontaminate.remove(docs, items)
    assert sorted(r.n for r in left.collect()) == [2, 3, 4] and left.columns == docs.columns


def test_near_copies_of_one_conflicting_value_leak(spark):
    rng = random.Random(6)
    fill = lambda n: sentence(rng, n)
    a, b, c = fill(20), fill(20), fill(20)
    texts = {1: (f"{a} with Tom {b} with Tom {c}", "Tom", "Bob"), 2: (f"{a} has 3 {b} has 3 {c}", "3", "4"),
             3: (f"{a} 7 minutes {b} 7 minutes {c}", "minutes", "seconds")}
    rows = [(k, (lambda cut: f"{cut[0]}{new}{cut[1]}")(t.rsplit(old, 1))) for k, (t, old, new) in texts.items()]
    rows += [(9, "Short words with Tom and Tom again"), (10, "Short words with Tom and Bob again")]
    items = spark.createDataFrame([*((k, t) for k, (t, _, _) in texts.items()), (9, rows[-2][1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    for k in texts:
        assert got[k, k].longest_run >= 40 and got[k, k].changed_slots == 0
        assert 1 <= got[k, k].n_windows - got[k, k].n_matched <= decontaminate.WINDOW
    assert (9, 9) in got and (10, 9) not in got


def test_each_notice_has_its_own_label_only(spark):
    by = "this work is licensed under a creative commons attribution {} 4 0 international license"
    full = ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU {} General Public "
            "License as published by the Free Software Foundation")
    short = "You may use it under the terms of the GNU General Public License as published by the Free Software Foundation"
    rows = [(i, f"a b {text} y z", label) for i, (label, text) in enumerate(licenses.NOTICES)]
    rows += [(100, full.format("Lesser"), "lgpl"), (101, full.format("Affero"), "agpl"), (102, full.format(""), "gpl"), (103, short, ""),
             (104, by.format("noncommercial sharealike"), "cc-by-nc,cc-by-sa"), (105, by.format("noderivatives"), "")]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, want string")).collect()}
    assert {i: got[i] for i, _, _ in rows} == {i: label for i, _, label in rows}


def test_null_keys_are_known_by_their_texts(spark):
    """An item cut in three parts, each in a row without a key, leaks from none of them."""
    words = "which train leaves the old station at nine and reaches the far harbour before the slow ferry that crosses twice every second day".split()
    item = " ".join(words)
    parts = [" ".join(words[a : a + 10]) for a in (0, 7, 14)]
    asked = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(None, p) for p in parts], "doc_id long, text string")
    assert decontaminate.leaks(docs, asked).count() == 0
    whole = docs.unionAll(spark.createDataFrame([(None, item), (None, item + " again")], docs.schema))
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(whole, asked).collect()] == [(None, 1)] * 2
    assert sorted(r.text for r in decontaminate.remove(whole, asked).collect()) == sorted(parts)
