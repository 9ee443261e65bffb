"""Extraction, licences, packing, toxicity and revisits against plain Python, with the odd cases."""

import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from risklane.llm import common, extract, licence_texts, licenses, neardup, packing, queries, revisits, toxicity

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body><header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="ad">Buy now</div><article><header><h1>Head &amp;amp; line</h1></header><p><b>First   para&nbsp;graph &lt;x&gt;.<br>
<p>Second <a href="/s">linked</a> one,\n with a break.</p><p>Short.</p><p class="ad">Buy <b>more</b><ul><li class="share">Send</ul><div class="share">Share this</div>
<section class="comments"><p>Reader says no</p></section><br></article><aside>Side</aside>
<form><label>Name</label><input></form><div id="comments"><article class="comment"><p>Another reader</p></article></div>
<footer>&copy; Site</footer></body></html>"""


def test_extract_article():
    assert extract.main_text(PAGE) == "Head &amp; line\nFirst para graph <x>.\nSecond linked one, with a break.\nShort."


def test_extract_without_article():
    long = "Many plain words that make a paragraph of some length here, without any link in it. " * 3
    html = (f"<html><body><div class=menu><a href=1>Home</a></div><div id=content><h2>Title</h2><p>{long}</p><p>{long}</p></div>"
            "<div class=sidebar><a href=2>More</a></div></body></html>")
    assert extract.main_text(html) == "\n".join(["Title", long.strip(), long.strip()])


PARAGRAPH = "Plain words that make a paragraph of some length here, told without any link in it, number {0}. " * 2


def test_extract_keeps_content_beside_the_largest_container():
    lead, last = PARAGRAPH.format("one"), PARAGRAPH.format("last")
    inner = [PARAGRAPH.format(i) for i in range(30)]
    html = (f"<body><div><p>{lead}</p><div>" + "".join(f"<p>{p}</p>" for p in inner) + f"</div><section><p>{last}</p></section></div></body>")
    assert extract.main_text(html).split("\n") == [p.strip() for p in [lead, *inner, last]]


@pytest.mark.parametrize("frame", [
    "<article>{}</article><article>{}</article><div class=menu>x</div><article>{}</article>",     # split over siblings
    "<main>{}<article>{}</article>{}</main>",       # a card inside the main text
    "<main><article>{}</article><div>{}</div></main><div>{}</div>",
    "<div><div>{}</div><article>{}</article></div>{}",      # a lead and an end beside the article
])
def test_extract_gives_every_region_with_content(frame):
    texts = [PARAGRAPH.format(i).strip() for i in range(3)]
    small = [f"<p><a href=/{i}>{i}</a></p>" for i in range(8)]
    html = "<body><div>" + "".join(small) + "</div>" + frame.format(*(f"<p>{t}</p><p>{t} More.</p>" for t in texts)) + "</body>"
    assert extract.main_text(html).split("\n") == [line for t in texts for line in (t, f"{t} More.")]


def test_extract_article_without_content_does_not_win():
    texts = [PARAGRAPH.format(i).strip() for i in range(5)]
    html = "<body><div>" + "".join(f"<p>{t}</p>" for t in texts) + "</div>" + "<br>x<br>y<br>z<article><p>Card</p></article></body>"
    assert extract.main_text(html).split("\n")[:5] == texts


def test_extract_keeps_linked_lines_among_the_content():
    texts = [PARAGRAPH.format(i).strip() for i in range(6)]
    cited = f"See <a href=1>{texts[3][:100]}</a> {texts[3][100:150]}"
    html = "<body><div>" + "".join(f"<p>{p}</p>" for p in [*texts[:3], cited, *texts[4:]]) + \
        "</div><div>" + "".join(f"<p><a href=/{i}>Link {i}</a></p>" for i in range(8)) + "</div></body>"
    got = extract.main_text(html).split("\n")
    assert got[:6] == [*texts[:3], f"See {texts[3][:100]} {texts[3][100:150]}".replace("  ", " "), *texts[4:]]
    assert "Link 5" not in got


@pytest.mark.parametrize("html", [None, "", "<html></html>", "<nav>only</nav>", "<script>x", "<!-- open", "<", "<p"])
def test_extract_nothing(html):
    assert extract.main_text(html) == ("<" if html == "<" else "")


def test_extract_table(spark, sf_dir):
    """The article element of every page, read by patterns."""
    import html as entities
    got = queries.op4_main_text(spark, sf_dir)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(pages)
    for row in rows:
        inner = re.search(r"<article>(.*)</article>", pages[row.page_id].html, re.S).group(1)
        blocks = [" ".join(entities.unescape(re.sub(r"</?(b|i|a)[^>]*>", "", part)).split())
                  for part in re.split(r"</?(?:p|h1|br)>", inner)]
        assert row.text == "\n".join(b for b in blocks if b) and row.n_chars == len(row.text)


def test_extract_odd_rows(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars string"
    df = spark.createDataFrame([(1, None, None, "t", "n"), (None, "u", "<p>" + "word " * 50000 + "</p>", None, None), (1, None, None, "t", "n")], schema)
    got = sorted((str(r.page_id), r.n_chars) for r in extract.extract(df).collect())
    assert got == [("1", 0), ("1", 0), ("None", 249999)]
    assert extract.extract(spark.createDataFrame([], schema)).collect() == []


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = []
    for phrase, label in licenses.PHRASES:
        parts = phrase.split()
        found += [(i, label) for i in range(len(words) - len(parts) + 1) if words[i:i + len(parts)] == parts]
    return len(words), found


def test_license_base(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    met = 0
    for row in queries.op10_licenses(spark, sf_dir).collect():
        words, places = brute_base(texts[row.doc_id])
        labels = sorted({label for _, label in places})
        assert (row.n_words, row.n_base, row.base_labels) == (words, len(places), ",".join(labels))
        assert (row.first_word, row.last_word) == ((min(p for p, _ in places), max(p for p, _ in places)) if places else (None, None))
        assert set(labels) <= set(filter(None, row.labels.split(","))) and 0 <= row.score <= 1
        met += bool(places)
    assert met


def longest_run(words, templates, end):
    best = 0
    for template in templates:
        for length in range(1, end + 2):
            run = words[end - length + 1:end + 1]
            if any(template[i:i + length] == run for i in range(len(template) - length + 1)):
                best = max(best, length)
    return best


@pytest.mark.parametrize("seed", range(5))
def test_matching_statistics(seed):
    rng = np.random.default_rng(seed)
    templates = [rng.integers(0, 3, 12).tolist() for _ in range(4)]
    text = rng.integers(0, 4, 40).tolist()
    machine = licenses.Automaton(templates)
    for end, (state, length) in enumerate(machine.statistics(text)):
        assert length == longest_run(text, templates, end)
        for template, place in machine.ends[state] if length else ():
            assert templates[template][place - length + 1:place + 1] == text[end - length + 1:end + 1]


def test_license_method():
    scanner = licenses.Scanner()
    isc = dict(licenses.TEMPLATES)["isc"].split()
    whole = scanner.scan("intro words " + " ".join(isc) + " outro")
    assert whole["labels"] == "isc" and whole["score"] == 1.0 and whole["n_base"] == 0
    assert whole["spans"] == [{"label": "isc", "first_word": 2, "stop_word": 2 + len(isc), "covered": 1.0}]
    changed = " ".join(isc[:10] + ["really"] + isc[11:])
    assert scanner.scan(changed)["labels"] == "isc" and scanner.scan(changed)["score"] < 1
    assert scanner.scan(" ".join(isc[:8]))["labels"] == ""
    assert scanner.scan("The MIT license; under THE mit-license!")["labels"] == "mit"
    empty = scanner.scan(None)
    assert (empty["n_words"], empty["labels"], empty["score"], empty["first_word"]) == (0, "", 0.0, None)


def test_license_spans_of_every_copy():
    isc = dict(licenses.TEMPLATES)["isc"].split()
    text = " ".join(["intro", *isc, *["between"] * 40, *isc, *["more"] * 40, *isc])
    n = len(isc)
    assert licenses.Scanner().scan(text)["spans"] == [
        {"label": "isc", "first_word": at, "stop_word": at + n, "covered": 1.0} for at in (1, 41 + n, 81 + 2 * n)]


@pytest.mark.parametrize("text, labels", [
    ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "gpl-3"),
    ("distributed under the terms of the gnu general public license version 3", "gpl-3"),
    ("the GNU General Public License, version 2 or later", "gpl-2"), ("the gnu general public license version 4", ""),
    ("mozilla public license 2.0", "mpl-2"), ("BSD 3-Clause License", "bsd-3"), ("the bsd 4 clause license", ""),
    ("GNU Lesser General Public License, version 3", "lgpl-3"), ("/* SPDX-License-Identifier: BSD-2-Clause */", "bsd-2"),
])
def test_license_titles(text, labels):
    """A title stands for its licence and version, and for no other one."""
    assert licenses.Scanner().scan(text)["labels"] == labels


@pytest.mark.parametrize("number", range(len(licence_texts.WHOLE)))
def test_license_whole_texts(number):
    """A whole text inside a file: its label, one span of it over all its words, and for BSD the right number of clauses."""
    label, text = licence_texts.WHOLE[number]
    before = "copyright 2020 someone all rights reserved\n".split()
    got = licenses.Scanner().scan(" ".join(before) + "\n" + text + "\nint main() { return 0; }")
    size = len(licenses.words_of(text))
    assert {"label": label, "first_word": len(before), "stop_word": len(before) + size, "covered": 1.0} in got["spans"]
    assert {"bsd-2": "bsd,bsd-2", "bsd-3": "bsd,bsd-3"}.get(label, label) == got["labels"]


@pytest.mark.parametrize("seed", range(4))
def test_license_matches_are_all_maximal_runs(seed):
    """Against every pair of places in text and templates, with templates that hold and lengthen each other's runs."""
    rng = random.Random(seed)
    templates = [("t", " ".join(rng.choice("abc") for _ in range(rng.randint(4, 12)))) for _ in range(5)]
    templates.append(("t", templates[0][1] + " " + templates[1][1]))
    scanner = licenses.Scanner(templates, (), ())
    words = [rng.choice("abcx") for _ in range(120)]
    found = np.array([scanner.number.get(w.encode(), -1) for w in words])
    expected = []
    for number, (_, text) in enumerate(templates):
        own = text.split()
        for i in range(len(words)):
            for j in range(len(own)):
                if words[i] == own[j] and not (i and j and words[i - 1] == own[j - 1]):
                    n = 0
                    while i + n < len(words) and j + n < len(own) and words[i + n] == own[j + n]:
                        n += 1
                    if n >= licenses.SEED:
                        expected.append(licenses.Match(i, n, number, j))
    assert Counter(scanner.matches(found)) == Counter(expected)


def test_license_openings_are_not_hidden():
    """The opening of BSD counts although the longer texts begin alike and go on."""
    label, text = licence_texts.WHOLE[2]
    opening = text[:text.index("3. Neither")]
    assert licenses.Scanner().scan(opening)["labels"] == "bsd"


def test_license_odd_rows(spark):
    schema = "doc_id bigint, text string, labels string, score string"
    df = spark.createDataFrame([(1, None, "x", "y"), (None, "CC BY-NC " * 5000, None, None), (1, None, "x", "y")], schema)
    got = sorted((str(r.doc_id), r.n_base, r.last_word) for r in licenses.scan(df).collect())
    assert got == [("1", 0, None), ("1", 0, None), ("None", 5000, 14997)]
    assert licenses.scan(spark.createDataFrame([], schema)).collect() == []


@pytest.fixture(scope="module")
def direct():
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    return lambda text: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID], np.uint32)


ODD = ["", "The cat's  CAT, İstanbul ΑΣ ﬁne é é x́y", "a b c\x1cd\x1ee\x85f", "<|endoftext|>hi<|endoftext|> <|start",
       "漢字 かな 12345 ½ ٣ #*$%& don't I'll WE'RE", "​﻿ 😀👍🏽 a_b__c", "ẞ ǅ ŉ K Å", "x" * 500, "ab\x00cd \x7f", "it's 'S 'LL'll"]


def test_encoder_equals_the_tokenizer(direct, spark, sf_dir):
    encoder = packing.Encoder(queries.tokenizer_path())
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(150).collect()]
    for text in texts * 2:
        assert encoder.ids(text).tolist() == direct(text)[:-1].tolist(), text[:80]


def test_encoder_keeps_a_new_word_once():
    """Plain words met for the first time are one entry each: a second table of parts took as much memory again."""
    tracemalloc.start()
    encoder = packing.Encoder(queries.tokenizer_path())
    names = ["".join(chr(97 + i // 26**k % 26) for k in range(5)) for i in range(30_000)]
    before = tracemalloc.get_traced_memory()[0]
    encoder.ids(" ".join(names))
    taken = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert taken / len(names) < 160     # 199 with two tables, 121 with one
    assert encoder.ids("Aaaaa, baaaa's").tolist() == encoder.tokenizer.encode("Aaaaa, baaaa's", add_special_tokens=False).ids


def test_texts_reach_workers_in_small_batches(spark, sf_dir, monkeypatch):
    """Whole texts come in batches bounded in bytes wherever a stage of the packing or of the near duplicates takes them."""
    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"bytes": [int(batch["text"].str.len().sum())]})

    texts = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.col("id"), F.lit(" word ")), 200).alias("text"))
    usual = spark.conf.get(common.ARROW_BYTES)
    found = [row.bytes for row in common.stage(texts.mapInPandas(sizes, "bytes bigint"), "sizes", 1 << 18).collect()]
    assert len(found) > 10 and max(found) < 1 << 19
    with pytest.raises(Exception, match="division"):
        common.stage(texts.select(F.expr("raise_error('division')")), "broken", 1 << 18)
    assert spark.conf.get(common.ARROW_BYTES) == usual
    asked = {}
    for module in (packing, neardup):
        monkeypatch.setattr(module, "stage", lambda df, label, batch=None: asked.setdefault(label, batch) and None or common.stage(df, label, batch))
    few = texts.limit(40)
    packing.pack(few, queries.tokenizer_path()).count()
    neardup.near_duplicates(few).count()
    assert asked["packed"] == asked["sketches"] == common.TEXT_BATCH
    corpus_pipeline.nontoxic(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert spark.conf.get(common.ARROW_BYTES) == str(common.TEXT_BATCH)      # its result is scored when it is written
    spark.conf.unset(common.ARROW_BYTES)
    assert spark.conf.get(common.ARROW_BYTES) == usual


def test_training_keeps_a_word_once(monkeypatch):
    """Words of the sample are one object each: a copy for every place took most of the memory of the fit."""
    rows = pd.DataFrame({"_text": ["plain words and plain", "words again, plain"] * 4, "_toxic": [0, 1] * 4, "_order": range(8)})
    met, fitted = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: met.extend(texts) or fitted(texts, labels))
    list(toxicity.train(iter([rows])))
    words = [word for text in met for word in text]
    assert len(words) > len(set(words)) == len({id(word) for word in words})


def test_packer_places_the_piece_that_fits_best():
    """The first piece is the best of a plain search, every id is placed, and thousands of waiting pieces are gone through quickly."""
    limits, rng = packing.Limits(60, 5, 40), np.random.default_rng(3)
    packer = packing.Packer(limits, 0)
    waiting = [(i, 0, np.arange(n, dtype=np.uint32), n, int(rng.integers(0, n))) for i, n in enumerate(rng.integers(1, 40, 300).tolist())]
    first = max(waiting, key=lambda p: (p[3] / 60) + 1 / 5 + (p[3] - p[4]) / 40 if p[3] - p[4] <= 40 else -1)
    packer.pieces = list(waiting)
    packer.drain(0)
    assert packer.rows[0][0] == first[0]
    assert sum(row[2] for row in packer.rows) == sum(p[3] for p in waiting)
    packer = packing.Packer(packing.Limits(), 0)
    packer.pieces = [(i, 0, np.zeros(200, np.uint32), 200, 0) for i in range(6000)]
    started = time.process_time()
    packer.drain(2000)
    assert time.process_time() - started < 0.45     # 0.91 s before, 0.11 s since sizes stand by limit


def pieces_hold(rows, ids_of, limits=packing.Limits()):
    """Every id in one piece, sequences gapless and within the limits; gives the shares of padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc, own in by_doc.items():
        ids, at = ids_of(doc), 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].astype("<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limits.ids and len(own) <= limits.segments and sum(r.loss_tokens for r in own) <= limits.loss
    return 1 - sum(r.length for r in rows) / (limits.ids * max(1, len(by_sequence)))


def test_packing_the_table(spark, sf_dir, direct):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op9_pack_sequences(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert pieces_hold(rows, lambda doc: direct(texts[doc])) < 0.02


@pytest.mark.parametrize("limits", [packing.Limits(64, 4, 64), packing.Limits(64, 100, 20), packing.Limits(50, 3, 10)])
def test_packing_limits(spark, direct, limits):
    rng = np.random.default_rng(5)
    texts = {i: " ".join(rng.choice(["cat", "dog", "antidisestablishment", "7"], int(rng.integers(0, 90)))) for i in range(120)}
    texts[1000] = None
    rows = [(i, t, int(rng.integers(0, 30)) if i % 3 else None, 1) for i, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, bears int, length int").repartition(2)
    got = packing.pack(df, queries.tokenizer_path(), loss_col="bears", limits=limits).collect()
    pieces_hold(got, lambda doc: direct(texts[doc]), limits)
    bears = {i: b for i, _, b, _ in rows}
    found = defaultdict(int)
    for r in got:
        found[r.doc_id] += r.loss_tokens
    assert all(found[i] == min(len(direct(t)), bears[i] if bears[i] is not None else 10 ** 9) for i, t in texts.items())


def test_packing_odd_rows(spark):
    schema = "doc_id bigint, text string"
    got = packing.pack(spark.createDataFrame([(None, None), (1, ""), (1, "")], schema).coalesce(1), queries.tokenizer_path()).collect()
    assert sorted((str(r.doc_id), r.length, r.doc_tokens) for r in got) == [("1", 1, 1), ("1", 1, 1), ("None", 1, 1)]
    assert sorted(r.offset for r in got) == [0, 1, 2] and len({r.sequence_id for r in got}) == 1
    assert packing.pack(spark.createDataFrame([], schema), queries.tokenizer_path()).collect() == []


BAD = ["blorf", "snarg", "vexing", "quibble"]


def toxic_rows(count, seed=0):
    rng = np.random.default_rng(seed)
    clean = ["".join(rng.choice(["ba", "do", "ki", "lu", "me", "ra"], int(rng.integers(2, 5)))) for _ in range(400)]
    rows = []
    for i in range(count):
        words = list(rng.choice(clean, int(rng.integers(20, 200))))
        bad = i % 6 == 0
        for _ in range(2 * bad):
            words[int(rng.integers(len(words)))] = str(rng.choice(BAD)) + str(rng.choice(["", "s", "ing!!"]))
        rows.append((i, " ".join(words), "en" if i % 2 else "de", int(bad)))
    return rows


@pytest.mark.parametrize("parts", [1, 64, 211])
def test_padding_does_not_depend_on_partitions(spark, parts):
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randint(1, 40)))) for i in range(3000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts), queries.tokenizer_path()).collect()
    sequences = {r.sequence_id for r in got}
    assert sum(r.length for r in got) > 0.97 * 4096 * len(sequences)
    assert {r.doc_id for r in got} == set(range(3000))


def test_toxicity_held_out(spark):
    rows = toxic_rows(1500)
    docs = spark.createDataFrame([(i, t, l, 0.5) for i, t, l, _ in rows] + [(None, None, None, 1.0), (10 ** 6, "", "xx", 1.0)],
                                 "doc_id bigint, text string, lang string, score double").repartition(4)
    labels = spark.createDataFrame([(i, b) for i, _, _, b in rows], "doc_id bigint, toxic int")
    got = toxicity.classify(docs, labels).collect()
    truth = {i: b for i, _, _, b in rows}
    assert len(got) == len(rows) + 2
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert sum(r.flagged == bool(truth[r.doc_id]) for r in held) / len(held) > 0.95
    assert all(not r.predicted for r in got if r.doc_id is None or r.doc_id == 10 ** 6)


def test_toxicity_scores_ignore_all_but_the_text(spark):
    rows = toxic_rows(120)
    labels = spark.createDataFrame([(i, b) for i, _, _, b in rows], "doc_id bigint, toxic int")
    docs = spark.createDataFrame([(i, t, l) for i, t, l, _ in rows], "doc_id bigint, text string, lang string")
    blob = toxicity.learned(docs, labels)
    other = spark.createDataFrame([(-i, t, "zz", 1) for i, t, _, _ in rows], "doc_id bigint, text string, lang string, _score int")
    first = {r.text: r._score for r in toxicity.scored(docs, blob).collect()}
    again = toxicity.scored(other, blob)
    assert "__score" in again.columns
    assert {r["text"]: r["__score"] for r in again.collect()} == first
    assert toxicity.clean_rows(other, blob).columns == other.columns


def test_toxicity_cuts_at_the_natural_prevalence(spark):
    """A word met in toxic texts now and then flags no text, however few clean rows the fit may take."""
    rng = np.random.default_rng(3)
    plain = ["bado", "kilu", "mera", "domelu", "raki", "luba", "kido", "rame"]
    kinds = [("crimson", 1)] * 260 + [("grizzle", 1)] * 100 + [("grizzle", 0)] * 500 + [("", 0)] * 2400
    rows = [(i, " ".join([*rng.choice(plain, 6), word]), "en", label) for i, (word, label) in enumerate(kinds)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id bigint, toxic int")
    got = toxicity.scored(docs, toxicity.learned(docs, labels, per_class=290)).collect()
    flagged = {word: np.mean([r._flagged for r in got if word in r.text]) for word in ("crimson", "grizzle")}
    assert flagged["crimson"] > 0.95 and flagged["grizzle"] < 0.2


def test_toxicity_cut_falls_back_to_all_languages():
    counts = np.zeros((2, toxicity.BINS))
    assert toxicity.best_cut(*counts) == 0.5
    counts[0, 100], counts[0, 900], counts[1, 900], counts[1, 3000] = 50, 9, 2, 10
    assert toxicity.best_cut(*counts) == 0.5
    counts[1, 900] = 30
    assert 100 < toxicity.best_cut(*counts) * toxicity.BINS <= 900


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "en")], "doc_id bigint, text string, lang string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.classify(docs, none).collect()] == [(0.0, 0)]
    assert toxicity.classify(docs.limit(0), none).collect() == []


def test_toxicity_long_text_in_chunks(monkeypatch):
    rows = toxic_rows(120)
    model = toxicity.fit([toxicity.LETTERS.findall(t.lower()) for _, t, _, _ in rows], np.array([b for *_, b in rows]))
    text = " ".join(t for _, t, _, _ in rows[:20])
    whole = model.score(text, toxicity.Words(model))
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    monkeypatch.setattr(toxicity, "CACHED_WORDS", 20)
    assert model.score(text, toxicity.Words(model)) == pytest.approx(whole, abs=1e-5)


def plain_url(url):
    found = re.match(r"(?:[A-Za-z][A-Za-z0-9+.\-]*://)?([^/?#]*)([^?#]*)(?:\?([^#]*))?", url)
    host = re.sub(r":(80|443)$", "", re.sub(r"^www\.", "", found.group(1).lower()))
    kept = sorted(p for p in (found.group(3) or "").split("&") if p and not re.match(r"(utm_[a-z]+|ref|fbclid|gclid)=", p))
    return host + found.group(2).rstrip("/") + ("?" + "&".join(kept) if kept else "")


def brute_revisits(records):
    out = {}
    for ident, url, at, kind, _, headers in records:
        if kind != "revisit":
            continue
        mine = {k.lower(): v for k, v in (headers or {}).items()}
        earlier = [] if url is None or at is None else [
            (a, i, h) for i, u, a, k, s, h in records
            if k == "response" and s == 200 and u is not None and a is not None and plain_url(u) == plain_url(url) and a < at]
        if not earlier:
            out[ident] = ("no_response", None, None)
            continue
        a, i, h = max(earlier, key=lambda e: e[:2])
        stored = {k.lower(): v for k, v in (h or {}).items()}
        tag = lambda x: None if x is None else re.sub("^W/", "", x.strip(" "))
        if "etag" not in mine and "last-modified" not in mine:
            out[ident] = ("no_validator", None, None)
        elif (tag(mine["etag"]) != tag(stored.get("etag"))) if "etag" in mine else mine["last-modified"] != stored.get("last-modified"):
            out[ident] = ("changed", None, None)
        else:
            merged = stored | {k: v for k, v in mine.items() if k not in revisits.NOT_MERGED}
            out[ident] = ("resolved", i, "\n".join(f"{k}: {v}" for k, v in sorted(merged.items())))
    return out


RECORDS = "record_id bigint, url string, at bigint, kind string, status int, headers map<string,string>"


def test_revisits(spark):
    rng = np.random.default_rng(2)
    urls = ["http://www.A.example/x?b=2&a=1&utm_source=q", "https://a.example:443/x/?a=1&b=2#top", "http://b.example/", "https://B.example", "c.example/p?ref=1"]
    records = []
    for i in range(400):
        # One URL holds most of the records.
        url = urls[int(rng.choice(5, p=[.4, .3, .1, .1, .1]))]
        tag = str(rng.choice(["t1", "t2", "W/t1"]))
        headers = {"ETag": tag, "Last-Modified": str(rng.integers(3)), "Content-Length": "9", "X-Old": "1"}
        if rng.random() < 0.4:
            headers = {k: v for k, v in headers.items() if rng.random() < 0.5} | {"Age": "3"}
        records.append((i, url, int(rng.integers(60)), "revisit" if rng.random() < 0.6 else "response", int(rng.choice([200, 200, 404])), headers))
    records += [(900, None, 5, "revisit", 304, {}), (901, urls[0], None, "revisit", 304, None), (902, urls[0], 70, "revisit", 304, None)]
    df = spark.createDataFrame([r + ("x",) for r in records], RECORDS + ", key string").repartition(6)
    got = {r.record_id: (r.outcome, r.response_id, r.headers) for r in revisits.resolve(df).collect()}
    assert got == brute_revisits(records)
    assert {o for o, _, _ in got.values()} == {"resolved", "changed", "no_response", "no_validator"}
    assert revisits.resolve(df.limit(0)).collect() == []


def test_revisits_of_the_table(spark, sf_dir):
    records = [tuple(r) for r in revisits.captures(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()]
    got = {r.record_id: (r.outcome, r.response_id, r.headers) for r in queries.op1_revisits(spark, sf_dir).collect()}
    assert got == brute_revisits(records)
    assert sum(o == "resolved" for o, _, _ in got.values()) > len(got) / 4


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, seen, sf_dir)
        assert out.columns == docs.columns, name
        seen = spark.createDataFrame(out.collect(), out.schema)
        assert seen.count()
    assert len(corpus_pipeline.STAGES) == 5
    assert corpus_pipeline.run(spark, sf_dir).columns == packing.COLUMNS


PARAGRAPHS = [f"This is paragraph number {i} of the long story, with several words and even a comma or two in it." for i in range(6)]


@pytest.mark.parametrize("frame", [
    '<div class="container with-sidebar">%s</div>', '<div class="post hidden-xs">%s</div>', '<div class="entry no-comments">%s</div>',
    '<article class="post related">%s</article>', '<article><h1>Title</h1><section id="public-notice">%s</section></article>',
    '<form id="aspnetForm">%s</form>', '<div class="page-header"><div class="promo">%s</div></div>'])
def test_hints_do_not_bar_the_whole_article(frame):
    inner = "".join(f"<p>{text}</p>" for text in PARAGRAPHS) + '<div class="comments"><p>' + "I liked it a lot. " * 9 + "</p></div>"
    page = f'<body><nav><a href="/">Home</a></nav>{frame % inner}<div class="cookie-notice">We use cookies on this site.</div><footer>Copyright</footer></body>'
    got = extract.main_text(page).split("\n")
    assert [line for line in got if line != "Title"] == PARAGRAPHS


def test_comments_longer_than_the_article_stay_out():
    page = f"<body><article><p>{PARAGRAPHS[0]}</p></article><section class='comments'>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS * 4) + "</section></body>"
    assert extract.main_text(page) == PARAGRAPHS[0]


def test_heading_and_end_beside_the_region_are_kept():
    inner = "".join(f"<p>{text}</p>" for text in PARAGRAPHS)
    page = f"<body><div><div><h2>A heading</h2></div><div>{inner}</div><div>The end.</div></div></body>"
    assert extract.main_text(page).split("\n") == ["A heading", *PARAGRAPHS, "The end."]


@pytest.mark.parametrize("broken", ["<![>", "<![<svg>", "<![if x", "<!-", "<!DOCTYPE [<!x>", "<![CDATA[ <p> ]]>", "</", "<a <b>", "&#xFFFFFFFF;"])
def test_broken_markup_ends_no_job(broken):
    inner = "".join(f"<p>{text}</p>" for text in PARAGRAPHS)
    assert extract.main_text(f"<body><article>{inner}{broken}<p>more</p></article>").startswith(PARAGRAPHS[0])


def test_deep_nesting_takes_linear_time():
    import time
    for piece in ("<div>x ", "<div class='sidebar'>x ", "<b>x ", "<section class='promo'><p>word "):
        start = time.process_time()
        extract.main_text(piece * 20_000)
        assert time.process_time() - start < 5


def test_pages_in_a_table(spark):
    schema = "page_id bigint, url string, html string, text int"
    rows = [(1, "u", None, 1), (1, "u", None, 1), (None, None, "", 2), (3, "v", f"<p>{PARAGRAPHS[0]}</p>", 3)]
    got = sorted(map(tuple, extract.extract(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, "", 0), (3, "v", PARAGRAPHS[0], len(PARAGRAPHS[0]))], key=str)
    assert extract.extract(spark.createDataFrame([], schema)).collect() == []


def test_header_names_that_differ_in_case(spark):
    # In SQL, where a map keeps the order it is written in.
    rows = spark.sql("""SELECT * FROM VALUES
        (1L, 'http://a.org/x', 1L, 'response', 200, map('ETag', 'old', 'X-A', '1', 'etag', 'new', 'x-a', '2')),
        (2L, 'http://a.org/x', 2L, 'revisit', 304, map('etag', 'old', 'ETAG', 'new')),
        (3L, 'http://a.org/x', 3L, 'revisit', 304, NULL) AS t(record_id, url, at, kind, status, headers)""")
    got = {r.record_id: (r.outcome, r.headers) for r in revisits.resolve(rows).collect()}
    assert got == {2: ("resolved", "etag: new\nx-a: 2"), 3: ("no_validator", None)}
