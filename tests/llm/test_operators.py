"""The numbered operators against brute force, plus the edge cases that their docstrings define."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.llm import bpe, chat, common, decontaminate, fingerprints, html_text, minhash, passages, pii, quality, shingles, suffixes

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, key long, n int, hash string, sub int, bucket int"
FOX = "the quick brown fox jumps over the lazy dog while the cat sleeps on the warm mat near the old door of the house and nobody in the street seems to mind the noise that the dog makes every single morning before the sun comes up over the quiet hills far away from the sea and the harbour"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty texts, repeated rows, a very long text, extra columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, FOX, 1, 1, "h", 1, 1),
        (2, FOX, None, None, None, None, None),
        (2, FOX, 2, 2, "h", 2, 2),
        (2, "", 3, 3, "h", 3, 3),
        (3, None, 4, 4, "h", 4, 4),
        (None, FOX, 5, 5, "h", 5, 5),
        (None, None, 6, 6, "h", 6, 6),
        (4, "a b", 7, 7, "h", 7, 7),
        (5, "A  b\n", 8, 8, "h", 8, 8),
        (6, long, 9, 9, "h", 9, 9),
        (7, " \t\n", 10, 10, "h", 10, 10),
        (8, FOX.replace("cat", "cow"), 11, 11, "h", 11, 11),
    ]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def word_sets(texts):
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    out = []
    for t in texts:
        w = (t or "").encode().translate(lower).split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


# --- 1 fingerprints


def test_fingerprints_edits_and_order(spark, docs):
    got = fingerprints.compare(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    own = docs.toPandas().sort_values("doc_id").reset_index(drop=True)
    texts = own["text"].tolist()
    for i, t in enumerate(texts):
        k = len(t) // 4
        edited = t[: len(t) - k] + texts[(i + 1) % len(texts)][:k]
        assert got["edited_sha256"][i] == hashlib.sha256(edited.encode()).hexdigest()
        a, e = word_sets([t, edited])
        if len(a) > 100:
            assert abs(len(a & e) / len(a | e) - got["near_edited"][i]) < 0.3


def test_fingerprints_odd(odd, empty):
    got = fingerprints.compare(odd)
    assert got.count() == odd.count() and fingerprints.compare(empty).count() == 0
    rows = got.where("doc_id = 2").select("n_chars", "fingerprint").distinct().collect()
    assert {(r.n_chars, r.fingerprint == "") for r in rows} == {(len(FOX), False), (0, True)}
    assert got.where("near_edited < 0 or near_edited > 1 or near_next is null").count() == 0


def test_fingerprints_merge_and_contain(spark):
    """Parts that overlap by four words merge to just the whole's fingerprint, however short they are; the
    containment of a short text in a long one is estimated from the same threshold."""
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 10**9)}" for _ in range(4000)]
    rows = [(1, " ".join(words))] + [(2, " ".join(words[i : i + 9])) for i in range(0, 4000 - 4, 5)]
    fp = fingerprints.with_fingerprint(spark.createDataFrame(rows, "doc_id long, text string"), "text", "fp")
    got = fp.groupBy("doc_id").agg(fingerprints.merged(F.collect_list("fp")).alias("fp")).orderBy("doc_id").collect()
    assert got[0].fp == got[1].fp and abs(len(got[0].fp) - 999) < 120
    pairs = [(1, " ".join(words), " ".join(words[500:900])), (2, " ".join(words[:400] + words[-400:]), " ".join(words[200:])), (3, "a b", "a b"), (4, "a b", "a c"), (5, "", None), (6, "", "a b"), (7, None, "x")]
    df = spark.createDataFrame(pairs, "id int, x string, y string")
    df = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, "x", "a"), "y", "b")
    r = df.orderBy("id").select(fingerprints.containment("b", "a").alias("ba"), fingerprints.containment("a", "b").alias("ab"), fingerprints.likeness("a", "b").alias("like")).collect()
    assert r[0].ba == 1 and abs(r[0].ab - 0.1) < 0.05 and abs(r[0].like - 0.1) < 0.05
    assert abs(r[1].ab - 0.75) < 0.15
    assert [x.like for x in r[2:]] == [1, 0, 1, 0, 0] and r[5].ab == r[6].ab == 1 and r[2].ab == 1 and r[3].ab == 0


# --- 2 decontamination


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_is_smith_waterman():
    rng = random.Random(3)
    for _ in range(400):
        a, b = [rng.randint(1, 4) for _ in range(rng.randint(1, 12))], [rng.randint(0, 4) for _ in range(rng.randint(1, 15))]
        s, x, y = decontaminate.align(np.array(a), np.array(b))
        assert s == smith_waterman(a, b) == (smith_waterman(a, b[x:y]) if s else 0)


def test_decontamination_finds_edited_copies(spark, docs, odd, empty):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    words = items.orderBy("item_id").first().text.split()
    words[7], words[12] = "changed", "words"
    leak = "Some prose comes first. " + " ".join(words) + " And some after it."
    rows = decontaminate.contaminated(spark.createDataFrame([(9000, leak), (9001, "nothing of the kind here at all")], "doc_id long, text string").unionByName(docs.select("doc_id", "text")), items).collect()
    own = {t.doc_id for t in docs.collect() for i in items.collect() if " ".join(i.text.split()) in " ".join(t.text.split())}
    assert {r.doc_id for r in rows} >= own | {9000} and 9001 not in {r.doc_id for r in rows}
    assert decontaminate.contaminated(odd, items).count() == 0
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(odd, items.limit(0)).count() == 0
    fox = spark.createDataFrame([(1, " ".join(FOX.split()[5:30])), (2, None), (None, "x y z")], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in decontaminate.contaminated(odd, fox).collect()) == ["1", "2", "2", "8", "None"]


def test_decontamination_equals_alignment_of_all_pairs(spark):
    """Copies with every third, fourth, fifth word replaced and with random edits against Smith-Waterman
    over all pairs of documents and items."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: prose(rng.randint(14, 40)) for i in range(12)} | {100: ["just", "three", "words"], 101: ["single"]}
    docs, regular = {}, set()
    for i, w in items.items():
        for step in (3, 4, 5, 99):
            copy = [f"x{rng.randint(0, 9)}" if k % step == step - 1 and i < 100 else x for k, x in enumerate(w)]
            regular.add(len(docs))
            docs[len(docs)] = prose(30) + copy + prose(30)
        for rate in (0.1, 0.2, 0.3):
            copy = [x for x in w if rng.random() > rate / 3]
            docs[len(docs)] = prose(20) + [rng.choice(vocabulary) if rng.random() < rate else x for x in copy] + prose(5)
    for _ in range(100):
        docs[len(docs)] = prose(60)
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(frame, bench).collect()}
    numbers = {x: k for k, x in enumerate({x for w in [*items.values(), *docs.values()] for x in w})}
    want = {}
    for d, w in docs.items():
        for i, v in items.items():
            score = decontaminate.align(np.array([numbers[x] for x in v]), np.array([numbers[x] for x in w]))[0] / (2 * len(v))
            if score >= decontaminate.LEAST:
                want[d, i] = score
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want)
    assert {x for x in want if x[0] in regular} <= set(got)
    assert sum(abs(got[x] - want[x]) < 1e-9 for x in got) > 0.97 * len(got)


def test_without_leaks_judges_each_row(spark):
    bench = spark.createDataFrame([(None, " ".join(FOX.split()[5:30])), (1, None), (1, "")], "item_id long, text string")
    rows = [(1, FOX, 1), (1, "nothing of the kind", 2), (None, FOX, 3), (None, None, 4), (None, "clean", 5), (2, "", 6), (3, FOX, None), (3, FOX, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leak int")
    got = decontaminate.without_leaks(docs, bench)
    assert got.columns == docs.columns and sorted(r.leak for r in got.collect()) == [2, 4, 5, 6]
    assert {r.item_id for r in decontaminate.contaminated(docs, bench).collect()} == {None}
    assert decontaminate.without_leaks(docs, bench.limit(0)).count() == len(rows)


# --- 3 html


def test_html_rules(spark):
    body = "The story of the day is in the hand of the many, and it was for them to be on the road. " * 3
    page = f"""<html><head><title>no</title><script>var a="<p>no</p>";</script></head><body><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies</div>
    <header><p>Site</p></header><h1>Big &amp; bold</h1><p>{body}</p><p>Short&nbsp;one.<br>Next <b>line</b></p><p>{body}</p><div class="comments"><p>{body}</p></div><form><p>{body}</p></form><footer>&copy; us</footer></body></html>"""
    assert html_text.main_text(page) == "\n\n".join(["Big & bold", body.strip(), "Short one. Next line", body.strip()])
    assert html_text.main_text("<article><h1>T</h1><p><b>one<br><p>two</p><aside>no</aside></article><p>outside</p>") == "T\n\none\n\ntwo"
    rows = [(1, "u", page, 1), (2, None, None, 1), (None, "u", "", 1), (3, "u", "<p", 1), (4, "u", "&#x41;&lt;", 1)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_pages(spark):
    """The article of each page; without <article>, and without any tag or class word that names furniture,
    nearly always too. The rules decide, not the element."""
    import html as h_
    from collections import Counter

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").toPandas()
    rules, wrong, wrong_bare = Counter(), 0, 0
    for h in pages["html"]:
        inner = re.search(r"<article>(.*?)</article>", h, re.DOTALL).group(1)
        blocks = [" ".join(h_.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n\n".join(b for b in blocks if b)
        assert html_text.main_text(h) == want
        found = html_text.blocks(h)
        first = [html_text.first_pass(b) for b in found]
        rules.update(rule if label == html_text.BAD else label for label, rule in first)
        plain = re.sub(r"</?article>", "", h)
        wrong += html_text.main_text(plain) != want
        wrong_bare += html_text.main_text(re.sub(r"(</?)(?:footer|nav)\b", r"\1div", plain.replace(' class="ad"', ""))) != want
    assert wrong <= 0.04 * len(pages) and wrong_bare <= 0.1 * len(pages)
    # links and text features decide on most blocks, tags and class words on few; most of the rest by neighbours
    assert rules["furniture"] < 0.15 * sum(rules.values()) and min(rules["links"], rules["good"], rules["near"], rules["short"], rules["sparse"]) > 50


def test_html_second_pass():
    b = lambda tag="p", inside=False: html_text.Block("x", 0, False, inside, tag)
    run = lambda labels, tags=None, inside=None: [x == "good" for x in html_text.second_pass(labels, [b(t, i) for t, i in zip(tags or ["p"] * len(labels), inside or [False] * len(labels))])]
    assert run(["bad", "short", "good", "short", "good", "near", "bad"], ["div", "div", "p", "li", "p", "p", "div"]) == [False, False, True, True, True, True, False]
    assert run(["bad", "title", "short", "good", "title", "bad"]) == [False, True, True, True, False, False]
    assert run(["bad", "near", "short"]) == [False, True, True] and run(["bad", "sparse", "bad"]) == [False, True, False]
    assert run(["short", "bad"]) == [False, False] and run([]) == []
    # the ends of an article count as good, and what lies outside is no neighbour of what lies inside
    assert run(["bad", "short", "good", "short", "short"], ["li", "li", "p", "li", "li"], [False, True, True, True, False]) == [False, True, True, True, False]


def test_html_odd(spark):
    long = "<article>" + "<p>The story of the day is in the hand of the many, and it was for them to be on the road. </p>" * 20_000 + "</article>"
    rows = [(1, None, long, "x"), (1, None, long, "x"), (2, "u", "<nav>only</nav>", None), (3, "u", "no markup, and short", None)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")).collect()
    assert [r.n_chars for r in got if r.page_id == 1] == [87 * 20_000 + 2 * 19_999] * 2 and {r.text for r in got if r.page_id in (2, 3)} == {""}


# --- 4 PII


def test_pii_base_spans_equal_the_patterns():
    kinds = (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"))
    good = (lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")), pii.good_card, lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15)
    rng = random.Random(1)
    parts = ["a", "b@", ".", "1", "2", "25", "+", "-", " ", "(", ")", "@", ".c", "1.2.", "4242424242424242", "\n", "é"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        want = sorted((m.start(), k, m.end()) for k in range(4) for m in kinds[k].finditer(t) if good[k](m.group()))
        assert pii.base_spans(t) == want


def test_pii_field_separates_what_ran_together(spark, odd, empty):
    rng = random.Random(2)
    card = lambda: next(c for c in iter(lambda: "4" + "".join(rng.choice("0123456789") for _ in range(15)), "") if pii.luhn(c))
    phone = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    rows = [(i, f"call {phone()} or pay with {card()} then version {i % 9}. and page {i}") for i in range(300)]
    rows.append((1000, f"both {phone()} {card()} here"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = pii.train(docs)
    got = pii.find(docs, field).where("doc_id = 1000").first()
    assert got.n_card == got.n_phone == 0 and got.n_added == 2 and [s.split(":")[0] for s in got.spans.split(",")] == ["phone", "card"]
    assert pii.mask(docs, field).where("doc_id = 1000").first().text == "both [PHONE] [CARD] here"
    assert pii.find(odd, field).count() == odd.count() and pii.find(empty, field).count() == 0
    assert pii.mask(odd, field).where("text is null").count() == 2
    assert pii.find(odd, pii.train(empty)).where("n_added > 0").count() == 0


def test_pii_skip_edges_change_labels(spark):
    """What is unclear alone gets the label of its repeat elsewhere in the document; with the skip edges
    taken out it doesn't. Cards with a wrong digit and secrets are added, plain numbers are not."""
    rng = random.Random(3)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    code = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(19)) + "7"
    rows = []
    for i in range(400):
        card = next(c for c in iter(lambda: "4" + digits(15), "") if pii.luhn(c))
        rows.append((i, f'item {code()} and item {code()} and {code()} are parts; token = "{code()}" and pay {card} or call +1 (212) 555-{digits(4)}. Part 1{digits(9)}'))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = pii.train(docs)
    secret = "k3y0fth3h0us3w1thd00"
    text = f'my token = "{secret}" is new; it was there that {secret} came; he said 12125550001 or +12125550001, and 4111111111111112'
    toks = pii.tokens_of(text)
    feats, near, shapes = pii.features_of(toks, text)
    skips = pii.skip_edges(toks, shapes)
    assert {k for _, _, k in skips} >= {0, 1}
    with_, without = (field.marginals(feats, near, e).argmax(1) for e in (skips, []))
    second = [i for i, t in enumerate(toks) if t[2] == secret][1]
    assert with_[second] == pii.FIRST["secret"] != without[second]
    spans = pii.find(spark.createDataFrame([(1, text), (2, "on page 12 of 4000 there are 2 cats and 1,000 dogs")], "doc_id long, text string"), field).orderBy("doc_id").collect()
    kinds = [x.split(":")[0] for x in spans[0].spans.split(",")]
    assert kinds.count("secret") == 2 and kinds.count("card") == 1 and spans[0].n_card == 0 and spans[0].n_spans == len(kinds)
    assert spans[1].n_spans == 0


def test_training_samples_are_bounded(spark, odd, empty):
    """Whole texts within both bounds, in the order of the hash; long texts, rows without doc_id and repeats stay out."""
    rows = [(i, "w" * (50 + i % 7)) for i in range(300)] + [(7, "w" * 50)] * 500 + [(1000, "x" * 2000), (None, "y"), (None, None), (1001, None), (1002, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = common.sampled(docs, 10_000, 16_000).collect()
    assert 14_000 < sum(len(x.text or "") for x in got) <= 16_000
    assert len(got) == len({(x.doc_id, x.text) for x in got}) and {(x.doc_id, x.text) for x in got} <= set(rows)
    assert 1000 not in {x.doc_id for x in got} and None not in {x.doc_id for x in got}
    assert common.sampled(docs, 40, 10**9).count() == 40
    assert {x.doc_id for x in common.sampled(docs, 40, 10**9).collect()} == {x.doc_id for x in common.sampled(docs.repartition(3), 40, 10**9).collect()}
    assert common.sampled(docs, 10_000, 10**9).count() == len({x for x in rows if x[0] is not None})
    assert common.sampled(empty, 10, 10).count() == 0 and common.sampled(odd, 10_000, 10**9).where("doc_id is null").count() == 0


def test_pii_training_is_bounded_in_tokens(spark):
    docs = spark.createDataFrame([(i, "call +1 (212) 555-%04d now" % i) for i in range(100)] + [(1000, "1 " * 5000)], "doc_id long, text string")
    text = "call +1 (212) 555-0001 now"
    few, all_ = pii.train(docs, most_tokens=60), pii.train(docs)
    assert pii.base_spans(text) and (few.unary != all_.unary).any()
    same = pii.train(docs.unionAll(docs).repartition(5))
    assert (same.unary == all_.unary).all() and (same.edges == all_.edges).all()


def test_pii_catches_planted_values_and_leaves_clean_documents(spark):
    """On documents that the field was not fitted on: what share of planted values that the patterns miss is found,
    and how many of the added spans are planted ones."""
    rng = random.Random(9)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    card = lambda good: next(c for c in iter(lambda: "4" + digits(15), "") if pii.luhn(c) == good)
    code = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(19)) + "7"
    words = "the meeting on day {0} had {1} people, version 2.{2}, page {1}{0} of 19{0}{2}; order no 7{1}{2} came at {0}:{1}. ".format
    clean = lambda: words(rng.randint(10, 28), rng.randint(10, 59), rng.randint(10, 99))
    fit = [(i, f'{clean()}token = "{code()}" and pay {card(True)} or call +1 (212) 555-{digits(4)}. {clean()}') for i in range(400)]
    field = pii.train(spark.createDataFrame(fit, "doc_id long, text string"))
    rows, planted = [], {}
    for i in range(300):
        value = (card(False), f"+1 (646) 555-{digits(4)} {card(True)}", code())[i % 3]
        named = f'token = "{value}" and {clean()}' if i % 3 == 2 else ""
        text = f"{clean()}{named}pay {value} now. {clean()}" if i % 3 < 2 else f"{clean()}{named}it was there that {value} came. {clean()}"
        rows.append((i, text))
        planted[i] = (text.rindex(value), text.rindex(value) + len(value))
    rows += [(1000 + i, clean() * 3) for i in range(300)]
    found = {x.doc_id: [tuple(map(int, s.split(":")[1:])) for s in x.spans.split(",") if s] for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), field).collect()}
    caught = sum(any(a < e and b > s for a, e in found[i]) for i, (s, b) in planted.items())
    wrong = sum(len(found[1000 + i]) for i in range(300))
    assert caught >= 0.9 * len(planted), caught
    assert wrong == 0, wrong


# --- 5 quality


def test_quality_held_out(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = quality.score(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"])
    r, y = got["score"].rank(), got["quality"] == 1
    auc = (r[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc > 0.97
    assert quality.score(odd, model).where("score between 0 and 1").count() == odd.count()
    assert quality.score(empty, model).count() == 0
    none = quality.train(docs, labels.limit(0))
    assert quality.score(docs, none).where("score = 0.5").count() == docs.count()


# --- 6 passages


def exact_repeats(rows, n=51):
    seen = {}
    for i, t in rows:
        w = (t or "").lower().split()
        for k in range(len(w) - n + 1):
            seen.setdefault(tuple(w[k : k + n]), set()).add(i)
    return set().union(*[v for v in seen.values() if len(v) > 1], set())


def test_passages_find_all_exact_repeats(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = passages.near_passages(docs).toPandas()
    assert exact_repeats(rows) <= set(got["doc_id"])
    text = dict(rows)
    for x in got[got["doc_id"] != got["rep_doc_id"]].itertuples():
        a, b = (word_sets([" ".join(text[d].split()[f:e])])[0] for d, f, e in ((x.doc_id, x.first_word, x.last_word), (x.rep_doc_id, x.rep_first_word, x.rep_last_word)))
        assert len(a & b) / len(a | b) >= 0.75 and x.last_word - x.first_word >= 50


def test_passages_odd(spark, odd, empty):
    got = passages.near_passages(odd)
    assert {r.doc_id for r in got.collect()} == {1, 2, 8, None} and passages.near_passages(empty).count() == 0


# --- 7 near-duplicates


def brute_components(rows):
    ids, sets = [i for i, _ in rows], word_sets([t for _, t in rows])
    top = {i: i for i in ids}

    def root(a):
        while top[a] != a:
            a = top[a]
        return a

    for x in range(len(ids)):
        for y in range(x):
            n = len(sets[x] & sets[y])
            if n and 100 * n >= 75 * (len(sets[x]) + len(sets[y]) - n):
                a, b = root(ids[x]), root(ids[y])
                top[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_minhash_equals_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rng = random.Random(4)
    base = [f"v{i}" for i in range(150)]
    for k in range(60):  # edited copies of one text, most of which resemble only the base
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(150)] = f"e{rng.randint(0, 9999)}"
        rows.append((5000 + k, " ".join(w)))
    rows.append((4999, " ".join(base)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for (i, _), s in zip(rows, word_sets([t for _, t in rows]))}


def test_minhash_pair_behind_unlike_centres(spark):
    """Each band that the two copies share has a group of short texts in it that hold its four shingles
    and nothing else of the copies; one of the group is the band's centre."""
    rng = random.Random(5)
    a = [f"q{i}" for i in range(800)]
    b = a[:695] + [f"z{i}" for i in range(105)]
    regs = lambda w: minhash.registers(minhash.shingle_set(" ".join(w))).reshape(minhash.BANDS, -1)
    bands = lambda w, k: (regs(w)[k] == regs(a)[k]).all()
    shared = [k for k in range(minhash.BANDS) if bands(b, k)]
    least = {}
    for i in range(691):
        h = int(minhash.shingle_set(" ".join(a[i : i + 5]))[0])
        least[h % 128] = min(least.get(h % 128, (1 << 64, 0)), (h >> 12, i))
    rows = [(1, " ".join(a)), (2, " ".join(b))]
    assert (regs(a)[shared] != minhash.EMPTY).all()
    for k in shared:
        other = lambda n: [f"h{k}x{rng.randint(0, 1 << 40)}" for _ in range(n)]
        quoting = lambda: [w for x in range(4 * k, 4 * k + 4) for w in a[least[x][1] : least[x][1] + 5] + other(1)]
        hub = next(w for w in (quoting() + other(40) for _ in range(10_000)) if bands(w, k))
        copies = (hub + [f"c{k}x{rng.randint(0, 1 << 40)}"] for _ in range(60))
        good = [w for w in copies if bands(w, k)][:14]
        rows += [(len(rows) + i + 1, " ".join(w)) for i, w in enumerate(good)]
    want = brute_components(rows)
    assert shared and want[2] == 1 and want[3] == 3
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_cells_link_all_components():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, rng.integers(10, 40)).astype(np.uint64)) for _ in range(60)]
    ids = np.arange(60)
    top = list(range(60))

    def root(a, t):
        while t[a] != a:
            a = t[a]
        return a

    want, got = list(top), list(top)
    for i in range(60):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                want[root(i, want)] = root(j, want)
    for i, j in minhash.cell_links(ids, ids, sets):
        got[root(i, got)] = root(j, got)
    assert all((root(i, want) == root(j, want)) == (root(i, got) == root(j, got)) for i in range(60) for j in range(i))


def test_registers_estimate():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = minhash.registers(x[:2000]), minhash.registers(x[500:2500])
    j, error = minhash.estimates(a[None], b[None], np.array([2000.0]), np.array([2000.0]))
    assert abs(j[0] - 0.6) < 4 * error[0]
    assert (minhash.registers(x[:0]) == minhash.EMPTY).all()


def test_minhash_odd(odd, empty):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count() and minhash.near_duplicates(empty).count() == 0
    comp = {(r.doc_id, r.n_shingles > 0): r.component_id for r in got}
    assert comp[(2, True)] == comp[(8, True)] == 1 and comp[(5, True)] == 4 and comp[(3, False)] == 3 and comp[(None, True)] is None
    kept = minhash.one_of_each(odd)
    assert kept.columns == odd.columns
    # of the fox only the first row; rows without words all stay
    assert sorted((r.doc_id is None, r.doc_id or 0, r.key) for r in kept.collect()) == [(False, 1, 1), (False, 2, 3), (False, 3, 4), (False, 4, 7), (False, 6, 9), (False, 7, 10), (True, 0, 6)]
    assert minhash.one_of_each(empty).count() == 0


# --- 8 suffixes


def brute_suffixes(rows, k=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - k + 1):
            if b[p : p + k] in seen:
                cover[p : p + k] = b"\1" * k
            else:
                seen.add(b[p : p + k])
        rest = bytes(c for c, m in zip(b, cover) if not m)
        out[i] = (len(b), sum(cover), sum(1 for p in range(len(cover)) if cover[p] and not (p and cover[p - 1])), hashlib.sha256(rest).hexdigest())
    return out


def test_suffixes_equal_brute_force(spark, docs):
    rng = random.Random(6)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(9000, "ab" * 400), (9001, "x" * 350), (9002, "ab" * 120 + "é" + "ab" * 120), (9003, FOX + FOX), (9004, FOX[:99]), (9005, FOX[50:160]), (9006, None)]
    rows += [(9100 + i, "".join(rng.choice("ab") for _ in range(600))) for i in range(5)]
    got = suffixes.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_suffixes(rows)


def test_sorting_puts_equal_prefixes_together():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 4096).astype(np.uint8)
    text[2048:2048 + 512] = text[1024:1024 + 512]  # the same residues modulo V
    starts = np.arange(0, 4096 - 200)
    order = suffixes.sort_block(np.concatenate((text, np.zeros(256, np.uint8))), starts)
    place = np.empty(len(starts), int)
    place[order] = np.arange(len(starts))
    assert all(abs(place[1024 + i] - place[2048 + i]) == 1 for i in range(400))
    assert set((a - b) % suffixes.V for a in suffixes.COVER for b in suffixes.COVER) == set(range(suffixes.V))


def test_sorting_is_the_order_of_the_suffixes():
    """Suffixes of all residues, in texts that repeat themselves at every distance."""
    rng = np.random.default_rng(4)
    for text in (rng.integers(97, 99, 3000), np.tile(rng.integers(97, 100, 37), 80), np.tile([97, 98, 97, 97, 98], 600), np.full(2000, 97), np.concatenate([np.tile([97, 98], 500), np.tile([97, 98], 500), [99]])):
        text = np.concatenate((text.astype(np.uint8), np.zeros(256, np.uint8)))
        starts = np.arange(0, len(text) - 256)
        keys = [text[s : s + suffixes.LENGTH].tobytes() for s in starts[suffixes.sort_block(text, starts)]]
        assert keys == sorted(keys)


def test_suffixes_of_hot_anchors(spark):
    """Anchors that are split, and contexts that stand for others, give the same removals."""
    rng = random.Random(8)
    phrase = "a frequent phrase of more than twenty four bytes "
    letters = lambda n: "".join(rng.choice("abc") for _ in range(n))
    pieces = [letters(60) for _ in range(6)]
    rows = [(i, "".join(rng.choice([letters(40), phrase, rng.choice(pieces)]) for _ in range(12))) for i in range(60)]
    rows += [(100 + i, FOX) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_suffixes(rows)
    for many, equal in ((4096, 16), (2, 1), (0, 10**9)):
        got = suffixes.deduplicate(docs, equal=equal, many=many).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_hot_passage_sends_few_contexts(spark):
    """A line in many documents, each with surroundings of its own: of the pieces that lie in the line alone, a batch of
    documents sends one, and the others are known to repeat it."""
    rng = random.Random(12)
    line = "".join(rng.choice("abcdefgh ") for _ in range(150))
    letters = lambda n: "".join(rng.choice("ijklmnop ") for _ in range(n))
    texts = [(i, letters(60) + line + letters(60)) for i in range(2000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    own = suffixes.numbered(docs)
    marks = suffixes.scattered(own, 8, 1).groupBy("bucket").applyInArrow(lambda t: suffixes.judged(t, 1, 100), suffixes.MARKS)
    rows = suffixes.contexts(own, marks).groupBy("hash").agg(F.count("*").alias("n"), F.count("context").alias("sent"), F.countDistinct("context").alias("different")).collect()
    hot = [r for r in rows if r.n >= 1500]
    assert hot and all(r.sent <= 4 * r.different for r in hot) and min(r.sent for r in hot) <= 4
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.deduplicate(docs, many=100).collect()}
    assert got == brute_suffixes(texts)


def test_suffixes_odd(odd, empty):
    got = suffixes.deduplicate(odd, keep_text=True).collect()
    assert len(got) == odd.count() and suffixes.deduplicate(empty).count() == 0
    assert sorted((str(r.doc_id), r.n_removed) for r in got if r.n_bytes == len(FOX)) == sorted([("None", 0), ("1", len(FOX)), ("2", len(FOX)), ("2", len(FOX)), ("8", next(r.n_removed for r in got if r.doc_id == 8))])


# --- 9 transcripts


def test_chat_roles(spark):
    c = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    known = chat.transcripts(c)
    got = chat.parse(known, chat.train(known)).withColumn("held_out", chat.held_out(F.col("conv_id"))).toPandas()
    own = got[got["held_out"]]
    assert own["n_right"].sum() / own["n_lines"].sum() > 0.9
    unmarked = own[own["conv_id"].isin([r.conv_id for r in known.where(chat.style(F.col("conv_id")) == 4).select("conv_id").collect()])]
    print("lines right, no markers:", unmarked["n_right"].sum() / unmarked["n_lines"].sum())
    assert unmarked["n_right"].sum() / unmarked["n_lines"].sum() > 0.6
    assert chat.parse(known.select("conv_id", "lines"), chat.train(known)).where("n_right is not null").count() == 0


def test_chat_viterbi_and_odd(spark):
    rows = [(1, 0, "user", "hi\nthere"), (1, 1, "assistant", "Hello, how can I help you today with this?"), (1, 1, None, None), (None, None, "user", "x"), (2, 5, "robot", "")]
    known = chat.transcripts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    model = chat.train(known)
    assert chat.parse(known, model).count() == 3
    # one row for a conversation however long, the same states as by one Viterbi pass; null turns in one order
    more = [(7, k if k % 50 else None, "user" if k % 2 else "assistant", f"line {k}" + "\nmore" * (k % 3)) for k in range(600)] + [(None, None, "user", "y"), (None, None, "user", "y")]
    known = chat.transcripts(spark.createDataFrame([(*r, "extra", 1) for r in more], "conv_id long, turn long, role string, text string, lines string, states int"))
    got = {r.conv_id: r for r in chat.parse(known, model).collect()}
    own = known.where("conv_id = 7").first()
    assert len(got) == 2 and got[7].n_lines == len(own.lines) == 1200 and got[None].n_lines == 2
    roles, text = chat.render(own.lines, model.viterbi(chat.observed(own.lines)))
    assert got[7].rendered == text and got[7].roles == ",".join(roles) and got[7].n_turns == len(roles)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.parse(chat.transcripts(none), chat.train(chat.transcripts(none))).count() == 0
    lines = ["User: a", "b", "Assistant: c", "User: d"]
    assert chat.render(lines, np.array([2, 3, 4, 2])) == (["user", "assistant", "user"], "<|user|>\na\nb\n<|end|>\n<|assistant|>\nc\n<|end|>\n<|user|>\nd\n<|end|>\n")
    # Viterbi against all paths
    import itertools

    obs = chat.observed(["System: x", "what?", "", "Assistant: y"])
    score = lambda p: model.first[p[0]] + sum(model.moves[a, b] for a, b in zip(p, p[1:])) + sum(f[s, obs[i, k]] for i, s in enumerate(p) for k, f in enumerate(model.feats))
    best = max(itertools.product(range(chat.STATES), repeat=4), key=score)
    assert abs(score(best) - score(tuple(model.viterbi(obs)))) < 1e-9


# --- 10 BPE


def test_bpe_equals_the_library(spark, docs, odd, empty):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    t = Tokenizer.from_file(path)
    own = [r.text for r in docs.collect()] + ["", "İstanbul ΣΑΣ ΣΣ é \x1c a b <|endoftext|>x<|startoftext|> don't I'LL 12½ aaaaaaaaaaa !!!!!!!!!! 漢字かな 😀😀 ÅÅ", "aaaa" * 50, "hello world's"]
    rng = random.Random(8)
    own += ["".join(rng.choice("abehnort's !é<|12\t") for _ in range(60)) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.encode(frame, path, keep_ids=True, keep_decoded=True).collect()}
    for i, x in enumerate(own):
        ids = t.encode(x, add_special_tokens=False).ids
        assert bytes(got[i].ids) == struct.pack(f"<{len(ids)}I", *ids) and got[i].decoded == t.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids)
    assert bpe.encode(odd, path).count() == odd.count() and bpe.encode(empty, path).count() == 0
    assert bpe.encode(odd, path).where("n_tokens = 0").count() == 4


def test_word_hashes_by_blocks():
    own = lambda t: shingles.word_hashes([t])
    assert len(shingles.shingle_sets([b"a b"])[0]) == 1 and not len(shingles.shingle_sets([b""])[0])
    h, n = shingles.word_hashes(["AÄ b\x0bc\x1cd".encode(), b"", b" \n", b"b aB", b"x" * 3_000_000 + b" b", b"b\t" * 1_500_000])
    assert n.tolist() == [3, 0, 0, 2, 2, 1_500_000]
    b = own(b"b")[0][0]
    assert h[1] == h[3] == h[6] == b and (h[7:] == b).all() and h[0] == own("aÄ".encode())[0][0] and h[4] == own(b"AB")[0][0] and h[2] == own(b"c\x1cD")[0][0]
    rng = random.Random(7)
    words = {"".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(20_000)}
    assert len(set(own(" ".join(words).encode())[0].tolist())) == len(words)
