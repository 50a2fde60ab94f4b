"""Every operator against a plain version or held-out accuracy."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmesh.llm import components, decontamination, html_text, jaccard_join, language_id, licenses, packing, pii, quality_rules, toxicity, url_rules

R = random.Random(4)
WORDS = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 7))) for _ in range(900)]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def frame(spark, texts, name="text"):
    return spark.createDataFrame(list(enumerate(texts)), f"doc_id bigint, {name} string").repartition(5)


# html ------------------------------------------------------------------------------------------------


def test_minimum_cut_is_minimal():
    r = random.Random(2)
    for _ in range(400):
        n = r.randint(1, 7)
        own = [r.randint(-30, 30) for _ in range(n)]
        edges = [(a, b, r.randint(0, 20)) for a in range(n) for b in range(a + 1, n) if r.random() < 0.5]

        def cost(label, own=own, edges=edges):
            return sum(abs(o) for o, k in zip(own, label, strict=True) if (o > 0) != k and o) + sum(c for a, b, c in edges if label[a] != label[b])

        assert cost(html_text.minimum_cut(own, edges)) == min(map(cost, itertools.product([True, False], repeat=n)))


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1><ul><li>Home</li></ul></header>
<div class="cookie-notice">We use cookies. Accept?</div><div id="wrapper"><div class="post-content"><h2>Title &amp; more</h2>
<p>Long paragraph of text that is   good, and has a sentence. More of it comes here.</p><ul><li>one item</li><li>two items here</li></ul><p>Short.</p>
<div class="advertisement">Buy now!</div><p>Another long paragraph, with some words and a <a href=x>link</a> in it. Yes.</p></div>
<div id="comments"><p>Great article, I really like this sentence here. Thanks for it.</p></div></div>
<aside><p>Related things are here, and they are long enough to count.</p></aside><form><label>Mail</label></form>
<script>var t="<p>no</p>";</script><footer>(c) 2020</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE).split("\n") == [
        "Title & more",
        "Long paragraph of text that is good, and has a sentence. More of it comes here.",
        "one item", "two items here", "Short.",
        "Another long paragraph, with some words and a link in it. Yes.",
    ]
    assert html_text.main_text("<article><h1>A &lt;b</h1><p><b>x y.<br><p>z &amp;am.</article>") == "A <b\nx y.\nz &am."
    assert html_text.main_text("<nav>" + "<li><a href=x>menu</a>" * 50) == ""
    assert len(html_text.main_text("<p>" + "word. " * 200_000)) == 1_199_999


def test_open_heads():
    whole = html_text.main_text(PAGE)
    assert html_text.main_text(PAGE.replace("</head>", "")) == whole
    assert html_text.main_text(PAGE.replace("</head><body>", "").replace("</body></html>", "")) == whole
    assert html_text.main_text(PAGE.replace("</head>", "<noscript><link href=x>")) == whole
    assert html_text.main_text(PAGE.replace("</li>", "").replace("</p>", "").replace("</head>", "")) == whole
    body = "<p>One sentence of the page that is long enough to be kept.<p>Another sentence that is long enough to be kept."
    two = "One sentence of the page that is long enough to be kept.\nAnother sentence that is long enough to be kept."
    for tag in ("main", "article", "div class=post", "section class=content", "center class=entry"):
        head = "<!doctype html><html><head><meta charset=utf-8><title>No</title><script>no()</script><style>no{}</style>\n"
        assert html_text.main_text(f"{head}<{tag}>{body}") == two
        assert html_text.main_text(f"{head}<body><{tag}>{body}<head>") == two
        assert html_text.main_text(f"{head}<template><p>No words of this, as it is never shown to anyone.</template><{tag}>{body}") == two
    assert html_text.main_text("<head><title>T</title>\n" + two.replace("\n", "<br>")) == two.replace("\n", " ")
    assert html_text.main_text("<head><head><title>No</title></head><body>" + body) == two


def test_formulas_are_text():
    page = "<article><p>The sum <math><mi>a</mi><mo>+</mo><mi>b</mi></math> is what we looked for here.</article>"
    assert html_text.main_text(page) == "The sum a+b is what we looked for here."


# licences --------------------------------------------------------------------------------------------


def test_licence_scan(spark):
    r = random.Random(1)
    plain = [prose(r, 30) for _ in range(60)]
    model = licenses.fit(plain)
    texts = [f"{prose(r, 9)}\n{t}" for texts in licenses.NOTICES.values() for t in texts] + plain + ["the general public has a copy of the program", "my driving license number"]
    found = {x.id: x for x in licenses.scan(frame(spark, texts), model).collect()}
    wanted = [f for f, ts in licenses.NOTICES.items() for _ in ts]
    right = sum(found[i].families == f and found[i].n_confirmed == 1 for i, f in enumerate(wanted))
    assert right >= 0.9 * len(wanted)
    assert all(found[i].n_licensed == 0 for i in range(len(wanted), len(texts)))
    assert found[0].lines == "MIT:1!" and found[0].n_paragraphs == 2


def test_frequent_licence_notice(spark):
    r = random.Random(7)
    notices = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "All rights reserved."]
    for notice in notices:
        docs = frame(spark, ["\n".join([prose(r, 20) for _ in range(8)] + [notice] * (i % 3 == 0)) for i in range(300)])
        found = licenses.scan(docs, licenses.train(docs)).collect()
        assert {x.id for x in found if x.n_licensed == 1 and x.n_confirmed == 1} == set(range(0, 300, 3))
        assert all(x.n_licensed == 0 for x in found if x.id % 3)


def test_notices_inside_long_lines(spark):
    r = random.Random(9)
    lines = {
        "Released under the MIT License. See LICENSE for details.": "MIT:0!",
        "Licensed under the Apache License, Version 2.0. See the NOTICE file distributed with this work for additional information.": "Apache-2.0:0!",
        "Licensed under the Apache License.": "Apache-2.0:0!",
        "the MIT License": "MIT:0!",
        "the MIT License, and a license that nobody granted to anyone": "MIT:0",
    }
    short = [(f, t) for f, texts in licenses.NOTICES.items() for t in texts if 3 <= len(licenses.split_words(t)) <= 20]
    texts = [*lines, *(f"{prose(r, 10)} {t} {prose(r, 10)}" for _, t in short)]
    wanted = [*lines.values(), *(f"{f}:0!" for f, _ in short)]
    model = licenses.fit([prose(r, 30) for _ in range(60)])
    found = {x.id: x.lines for x in licenses.scan(frame(spark, texts), model).collect()}
    assert [found[i] for i in range(len(lines))] == wanted[: len(lines)]
    assert all(found[i] in (wanted[i], "") for i in range(len(texts))), [(texts[i], found[i]) for i in found if found[i] != wanted[i]]
    assert sum(found[i] == wanted[i] for i in range(len(texts))) >= 0.9 * len(texts), [(texts[i], found[i]) for i in found if found[i] != wanted[i]]


def test_licence_anchors_skip_no_paragraph():
    r = random.Random(8)
    words = sorted({w for ts in licenses.NOTICES.values() for t in ts for w in licenses.split_words(t)})
    model = licenses.fit([" ".join(r.choices(words, k=8)) for _ in range(200)] + [prose(r, 30) + " the of this under a" for _ in range(300)])
    anchors = set(model.anchors)
    assert len(anchors) < len({w for f in model.weights for w in f.split(" ")})
    for _ in range(4_000):
        t = " ".join(r.choices([w for w in words if w not in anchors] if r.random() < 0.7 else words, k=r.randint(1, 40)))
        scores = np.sum([model.bias, *(model.weights[f] for f in licenses.features(t) if f in model.weights)], axis=0)
        assert scores[:-1].max() < scores[-1] or anchors & set(licenses.split_words(t))


# toxicity --------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    r = random.Random(5)
    bad = ["vile one", "rotten lot", "nasty pest"]
    rows = []
    for i in range(1_500):
        words = prose(r, r.randint(20, 200)).split()
        toxic = i % 3 == 0
        for _ in range(r.randint(1, 3) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    model = toxicity.train(df, df.where("doc_id % 5 <> 0"))
    assert len(model) < 3_000  # L1 leaves few weights
    out = toxicity.score(df, model).join(df, F.col("id") == F.col("doc_id")).where("doc_id % 5 = 0").collect()
    assert sum(x.predicted == x.label for x in out) >= 0.97 * len(out)
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in out)


# url rules -------------------------------------------------------------------------------------------


def plain_rule(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate({i: i + 32 for i in range(65, 91)})
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda x: x[:2], default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("ranges", [1, 7])
def test_url_rules(spark, ranges):
    r = random.Random(6)
    hosts = [".".join(r.choice(["a", "b", "www", "ex", "É"]) for _ in range(r.randint(1, 4))) + r.choice([".com", ".net", ""]) for _ in range(60)]
    paths = ["", "/", "/a", "/a/b", "/ab", "/É", "/a/b/c"]
    rules = list({(h, p): (h, p, r.choice(["allow", "block"])) for h in [*r.sample(hosts, 25), "com", "net"] for p in r.sample(paths, 3)}.values())
    urls = [f"http{r.choice(['', 's'])}://{r.choice(hosts).upper() if r.random() < 0.2 else r.choice(hosts)}{r.choice(paths)}{r.choice(['', '?q=/a', '#x', '/z'])}" for _ in range(800)]
    urls += ["http://hot.ex.com/a/b"] * 400 + [None, "", "no host", "://", "http://", "x://a.b?c/d"]
    got = url_rules.match_urls(frame(spark, urls, "url"), spark.createDataFrame(rules, "host string, path string, verdict string"), "doc_id", ranges=ranges)
    assert {x.id: tuple(x)[1:] for x in got.collect()} == {i: plain_rule(u, rules) for i, u in enumerate(urls)}


# personal data ---------------------------------------------------------------------------------------


def plain_spans(t):
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    out = [(m.start(), 0, m.end()) for m in re.finditer(email, t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return [(s, e, pii.KINDS[k]) for s, k, e in sorted(out)]


def test_overlapping_base_spans_hide_nothing(monkeypatch):
    field = pii.trained()
    text = "4111111111111111@example.com 555-123-4567"
    assert (29, 41, "phone") in pii.spans_of(text, field)[1]
    assert "555" not in pii.mask(text, pii.spans_of(text, field)[1])
    r = random.Random(11)
    parts = ["4111111111111111", "@example.com", "+378282246310005", " jo@é.org", " 555-123-4567", " ", "10.0.0.1", ", ", "tel ", "(555) 123-4567", "x", "\n", "4111 1111 1111 1111"]
    texts = ["".join(r.choices(parts, k=r.randint(1, 8))) for _ in range(300)]
    found = [pii.spans_of(t, field) for t in texts]
    monkeypatch.setattr(pii, "_marks_left", lambda *_: True)
    assert found == [pii.spans_of(t, field) for t in texts]


def test_base_patterns():
    r = random.Random(1)
    for _ in range(6_000):
        t = "".join(r.choice("a1.2@-+ ()x5é9\n.@0") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == plain_spans(t)
    assert pii.base_spans("4111 1111 1111 1111")[0][2] == "card"
    for t in ("a" * 300_000 + "1", "1" * 300_000, "@" * 100_000, "1." * 100_000, "a.b" * 100_000 + "@"):
        pii.spans_of(t, pii.trained())  # in one pass


def test_field_adds_spans(spark):
    texts = ["call (555) 123-4567 now", "tel 555-123-4567", "on 2024-01-02 at 10:30", "card 4111.1111.1111.1111 ok", "josé@correo.example.com ok", "mail a.b@c.example.org now", "pages 12 34 and 56"]
    got = {x.id: x for x in pii.find_pii(frame(spark, texts)).collect()}
    assert [got[i].spans for i in range(7)] == ["phone:5:19", "phone:4:16", "", "card:5:24", "email:0:23", "email:5:22", ""]
    assert got[4].n_email == 0 or got[4].base_sha256  # counts are those of the base patterns
    masked = {x.doc_id: x.text for x in pii.mask_pii(frame(spark, texts)).collect()}
    assert masked[0] == "call [PHONE] now" and masked[2] == texts[2]


def test_field_likelihood_gradient():
    """One step on one sentence raises its own likelihood."""
    sentence = [("tel 555-123-4567 and 12", [(4, 16, 3)])]
    field = pii.SemiMarkov().fit(sentence, epochs=30)
    assert [(s, e, k) for s, e, k, _ in field.decode(sentence[0][0])] == [(4, 16, 3)]


def test_toxicity_sample_is_bounded_in_rows(spark, monkeypatch):
    """One id with very many rows, and labels given many times, leave the fitting task its bound."""
    lines = [(i % 3 if i < 900 else i, f"words number {i}", i % 2) for i in range(1_000)]
    data = spark.createDataFrame(lines, "doc_id bigint, text string, label int").repartition(4)
    labels = data.selectExpr("doc_id", "doc_id % 2 AS label").union(data.selectExpr("doc_id", "doc_id % 2 AS label"))
    seen = []
    fitted = type(data).mapInArrow
    monkeypatch.setattr(type(data), "mapInArrow", lambda df, *a, **k: seen.append(df.count()) or fitted(df, *a, **k))
    toxicity.train(data, labels, sample_rows=60)
    assert seen == [60]


# decontamination -------------------------------------------------------------------------------------


def test_decontamination(spark):
    r = random.Random(8)
    items = [prose(r, r.randint(15, 60)) for _ in range(30)] + ["short one of five words"]
    texts, dirty = [], set()
    for i in range(200):
        words = prose(r, r.randint(5, 300)).split()
        if i % 4 == 0:
            item = r.choice(items[:30]).split()
            for k in r.sample(range(len(item)), len(item) // 12):
                item[k] = "replaced"
            at = r.randrange(len(words))
            words[at:at] = [w.upper() + "," for w in item]
            dirty.add(i)
        texts.append(" ".join(words))
    texts += ["x short one, of five WORDS y", None]
    dirty.add(200)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = decontamination.find_contamination(frame(spark, texts), bench).collect()
    assert {x.id for x in got if x.contaminated} == dirty
    kept = decontamination.drop_contaminated(frame(spark, texts), bench).collect()
    assert {x.doc_id for x in kept} == set(range(202)) - dirty


def plain_contamination(texts, items):
    """Every text against every item at every shift where the words under some mask are equal."""
    out = {}
    for i, text in enumerate(texts):
        a, n, names, spans = decontamination.tokens(text), 0, set(), set()
        for ident, item in items:
            b, met = decontamination.tokens(item), set()
            if len(b) >= 10:
                masks = [(m, None) for m in decontamination.MASKS]
            elif len(b) >= 6:
                masks = [(decontamination.SHORT_MASKS[len(b) >= 8], 2)]
            else:
                masks = [(tuple(range(len(b))), 1)]
            for shift in range(-len(b), len(a)):
                first, last = max(0, -shift), min(len(b), len(a) - shift)
                equal = {p: b[p] == a[p + shift] for p in range(first, last)}
                if any(all(equal.get(p + k) for k in m) for m, top in masks for p in range(len(b) if top is None else top) if b):
                    row = np.array([equal[p] for p in range(first, last)])
                    met |= {(first + shift + s, first + shift + e) for s, e in decontamination.overlaps(row, len(b))}
            if met:
                n, spans, names = n + 1, spans | met, names | {ident}
        covered = len({k for s, e in spans for k in range(s, e)})
        out[i] = (n, covered, ",".join(map(str, sorted(names))), ",".join(f"{s}:{e}" for s, e in sorted(spans)))
    return out


@pytest.mark.parametrize("limits", [{}, {"HOT_ROWS": 2, "BROADCAST_TEXTS": 0, "MAX_FILTER_BITS": 64, "KNOWN_WORDS": 20, "RUN_WORDS": 30}])
def test_contamination_equals_plain_version(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(decontamination, name, value)
    r = random.Random(12)
    few = WORDS[:25]
    items = [" ".join(r.choice(few) for _ in range(n)) for n in (*range(10), *range(10, 60, 7))]
    items += [items[-1], "again " * 14, "one two " * 12]
    texts = [" ".join(r.choice(few) for _ in range(r.randint(0, 40))) for _ in range(20)] + ["again " * 50, "one two " * 30, "", None]
    for item in items:
        for replaced in range(3):
            words = item.split()
            for k in r.sample(range(len(words)), min(len(words), replaced)):
                words[k] = "other"
            texts.append(f"{prose(r, 6)} {' '.join(words)} {prose(r, 3)} {item[: len(item) // 2]}")
    texts += texts[40:44] * 3
    wanted = plain_contamination(texts, list(enumerate(items)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = decontamination.find_contamination(frame(spark, texts), bench).collect()
    assert {x.id: (x.n_items, x.n_words, x.items, x.spans) for x in got} == wanted
    clean = {i for i, x in wanted.items() if not x[0]}
    assert 0 < len(clean) < len(texts)
    docs = frame(spark, texts).withColumn("_digest", F.lit("mine")).withColumn("_row", F.lit(1)).withColumn("_salt", F.lit(2))
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == clean


def test_repeated_words_are_linear():
    a, b = np.arange(300_000), np.arange(5, 200_000)
    assert decontamination.differences(a, b).tolist() == list(range(-199_999, 300_000 - 5))
    r = np.random.default_rng(4)
    a, b = np.unique(r.integers(0, 3_000, 500)), np.unique(r.integers(100, 9_000, 400))
    assert decontamination.differences(a, b).tolist() == np.unique(np.subtract.outer(a, b)).tolist()


def test_benchmark_stays_a_table(spark):
    """No row of the benchmark is collected, and the filter's size is bounded."""
    items = decontamination._items(spark.range(400).selectExpr("id AS item_id", "repeat(concat('w', id, ' x', id % 7, ' '), 20) AS text"), "item_id", "text")
    bits, masks = decontamination._filter(decontamination._seeds(items))
    assert masks == [0, 1, 2, 3]
    assert 64 * len(bits) <= decontamination.MAX_FILTER_BITS


# packing ---------------------------------------------------------------------------------------------

PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_plan_holds_everything():
    r = random.Random(3)
    for counts in (
        collections.Counter(r.randint(1, 1024) for _ in range(20_000)),
        collections.Counter([400] * 9_000 + [r.randint(1, 1023) for _ in range(9_000)]),
        collections.Counter([1, 2, 3]),
        collections.Counter(),
    ):
        runs = packing.plan(counts)
        held = collections.Counter()
        for lengths, n in runs:
            assert sum(lengths) <= 1024
            for k in lengths:
                held[k] += n
        assert held == counts
        least = -(-sum(k * n for k, n in counts.items()) // 1024)
        if max(counts.values(), default=0) < 1_000:
            assert sum(n for _, n in runs) <= 1.01 * least + 1


def test_pack_round_trip(spark):
    r = random.Random(9)
    texts = [prose(r, int(r.paretovariate(0.7) * 20) % 3_000) for _ in range(300)] + [None, "", "a <|endoftext|> b", "日本語 text", "é ñ ß ½ ² \u00a0 \x85 x"]
    got = packing.pack(frame(spark, texts), *PATHS).toPandas()
    exact = Tokenizer.from_file(PATHS[0])
    for i, text in enumerate(texts):
        ids = np.array(exact.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        mine = got[got.doc_id == i].sort_values("piece")
        assert list(mine.start) == [0, *np.cumsum(mine.length)[:-1]] and mine.length.sum() == len(ids)
        assert (mine.length.iloc[1:] == 1024).all() and list(mine.piece) == list(range(len(mine)))
        assert [zlib.crc32(ids[s : s + k].tobytes()) for s, k in zip(mine.start, mine.length, strict=True)] == list(mine.ids_crc32)
    ordered = got.sort_values(["sequence_id", "offset"])
    before = ordered.groupby("sequence_id").length.cumsum() - ordered.length
    assert (before == ordered.offset).all() and ordered.groupby("sequence_id").length.sum().max() <= 1024


def test_fast_ids_are_exact():
    """Every plain character, alone and in context, has the ids of the JSON tokenizer."""
    encoder = packing.Encoder(*PATHS)
    chars = [chr(c) for c in [*range(0x1C), *range(0x20, 0x2B0), *range(0x2010, 0x2028), 0x20AC]]
    for c in chars:
        text = f"a{c} {c}b{c}{c}1{c}  {c}\n{c}.{c}'s{c}"
        assert packing._PLAIN.match(text)
        assert list(encoder.ids(text)) == encoder.exact.encode(text, add_special_tokens=False).ids, hex(ord(c))
    assert not packing._PLAIN.match("日") and not packing._PLAIN.match("\x1c")


# quality ---------------------------------------------------------------------------------------------


def plain_counts(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    r = random.Random(10)
    texts = ["".join(r.choice(["a ", "b ", "c\n", "d# ", "\t", "é\u00a0", "x|y ", "\x0b", "\x1c"]) for _ in range(r.randint(0, 200))) for _ in range(150)]
    texts += [None, "", "a " * 500, prose(r, 20_000)]
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in quality_rules.quality(frame(spark, texts)).collect()}
    assert got == {i: plain_counts(t) for i, t in enumerate(texts)}


def test_quality_verdicts(spark):
    r = random.Random(11)
    good = "\n".join(prose(r, 40).capitalize() + "." for _ in range(3))
    cases = {
        good: True, good + "\nHome | About | Contact\nAll rights reserved.": True, good.upper(): False,
        " ".join(w + "###" for w in good.split()): False, " | ".join(good.split()): False, " ".join(w + "!!" for w in good.split()): False, "short text.": False,
    }
    docs = frame(spark, list(cases))
    assert {x.doc_id: x.kept for x in quality_rules.quality(docs).collect()} == dict(enumerate(cases.values()))
    assert {x.doc_id for x in quality_rules.keep_clean(docs).collect()} == {i for i, v in enumerate(cases.values()) if v}
    cleaned = spark.createDataFrame([(good + "\nHome | About | Contact | Shop",)], "t string").select(quality_rules.clean_lines(F.col("t"))).first()[0]
    assert cleaned == good


# language --------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    r = random.Random(12)
    roots = {"en": "the and ing tion er wh".split(), "de": "der ung sch ich keit ü".split(), "fr": "eau que é oir ment è".split()}
    make = lambda lang, n: " ".join("".join(r.choice(roots[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))
    rows = [(i, make(lang := r.choice(list(roots)), r.randint(3, 300)), lang) for i in range(500)]
    df = spark.createDataFrame([*rows, (900, "123 456", "en"), (901, None, "de")], "doc_id bigint, text string, lang string")
    net = language_id.train(df.where("doc_id % 3 <> 1"))
    got = language_id.identify(df, net).join(df, F.col("id") == F.col("doc_id")).collect()
    held = [x for x in got if x.doc_id % 3 == 1 and x.doc_id < 900]
    assert sum(x.lang_pred == x.lang for x in held) >= 0.97 * len(held)
    assert {x.lang_pred for x in got if x.doc_id >= 900} == {"und"} and all(0 <= x.score <= 1 for x in got)


def test_every_language_is_learned(spark):
    rows = [(f"text number {i} of {i % 450}", f"l{i % 450:03}") for i in range(900)]
    net = language_id.train(spark.createDataFrame([*rows, (None, "none"), ("no language", None)], "text string, lang string"), sample_rows=2)
    assert net.languages == sorted({v for _, v in rows})


def test_tables_equal_convolution():
    net = language_id.Network(["a", "b"])
    x = np.random.default_rng(1).integers(0, 256, (3, language_id.WINDOW)).astype(np.uint8)
    e = net.embedding[x]
    pooled = []
    for w, f, b in zip(language_id.WIDTHS, net.filters, net.bias, strict=True):
        span = np.concatenate([e[:, k : language_id.WINDOW - w + 1 + k] for k in range(w)], axis=2)
        pooled.append((span @ f).max(axis=1) + b)
    plain = language_id.softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ net.out + net.out_bias)
    assert np.allclose(net.probabilities(x, net.tables()), plain, atol=1e-5)


# near duplicates -------------------------------------------------------------------------------------


def plain_components(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 4 * both >= 3 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def shingles(t):
    w = re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("heavy,probes", [(16, 8), (2, 1)])
def test_jaccard_join(spark, monkeypatch, heavy, probes):
    monkeypatch.setattr(jaccard_join, "HEAVY_LEAST", heavy)
    monkeypatch.setattr(jaccard_join, "PROBES", probes)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4 * probes)
    r = random.Random(13)
    passage = prose(r, 60)
    texts = [prose(r, r.randint(0, 120)) for _ in range(80)]
    texts += [f"{prose(r, r.randint(5, 40))} {passage} {prose(r, r.randint(0, 30))}" for _ in range(60)]
    texts += [f"{passage} {prose(r, r.randint(3, 14))}" for _ in range(60)]
    for share in (40, 25, 12):  # chains and clusters of near copies
        base = prose(r, 150).split()
        for _ in range(50):
            words = list(base)
            for k in r.sample(range(len(words)), r.randint(0, len(words) // share)):
                words[k] = r.choice(WORDS)
            base = words if r.random() < 0.3 else base
            texts.append(" ".join(words))
    texts += [texts[0]] * 70 + [texts[100].upper(), None, "", " ", "one two", "ONE two", "é one", "É one"]
    got = {x.id: (x.n_shingles, x.component_id) for x in jaccard_join.near_duplicates(frame(spark, texts)).collect()}
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    wanted = plain_components(sets)
    assert got == {i: (len(sets[i]), wanted[i]) for i in sets}


def test_repeated_rows_have_one_text(spark, monkeypatch):
    r = random.Random(15)
    words = prose(r, 150).split()
    near = [" ".join(words[:k] + [r.choice(WORDS)] + words[k + 1 :]) for k in range(0, 150, 30)]
    rows = [(None, near[0])] * 40 + [(7, near[1])] * 30 + [(8 + i, t) for i, t in enumerate(near)]
    seen = []
    verify = jaccard_join._verify
    monkeypatch.setattr(jaccard_join, "_verify", lambda pairs, texts: seen.append(texts) or verify(pairs, texts))
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    assert len(got) == len(rows) and {x.component_id for x in got} == {7}
    keys = [x.key for x in seen[0].select("key").collect()]
    assert sorted(set(keys)) == sorted(keys) and len(keys) == len(near)


def test_near_copies_are_compared_with_a_few_partners_each(spark, monkeypatch):
    r = random.Random(16)
    words = prose(r, 120).split()
    near = [" ".join(words[:j] + [r.choice(WORDS), "x"] + words[j + 2 : k] + [f"z{j}"] + words[k + 1 :]) for j in range(0, 50, 7) for k in range(60, 120, 4)]
    compared = []
    verify = jaccard_join._verify
    monkeypatch.setattr(jaccard_join, "_verify", lambda pairs, texts: compared.append(pairs.count()) or verify(pairs, texts))
    monkeypatch.setattr(jaccard_join, "PARTNERS", 2)
    got = jaccard_join.near_duplicates(frame(spark, near)).collect()
    sets = {i: shingles(t) for i, t in enumerate(near)}
    assert {x.id: x.component_id for x in got} == plain_components(sets)
    assert 0 < compared[0] <= 2 * len(near)


def test_only_named_and_repeated_texts_move(spark, monkeypatch):
    r = random.Random(17)
    texts = [prose(r, 30) for _ in range(60)] + [f"{prose(r, 4)} {prose(random.Random(18), 60)}" for _ in range(20)]
    plans = {}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    stored = jaccard_join.materialize
    monkeypatch.setattr(jaccard_join, "materialize", lambda df, name: plans.setdefault(name, plan(df)) and stored(df, name))
    jaccard_join.near_duplicates(frame(spark, texts))
    assert "hashpartitioning(rk" not in plans["texts"] and "Broadcast" in plans["texts"]
    # a class beside a group of three blocks: one link, and only the texts of either move
    words = prose(r, 100).split()
    near = [" ".join([*words[:k], "x", *words[k + 1 :]]) for k in range(3 * jaccard_join.BLOCK)]
    keyed = spark.createDataFrame([(k, t) for k, t in enumerate([*near, " ".join(words), *texts])], "key bigint, text string")
    grouped = spark.createDataFrame([(k, 0) for k in range(len(near))] + [(10**6, 10**6)], "node bigint, component bigint")
    asked = spark.createDataFrame([(len(near), 0)], "a bigint, group bigint")
    found = jaccard_join._open(asked, grouped, keyed)
    assert "LeftSemi" in plan(found)
    (link,) = found.collect()
    assert link.a < len(near) == link.b


def test_first_probes_are_a_few_of_each_class(spark):
    asked = spark.createDataFrame([(1, g, 1, g, 3 + g % 7) for g in range(20, 60)] + [(2, 30, 1, 30, 3)], "a bigint, group bigint, members bigint, only bigint, shared bigint")
    none = spark.createDataFrame([], "a bigint, b bigint")
    grouped = spark.createDataFrame([], "node bigint, component bigint")
    pairs = lambda **most: {(x.a, x.b) for x in jaccard_join._probes(asked, grouped, none, **most).collect()}
    assert pairs(most=2) == {(1, 20), (1, 27), (2, 30)}
    assert len(pairs()) == 41


def test_components(spark):
    r = random.Random(14)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)] + [(7, 7), (5, 900), (900, 5), (5, 6)]
    root = {v: v for e in edges for v in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {k: got.get(k, k) for k in root} == root
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


ARTICLE = (
    "<p>The first paragraph of an article that is long enough to be one, with a sentence. And more of it here.</p>"
    "<p>A second paragraph follows with many words, commas, and another sentence that ends here.</p>"
    "<p>The third paragraph is the last one of this article and says what was to be said in the end.</p>"
)


def test_wrappers_of_any_name_keep_the_article():
    want = html_text.main_text(f"<article>{ARTICLE}</article>")
    assert want.count("\n") == 2
    around = "<body><nav><ul><li><a href=x>a</a></ul></nav>{}<footer>(c) all of it</footer>"
    for word in sorted(html_text.BOILERPLATE | html_text.COMMENTS):
        for page in (
            f'<div class="{word}"><article>{ARTICLE}</article></div>', f'<div class="layout has-{word}"><article>{ARTICLE}</article></div>',
            f'<div id="{word}"><div class="content">{ARTICLE}</div></div>', f'<article><div class="{word}">{ARTICLE}</div></article>',
            f'<article><section id="{word}-work">{ARTICLE}</section></article>', f'<div class="{word}">{ARTICLE}</div>',
            f'<main><div class="article-{word}-wrapper">{ARTICLE}</div></main>',
        ):
            assert html_text.main_text(around.format(page)) == want, page
    for page in (
        f'<div class="page no-banner"><div class="content">{ARTICLE}</div></div>', f'<article><div id="social-media-in-schools">{ARTICLE}</div></article>',
        f'<form id="aspnetForm"><div class="content">{ARTICLE}</div></form>', f"<form>{ARTICLE}</form>", f"<header>{ARTICLE}</header>",
        f"<article><div hidden>{ARTICLE}</div></article>", f'<article><div style="display:none">{ARTICLE}</div></article>', f"<article><object>{ARTICLE}</object></article>",
    ):
        assert html_text.main_text(page) == want, page


def test_boilerplate_beside_the_article_goes():
    want = html_text.main_text(f"<article>{ARTICLE}</article>")
    comment = "<p>Great article, I really like this sentence here. Thanks for it, and more of it please.</p>" * 6
    for page in (
        f'<article>{ARTICLE}</article><div id="comments">{comment}</div>', f'<article>{ARTICLE}<div class="comments">{comment}</div></article>',
        f'<div class="post">{ARTICLE}</div><div class="comment-list">' + f'<article class="comment">{comment}</article>' * 4 + "</div>",
        f'<div class="content">{ARTICLE}</div><aside>{ARTICLE.replace("article", "story")}</aside>',
    ):
        assert html_text.main_text(page) == want, page
    for word in sorted(html_text.BOILERPLATE):
        beside = f'<div class="site-{word}"><p>Some words of another kind stand here, and they end in a sentence too.</p></div>'
        assert html_text.main_text(f"{beside}<article>{ARTICLE}</article>{beside}") == want, word
    assert html_text.main_text("<article><p>Short.</p></article><footer>" + "All rights are held by someone, and a lot of text says so. " * 9 + "</footer>") == "Short."


def test_short_pages_without_marks():
    assert html_text.main_text("<div><p>One short line</p><p>Two</p></div>") == "One short line\nTwo"
    assert html_text.main_text("<p>Hi") == "Hi"
    assert html_text.main_text("<nav><p>Home</p></nav>") == ""


def test_deeply_nested_pages_take_linear_time():
    page = "<div class=x>" * 20_000 + "<p>" + "A sentence of the page. " * 20 + "</p>" + "</div>" * 20_000
    assert html_text.main_text(page).startswith("A sentence")


def test_numbers_are_no_letters():
    assert not any(map(language_id.has_letter, ["", "²³", "½", "Ⅷ", "①", "12 _ 3", "٣", "!?"]))
    assert all(map(language_id.has_letter, ["a", "½ x", "ß", "中", "ʰ", "²é"]))


def test_a_repeated_text_is_learned_once(spark, monkeypatch):
    seen = []

    def spy(texts, langs, **_):
        raise RuntimeError(f"rows {len(texts)} {len(set(texts))} {sorted(set(langs))}")

    monkeypatch.setattr(language_id, "fit", spy)
    r = random.Random(9)
    rows = [("the same text again", "en")] * 3000 + [(prose(r, 5), r.choice(["en", "de"])) for _ in range(4000)] + [("einzig", "fr"), (None, "en"), ("x", None)]
    data = spark.createDataFrame(rows, "text string, lang string").repartition(6)
    with pytest.raises(Exception, match=r"rows 401 401 \['de', 'en', 'fr'\]"):
        language_id.train(data, sample_rows=200)
    assert seen == []


def test_late_tokens_of_a_common_passage(spark, monkeypatch):
    """Texts that end in one passage, some similar by it and some not; every list goes through the matrix."""
    r = random.Random(12)
    passage = [f"p{i}" for i in range(80)]
    texts = []
    for own in (8, 14, 18, 22, 30, 60):
        for _ in range(12):
            texts.append(" ".join([f"u{r.randint(0, 10**9)}" for _ in range(own)] + passage))
    for _ in range(30):
        base = r.choice(texts).split()
        for _ in range(r.randint(0, 6)):
            base[r.randrange(len(base))] = f"v{r.randint(0, 10**9)}"
        texts.append(" ".join(base))
    monkeypatch.setattr(jaccard_join, "HEAVY_LEAST", 2)
    monkeypatch.setattr(jaccard_join, "FEW_KEYS", r.choice([0, 10**6]))
    shingles = jaccard_join.Shingles()
    sets = [set(shingles(t).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    got = {x.id: x.component_id for x in jaccard_join.near_duplicates(frame(spark, texts)).collect()}
    assert got == {i: root(i) for i in range(len(texts))}
    assert 5 < len(set(got.values())) < len(texts) - 10


def test_keep_first_keeps_columns_of_any_name(spark):
    rows = [(1, "same words in this short text here", 5, 6, 7), (2, "same words in this short text here", 5, 6, 7), (3, None, 5, 6, 7)]
    data = spark.createDataFrame(rows, "doc_id bigint, text string, _n int, _rk int, first int")
    assert sorted(tuple(r) for r in jaccard_join.keep_first(data).collect()) == [rows[0], rows[2]]
