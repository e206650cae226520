"""Operators 6, 7 and 8, the registered queries and the pipeline."""

import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import queries
from tessera.llm import html_text
from tessera.llm.html_text import extract_pages, importance, main_text, unimportant_nodes
from tessera.llm.quotations import ORACLE_SQL, chat_conversations, linked_messages
from tessera.llm.toxicity import Model, fit, fold, held_out, score_rows, score_toxicity

SF = "/root/testdata/sf0.001"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="home">
<header class=site><h2>Site</h2></header><nav><ul><li><a href="x">m</a></li></ul></nav><!-- <p>no</p> --><div class="ad">AD</div><div id="cookie-notice">c</div>
<article><header><h1>Title &amp; more</h1></header><p><b>One  two.<br>three<p>next&nbsp;x &#233;</p><ul><li>a<li>b</ul><table><tr><td>1<td>2</table><div class="comments"><p>nice!</p></div><form><input>f</form><p hidden>h</p></article>
<aside>s</aside><footer>&copy; x</footer>"""


def test_main_text():
    assert main_text(PAGE) == "Title & more\nOne two. three\nnext x é\na\nb\n1\n2"
    assert main_text("<p>a<p>b<div>c") == "a\nb\nc"
    assert main_text(None) == main_text("") == main_text("<article></article>") == main_text("<script>x") == ""
    assert main_text("plain < text & more") == "plain < text & more"


def test_style_tree_removes_what_all_pages_have(spark):
    page = lambda k: f"<body><div class='box'>Sign here for updates</div><div class='text'><p>Own words {k}.</p><p>And {k * 7} more.</p></div></body>"
    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(20)] + [(100 + k, f"http://few.example/{k}", page(k)) for k in range(3)] + [(200 + k, "http://copies.example/", page(1)) for k in range(30)]
    rows += [(300, None, page(3)), (301, "no host", None), (302, "http://h.example/302", ""), (None, "http://h.example/x", page(9))]
    df = spark.createDataFrame([(*r, "n") for r in rows], "page_id long, url string, html string, nodes string").repartition(4)
    out = {(r.page_id, r.url): r.text for r in extract_pages(df).collect()}
    assert len(out) == len(rows)
    assert out[5, "http://h.example/5"] == "Own words 5.\nAnd 35 more."
    assert out[None, "http://h.example/x"] == "Own words 9.\nAnd 63 more."
    assert out[100, "http://few.example/0"].startswith("Sign here") and out[200, "http://copies.example/"].startswith("Sign here") and out[300, None].startswith("Sign here")
    assert out[301, "no host"] == out[302, "http://h.example/302"] == ""
    assert extract_pages(df.limit(0)).count() == 0
    assert {r.host for r in unimportant_nodes(df.withColumn("host", F.regexp_extract("url", "//([^/]+)", 1))).collect()} == {"h.example"}


def test_words_in_an_article_are_text():
    assert main_text('<article><h2 id="side-effects">Side effects</h2><p>x</p></article>') == "Side effects\nx"
    assert main_text('<article><h2 id="related-work">Related</h2><p id="notice">n</p><div class="side-notes">s</div><div class="comments">c</div></article>') == "Related\nn\ns"
    assert main_text('<div class="with-sidebar"><div class="sidebar">s</div><main>m</main></div><div class="comments"><article>c</article></div>') == "m"
    assert main_text('<div id="comments"><article class="comment">c</article></div><div>d</div>') == "d"
    assert main_text('<header>Site</header><div>a<header>b</header></div>') == "a"


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + "<p>x</p>" + "</div>" * 20_000 + "<p>y</p>"
    assert main_text(deep) == main_text(deep, {1}) == "x\ny" and len(html_text.style_features(deep)) < 5000
    assert main_text("<p>" + "word " * 500_000).count("word") == 500_000


def styled_pages():
    """Pages of three hosts, with boxes that repeat more or less, as well-formed XML."""
    rnd, rows = random.Random(6), []
    for k in range(60):
        box = f"<div class='box'><p>Sign here {k % (1, 3, 30)[k % 3]}</p><ul>{'<li>item</li>' * (1 + k % 2)}</ul></div>"
        text = "".join(f"<p>Own words {k} {j}<b>x{rnd.randrange(3)}</b></p>" for j in range(rnd.randrange(1, 5)))
        main = ("<div class='text'>{}</div>", "<article>{}<div class='by'>by us</div></article>")[k % 2].format(text)
        rows.append((f"h{k % 3}", f"<html><body>{box}{main}<div id='f{k}'><i>end</i></div></body></html>"))
    return rows


def brute_importance(rows):
    """Node importance by its definition, from XML trees."""
    import math
    import xml.etree.ElementTree as ET
    from collections import Counter, defaultdict

    nodes = defaultdict(lambda: (set(), Counter(), Counter()))

    def style(e):
        return e.tag + "".join(f".{c}" for c in sorted(e.get("class", "").split())) + (f"#{''.join(c for c in e.get('id') if not c.isdigit())}0" if e.get("id") else "")

    def layout(e):
        return (style(e), tuple(layout(c) for c in e))

    def texts(e):
        """Blocks: text of an element that makes its own block with what is inline in it."""
        if e.tag in ("p", "li", "i"):
            return ["".join(e.itertext())]
        return ([e.text] if e.text else []) + [t for c in e for t in texts(c)]

    for n, (host, page) in enumerate(rows):
        seen = defaultdict(lambda: (set(), set()))

        def walk(e, path, inside):
            path = html_text._hash(f"{path} {style(e)}")
            if e.tag not in ("html", "body", "article"):
                # inline elements within a block hold no block of their own
                seen[path][0].update(texts(e) if e.tag != "b" else [])
                seen[path][1].add(layout(e))
            for c in e:
                walk(c, path, inside)

        walk(ET.fromstring(page), 0, False)
        for path, (blocks, layouts) in seen.items():
            pages, b, s = nodes[host, path]
            pages.add(n)
            b.update(blocks)
            s.update(layouts)
    out = {}
    for key, (pages, b, s) in nodes.items():
        if len(pages) > 1 and b:
            content = 1 - sum(c * math.log(c) for c in b.values()) / sum(b.values()) / math.log(len(pages))
            total = sum(s.values())
            out[key] = (len(pages), (content - sum(c / total * math.log(c / total) for c in s.values()) / math.log(total)) / 2)
    return out


def test_importance_against_brute_force(spark):
    rows = styled_pages()
    expected = brute_importance(rows)
    df = spark.createDataFrame(rows, "host string, html string").repartition(3)
    found = {(r.host, r.node): (r.pages, pytest.approx(r.importance, abs=1e-9)) for r in importance(df).collect()}
    assert found == expected and len(found) > 20
    low = {(r.host, r.node) for r in unimportant_nodes(df).collect()}
    inside = {(r.host, r.node) for r in importance(df).where("inside").collect()}
    assert low == {k for k, (n, x) in expected.items() if n >= 8 and x < (0.1 if k in inside else 0.4)} and low & inside


def test_the_tree_removes_without_marks(spark):
    """A page's menu, advert and footer go on a large host by importance alone."""
    pages = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/pages.parquet")
    large = pages.where("regexp_extract(url, '://([^/]+)', 1) = 'blog.tionsh.example.com'")
    tree = {r.page_id: r.text for r in extract_pages(large, marks=False).collect()}
    assert len(tree) == 320 and tree == {r.page_id: r.text for r in extract_pages(large).collect()}
    plain = {r.page_id: main_text(r.html, marks=False) for r in large.collect()}
    assert all(tree[k] != plain[k] for k in tree)


@pytest.mark.parametrize("hot", [1, 10_000])
def test_pages_of_hot_and_other_hosts(spark, monkeypatch, hot):
    monkeypatch.setattr(html_text, "HOT_HOSTS", hot)
    page = lambda k: f"<body><div class='box'>Sign here</div><div class='text'><p>Own words {k}.</p></div></body>"
    df = spark.createDataFrame([(k, f"http://h{k % 4}.example/{k}", page(k), "n") for k in range(80)], "page_id long, url string, html string, size string")
    assert {r.page_id: r.text for r in extract_pages(df).collect()} == {k: f"Own words {k}." for k in range(80)}


def test_fold():
    assert fold("1d10t іdiоt c1own $tup1d l0ser!! id!ot 10.0.0.1 ＭＯＲＯＮ st​upid") == ["idiot", "idiot", "ciown", "stupid", "ioser", "idiot", "10", "0", "0", "1", "moron", "stupid"]
    assert fold("1d10t") == fold("idiot") and fold("c1own") == fold("clown") and fold("сl0wn") == fold("clown")
    assert fold(None) == fold("") == []


def toxic_corpus():
    rnd = random.Random(8)
    words = [f"{a}{b}" for a in ("ba", "ko", "mi", "re", "tu") for b in ("lan", "dor", "shi", "nek", "pos")]
    rows, labels = [], []
    for k in range(600):
        text, toxic = [rnd.choice(words) for _ in range(rnd.randrange(10, 80))], k % 5 == 0
        if toxic:
            for _ in range(3):
                text.insert(rnd.randrange(len(text)), rnd.choice(["clown", "c1own", "cl0wn", "vexu" + rnd.choice(words)]))
        rows.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    extra = [(9000, None), (9001, ""), (None, "clown clown"), (9002, "a clown fish"), (9003, "the class clown, a clown and a clown")]
    df = spark.createDataFrame([(d, t, 0.5) for d, t in rows + extra], "doc_id long, text string, score double")
    lf = spark.createDataFrame([(d, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, t in labels] + [(None, 1), (1, None), (0, 0)], "doc_id long, toxic int")  # labels that are held out are wrong here
    out = {r.doc_id: r for r in score_toxicity(df, lf).collect()}
    assert len(out) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in out.values())
    for d, t in labels:
        assert out[d].predicted == t and out[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
    assert out[9000].predicted == out[9001].predicted == out[9002].predicted == 0 and out[9003].predicted == out[None].predicted == 1
    assert out[9000].score == out[9001].score
    assert {r.score for r in score_toxicity(df, lf.limit(0)).collect()} == {0.0}
    assert score_toxicity(df.limit(0), lf).count() == 0


def test_harmless_phrases_are_learned(spark):
    rnd = random.Random(3)
    rows, labels = [], []
    for k in range(900):
        text = [f"w{rnd.randrange(60)}" for _ in range(30)]
        if k % 4 == 0:
            text[rnd.randrange(30)] = "vexuda"
        elif k % 30 == 1:
            text[10:12] = ["vexuda", "tree"]
        rows.append((k, " ".join(text)))
        labels.append((k, int(k % 4 == 0)))
    df, lf = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit(df, lf, ())
    assert model.exceptions == ("vexuda tree",)
    out = {r.doc_id: r.predicted for r in score_toxicity(df, lf).collect()}
    assert all(out[k] == t for k, t in labels)


def test_toxicity_of_held_out_documents(spark):
    """Of labelled documents that taught nothing, nine in ten toxic ones are found, and hardly any other."""
    at = SF.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{at}/labels.parquet")
    out = score_toxicity(spark.read.parquet(f"{at}/documents.parquet"), labels).where("held_out").join(labels, "doc_id")
    n = {(r.toxic, r.predicted): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.02 * n[0, 0]


def test_toxicity_of_a_very_long_text(spark):
    rows, labels = toxic_corpus()
    rows += [(9000, "ba " * 400_000), (9001, "ba " * 200_000 + "clown vexulan vexudor " * 20_000)]
    out = {r.doc_id: r.predicted for r in score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).where("doc_id >= 9000").collect()}
    assert out == {9000: 0, 9001: 1}


def test_scores_keep_all_columns(spark):
    df = spark.createDataFrame([(1, "x", "s", 2)], "doc_id long, text string, score string, row int")
    assert score_rows(df, Model({})).first() == (("1" and 1, "x", "s", 2), 0.0)


def chat():
    rnd, rows = random.Random(5), []
    lines = ["alpha beta", "gamma, delta.", "Eps zeta!", "eta theta", "ok", "iota kappa"]
    for c in range(25):
        messages = []
        for t in range(rnd.randrange(1, 9)):
            own = "\n".join(rnd.choice(lines) + rnd.choice(["", f" x{rnd.randrange(9)}", "\n"]) for _ in range(rnd.randrange(1, 4)))
            if messages and rnd.random() < 0.6:
                own = "On a day, X wrote:\n" + "\n".join("> " + x for x in rnd.choice(messages).split("\n")) + "\n" + own
            messages.append(own)
            rows.append((c, t, rnd.choice(["user", "assistant"]), own))
    repeated = [rows[k] for k in range(0, len(rows), 3)]
    return [*rows, *repeated, (None, 1, "user", "> a\nb"), (3, None, "user", "q"), (3, None, None, None), rows[0], rows[0], (99, 0, "user", None), *[(77, k, "user", f"> m{k - 1} words here\nm{k} words here" if k else "m0 words here") for k in range(600)]]


def as_rows(frame):
    plain = lambda v: None if v is None or v is pd.NA or v != v else v if isinstance(v, str) else int(v)
    return sorted(([plain(v) for v in r] for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


def test_quotations(spark):
    df = spark.createDataFrame([(*r, "t") for r in chat()], "conv_id long, turn long, role string, text string, thread string").repartition(4)
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(chat(), columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    assert as_rows(chat_conversations(df).toPandas()) == as_rows(con.sql(ORACLE_SQL).df())
    assert chat_conversations(df.limit(0)).count() == 0
    chain = {r.turn: r for r in linked_messages(df).where("conv_id = 77").collect()}
    assert all((chain[k].thread, chain[k].depth, chain[k].reply_to, chain[k].body) == (0, k, k - 1, f"m{k} words here") for k in range(1, 600))


def test_a_repeated_message_quotes_what_it_quotes(spark):
    rows = [(1, 0, "user", "alpha beta and more words"), (1, 1, "user", "alpha beta and more words\ngamma"), *[(1, 2, "user", "> alpha beta and more words\n> gamma\nyes")] * 3]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [(r.turn, r.reply_to, r.copies) for r in linked_messages(df).orderBy("turn").collect()] == [(0, None, 1), (1, None, 1), (2, 1, 3)]


def test_long_conversations_are_cut_in_reply_order(spark):
    rows = [(1, k, "user", f"message number {k}") for k in range(300)] + [(1, 300, "user", "> message number 10\n\nyes")]
    rows += [(2, 0, "user", f"all in one turn {k}") for k in range(600)] + [(None, k % 2, "user", "z") for k in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = chat_conversations(df).collect()
    parts = {(r.conv_id, r.part): r.text for r in got if r.conv_id}
    assert sorted(parts) == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)] and parts[1, 0].count("<|end|>") == parts[2, 1].count("<|end|>") == 256
    assert "message number 10\n<|end|>\n<|user|>\nyes\n" in parts[1, 0] and "message number 11\n" not in parts[1, 0].split("yes")[0]
    assert sorted((r.n_messages, r.text) for r in got if r.conv_id is None) == [(3, "<|user|>\nz\n<|end|>\n")] * 2
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    assert as_rows(chat_conversations(df).toPandas()) == as_rows(con.sql(ORACLE_SQL).df())


def test_a_very_long_message(spark):
    quoted = "\n".join(f"> line {k} of a long message" for k in range(20_000))
    rows = [(1, 0, "user", quoted.replace("> ", "")), (1, 1, "user", f"{quoted}\nthanks")]
    r = linked_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("turn = 1").first()
    assert (r.reply_to, r.body) == (0, "thanks")


def test_nested_quotes_leave_the_text(spark):
    text = "Hi,\nBo wrote:\n> yes, I think so\n>> do you think so?\n\nFine > good"
    df = spark.createDataFrame([(1, 0, "user", "Do you think so?"), (1, 1, "user", "Yes, I think so."), (1, 2, "user", text)], "conv_id long, turn long, role string, text string")
    r = linked_messages(df).where("turn = 2").first()
    assert (r.reply_to, r.thread, r.depth, r.body) == (1, 1, 1, "Hi,\n\nFine > good")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, expected = queries.queries()[name](spark, SF).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    assert as_rows(got) == as_rows(expected)


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = [{r.doc_id for r in docs.select("doc_id").collect()}]
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF).cache()
        assert now.columns == docs.columns
        ids.append({r.doc_id for r in now.collect()})
        assert ids[-1] <= ids[-2]
    assert len(ids[-1]) > 100
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == ids[-1]


def test_pipeline_against_brute_force(spark):
    """Each stage by its definition, on the documents of the smallest table."""
    from test_dedup_llm import Sets, brute_lines

    from tessera.llm.near_dedup import multiset, shingles, similarity
    from tessera.llm.tokens import load_tokenizer, tokenizer_path

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = corpus_pipeline.fit_held_in(docs, labels)
    matcher = model.matcher()
    clean = {d: t for d, t in texts.items() if model.score(model.sums(matcher, fold(t))) < 0.3}
    cut = {d: t for d, t in brute_lines(list(clean.items()), 50).items() if t.split() or not clean[d].split()}
    bags = [(d, multiset(h)) for d, t in sorted(cut.items()) if len(h := shingles(t)[1])]
    sets = Sets()
    for i, (a, x) in enumerate(bags):
        for b, y in bags[:i]:
            if similarity(x, y) >= 0.8:
                sets.join(a, b)
    tok = load_tokenizer(tokenizer_path("word_bpe_49k.json"))
    expected = {d: [*tok.encode(t, add_special_tokens=False).ids, 2] for d, t in cut.items() if sets.find(d) == d}
    assert 0 < len(texts) - len(clean) and len(expected) < len(cut)
    got: dict = {}
    for r in corpus_pipeline.run(spark, SF).orderBy("doc_id", "start").collect():
        assert r.start == len(got.setdefault(r.doc_id, []))
        got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert got == expected


def test_held_out(spark):
    df = spark.range(50).select("id", held_out(F.col("id")).alias("h"))
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in df.collect())
    assert fit(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")).beta == []
