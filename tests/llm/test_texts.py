"""Shingle join, quality classifier, page extraction and chat formatting."""

import random
import time
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from sparkclean.llm import chat_format, html_text, quality, shingle_join
from sparkclean.llm.shingles import shingle_sets


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def plain_components(rows, width, least):
    sets = [shingles(t, width) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= least * (len(sets[i]) + len(sets[j]) - both):
                a, b = part[i], part[j]
                part = [b if p == a else p for p in part]
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if part[j] == part[i] and rows[j][0] is not None]
        out.append((key, len(sets[i]), min(ids, default=None) if sets[i] else key))
    return sorted(out, key=str)


def check_join(spark, rows, width=4, least=85):
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, n long, node string")
    found = shingle_join.join_shingles(df, width=width, least=least).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == plain_components(rows, width, least)


def edited(words, changes, rng):
    out = list(words)
    for _ in range(changes):
        at = rng.randrange(len(out))
        out[at : at + rng.choice([0, 1, 1])] = [rng.choice("abcdefghijkl") + str(rng.randrange(1000))]
    return " ".join(out)


def families(seed, groups, members, words):
    rng = random.Random(seed)
    passage = [f"common{k}" for k in range(30)]
    texts = []
    for g in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)] + passage * rng.choice([0, 1])
        texts += [edited(base, rng.randrange(0, 5), rng) for _ in range(members)] + [" ".join(base)]
    texts += [" ".join(passage + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 60))]) for _ in range(40)]
    return texts


def test_shingle_sets():
    texts = ["", "A", "a b", "x y z a b c a b c a b c", "é É  é b\tc\n\x1cd", "a b c d", "A B\x0bC\x0cD"]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts])
    hashed, sizes = shingle_sets(data, offsets, 4)
    assert sizes.tolist() == [len(shingles(t, 4)) for t in texts]
    parts = np.split(hashed, np.cumsum(sizes)[:-1])
    assert parts[5].tolist() == parts[6].tolist() and len(set(hashed.tolist())) == len(set().union(*(shingles(t, 4) for t in texts)))


def test_join_of_families(spark):
    texts = families(1, 12, 8, 80)
    rows = list(enumerate(texts + texts[:5] + [None, "", " ", "one", "one", "ONE", "one two three", "a b c d e f g"], 10))
    check_join(spark, rows + [rows[3], (None, texts[0]), (None, "only here and nowhere else in it"), (3, texts[20]), (3, texts[40])])


def test_join_of_dense_groups(spark, monkeypatch):
    """Small limits, so that combinations, stars, families and chunks all take part."""
    monkeypatch.setattr(shingle_join, "FREQUENT", 3)
    monkeypatch.setattr(shingle_join, "CHUNK", 4)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    texts = [edited(base, rng.randrange(0, 8), rng) for _ in range(60)] + families(2, 3, 10, 60)
    check_join(spark, list(enumerate(texts)))
    check_join(spark, list(enumerate(texts)), width=5, least=80)


def test_join_of_an_empty_table(spark):
    check_join(spark, [])


def test_rejects_no_row_of_odd_tables(spark, odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    found = shingle_join.join_shingles(odd_documents).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == plain_components(rows, 4, 85)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    good = [" ".join(rng.choice(["the", "sun", "river", "walks", "quietly", "over", "stone", "bridge", "and"]) for _ in range(rng.randrange(5, 200))) + "." for _ in range(300)]
    bad = [" ".join(rng.choice(["BUY!!", "$$$", "click###", "%%%win", "NOW!!"]) for _ in range(rng.randrange(5, 200))) for _ in range(80)]
    rows = [(k, t, int(k < 300)) for k, t in enumerate(good + bad)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_quality_on_held_out_rows(labelled, odd_documents, spark):
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    labels = labelled.select("doc_id", "quality").union(spark.createDataFrame([(None, 1), (5, None), (6, 3), (99999, 0)], "doc_id long, quality int"))
    model = quality.fit_quality(labelled.drop("quality"), labels, ~held)
    rows = quality.score_quality(labelled, model).where(held).collect()
    right = [(r.score >= 0.5) == (r.quality == 1) for r in rows]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows) and sum(right) >= 0.95 * len(right)
    again = quality.fit_quality(labelled.drop("quality"), labels.repartition(3), ~held)
    assert again == model  # the same rows, whatever their order
    odd = quality.score_quality(odd_documents, model).collect()
    assert len(odd) == odd_documents.count() and all(0 <= r.score <= 1 for r in odd)
    assert [c for c in odd[0].asDict()] == [*(c for c in odd_documents.columns if c != "score"), "score"]
    assert quality.score_quality(spark.createDataFrame([], odd_documents.schema), model).count() == 0


def test_quality_without_labels_of_both_kinds(labelled):
    model = quality.fit_quality(labelled.drop("quality"), labelled.where("quality = 1").select("doc_id", "quality"))
    assert min(r.score for r in quality.score_quality(labelled, model).collect()) > 0.99


PAGE = """<html><head><title>x</title><script>var a="<p>no</p>";</script></head><body><header><h1>Site</h1></header>
<div id="cookie-notice">We use cookies a lot of words here for you</div><nav><ul><li><a>Home</a></li></ul></nav>
<div class="wrap"><div class="content"><h1>Real title &eacute;</h1><p>One two three <b>four</b>five &lt;six&gt;
 seven&nbsp;eight.</p><aside>Read also many other things in this box which is fairly long and wordy text here</aside><!-- <p>no</p> -->
<p>Nine ten eleven twelve.</p><div class="ad">Buy now and here</div><ul><li>item one</li><li>item two</li></ul><p>End of it.</p></div></div>
<form><label>Mail</label></form><section class="comments"><h3>Comments</h3><p>I love this article so much, it is great and long</p></section>
<footer>Copyright 2020 and all that stuff goes here</footer></body></html>"""
TEXT = "Real title é\nOne two three fourfive <six> seven eight.\nNine ten eleven twelve.\nitem one\nitem two\nEnd of it."


def test_pages(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "plain text  only"), (5, "x", "<p>cut off <b>in <a href='q"), (1, "u", PAGE), (6, "y", "<nav>a b c</nav>"),
            (7, "z", "<article><p>" + "long text " * 50_000 + "</p></article><footer>a b</footer>")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    found = html_text.extract_text(df, html_text.learn_weights(df)).collect()
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in found)
    long = "long text " * 49_999 + "long text"
    want = [(1, "u", TEXT), (2, None, ""), (3, "v", ""), (None, "w", "plain text only"), (5, "x", "cut off in <a href='q"), (1, "u", TEXT), (6, "y", ""), (7, "z", long)]
    assert got == Counter((*w, len(w[2])) for w in want)
    assert html_text.extract_text(df.limit(0), html_text.learn_weights(df.limit(0))).count() == 0


@pytest.mark.parametrize("begin, end", [
    ('<div id="page" class="site has-sidebar">', "</div>"), ('<div class="post no-comments">', "</div>"), ('<form id="aspnetForm">', "</form>"), ('<div class="sidebar">', "</div>"),
    ('<section class="comments">', "</section>"), ('<div data-id="form" title="a class=form">', "</div>")])
def test_marks_of_what_holds_the_content(begin, end):
    weights = html_text.TagWeights()
    text = "One two three.\nFour five six seven eight nine ten eleven twelve thirteen fourteen."
    paragraphs = "".join(f"<p>{x}</p>" for x in text.split("\n"))
    for label, close in (("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>")):
        page = f"<html><body><nav>a b c</nav>{begin}{label}{paragraphs}{close}<aside>Read also</aside>{end}<footer>x y</footer></body></html>"
        assert html_text.main_text(page, weights) == text


def test_ids_made_from_headings():
    weights = html_text.TagWeights()
    page = ('<article><h2 id="form-of-government">Form of government</h2><p>One two.</p><h2 id="navigation">Navigation</h2><section id="related-work"><h2>Related work</h2>'
            '<p>Three four.</p></section><section id="related"><p>Five and more words of it.</p></section><div class="section" id="header"><p>Six and more words of it.</p></div></article>'
            '<div id="comments"><article><p>I love it.</p></article></div>')
    assert html_text.main_text(page, weights) == "Form of government\nOne two.\nNavigation\nRelated work\nThree four.\nFive and more words of it.\nSix and more words of it."


@pytest.mark.parametrize("void", [
    "<svg/>", "<svg class='x' />", "<video src=a />", "<iframe src=a>", "<iframe src=http://a/>", "<select>", "<object data='a'>", "<canvas>", "<noscript>", "<math>", "<audio controls/>",
    "<title/>", '<style id="x"/>', "<video src=a>later</video><video src=b>", "<noscript><template><svg>"])
def test_unclosed_elements(void):
    weights = html_text.TagWeights()
    long = "Two three four five six seven eight nine ten eleven twelve thirteen fourteen."
    page = f"<html><body><article><p>{long}</p>{void}<p>{long}</p></article><iframe src=b>not shown</iframe><p>End.</p></body></html>"
    assert html_text.main_text(page, weights) == f"{long}\n{long}"


@pytest.mark.parametrize("head", [
    "<head><title>t</title>", "<head><meta charset=x><title>t</title><noscript><p>not shown</p></noscript>\n", "<head><link href=a /><style>p{}</style><body>", "<head><noscript><body>"])
def test_head_without_end_tag(head):
    weights, text = html_text.TagWeights(), "Two three four five six seven eight nine ten eleven twelve thirteen fourteen."
    assert html_text.main_text(f"<html>{head}<article><h1>One</h1><p>{text}</p></article></html>", weights) == f"One\n{text}"
    assert html_text.main_text(f"<html>{head}{text}</html>", weights) == text


def test_opaque_elements_stay_hidden():
    page = ("<html><head><title>t</title><noscript><meta name=a><img src=b></noscript></head><body><article><p>One <svg viewBox='0 0'><title>not</title><text>shown</text></svg>two "
            "<select class=form><option>a<option>b</select>three.</p><video><p>not shown</p><object>nor this</object></video><noscript><article>shown</article></noscript>"
            "<template><article>not shown</article></template><script>if (a</b>c) d</script><p>Four five six seven.</p><textarea>not shown</article>")
    assert html_text.main_text(page, html_text.TagWeights(dict.fromkeys(("article", "/article"), 0.0))) == "One two three.\nshown\nFour five six seven."


def test_best_run_against_all_runs():
    rng = random.Random(2)
    for _ in range(300):
        scores = [rng.choice([-2.0, -1, -0.5, 0.5, 1, 2]) for _ in range(rng.randrange(0, 12))]
        a, b = html_text.best_run(scores)
        assert sum(scores[a:b]) == max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1))])


def turns_table(spark):
    rng, rows = random.Random(6), []
    say = lambda n: "\n".join(" ".join(rng.choice(["so", "it", "goes", "on", "and"]) for _ in range(rng.randrange(4, 9))) + "." for _ in range(n))
    for conv in range(150):
        roles = ["system"] * rng.choice([0, 0, 1]) + ["user", "assistant"] * rng.randrange(1, 4)
        rows += [(conv, t, r, say(rng.randrange(8, 20) if r == "assistant" else rng.choice([1, 1, 2]))) for t, r in enumerate(roles)]
    return rows


def test_roles_come_back(spark):
    rows = turns_table(spark)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat_format.fit_chat(df, F.col("conv_id") % 3 != 1)
    found = {(r.id, r.turn): (r.role, r.text, r.rendered) for r in chat_format.parse_transcripts(chat_format.transcripts(df), model).collect()}
    held = [(c, t, r, x) for c, t, r, x in rows if c % 3 == 1]
    right = sum(found.get((c, t)) == (r, x, f"<|im_start|>{r}\n{x}<|im_end|>\n") for c, t, r, x in held)
    assert right >= 0.9 * len(held)


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, None, None, ""), (None, 3, "tool", "x"), (2, 0, " User ", "a\n\nb"), (3, 200, "user", "far")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, rendered string")
    model = chat_format.fit_chat(df)
    texts = chat_format.transcripts(df).collect()
    assert {(r.id, r.part) for r in texts} == {(1, 0), (None, 0), (2, 0), (3, 3)}
    found = chat_format.parse_transcripts(chat_format.transcripts(df), model).collect()
    assert {r.role for r in found} <= set(chat_format.ROLES) and any("far" in r.text for r in found)
    assert chat_format.parse_transcripts(chat_format.transcripts(df.limit(0)), chat_format.fit_chat(df.limit(0))).count() == 0


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    model = chat_format.ChatModel.counted(Counter({("marker", s, m): int(rng.integers(1, 9)) for s in range(6) for m in range(7)} | {("following", i, j): int(rng.integers(0, 9)) for i in range(6) for j in range(6)}))
    lines = [chat_format.Line("", "", int(rng.integers(7)), int(rng.integers(2)), int(rng.integers(len(chat_format.LENGTHS) + 1))) for _ in range(5)]

    def score(path):
        out = model.first[path[0]] + sum(model.following[a, b] for a, b in zip(path, path[1:]))
        return out + sum(model.marker[s, x.marker] + model.after_blank[s, x.after_blank] + model.length[s, x.length] for s, x in zip(path, lines))

    best = max(score(p) for p in np.ndindex(*[6] * 5))
    assert abs(score(model.states(lines)) - best) < 1e-9


def test_hostile_pages_take_linear_time():
    """A megabyte each of what made earlier readers quadratic: tags and quotes that never close, deep nesting."""
    size, weights = 1 << 20, html_text.TagWeights({"div": 1.0, "p": 0.05})
    depth = size // 30
    pages = [k * (size // len(k)) for k in ("<a ", "<a '", "<a \"'", "<p><a>x</a>", "<!", "<svg><article>", "<script ", "</a", "<nav>x", '<a b="')]
    pages += ["<a " * (size // 3) + "' >", '<div class="sidebar">x ' * depth + "</div>" * depth, "<svg>" * depth + "<article>x</article>" + "</svg>" * depth]
    for page in pages:
        began = time.time()
        html_text.main_text(page, weights)
        assert time.time() - began < 20, page[:40]


def test_tags_that_never_end_are_text():
    weights = html_text.TagWeights()
    assert html_text.main_text('a <b class="x>y c', weights) == 'a <b class="x>y c'
    assert html_text.main_text("one <i title='>'>two</i> <a <b>three</b> <c ' four", weights) == "one two three <c ' four"
    assert html_text.main_text("x<script>if (a<b) {}</script>y<style/>z", weights) == "xyz"


def test_quality_scores_equal_recomputed_ones(labelled):
    """Sizes by plain compression block by block, the calibration by its own optimum."""
    held = F.col("doc_id") % 3 == 0
    labels = labelled.select("doc_id", "quality")
    model = quality.fit_quality(labelled.drop("quality"), labels, ~held)

    def size(text, data):
        table = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if data[:4] == quality.TRAINED else zstandard.DICT_TYPE_RAWCONTENT)
        packer = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=table, write_content_size=False, write_checksum=False, write_dict_id=False)
        blocks = [text[i : i + quality.BLOCK] for i in range(0, len(text), quality.BLOCK)]
        return sum(len(packer.compress(b)) - len(packer.compress(b"")) for b in blocks)

    def inputs(text):
        data = (text or "").encode()
        good, bad = size(data, model.good), size(data, model.bad)
        return (bad - good) / (len(data) + 64), (min(good, bad) + 32) / (len(data) + 64)

    for r in quality.score_quality(labelled, model).collect():
        difference, smaller = inputs(r.text)
        at = model.weights[0] + model.weights[1] * difference + model.weights[2] * smaller
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(at, -30, 30))), abs=1e-12)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2)) * [0.02, 0.1] + [0.01, 0.4]
    y = (x[:, 0] * 60 + rng.normal(size=400) > 0.5).astype(int)
    w = np.array(quality.calibrated(x, y))
    scale = x.std(0) + 1e-9

    def loss(w):
        at = w[0] + x @ w[1:]
        return np.log1p(np.exp(-np.where(y == 1, at, -at))).sum() + 0.5 * 1e-3 * len(x) * ((w[1:] * scale) ** 2).sum()

    for step in np.concatenate([np.eye(3), -np.eye(3)]) * [1e-3, 1e-2, 1e-2]:
        assert loss(w) <= loss(w + step) + 1e-9


def test_many_named_speakers_take_linear_time():
    began = time.time()
    lines = chat_format.lines_of("\n".join(f"Speaker{k}: says something" for k in range(40_000)))
    assert len(lines) == 40_000 and time.time() - began < 10
