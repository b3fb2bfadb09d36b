"""Main text, quality, piece encoding and secret scans."""

import base64
import hashlib
import json
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pathloom.llm import piece_bpe, quality, secrets
from pathloom.llm.main_text import blocks, extracted, labelled, log_odds, main_text, min_cut
from pathloom.llm.piece_bpe import encoded, encoder
from pathloom.llm.queries import piece_model
from pathloom.llm.secrets import scanned, spans
from pathloom.llm.suffix_sort import sorted_strings
from pyspark.sql import functions as F

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">Menu one<li><a href="/b">Menu two</ul></nav><div class="ad">Buy now, it is cheap.</div>
<div role="alert">We use cookies.</div><article><h1>The &lt;title&gt;</h1><p>First   para&shy;graph,
with <b>bo</b>ld.<p>Tiny.</p><form><label>Mail</label><button>Send</button></form><aside>Related text that is rather long, as sidebars go.</aside>
<!-- <p>no</p> --><p>Last one &amp; end</p><section id="comments"><p>A reader wrote a very long comment here, with many words. It goes on and on, and on.</p></section></article>
<footer>&copy; 2020</footer></body></html>"""


def test_main_text_of_a_page():
    assert main_text(PAGE) == "The <title> First para\xadgraph, with bold. Tiny. Last one & end"


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- open", "<script>x", "</p></p>", "<a href='>'", "\0<b>", "<![CDATA[x"])
def test_odd_pages_are_read(page):
    assert isinstance(main_text(page), str)


def test_blocks_keep_inline_elements_together():
    assert [b.text for b in blocks("<p>a<i>b</i>c <em>d</em></p><p>e<br>f</p>")[0]] == ["abc d", "e f"]


@pytest.mark.parametrize("page", [
    '<body class="single no-sidebar"><article><p>{}</p></article>', '<body class="post comments-open"><article><p>{}</p></article>', '<article class="post tag-social category-legal"><p>{}</p></article>',
    '<div class="elementor-widget-container"><article><p>{}</p></article></div>', '<article><section id="notice-period"><h2 id="search">{}</h2></section></article>', '<article><p title="a hidden gem">{}</p></article>',
    '<article><p data-hidden="false">{}</p></article>', '<article><p data-x="<p hidden>" id=x>{}</p></article>',
])
def test_names_that_only_mention_a_cue(page):
    assert main_text(page.format("The text.")) == "The text."


def test_the_only_article_is_not_judged_by_its_name():
    text = "A text of some length about the law, which says what it has to say."
    assert main_text(f'<body><nav><a href="/">Home</a></nav><article class="legal"><p>{text}</p></article></body>') == text
    assert main_text(f'<main class="notice"><article id="disclaimer"><p>{text}</p><div class="notice"><p>Closed on Monday.</p></div></article></main>') == text
    several = f'<article><p>{text}</p></article><article class="comment"><p>A reader wrote this, which is not the text.</p></article>'
    assert main_text(several) == text


@pytest.mark.parametrize("name", ["cookie-banner", "ad_slot", "adSlot", "commentList", "comment-list", "sidebar-left", "share-buttons", "newsletter-signup", "main-nav", "ad-1"])
def test_names_that_are_cues(name):
    assert main_text(f'<article><p>A text.</p><div class="x {name}"><p>Something else, which is not the text.</p></div></article>') == "A text."


def test_the_cut_mends_the_classifier():
    """A line of links amid sentences, and a sentence amid links: neighbours decide."""
    sentence = "<p>This is a long enough sentence of an article that nothing in the markup marks as one.</p>"
    link = '<li><a href="/x">Other page of the site</a></li>'
    found = labelled(f"<div>{sentence}<p><a href='/y'>The linked work</a></p>{sentence}</div>")
    assert [log_odds(b) > 0 for b, _ in found] == [True, False, True] and all(c for _, c in found)
    found = labelled(f"<ul>{link * 3}<li>Go on.</li>{link * 3}</ul>".replace("<li>Go", "<p>Go"))
    assert [log_odds(b) > 0 for b, _ in found] == [False] * 3 + [True] + [False] * 3 and not any(c for _, c in found)


def test_extraction_equals_what_pages_were_made_of(spark):
    r = random.Random(6)
    sentence = lambda: " ".join(r.choice(["lake", "of", "stone", "under", "rivers", "go"]) for _ in range(r.randint(6, 25))).capitalize() + "."
    rows, want = [], {}
    for k in range(80):
        body = [sentence() for _ in range(r.randint(1, 12))]
        noise = lambda: r.choice(['<nav><a href="/">Home</a></nav>', '<div class="advert">Buy this now.</div>', "<script>x</script>", "<form><p>Your mail</p></form>", ""])  # noqa: B023, E731
        inner = "".join(f"<p>{x.replace(' ', r.choice([' ', '  ', chr(10)]), 1)}</p>{noise()}" for x in body)
        rows.append((k, "u", f'<html><body>{noise()}<header><a href="/">Site</a></header><article>{inner}</article><section class="comments"><p>{sentence()}</p></section><footer>{sentence()}</footer></body></html>'))
        want[k] = " ".join(body)
    rows.append((80, "u", "<article>" + f"<p>{sentence()}</p>" * 20_000 + "<div>a" * 20_000))  # very long, very deep
    got = {g.page_id: (g.text, g.n_chars) for g in extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got.pop(80)[1] > 20_000 * 10 and got == {k: (t, len(t)) for k, t in want.items()}


def test_min_cut_is_minimal():
    r = random.Random(3)
    for _ in range(60):
        n = r.randint(1, 8)
        s, t = [r.randint(0, 9) for _ in range(n)], [r.randint(0, 9) for _ in range(n)]
        e = [(a, b, r.randint(1, 6)) for a in range(n) for b in range(a + 1, n) if r.random() < 0.5]

        def cost(side):
            return sum(t[k] if side[k] else s[k] for k in range(n)) + sum(w for a, b, w in e if side[a] != side[b])

        assert cost(min_cut(s, t, e)) == min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))


def test_extraction_over_a_table(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "x", ""), (1, "u", PAGE)]
    got = extracted(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text")).collect()
    assert sorted((g.page_id or 0, g.n_chars) for g in got) == [(0, 0), (1, len(main_text(PAGE))), (1, len(main_text(PAGE))), (2, 0)]
    assert extracted(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    assert all(content for b, content in labelled("<article><p>Word</p></article>"))


def good(r):
    return "\n".join(" ".join(r.choice(["the", "of", "house", "river", "stone", "walk"]) for _ in range(12)).capitalize() + "." for _ in range(r.randint(1, 6)))


def bad(r):
    return "\n".join(" ".join(r.choice(["the", "of", "house", "river"]) + "$$$" for _ in range(12)) for _ in range(r.randint(1, 6)))


def test_marginals_equal_enumeration():
    r = np.random.default_rng(0)
    node, jump, per_text = r.normal(size=7), r.normal(size=(2, 2)), np.array([3, 1, 3])
    marginal, moves, total = quality.marginals(node, jump, per_text)
    want, pairs, logs, at = [], np.zeros((2, 2)), 0.0, 0
    for n in per_text:
        weights = {}
        for m in range(1 << n):
            y = [m >> k & 1 for k in range(n)]
            weights[tuple(y)] = np.exp(sum(node[at + k] * y[k] for k in range(n)) + sum(jump[y[k], y[k + 1]] for k in range(n - 1)))
        z = sum(weights.values())
        logs += np.log(z)
        want += [sum(w for y, w in weights.items() if y[k]) / z for k in range(n)]
        for y, w in weights.items():
            for k in range(n - 1):
                pairs[y[k], y[k + 1]] += w / z
        at += n
    assert np.allclose(marginal, want) and np.allclose(moves, pairs) and np.isclose(total, logs)


def test_scores_recomputed_by_hand():
    """Marginals by plain forward and backward sums, each line weighing its bytes and one, a logistic curve on the log odds."""
    r = random.Random(7)
    model = quality.fitted([((good(r) if k % 2 else bad(r)).encode(), k % 2) for k in range(60)])
    texts = [(good(r) + "\n" + bad(r)).encode() for _ in range(12)] + [b"", b"\n", b"one line"]
    got = model.scores(texts)[0]
    for text, score in zip(texts, got, strict=True):
        features = quality.line_features([text])[0]
        node = [float(np.clip((row - model.mean) / model.deviation, -6, 6) @ model.weights) for row in features]
        ahead = [np.array([1.0, math.exp(node[0])])]
        for x in node[1:]:
            ahead.append(np.array([sum(ahead[-1][a] * math.exp(model.jump[a, b]) for a in (0, 1)) * (math.exp(x) if b else 1) for b in (0, 1)]))
        back = [np.ones(2)]
        for x in node[:0:-1]:
            back.insert(0, np.array([sum(math.exp(model.jump[a, b]) * (math.exp(x) if b else 1) * back[0][b] for b in (0, 1)) for a in (0, 1)]))
        good_share = [(f * b)[1] / (f * b).sum() for f, b in zip(ahead, back, strict=True)]
        weight = [len(line) + 1 for line in text.split(b"\n")]
        mean = min(max(sum(w * g for w, g in zip(weight, good_share, strict=True)) / sum(weight), 1e-4), 1 - 1e-4)
        assert math.isclose(score, 1 / (1 + math.exp(-(model.slope * math.log(mean / (1 - mean)) + model.offset))), rel_tol=1e-9)


def test_a_long_labelled_text_leaves_the_model_on(spark):
    """A text of 40 MB, labelled and first in the order, is passed over; so is what doesn't fit what is left."""
    r = random.Random(9)
    rows = [(i, good(r) if i % 2 else bad(r), i % 2) for i in range(160)]
    kind = "doc_id long, text string"
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    short = spark.createDataFrame([(i, t) for i, t, _ in rows], kind)
    first = labels.where(quality.in_fold(F.col("doc_id")) != 2).orderBy(F.xxhash64("doc_id", F.lit("train")), "doc_id").first().doc_id
    long = short.where(F.col("doc_id") != first).unionByName(spark.range(1).select(F.lit(first).cast("long").alias("doc_id"), F.repeat(F.lit("long text. "), 40 << 20 >> 3).alias("text")))
    with_long, without = quality.trained(long, labels), quality.trained(short.where(F.col("doc_id") != first), labels)
    assert np.array_equal(with_long.weights, without.weights) and with_long.slope == without.slope != 0
    few = quality.trained(short, labels, train_bytes=20_000)
    assert few.slope != 0 and np.abs(few.weights).max() > 0
    texts = [t.encode() for _, t, _ in rows]
    assert np.mean((few.scores(texts)[0] > 0.5) == np.array([y for *_, y in rows])) > 0.9


def test_quality_learns_and_holds_out(spark):
    r = random.Random(2)
    rows = [(i, good(r) if i % 3 else bad(r), i % 3 > 0) for i in range(240)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "x"), (5, rows[5][1])], "doc_id long, text string").selectExpr("*", "'q' as quality", "1 as score")
    labels = spark.createDataFrame([(i, int(y) if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - int(y)) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality.scored(docs, quality.trained(docs, labels, train_docs=150)).collect()
    assert len(got) == 244 and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.7) for g in got)
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 4 == 2) for g in got if g.doc_id is not None)
    truth = {i: y for i, _, y in rows}
    assert np.mean([truth[g.doc_id] == g.predicted for g in got if g.doc_id in truth]) > 0.97  # held-out labels are false on purpose
    none = quality.trained(docs, labels.limit(0))
    assert {round(g.score, 6) for g in quality.scored(docs, none).collect()} == {0.5}
    assert quality.scored(docs.limit(0), none).collect() == []


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


def test_pieces_equal_the_library(library):
    r, bpe = random.Random(7), encoder(piece_model())
    alphabet = list("abcdehinorstu  ▁\n\t.,'*!é中😀\x00") + ["the ", "ing", "tion", "    ", "<s>", "0x0A"]
    for _ in range(1500):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
        ids = library.encode(text, add_bos=True, add_eos=True)
        own = bpe.encode(text)
        assert np.frombuffer(own, "<u4").tolist() == ids, text
        assert bpe.decoded_bytes(own).decode() == library.decode(ids) == bpe.decode(own)
    long = "thenationing" * 8000
    assert np.frombuffer(bpe.encode(long), "<u4").tolist() == library.encode(long, add_bos=True, add_eos=True)
    assert all(bpe.split(w) == bpe.merged(w) for w in ("international", "▁▁▁▁▁x", "aaaaaaaaab", "zzzzqqq"))


def test_pieces_over_a_table(spark, library):
    rows = [(1, "Hello world"), (2, None), (None, ""), (1, "Hello world"), (3, "x" * 50_000)]
    got = encoded(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as ids"), piece_model()).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted((g.doc_id or 0, g.n_tokens, g.ids_sha256, g.decoded_sha256) for g in got) == sorted(want)


def der(tag, body):
    size = len(body)
    return bytes([tag]) + (bytes([size]) if size < 128 else bytes([0x82, size >> 8, size & 255])) + body


def test_secrets_by_shape_and_by_structure():
    assert [s[2] for s in spans('token = "abcdef" API-KEY: x apikey:abcdeg PASSWD=short')] == ["assign", "assign"]
    assert spans("ſecret=abcdefgh") == []  # letters of other scripts don't fold
    assert [s[2] for s in spans("AKIA" + "A" * 16 + " AKIA" + "B" * 15)] == ["access"]
    assert spans("é " + "ab12" * 6)[0] == (2, 26, "hex")
    key = der(0x30, der(2, b"\0") + der(0x30, der(6, bytes.fromhex("2b6570"))) + der(4, der(4, b"k" * 32)))
    text = base64.b64encode(key).decode()
    assert [s[2] for s in spans(f"x {text} y")] == ["der64"] and spans(f"x M{text[:-6]} y") == []
    assert [s[2] for s in spans(f" {key.hex().upper()} ")] == ["derhex"]
    assert "pem" in [s[2] for s in spans(f"-----BEGIN PRIVATE KEY-----\n{text}\n-----END PRIVATE KEY-----")]
    pem = lambda data, kind="PRIVATE KEY", head="": [s[2] for s in spans(f"-----BEGIN {kind}-----\n{head}{base64.encodebytes(data).decode()}-----END {kind}-----") if s[2] == "pem"]
    assert not pem(der(0x30, der(2, b"\1") + der(2, b"\2")))  # parses, but is no key
    assert pem(der(0x30, der(0x30, der(6, bytes.fromhex("2a864886f70d01050d"))) + der(4, b"c" * 48)), "ENCRYPTED PRIVATE KEY")
    assert pem(b"c" * 64, "RSA PRIVATE KEY", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n") and not pem(b"c" * 64, "RSA PRIVATE KEY")
    string = lambda x: len(x).to_bytes(4, "big") + x
    ssh = b"openssh-key-v1\0" + string(b"none") * 2 + string(b"") + (1).to_bytes(4, "big") + string(b"p" * 51) + string(b"q" * 128)
    assert pem(ssh, "OPENSSH PRIVATE KEY") and not pem(ssh[:-1], "OPENSSH PRIVATE KEY")
    part = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    head = part(json.dumps({"alg": "HS256"}).encode())
    assert [s[2] for s in spans(f"a {head}.{part(b'{}')}.{part(b'sig')} b")] == ["token"]
    assert spans(f"a {part(b'{\"x\": 1}')}.{part(b'{}')}.{part(b'sig')} b") == []


def test_key_blocks_equal_one_pattern():
    whole = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----\s*((?:[A-Za-z0-9-]+:[^\n]*\n\s*)*)([A-Za-z0-9+/=\s]+)-----END \1-----")
    r = random.Random(3)
    bits = ["-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "\n", " ", "\n\n", "Name: value", "a:", "-", "abc+/=", "x\ny", "é"]
    found = 0
    for _ in range(30_000):
        text = "".join(r.choice(bits) for _ in range(r.randint(2, 14)))
        want = [(m.start(), m.end(), "".join(m[3].split())) for m in whole.finditer(text) if m[3].strip()]
        got = [(a, b, "".join(body.split())) for a, b, _, body in secrets.pem_blocks(text) if body.strip()]
        assert got == want, text
        found += len(want)
    assert found > 100


@pytest.mark.parametrize("unit", [" ", "\n", "a: b\n", "A", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----a:", "x: -----BEGIN PRIVATE KEY-----\n", "-----BEGIN PRIVATE KEY-----\nab", "eyJ.", "M", "30", "password ", "AKIA"])
def test_secrets_take_linear_time(unit):
    text = "-----BEGIN RSA PRIVATE KEY-----" + unit * ((1 << 20) // len(unit))
    began = time.process_time()
    spans(text)
    assert time.process_time() - began < 4


def test_secrets_over_a_table(spark):
    rows = [(1, "secret: hunter2hunter2"), (2, None), (None, ""), (1, "secret: hunter2hunter2")]
    got = scanned(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 as spans")).collect()
    assert sorted((g.doc_id or 0, g.n_assign, g.spans) for g in got) == [(0, 0, ""), (1, 1, "assign:0:22"), (1, 1, "assign:0:22"), (2, 0, "")]
    assert {g.base_sha256 for g in got if not g.n_assign} == {hashlib.sha256(b"").hexdigest()}


def base_spans(text):
    """The contract's patterns as they stand."""
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [x for *_, x in sorted(found)]


def test_secrets_equal_brute_force(spark):
    r = random.Random(12)
    bits = ["password", "PassWd", " ", "  ", "=", ":", "'", '"', "token", "api_key", "APIKEY", "secret", "AKIA", "AKIAAKIA", "é", "ſecret", "x", "\n", "_", "-"]
    made = lambda: r.choice(bits) if r.random() < 0.7 else "".join(r.choice(r.choice(["0123456789abcdef", "ABCXYZ0189", "abc./+="])) for _ in range(r.randint(1, 30)))
    rows = [(k, "".join(made() for _ in range(r.randint(0, 60)))) for k in range(400)]
    rows += [(400, "".join(made() for _ in range(60_000))), (401, None), (401, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((g.doc_id, g.base_sha256, g.n_assign + g.n_access + g.n_hex) for g in scanned(docs).collect())
    want = [(k, base_spans(t or "")) for k, t in rows]
    assert got == sorted((k, hashlib.sha256(",".join(w).encode()).hexdigest(), len(w)) for k, w in want) and sum(len(w) for _, w in want) > 500
    assert scanned(docs.limit(0)).collect() == []


def test_suffix_sort_orders_groups():
    r = random.Random(4)
    for _ in range(40):
        strings = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 40))]
        group = np.sort(np.array([r.randint(0, 3) for _ in strings]))
        data = np.frombuffer(b"".join(strings) or b"x", dtype=np.uint8)
        sizes = np.array([len(s) for s in strings])
        order, common = sorted_strings(group, data, np.cumsum(sizes) - sizes, sizes)
        keys = [(group[k], strings[k]) for k in order]
        assert keys == sorted(keys)
        for k in range(1, len(order)):
            a, b = strings[order[k - 1]], strings[order[k]]
            same = group[order[k]] == group[order[k - 1]]
            assert common[k] == (next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) if same else -1)


def test_encoder_keeps_nothing_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(piece_bpe, "mapped", lambda table, run, schema: run)
    run = piece_bpe.encoded(spark.createDataFrame([(1, "a")], "doc_id long, text string"), piece_model())
    out = list(run(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "__text": ["one two  three, fourteen"]})])))
    bpe = encoder(piece_model())
    assert out[0].num_rows == 1 and not bpe.cuts and not bpe.compatible.cache_info().currsize
