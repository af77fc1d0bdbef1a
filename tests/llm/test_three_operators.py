"""Page text, token alignment and fill-in-the-middle on small tables with nulls, empty and long texts, repeats and clashing columns, against brute force."""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections import Counter
from html.parser import HTMLParser

import duckdb
import pytest

from ledgerloom.llm import alignment, extraction, infill

SF = "/root/testdata/sf0.001"
LONG = "The council of the city has agreed to the plan for the new bridge, which will be built in the north of the town by the end of the year and is to cost less than that of the old one."
DOCS = "doc_id bigint, text string, n string, form string, row string, pairs string, cut string, first string"


@pytest.fixture(scope="module")
def texts() -> list[tuple]:
    rng = random.Random(7)
    odd = ["a<P>b", "<S>", "x <M", "P><S", "été über naïve 日本語 テキスト", "tab\tand\nnew  line   x", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ low", "😀😃 ok", "I'm they'LL 3.14 100,000", " leading", "trailing ", "\x00\x01", "A" * 3000, "日" * 500]
    made = ["".join(rng.choice("ab<PSM> é.\nZ1") for _ in range(rng.randrange(40))) for _ in range(60)]
    long = " ".join(rng.choice(["the", "naïve", "token", "izers", "<P", "…", "x1", "Überfluss"]) for _ in range(30_000))
    rows = [(i, t) for i, t in enumerate([*odd, *made, long, "", None, "the same words", "the same words", "z"])]
    return [*rows, rows[3], (5, "another text of the same id"), (None, "no id"), (None, None), (-9, "below")]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x") for r in texts], DOCS).repartition(3)


def ordered(rows) -> list[tuple]:
    return sorted(map(tuple, rows), key=lambda r: tuple((v is None, v) for v in r))


# Fill in the middle.


def test_infill_equals_sql(spark, docs, texts):
    import pandas as pd

    got = infill.infilled(docs)
    out = got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", infill.restored(got.output, got.form).alias("back")).collect()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": pd.array([r[0] for r in texts], dtype="Int64"), "text": [r[1] for r in texts]}))
    want = con.sql(infill.ORACLE["op13_fill_in_middle"]).fetchall()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert ordered((*r[:5], sha(r.output), sha(r.back)) for r in out) == ordered(want)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert sorted(r.back for r in out) == sorted(t or "" for _, t in texts)
    assert infill.infilled(docs.limit(0)).count() == 0


def test_unit_ranks_are_those_of_the_pattern(texts):
    for _, text in texts:
        text = (text or "")[:400]
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        starts, before, marked = infill.unit_gaps(text)
        assert before[-1] == len(units) and marked == any(s in text for s in ("<P>", "<S>", "<M>"))
        assert [infill.offset_of_rank(k, starts, before) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


def test_op13_on_the_smallest_tables(spark):
    df = infill.op13_fill_in_middle(spark, SF)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(infill.ORACLE["op13_fill_in_middle"])
    assert df.columns == want.columns and ordered(df.collect()) == ordered(want.fetchall())


# Alignment.


def brute_alignment(rows: list[tuple]) -> list[tuple]:
    """By byte offsets, with the other library's file of the byte tokenizer."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    byte = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    byte.encode_special_tokens = True
    piece = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    counts, parts = Counter(), []
    for key, text in rows:
        a = byte.encode(" " + text, add_special_tokens=False).ids if text else []
        b = piece.encode(text) if text else []
        own_a = [bytes(letter[c] for c in byte.id_to_token(x)) for x in a]
        own_b = [bytes([int(piece.id_to_piece(x)[3:5], 16)]) if piece.is_byte(x) else piece.id_to_piece(x).replace("▁", " ").encode() for x in b]
        whole = b" " + (text or "").encode()
        if b"".join(own_a) != whole or b"".join(own_b) != whole:
            parts.append((key, 0, 0, 0, [], ""))
            continue
        at_a, at_b = [0], [0]
        for at, own in ((at_a, own_a), (at_b, own_b)):
            for x in own:
                at.append(at[-1] + len(x))
        cuts = sorted(set(at_a) & set(at_b))
        within = lambda ids, at, lo, hi: ",".join(map(str, ids[bisect.bisect_left(at, lo) : bisect.bisect_left(at, hi)]))
        said = ";".join(f"{within(a, at_a, lo, hi)}|{within(b, at_b, lo, hi)}" for lo, hi in zip(cuts, cuts[1:], strict=False))
        links, j = [], 0
        for i, x in enumerate(a):
            while at_b[j + 1] <= at_a[i]:
                j += 1
            k = j
            while k < len(b) and at_b[k] < at_a[i + 1]:
                links.append((x, b[k]))
                k += 1
        counts.update(links)
        parts.append((key, len(a), len(b), len(cuts) - 1, links, hashlib.sha256(said.encode()).hexdigest()))
    most: dict = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    return [(key, na, nb, ng, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), said) for key, na, nb, ng, links, said in parts]


@pytest.mark.parametrize("hot", [1 << 20, 40, 0])
def test_alignment_equals_offsets(spark, docs, texts, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot)
    got = alignment.scored_documents(docs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = brute_alignment(texts)
    assert ordered(got.collect()) == ordered(want)
    assert sum(1 for r in want if r[1] == 0) >= 4


def test_alignment_of_nothing(spark, docs):
    assert alignment.scored_documents(docs.limit(0)).count() == 0
    none = alignment.scored_documents(docs.where("text is null or text = ''")).collect()
    assert none and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in none)


def test_op12_on_the_smallest_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert ordered(alignment.op12_token_alignment(spark, SF).collect()) == ordered(brute_alignment(rows))


def test_groups_cover_the_bytes(spark, docs, texts):
    rows = alignment.token_groups(docs.where("doc_id = 4 or doc_id = 9")).collect()
    text = {i: t for i, t in texts if i in (4, 9)}
    for key in (4, 9):
        own = sorted((r for r in rows if r.doc_id == key), key=lambda r: r.group)
        assert [r.group for r in own] == list(range(len(own))) and own[0].start == 0 and own[-1].end == len((" " + text[key]).encode())
        assert all(x.end == y.start for x, y in zip(own, own[1:], strict=False)) and all(r.ids_a and r.ids_b for r in own)


def test_transitions_may_be_forgotten():
    words = [b"a", b"b", b"ab", b"abc", b"c", b"bc"]
    rng = random.Random(2)
    keeps, forgets = alignment.Transducer(words, words), alignment.Transducer(words, words, limit=0)
    for _ in range(300):
        whole = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 20)))

        def split(at=0):
            out = []
            while at < len(whole):
                k = rng.choice([i for i, w in enumerate(words) if whole.startswith(w, at)])
                out.append(k)
                at += len(words[k])
            return out

        a, b = split(), split()
        groups, links = keeps.align(a, b)
        assert (groups, links) == forgets.align(a, b) and len(links) == len(a) + len(b) - len(groups)
        assert keeps.align(a, b[:-1]) is None and keeps.align(a, [*b, 0]) is None and keeps.align(a, [*b[:-1], 1 if whole[-1:] != b"b" else 0]) is None


# Page text.


def page_text(page: str) -> str:
    blocks = extraction.read_blocks(page)
    return " ".join(b.text for b, label in zip(blocks, extraction.inherited(blocks, extraction.decided(blocks)), strict=True) if label == "content")


class ArticleText(HTMLParser):
    """What stands inside <article>, with a space for every tag but inline ones."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag not in ("b", "i", "em", "a", "span"):
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag not in ("b", "i", "em", "a", "span"):
            self.out.append(" ")

    def handle_data(self, data):
        if self.depth:
            self.out.append(data)


def test_op11_is_the_articles_text(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        parser = ArticleText()
        parser.feed(r.html)
        parser.close()
        want[r.page_id] = " ".join("".join(parser.out).split())
    got = extraction.op11_page_text(spark, SF)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert {r.page_id: r.text for r in got.collect()} == want and all(r.n_chars == len(r.text) for r in got.collect())


CASES = {
    "notice, form and comments": (f'<body><header><h2>Site</h2></header><div class="cookie-notice"><p>{LONG}</p></div><main><article><header><h1>Title</h1></header><p>{LONG}</p><p>Yes.</p><form><label>Email</label><input></form><div id="comments"><p>{LONG}</p></div></article></main><aside>{LONG}</aside></body>', f"Title {LONG} Yes."),
    "comments as articles": (f'<article><p>{LONG}</p></article><section class="comments"><article><p>{LONG}</p></article></section>', LONG),
    "no article": (f'<div><a href="/">Home</a> <a href="/a">About</a></div><div><h1>Tea</h1><p>{LONG}</p><p>So.</p><p>{LONG}</p></div><div>© 2020 Foo. All rights reserved.</div>', f"Tea {LONG} So. {LONG}"),
    "heading of comments": (f'<body><div class="post"><h1>T</h1><p>{LONG}</p><h3>3 Comments</h3><p>{LONG}</p></div></body>', f"T {LONG}"),
    "references": ("<article><p>a &lt;b&gt; &amp;amp; &#233;&nbsp;x &copy; y&eacute</p></article>", "a <b> &amp; é x © yé"),
    "unclosed": ('<article><h1>T<p>one<p class="ad">two<p>three<ul><li>x<li><a href=1>menu</a></ul>four', "T one three x four"),
    "raw text": ('<article><script>if(a<b){"</p>"}</script><p>k</p><style>p{}</style><!-- <p>no</p> -->q</article>tail', "k q"),
    "tags in attributes": ('<article><p title="a>b">z</p><img alt="x>y">w</article>', "z w"),
    "hidden": ('<article><p>a</p><div style="display:none">b</div><p hidden>c</p><nav>d</nav><div class="share-buttons">e</div><span class="ad">f</span> g</article>', "a g"),
    "named content": (f'<div class="wrapper"><ul class="menu"><li>m</li></ul><div id="content"><h2>H</h2><p>short.</p></div><div class="sidebar">{LONG}</div></div>', "H short."),
    "short named part": (f'<div><h1>Tea</h1><p>{LONG}</p></div><div class="main-logo">Logo</div><div>© x</div>', f"Tea {LONG}"),
    "inline tags join": ("<article><p>ab<b>cd</b> e<br>f</p>\n<p>\t g </p></article>", "abcd e f g"),
    "less-than signs": ("<article><p>1 < 2 and 3 <4 </p></article>", "1 < 2 and 3 <4"),
    "nothing": ("", ""), "blank": (" \n ", ""), "no markup": ("just text", "just text"), "only a menu": ("<nav><a href=1>x</a></nav>", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_page_cases(name):
    page, want = CASES[name]
    assert page_text(page) == want


def test_second_pass_takes_the_nearest_of_the_container():
    page = f"<div><p>{LONG}</p><p>Yes.</p><p>No.</p></div><div><a href=1>one</a></div><p>Alone.</p><div>© x</div>"
    assert page_text(page) == f"{LONG} Yes. No."


def test_pages_with_nulls_repeats_and_clashes(spark):
    long = "<article>" + "<p>word é</p>" * 20_000 + "</article>"
    rows = [(1, "u", "<article><p>x</p></article>"), (1, "u", "<article><p>x</p></article>"), (1, None, "<article>y</article>"), (None, "v", None), (2, "w", ""), (3, "l", long)]
    pages = spark.createDataFrame([(*r, "c", "c", "c") for r in rows], "page_id bigint, url string, html string, blocks string, text string, label string")
    got = extraction.page_blocks(pages).select("page_id", "url", extraction.main_text(extraction.F.col("blocks")).alias("text")).collect()
    assert ordered(got) == ordered([(1, "u", "x"), (1, "u", "x"), (1, None, "y"), (None, "v", ""), (2, "w", ""), (3, "l", " ".join(["word é"] * 20_000))])
    assert extraction.page_blocks(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<" * 100_000, "<a " * 50_000, '<a href="' * 30_000, "<div>" * 20_000 + "</span></p>" * 20_000, "<!-- " * 50_000, "&" * 100_000, "<p>a" * 30_000])
def test_broken_markup_takes_linear_time(page):
    import time

    began = time.time()
    page_text(page)
    assert time.time() - began < 5
