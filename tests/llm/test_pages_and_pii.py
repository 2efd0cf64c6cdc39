"""Page text against what was put into the page, and personal data against the patterns themselves."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillmere.llm import html_text, pii

BODY = "<h1>The &amp; Title</h1><p>First   para\n with <b>bold</b> &lt;x&gt; text.</p><p>Second, a <a href=x>link</a> inside.<p>Third unclosed<ul><li>one<li>two</ul>"
TEXT = "The & Title\nFirst para with bold <x> text.\nSecond, a link inside.\nThird unclosed\none\ntwo"
PAGES = {
    "article": (f"<html><body><nav><a href=1>m</a></nav><article>{BODY}</article><footer>f</footer></body></html>", TEXT),
    "divs": (f"<div id=menu><a href=1>a</a></div><div class='content'>{BODY}</div><div class=sidebar>s</div>", TEXT),
    "no marks": (f"<body><div><a href=1>aa</a> <a href=2>bb</a></div><div>{BODY}</div><div><a href=3>cc</a></div>", TEXT),
    "comments": (f"<main>{BODY}<section id='comments'><p>Nice post, a long reader comment here.</p></section></main>", TEXT),
    "form and script": (f"<article><form><p>Sign up</p></form><script>var a='</p><p>x';</script>{BODY}<style>p{{}}</style></article>", TEXT),
    "notice": (f"<div class='cookie-notice'><p>We use cookies and more words here.</p></div><article>{BODY}</article>", TEXT),
    "comment": (f"<!-- <p>no</p> --><article>{BODY}<!-- open", TEXT),
    "cut": ("<article><p>Hello wor", "Hello wor"),
    "upper": (f"<ARTICLE>{BODY.upper().replace('&AMP;', '&amp;').replace('&LT;', '&lt;').replace('&GT;', '&gt;')}</ARTICLE>", TEXT.upper()),
    "empty": ("", ""),
    "only menu": ("<nav><a href=1>x</a></nav>", ""),
    "plain": ("just text", "just text"),
    "broken": ("<b><![foo[x]]>z</i></b></div>", "z"),
    "frame": (f"<div class='has-sidebar'><article>{BODY}</article></div>", TEXT),
    "table": ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\nb\nc"),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    assert html_text.main_text(PAGES[name][0]) == PAGES[name][1]


def test_deep_and_long_pages_do_not_recurse():
    assert html_text.main_text("<div>" * 20_000 + "deep") == "deep"
    assert html_text.main_text("<p>" + "x " * 400_000) == ("x " * 400_000).strip()
    assert html_text.main_text("<b>" * 5000 + "</i>" * 5000 + "t") == "t"


def test_extract(spark):
    rows = [(i, f"u{i}", h) for i, (h, _) in enumerate(PAGES.values())] + [(None, None, None), (0, "u0", PAGES["article"][0])]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    texts = [t for _, t in PAGES.values()]
    assert len(got) == len(rows)
    for r in got:
        assert r.text == ("" if r.page_id is None else texts[r.page_id]) and r.n_chars == len(r.text)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_density_prefers_text_to_links():
    root = html_text.parse("<div><a href=1>one two three four</a></div><div><p>one two three four five six</p></div>")
    nodes = {n.tag: n for n in html_text.measure(root)}
    assert nodes["p"].density > nodes["a"].density


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            n = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True, "ip": lambda m=m: all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")),
                "card": lambda n=n: 12 <= len(n) <= 19 and luhn(n), "phone": lambda n=n: 9 <= len(n) <= 15,
            }[kind]()
            if good:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


TRICKY = [
    None, "", "a@b.c_d@e.f x@y +1 (234) 555-6789 256.1.1.1 1.2.3.4.5.6.7.8 001.2.3.004", "4111 1111 1111 1111 4111-1111-1111-1112",
    "9" * 30_000 + " " + "1 " * 30_000 + "a@" + "b." * 20_000 + "c", "jane [at] mail [dot] com, tel: (030) 555-1234 é😀 x.y@z.co",
    "🎉a+b@c.de" + "x" * 100_000, "+" * 50 + "1 2 3 4 5 6 7 8 9", "a" * 50_000, "1.2.3.4@5.6.7.8 0.0.0.0", "4111111111111111 +4111111111111111",
]


def test_spans_equal_the_patterns(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(TRICKY)] + [(None, None), (10**6, None)], "doc_id long, text string")
    docs = rows.union(more).selectExpr("doc_id", "text", "1 AS spans", "'x' AS email")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    got = pii.digests(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        want = base(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), r.doc_id
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k in PATTERNS]
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans) and len(spans) == len(want) + r.n_added
        order = [(int(x.split(":")[1]), list(PATTERNS).index(x.split(":")[0])) for x in spans]
        assert order == sorted(order)
    assert pii.digests(docs.limit(0)).count() == 0


def test_added_spans_in_chains(spark):
    rng = random.Random(3)
    rows = [(0, [(0, 5, 1), (4, 9, 1), (8, 12, 1)]), (1, []), (2, [(3, 9, 2), (3, 6, 1), (6, 8, 0), (3, 6, 1)])]
    for i in range(3, 60):
        starts = [rng.randrange(40) for _ in range(rng.randrange(12))]
        rows.append((i, [(a, a + rng.randrange(1, 8), rng.randrange(4)) for a in starts]))
    want = {}
    for i, spans in rows:
        kept = []
        for a, k, z in sorted((a, k, z) for a, z, k in spans):
            if not kept or a >= kept[-1][1]:
                kept.append((a, z, k))
        want[i] = kept
    assert want[0] == [(0, 5, 1), (8, 12, 1)]
    df = spark.createDataFrame(rows, "id int, s array<struct<start:int,stop:int,kind:int>>")
    got = {r.id: [tuple(x) for x in r.s] for r in df.select("id", pii.apart(F.col("s")).alias("s")).collect()}
    assert got == want


def test_em_finds_the_reliable_labeler():
    # Labeler 2 is right nine times in ten, labeler 3 votes by chance.
    patterns = [(0, (0, 0, 1, 1, 0), 450), (0, (0, 0, 1, -1, 0), 450), (0, (0, 1, 1, 0, 1), 500), (0, (0, -1, -1, 1, -1), 500), (0, (0, -1, -1, -1, 0), 500)]
    likely = pii.reliabilities(patterns)
    assert likely[0, (0, 0, 1, 1, 0)] > 0.8 and likely[0, (0, 0, 1, -1, 0)] > 0.8
    assert likely[0, (0, -1, -1, 1, -1)] < 0.2


STORY = "".join(f"<p>Paragraph {i} of the story, which goes on for a good while and links to nothing at all.</p>" for i in range(6))
STORY_TEXT = "\n".join(f"Paragraph {i} of the story, which goes on for a good while and links to nothing at all." for i in range(6))
CARDS = "".join(f"<article><h3><a href={i}>Teaser {i} with a long linked title</a></h3></article>" for i in range(3))


@pytest.mark.parametrize("html", [f"<div>{STORY}</div><div>{CARDS}</div>", f"<main><div>{STORY}</div>{CARDS}</main>", f"<div>{CARDS}</div><main>{STORY}</main>"])
def test_density_overrules_article_tags(html):
    assert html_text.main_text(html) == STORY_TEXT


def test_story_goes_on_beside_the_article_tag():
    first, rest = STORY[: STORY.index("<p>Paragraph 4")], STORY[STORY.index("<p>Paragraph 4") :]
    assert html_text.main_text(f"<div><article>{first}</article><div>{rest}</div></div>") == STORY_TEXT
