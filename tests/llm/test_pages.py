"""The tag-path ratio where no element and no class names the article, and what words in classes may rule out."""

import re
from collections import defaultdict

import numpy as np
import pytest

from custodia.llm import pages

LONG = "A sentence of the story, with some words in it; and then another one, just as long. " * 4
DATA = "/root/testdata/sf0.01/pages.parquet"


def paragraphs(n):
    return "".join(f"<p>{k} {LONG}</p>" for k in range(n))


def story(n):
    return "\n".join(f"{k} {LONG}".strip() for k in range(n))


@pytest.mark.parametrize("page, want", [
    # Nothing names the story: the ratio alone keeps what stands around it out, and short blocks in it stay.
    (f"<div>Home</div><div>Contact us today</div><div class=x><h1>Head</h1>{paragraphs(3)}<ul><li>a<li>b</ul></div><div>(c) 2024 Example Ltd.</div>", f"Head\n{story(3)}\na\nb"),
    (f"<body><div>Home</div><h2>Head</h2>{paragraphs(3)}<p>End.</p><div>(c) 2024 Example Ltd.</div></body>", f"Head\n{story(3)}\nEnd."),
    (f"<ul><li>One<li>Two<li>Three</ul><div><div>{paragraphs(2)}</div><h2>Mid</h2><div>{paragraphs(1)}</div></div><div>x</div>", f"{story(2)}\nMid\n{story(1)}"),
    # A layout element's class does not rule out an article in it; an aside's, and one inside the article, does.
    (f"<div class=page-header><article>{paragraphs(2)}</article></div>", story(2)),
    (f"<div class='news side'><main><h1>H</h1>{paragraphs(1)}</main></div>", f"H\n{story(1)}"),
    (f"<article>{paragraphs(2)}<div class=side><article>{paragraphs(1)}</article></div></article>", story(2)),
    (f"<article>{paragraphs(2)}</article><section class=comments><article>{paragraphs(3)}</article></section>", story(2)),
    (f"<aside><article>{paragraphs(1)}</article></aside><div><article>{paragraphs(2)}</article></div>", story(2)),
    # A teaser in an article element does not hide the story beside it.
    (f"<article><p>More news.</p></article><div>{paragraphs(4)}</div>", story(4)),
    # Links, and pages with little on them.
    (f"<div>{paragraphs(2)}<ul><li><a href=a>Somewhere else</a><li><a href=b>And there</a></ul></div>", story(2)),
    ("<p>no stop", "no stop"), ("a < b", "a < b"), ("<a href=x>only a link</a>", ""), ("<nav>Home</nav>", ""), ("", ""), (None, ""),
])
def test_main_text(page, want):
    assert pages.main_text(page) == want


def ratios_by_hand(found):
    """The same ratios with loops over paths and neighbours."""
    members = defaultdict(list)
    for k, b in enumerate(found):
        members[b.path].append(k)
    own = {p: sum(max(0, len(found[k].text) - found[k].linked) for k in ks) / len(ks) * (1 + sum(len(pages._PUNCTUATION.findall(found[k].text)) for k in ks)) for p, ks in members.items()}
    values = [own[b.path] for b in found]
    side, total = np.exp(-0.5), 1 + 2 * np.exp(-0.5)
    smooth = [(values[k] + side * (values[max(k - 1, 0)] + values[min(k + 1, len(values) - 1)])) / total for k in range(len(values))]
    fused = {p: (own[p] * sum(smooth[k] for k in ks) / len(ks)) ** 0.5 for p, ks in members.items()}
    spread = np.std([fused[b.path] for b in found])
    return [fused[b.path] >= pages.SPREAD * spread for b in found]


def bare(page):
    """The page with plain elements only: nothing names the article any more."""
    page = re.sub(r'\s(?:class|id|role)="[^"]*"', "", page)
    return re.sub(r"<(/?)(?:article|main|nav|header|footer|aside|section)\b", r"<\1div", page)


def test_ratio_finds_articles_that_nothing_names(spark, monkeypatch):
    given = [r.html for r in spark.read.parquet(DATA).collect()]
    named, found = [pages.main_text(h) for h in given], [pages.main_text(bare(h)) for h in given]
    assert np.mean([a == b for a, b in zip(named, found, strict=True)]) >= 0.9
    assert all(set(a.split("\n")) <= set(b.split("\n")) for a, b in zip(named, found, strict=True))
    for h in given:
        blocks = [b for b in pages.parse(bare(h)).blocks if not b.aside]
        assert pages.content_paths(blocks).tolist() == ratios_by_hand(blocks)
    monkeypatch.setattr(pages, "SPREAD", 0.0)
    assert np.mean([pages.main_text(bare(h)) == f for h, f in zip(given, found, strict=True)]) <= 0.1


def test_deep_pages_and_clashing_names(spark):
    deep = "<div>" * 50_000 + LONG + "</div>" * 50_000
    assert pages.main_text(deep) == LONG.strip()
    rows = [(1, "u", "<p>One.", "t", 7), (None, None, "<p>Two.", None, None), (1, "u", "<p>One.", "t", 7)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    got = pages.extract_pages(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "u", "One.", 4), (None, None, "Two.", 4), (1, "u", "One.", 4)], key=repr)
    assert pages.extract_pages(df.limit(0)).count() == 0
