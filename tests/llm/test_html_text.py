"""The two passes against labels worked out block by block from their definition, and pages with and without markup."""

import random
import re

import pyarrow.parquet as pq

from lodestone.llm import html_text
from lodestone.llm.html_text import Block


def plain(rows):
    """rows: (text, share of stop words, share of links, main, out, head). Every block looks at all others."""
    n, kinds = len(rows), []
    for text, stop, link, main, out, head in rows:
        if out or link > (0.75 if main else 0.33):
            kinds.append("short" if head and main and not out else "bad")
        elif len(text) < 70:
            kinds.append("bad" if link and not main else "short")
        elif stop >= 0.2:
            kinds.append("good" if len(text) > 200 else "near")
        else:
            kinds.append("near" if stop >= 0.12 or main else "bad")
    inside = sum(len(r[0]) for r, k in zip(rows, kinds) if r[3] and k != "bad")
    if inside and sum(len(r[0]) for r, k in zip(rows, kinds) if not r[3] and k == "good") <= 4 * inside:
        kinds = [k if r[3] else "bad" for r, k in zip(rows, kinds)]
    labels = []
    for i, (kind, row) in enumerate(zip(kinds, rows)):
        decided = {"good": 1, "bad": 0} | ({"near": 1} if kind == "short" else {})
        places = [j for j in range(n) if j != i and rows[j][3] == row[3] and kinds[j] in decided]
        before, after = max([j for j in places if j < i], default=None), min([j for j in places if j > i], default=None)
        near = [decided[kinds[j]] for j in (before, after) if j is not None]
        follows = row[5] and after is not None and decided[kinds[after]]
        if kind in ("good", "bad"):
            labels.append(kind == "good")
        elif not near:
            labels.append(True)
        elif kind == "near":
            labels.append(bool(max(near)) or not row[3] and "good" not in kinds)
        elif row[3]:
            labels.append(bool(follows or min(near)))
        else:
            labels.append(bool(follows or near == [1, 1] or not {"good", "near"} & set(kinds)))
    return labels


def test_passes():
    rnd = random.Random(3)
    for _ in range(3000):
        rows, blocks, texts = [], [], []
        for _ in range(rnd.randint(1, 9)):
            words = ["the" if rnd.random() < rnd.choice((0, 0.15, 0.4)) else "xyzzy" for _ in range(rnd.choice((1, 6, 20, 30, 60)))]
            text = " ".join(words)
            link, main, out, head = rnd.choice((0, 0, 0.2, 0.5, 1)), rnd.choice((0, 0, 1, 2)), rnd.random() < 0.15, rnd.random() < 0.2
            linked = int(link * len(text))
            rows.append((text, words.count("the") / len(words), linked / len(text), main, out, head))
            blocks.append(Block([text], linked, len(text), main, out, head))
            texts.append(text)
        first = html_text._settled(blocks, texts, [html_text.first_pass(b, t) for b, t in zip(blocks, texts)])
        assert html_text.second_pass(blocks, first) == plain(rows)


def test_without_markup():
    """The same blocks mostly stay when a page's article element is taken away, and no other comes in."""
    same = whole = extra = 0
    for html in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        marked, bare = (html_text.main_text(x).split("\n") for x in (html, re.sub("</?article>", "", html)))
        same, whole, extra = same + len(set(marked) & set(bare)), whole + len(set(marked)), extra + len(set(bare) - set(marked) - {""})
    assert same >= 0.8 * whole and extra == 0


def test_kinds_of_regions():
    body = "The end of the story is that it was the best of all for us. " * 5
    page = f"<body><header>Site</header><div class='cookie-notice'>{body}</div><div><p>{body}<p>Short one.<p>{body}</div><form>{body}</form><div id='comments'><p>{body}</div><ul><li><a href=x>{body}</a></ul>"
    assert html_text.main_text(page) == "\n".join([body.strip(), "Short one.", body.strip()])
    listed = "<nav>x</nav><main><h1><a href=x>A title</a></h1><p>aaa | bbb | ccc</main><p>" + body
    assert html_text.main_text(listed) == "A title\naaa | bbb | ccc\n" + body.strip() or html_text.main_text(listed)
