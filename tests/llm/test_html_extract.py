import random
import re

from brindle.llm import html_extract as h
from brindle.llm.html_extract import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>Title &amp; more</h1><p>First   para,\nwith <b>bold</b> text.<p>Second &lt;p&gt;.<br>Still second.</p><div class="comments"><p>Reader says hi.</p></div></article>
<aside>Side</aside><div class="ad">Buy now.</div><form>Search <button>go</button></form><footer>&copy; x</footer></body></html>"""


def test_article_only():
    assert main_text(PAGE) == "Title & more\nFirst para, with bold text.\nSecond <p>. Still second."


def test_without_article():
    page = "<body><div id=menu><a href=1>one</a> <a href=2>two</a></div><div class=content><p>A long enough sentence, with commas, and stops. It goes on.</p><p>Short.</p></div><div class=footer>foot</div></body>"
    assert main_text(page) == "A long enough sentence, with commas, and stops. It goes on.\nShort."


def test_defined_for_anything(spark):
    long = "<article>" + "<p>word word.</p>" * 20_000
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p"), (4, "u", "plain text, no tags."), (5, "u", long), (6, "u", "<article><p>x & y &am</article>"), (6, "u", "<!-- open"), (None, "u", "<script>never closed")]
    got = extract(spark.createDataFrame([(*r, "n") for r in rows], "page_id long, url string, html string, text string")).collect()
    texts = {(r.page_id, r.url): r.text for r in got}
    assert len(got) == 8 and texts[1, "u"] == texts[2, None] == "" and texts[4, "u"] == "plain text, no tags." and texts[5, "u"].count("\n") == 19_999
    assert sorted(r.text for r in got if r.page_id == 6) == ["", "x & y &am"] and all(r.n_chars == len(r.text) for r in got)


def test_empty_table(spark):
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_ratios_decide_in_marked_pages():
    body = "".join(f"<p>Sentence number {k} of the text is long enough, has commas, and stops. So does its second one.</p>" for k in range(6))
    links = "<div><ul>" + "".join(f"<li><a href=/{k}>Link {k}</a></li>" for k in range(8)) + "</ul></div>"
    assert "Link" not in main_text(f"<body><article>{body}{links}</article></body>")
    # The article is a teaser; the text is beside it.
    got = main_text(f"<body><article><p>Read on.</p></article><div>{body}</div></body>")
    assert "Sentence number 5" in got


def test_names_of_wrappers_lose_no_text():
    text = "A long enough sentence, with commas, and stops. It goes on, and on."
    for start, end in (('<div class="layout has-sidebar">', "</div>"), ('<div class="page no-header">', "</div>"), ("<form>", "</form>"), ('<div class="sidebar">', "</div>")):
        for article in (f"<article><p>{text}</p></article>", f"<div><p>{text}</p></div>"):
            assert main_text(f"<body>{start}{article}{end}<div class=menu>Menu</div></body>") == text
    # A part of a longer name alone doesn't drop a part of an article; a name does.
    got = main_text(f'<body><article><p>{text}</p><div class="share-price"><p>{text} Shares fell, too.</p></div><div class="comments"><p>I say, {text}</p></div></article></body>')
    assert got == f"{text}\n{text} Shares fell, too."


def test_ratios_match_brute_force():
    """The steps of the ratios, each over all blocks anew: sums a path, smoothing, fusing, priors."""
    rng = random.Random(2)
    for _ in range(30):
        paths = [f"/body{'/div' * rng.randrange(3)}/{rng.choice(['p', 'li', 'h1'])}" for _ in range(6)]
        blocks = []
        for _ in range(rng.randrange(1, 25)):
            text = "".join(rng.choice("abc ,.! ") for _ in range(rng.randrange(1, 60))).strip() or "x"
            blocks.append((rng.choice(paths), text, rng.randrange(len(text) + 1), rng.choice([0, 0, 0, h.PART, h.NAMED]), rng.random() < 0.3))
        keys = list(dict.fromkeys((p, bad, good) for p, _, _, bad, good in blocks))

        def ratio(key):
            own = [b for b in blocks if (b[0], b[3], b[4]) == key]
            chars, links = sum(len(b[1]) for b in own), sum(b[2] for b in own)
            marks = sum(len(re.findall(r"[.,;:!?。，…¿¡]", b[1])) for b in own)
            return (chars - links) / len(own) * (1 + marks / len(own))

        want = {}
        for k, key in enumerate(keys):
            smooth = (2 * ratio(key) + ratio(keys[max(0, k - 1)]) + ratio(keys[min(len(keys) - 1, k + 1)])) / 4
            section = max(ratio(x) for x in keys if x[0].rsplit("/", 1)[0] == key[0].rsplit("/", 1)[0] and x[1:] == key[1:])
            score = max(min(smooth, 2 * ratio(key)), section)
            want[key] = 0.0 if key[1] > h.PART else score * (4.0 if key[2] else 1.0) * (0.1 if key[1] else 1.0)
        got = h.path_scores(blocks)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_text_follows_the_ratios(monkeypatch):
    text = "A long enough sentence, with commas, and stops. It goes on, and on."
    page = f"<body><article><p>{text}</p><ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul></article></body>"
    assert main_text(page) == text
    # Turned around, the ratios keep the links and drop the sentence: nothing else decides.
    real = h.path_scores
    monkeypatch.setattr(h, "path_scores", lambda blocks: {k: 1.0 / (1.0 + v) for k, v in real(blocks).items()})
    assert text not in main_text(page) and "one" in main_text(page)
