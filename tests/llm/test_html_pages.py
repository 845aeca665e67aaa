"""Hand-labelled page shapes: an article in many kinds of page, with what must go around it."""

from collections import Counter

import pytest

from quillmark.llm import html_text

LONG = [
    "The harbour town woke late that morning, and nobody on the quay noticed the grey ship until it had tied up.",
    "By noon, however, every shop on the front had heard three stories about its cargo; none of them agreed.",
    "The harbour master, a careful man, wrote down what he saw: crates, ropes, and a single caged bird.",
    "When evening came the crew walked up the hill, bought bread, and paid with coins that no one knew.",
]
SHORT = ["A brief note, for the record: the bridge is closed.", "It opens again on Monday, at nine, after repairs."]
MENU = "<ul><li><a href=/>Home</a><li><a href=/news>News</a><li><a href=/about>About us</a></ul>"
FOOT = "© 2024 Example Press. All rights reserved."
SAYS = ["I was there, and it did not happen like that at all, believe me, my friends.", "Nice piece, thank you, although the photographs could be larger, in my view.", "First! Also, why is there no map, and who paid for the ship in the end?"]
p = lambda texts: "".join(f"<p>{x}</p>" for x in texts)
H, B = "<h1>The grey ship</h1>", "The grey ship"
L, S = " ".join(LONG), " ".join(SHORT)

NAMES = ["content", "elementor-widget-theme-post-content", "site no-sidebar", "post has-comments", "login-required", "social-science", "entry", "story__body", "td-post-content", "c-article-body js-copy", "page-with-banner", "noticeboard", "widget", "promo"]
PAGES = {
    **{f"class {n}": (f"<body><div class='menu'>{MENU}</div><div class='{n}'>{H}{p(LONG)}</div><div class='footer'>{FOOT}</div></body>", f"{B} {L}") for n in NAMES},
    **{f"class {n}, stray footer": (f"<body><div class='{n}'>{H}{p(LONG)}</div><div>Printed by hand, in the old town.</div></body>", f"{B} {L}") for n in ("content", "site no-sidebar", "social-science")},
    **{f"class {n}, short, stray footer": (f"<body><div class='menu'>{MENU}</div><div class='{n}'>{H}<p>{LONG[0]}</p></div><div>Printed by hand, in the old town.</div></body>", f"{B} {LONG[0]}") for n in NAMES[:6]},
    "quote without equals": ("<div class=x'>Hello there, reader of this page.</div><p>Don't stop here, there is more to come.", "Hello there, reader of this page. Don't stop here, there is more to come."),
    "unquoted value with a quote": (f"<div title=it's><p>{LONG[0]}</p><p>{LONG[1]}</p></div>", f"{LONG[0]} {LONG[1]}"),
    "greater-than in a value": (f"<div data-x='a > b'><p title=\"1 > 0\">{LONG[0]}</p><p>{LONG[1]}</p></div>", f"{LONG[0]} {LONG[1]}"),
    "only a copyright line": (f"<body><div>{FOOT}</div></body>", ""),
    "only a footer by class": ("<body><div class='site-footer'>Example Press, Harbour Street.</div></body>", ""),
    "article element": (f"<body><header><h1>Example Press</h1></header><nav>{MENU}</nav><article>{H}{p(LONG)}</article><footer>{FOOT}</footer></body>", f"{B} {L}"),
    "article and aside": (f"<body><article>{H}{p(LONG[:2])}<aside><p>{SAYS[0]}</p></aside>{p(LONG[2:])}</article></body>", f"{B} {L}"),
    "main with comments": (f"<main><article>{H}{p(LONG)}</article><section class='comments'>{p(SAYS * 3)}</section></main>", f"{B} {L}"),
    "long comments after a short article": (f"<div class='post'>{H}{p(SHORT)}</div><div id='comments'>{''.join(f'<div class=comment>{p([x])}</div>' for x in SAYS * 4)}</div>", f"{B} {S}"),
    "comments inside the post": (f"<div class='post has-comments'>{H}{p(LONG)}<div class='comment-list'>{p(SAYS)}</div></div>", f"{B} {L}"),
    "related posts": (f"<div id=main>{H}{p(LONG)}<div class='related-posts'><h3>More</h3><a href=1>The red ship, a tale in two parts</a></div></div>", f"{B} {L}"),
    "cookie banner": (f"<div class='cookie-banner'><p>We use cookies, as everyone does, to count visits; do you agree?</p><button>OK</button></div><div class=c>{H}{p(LONG)}</div>", f"{B} {L}"),
    "newsletter form": (f"<div class=c>{H}{p(LONG[:2])}<form><p>Subscribe to our letter, it is free.</p><input></form>{p(LONG[2:])}</div>", f"{B} {L}"),
    "page inside a form": (f"<body><form id=aspnetForm><div class=c>{H}{p(LONG)}</div><div class='footer'>{FOOT}</div></form></body>", f"{B} {L}"),
    "share buttons": (f"<article>{H}<div class='share-buttons'><a href=1>Tweet</a> <a href=2>Post</a></div>{p(LONG)}</article>", f"{B} {L}"),
    "unnamed menu of links": (f"<div>{MENU}</div><div>{H}{p(LONG)}</div><div>{MENU}</div>", f"{B} {L}"),
    "menu inside the container": (f"<div class=c>{H}{MENU}{p(LONG)}</div>", f"{B} {L}"),
    "list in the article": (f"<div class=c>{H}{p(LONG[:2])}<ul><li>bread<li>rope<li>a bird</ul>{p(LONG[2:])}</div>", f"{B} {' '.join(LONG[:2])} bread rope a bird {' '.join(LONG[2:])}"),
    "list at the end": (f"<div class=c>{H}{p(LONG)}<ul><li>bread</li><li>rope</li></ul></div>", f"{B} {L} bread rope"),
    "headings between": (f"<div class=c>{H}<h2>Morning</h2>{p(LONG[:1])}<h2>Noon</h2>{p(LONG[1:2])}<h3>Night</h3>{p(LONG[2:])}</div>", f"{B} Morning {LONG[0]} Noon {LONG[1]} Night {' '.join(LONG[2:])}"),
    "title outside the container": (f"<body><div id=head>{MENU}</div>{H}<div class=body>{p(LONG)}</div><div class='footer'>{FOOT}</div></body>", f"{B} {L}"),
    "title in a sibling": (f"<div class=post><div class=top>{H}</div><div class=body>{p(LONG)}</div></div>", f"{B} {L}"),
    "lead above the body": (f"<main>{H}<p class=lead>{LONG[0]}</p><div class=body>{p(LONG[1:])}</div></main>", f"{B} {L}"),
    "sections": (f"<body>{''.join(f'<div class=s><p>{x}</p></div>' for x in LONG)}<div class='footer'>{FOOT}</div></body>", L),
    "table layout": (f"<table><tr><td class=nav>{MENU}</td><td class=c>{H}{p(LONG)}</td></tr></table>", f"{B} {L}"),
    "breaks instead of paragraphs": (f"<div class=c>{H}{'<br><br>'.join(LONG)}</div><div class='footer'>{FOOT}</div>", f"{B} {L}"),
    "unclosed paragraphs": (f"<div class=c>{H}<p>{'<p>'.join(LONG)}</div><footer>{FOOT}</footer>", f"{B} {L}"),
    "inline markup": (f"<div class=c><p>{LONG[0].replace('harbour', '<b>har</b>bour')}</p><p>{LONG[1]}</p></div>", f"{LONG[0]} {LONG[1]}"),
    "hidden inline text": (f"<div class=c><p>ship<span hidden>xx</span>yard, and more of it, for those who read on.</p><p>{LONG[1]}</p></div>", f"shipyard, and more of it, for those who read on. {LONG[1]}"),
    "links in the text": (f"<div class=c>{H}<p>The <a href=1>harbour master</a>, as <a href=2>we wrote</a>, kept a list of every ship that came.</p>{p(LONG[1:])}</div>", f"{B} The harbour master, as we wrote, kept a list of every ship that came. {' '.join(LONG[1:])}"),
    "scripts and styles": (f"<style>p{{}}</style><script>var a='<p>no</p>';</script><div class=c>{H}{p(LONG[:2])}<script>x<y</script>{p(LONG[2:])}</div>", f"{B} {L}"),
    "sidebar with prose": (f"<div class='sidebar'><h3>About</h3><p>{SAYS[0]}</p></div><div class=c>{H}{p(LONG)}</div>", f"{B} {L}"),
    "sidebar widget": (f"<div class=c>{H}{p(LONG)}</div><div class='widget sidebar-right'><p>{SAYS[0]}</p></div>", f"{B} {L}"),
    "advert between": (f"<article>{H}{p(LONG[:2])}<div class='ad-slot'>Buy a bird, today only!</div>{p(LONG[2:])}</article>", f"{B} {L}"),
    "notice above": (f"<div class=notice>The site is down for repairs, on Sunday, from two until four.</div><div class=c>{H}{p(LONG)}</div>", f"{B} {L}"),
    "breadcrumbs": (f"<div class=c><div class='breadcrumbs'><a href=/>Home</a> > <a href=/n>News</a></div>{H}{p(LONG)}</div>", f"{B} {L}"),
    "short article": (f"<nav>{MENU}</nav><article>{H}{p(SHORT)}</article>", f"{B} {S}"),
    "one sentence": ("<body><p>Closed today.</p></body>", "Closed today."),
    "roles": (f"<div role=banner>Example Press</div><div role=main>{H}{p(LONG)}</div><div role=contentinfo>{FOOT}</div>", f"{B} {L}"),
    "articleBody": (f"<div><p>{SAYS[0]}</p></div><div itemprop=articleBody>{H}{p(LONG)}</div>", f"{B} {L}"),
    "references": ("<p>Fish &amp; chips, at 5&nbsp;pm &lt;today&gt;, for all who ask politely.</p>", "Fish & chips, at 5 pm <today>, for all who ask politely."),
    "quotation": (f"<article>{H}<blockquote><p>{LONG[0]}</p></blockquote>{p(LONG[1:])}</article>", f"{B} {L}"),
    "figure with caption": (f"<article>{H}{p(LONG[:2])}<figure><img src=x><figcaption>The ship at rest.</figcaption></figure>{p(LONG[2:])}</article>", f"{B} {' '.join(LONG[:2])} The ship at rest. {' '.join(LONG[2:])}"),
    "comment markup": (f"<!-- <p>no</p> --><div class=c>{H}{p(LONG)}</div><!-->", f"{B} {L}"),
    "linked headings": (f"<article><h1>Ten tools</h1>{p(LONG[:1])}<h2><a href=1>Tool number 1</a></h2>{p(LONG[1:2])}<h2><a href=2>Tool number 2</a></h2>{p(LONG[2:])}<h2><a href=3>More stories</a></h2><ul><li><a href=4>One story</a><li><a href=5>Other story</a></ul></article>", f"Ten tools {LONG[0]} Tool number 1 {LONG[1]} Tool number 2 {' '.join(LONG[2:])}"),
    **{f"comments in {name}": (f"<article>{H}{p(LONG)}{'<div class=%r>' % name if inside else ''}{p(SAYS) if inside else ''}{'</div>' if inside else ''}</article>{'' if inside else '<div class=%r>' % name + p(SAYS) + '</div>'}", f"{B} {L}") for name in ("user-thread comments", "discussion", "responses", "talkback", "reader-feedback") for inside in (0, 1)},
    "comments by reply links": (f"<div class=c>{H}{p(LONG)}</div><div class=z><h3>3 responses</h3>" + "".join(f"<div class=y><span>Name {i}</span><div>{t}</div><div><a href=#>Reply</a></div></div>" for i, t in enumerate(SAYS * 3)) + "</div>", f"{B} {L}"),
    "comments by times": (f"<article>{H}{p(LONG)}<ul>" + "".join(f"<li class=y><div>Name {i}, {i + 1} hours ago</div><p>{t}</p></li>" for i, t in enumerate(SAYS * 3)) + "</ul></article>", f"{B} {L}"),
    "sections with times are the article": (f"<article>{H}" + "".join(f"<section class=e><h3>Entry {i}</h3><div>10:{i}0</div>{p(LONG)}</section>" for i in (1, 2)) + "</article>", f"{B} Entry 1 10:10 {L} Entry 2 10:20 {L}"),
    "login box": (f"<div class='login'><p>Sign in, or register, to read on.</p></div><div class=c>{H}{p(LONG)}</div>", f"{B} {L}"),
    "pagination": (f"<div class=c>{H}{p(LONG)}<div class='pagination'><a href=2>2</a> <a href=3>3</a></div></div>", f"{B} {L}"),
}


def common(got: str, want: str) -> tuple[int, int, int]:
    a, b = Counter(got.split()), Counter(want.split())
    return sum((a & b).values()), sum(a.values()), sum(b.values())


@pytest.mark.parametrize("shape", sorted(PAGES))
def test_article_of_the_shape(shape):
    page, text = PAGES[shape]
    assert html_text.main_text(page) == text


def test_recall_and_precision_of_words():
    both, got, want = map(sum, zip(*(common(html_text.main_text(page), text) for page, text in PAGES.values()), strict=True))
    print(f"{len(PAGES)} shapes, recall {both / want:.3f}, precision {both / got:.3f}")
    assert len(PAGES) >= 40 and both / want >= 0.97 and both / got >= 0.97


def test_very_long_pages_are_read_whole():
    page = f"<body><div class=c>{H}{p(LONG * 5000)}</div>{'<div class=comment>'}{p(SAYS * 3000)}</div></body>"
    assert html_text.main_text(page) == f"{B} {' '.join(LONG * 5000)}"
