"""Pages written by hand, none in a layout of the composer or of the test tables, with the text that should come out."""

P = "The council met on Tuesday to discuss the new bridge, and most members spoke in favour of it."
Q = "Work is expected to start in spring, once the river has been surveyed; the cost is shared by three towns."
R = "Nobody knows yet what happens to the ferry, which has carried people across for two hundred years."

NEWS = f"""<!doctype html>
<html lang=en class="no-js"><head><title>Bridge approved | The Daily Post</title>
<script>window.dataLayer=window.dataLayer||[];for(var i=0;i<3;i++){{dataLayer.push(i)}}</script>
<style>.a>.b::after{{content:"<p>"}}</style></head>
<body class="single post-template"><div id="skip"><a href="#c">Skip to content</a></div>
<header class="site-header"><div class="logo"><a href="/">The Daily Post</a></div>
<nav class="main-navigation"><ul><li><a href="/n">News</a><li><a href="/s">Sport</a><li><a href="/w">Weather</a></ul></nav></header>
<main id="c"><article class="story"><h1>Bridge approved after long debate</h1>
<p>{P}</p><p>{Q}<p>{R}
<aside class="related"><h3>Related</h3><ul><li><a href="/1">Ferry on sale</a></li><li><a href="/2">River rises</a></li></ul></aside>
<blockquote>We will build it, <em>whatever</em> the weather.</blockquote></article></main>
<section id="comments" class="comments"><h2>2 comments</h2><div class="comment"><b>anna</b><p>Great news for all of us here!</p></div></section>
<footer><p>&copy; 2024 The Daily Post. All rights reserved.</p></footer></body></html>"""

BLOG = f"""<html><body><div id="wrap"><div class="header"><h2><a href="/">My garden diary</a></h2></div>
<div class="navbar"><a href=/a>Home</a> | <a href=/b>About</a> | <a href=/c>Archive</a></div>
<div class="content"><div class="post"><h1>What I planted in May</h1>
<p title=it's>I don't often write about beans, but {P.lower()}</p>
<p>{Q} <a href="/more">More about it</a> is on another page, with pictures of every bed.</p>
<ul><li>Beans &amp; peas<li>Three kinds of lettuce</ul></div></div>
<div class="sidebar"><h3>Tags</h3><a href=/t1>beans</a> <a href=/t2>soil</a></div>
<div class="cookie-notice">We use cookies to make this site better. <button>Fine</button></div>
<div class="footer">Powered by nothing at all</div></div></body></html>"""

DOCS = f"""<!DOCTYPE html><html><head><script type="module">if(a<b&&c>d){{x()}}</script></head><body>
<nav aria-label=main><a href=/>Docs</a><a href=/api>API</a><a href=/faq>FAQ</a></nav>
<main><h1>Reading files</h1><p>{P}</p><h2 id=ex>Example</h2><pre><code>for line in open(path):
    if len(line) &lt; 80: print(line)</code></pre><p>{R}</p></main>
<footer><a href=/l>Licence</a> <a href=/p>Privacy</a></footer></body></html>"""

TABLE = f"""<HTML><BODY BGCOLOR=white><TABLE WIDTH=100%><TR><TD CLASS=menu><A HREF=1>Home</A><BR><A HREF=2>Links</A><BR><A HREF=3>Guestbook</A>
<TD><H1>The old mill</H1><P>{P}<P>{Q}<P>{R}
<TD CLASS=ads><A HREF=x>Buy one now</A></TABLE><HR><DIV CLASS=footer>Last changed in 1998</DIV></BODY></HTML>"""

GOLDEN = {
    "news": (NEWS, ["Bridge approved after long debate", P, Q, R, "We will build it, whatever the weather."]),
    "blog": (BLOG, ["What I planted in May", f"I don't often write about beans, but {P.lower()}", f"{Q} More about it is on another page, with pictures of every bed.", "Beans & peas", "Three kinds of lettuce"]),
    "docs": (DOCS, ["Reading files", P, "Example", "for line in open(path): if len(line) < 80: print(line)", R]),
    "table": (TABLE, ["The old mill", P, Q, R]),
}


# ---- layouts that say little of what their parts are

MENU = "<ul><li><a href=/a>Home</a><li><a href=/b>News of the day</a><li><a href=/c>About us</a></ul>"
FOOT = "<p>&copy; 2024 The Daily Post. All rights reserved.</p>"
TEXT = f"<h1>Bridge approved</h1><p>{P}</p><p>{Q}</p><p>{R}</p>"
WANT = ["Bridge approved", P, Q, R]
SECTIONS = TEXT.replace("<p>", "<div>").replace("</p>", "</div>")

SPARSE = {
    "divs alone": (f"<body><div>{MENU}</div><div>{SECTIONS}</div><div>{FOOT}</div></body>", WANT),
    "divs around paragraphs": (f"<body><div>{MENU}</div><div>{TEXT}</div><div>{FOOT}</div></body>", WANT),
    "section without a name": (f"<body><div>{MENU}</div><section>{TEXT}</section><footer>{FOOT}</footer></body>", WANT),
    "itemprop": (f"<body><nav>{MENU}</nav><div itemprop=articleBody>{TEXT}</div><footer>{FOOT}</footer></body>", WANT),
    "form around the page": (f"<body><form id=aspnetForm method=post><div id=menu>{MENU}</div><div id=content>{TEXT}</div><div id=footer>{FOOT}</div></form></body>", WANT),
    "forum": (f"<body><div class=nav>{MENU}</div><h1>Bridge approved</h1><div class=message><div class=author>anna</div><p>{P}</p></div><div class=message><div class=author>bert</div><p>{Q}</p></div><div class=footer>{FOOT}</div></body>", WANT[:3]),
    "linked paragraph": (f"<body><nav>{MENU}</nav><article><h1>Bridge approved</h1><p><a href=/x>{P}</a></p><p>{Q}</p></article><footer>{FOOT}</footer></body>", WANT[:3]),
    "breaks": (f"<body><div class=nav>{MENU}</div><div class=content><h1>Bridge approved</h1>{P}<br><br>{Q}<br><br>{R}</div><div class=footer>{FOOT}</div></body>", ["Bridge approved", f"{P} {Q} {R}"]),
    "paragraphs alone": (f"<body>{TEXT}{FOOT}</body>", WANT),
    "hashed names": (f"<body><div class=css-1x2y><div class=css-9a>{MENU}</div></div><div class=css-77f>{TEXT}</div><div class=css-0b>{FOOT}</div></body>", WANT),
    "open svg": (f"<body><nav>{MENU}</nav><article><h1>Bridge approved</h1><svg><path><p>{P}</p><p>{Q}</p></article><footer>{FOOT}</footer></body>", WANT[:3]),
    "hidden blocks": (f"<body style='visibility:hidden'><nav>{MENU}</nav><article><h1>Bridge approved</h1><p>{P}</p><div hidden><p>{R}</p></div><p style='color:red; display: none'>{R}</p><p>{Q}</p></article></body>", WANT[:3]),
    "chinese": ("<body><nav><a href=/>首页</a></nav><article><h1>大桥获批</h1><p>市议会周二开会讨论新桥，大多数议员表示赞成，工程将于春天开始。</p></article></body>", ["大桥获批", "市议会周二开会讨论新桥，大多数议员表示赞成，工程将于春天开始。"]),
}
