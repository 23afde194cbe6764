"""Labelled pages that train the content model.

An element marked data-main="1" is main text with all it holds, up to elements marked
data-main="0".  The marks are no features.
"""

from __future__ import annotations

_LONG = (
    "The council met on Tuesday evening to discuss the new bridge, which has been closed since the storm in spring. "
    "Several members asked how long the repairs would take, and whether the old road could carry the traffic. "
    "No decision was made before midnight."
)
_MID = "Work on the second part of the line begins next week. It should be done before winter."
_SHORT = "Rain stopped play."
_HEAD = '<head><title>News of the day</title><meta charset="utf-8"><style>p{margin:0}</style><script>var a=1;</script></head>'
_NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li></ul></nav>'
_FOOT = "<footer>&copy; 2020 Example Press. All rights reserved. <a href='/terms'>Terms</a></footer>"
_ASIDE = '<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/a">A long headline about the harbour</a></li><li><a href="/b">Another one</a></li></ul></aside>'
_COMMENTS = (
    '<section id="comments" class="comments"><h2>3 comments</h2><div class="comment"><p>I drove over that bridge every day for years. It was never safe.</p></div>'
    '<div class="comment"><p>Well said, I agree with every word of this.</p></div><form><textarea>Your reply</textarea><button>Send</button></form></section>'
)
_COOKIE = '<div class="cookie-notice" role="dialog"><p>We use cookies to improve this site. Read our policy. <a href="/p">Accept</a></p></div>'
_AD = '<div class="ad">Buy two lamps and get one free. Order today and save.</div>'
_FORM = '<form class="signup"><label>Email</label><input name="e"><p>Sign up for our weekly letter. We never share your address.</p><button>Join</button></form>'

PAGES = (
    # a plain article element between menu, advert and footer
    f'<!DOCTYPE html><html>{_HEAD}<body>{_NAV}{_AD}<article data-main="1"><h1>Bridge stays closed</h1><p><b>Bridge stays closed<br><p>{_LONG}</p><p>{_MID}</p><p>{_SHORT}</p></article>{_FOOT}</body></html>',
    f'<html>{_HEAD}<body>{_NAV}<!-- ad --><div class="ad">{_MID}</div><article data-main="1"><h1>Short</h1><p>{_SHORT}</p><p>Yes.</p><p><b>{_MID}<br><p>{_SHORT}</p></article><footer>&copy; a.example.com &middot; {_SHORT} {_SHORT}</footer>',
    # main with a sidebar, comments inside the article
    f'<html>{_HEAD}<body><header><h1>Example Press</h1>{_NAV}</header><main><article data-main="1"><header><h1>Line opens</h1></header><p>{_LONG}</p><ul><li>First stop: harbour.</li><li>Second stop: market.</li></ul><blockquote><p>{_MID}</p></blockquote>'
    f'<div class="share" data-main="0"><a href="#">Share</a> <a href="#">Tweet</a></div><p>{_LONG}</p></article>{_COMMENTS}</main>{_ASIDE}{_FOOT}</body></html>',
    # divs only, named by class
    f'<html>{_HEAD}<body><div id="header"><a href="/">Example</a><p>{_SHORT}</p></div><div class="menu"><ul><li><a href="/">Home</a></li><li><a href="/x">About us</a></li></ul></div><div class="wrapper"><div class="post-content" data-main="1"><h2>Quiet week</h2><p>{_LONG}</p><p>{_MID}</p><table><tr><td>Monday</td><td>Sunny</td></tr></table></div>'
    f'<div class="sidebar"><div class="widget"><h3>About</h3><p>{_MID}</p></div></div></div><div id="footer"><p>Contact us at the office. {_SHORT}</p></div>{_COOKIE}</body></html>',
    # divs without names: long text is content, links are not
    f'<html>{_HEAD}<body><div><a href="/">Home</a> <a href="/a">News</a> <a href="/b">Contact</a></div><div data-main="1"><h1>Harbour opens</h1><p>{_LONG}</p><p>{_LONG}</p><p>{_MID}</p></div><div><a href="/1">Next</a> <a href="/2">Previous</a></div>{_FOOT}</body></html>',
    f'<html>{_HEAD}<body>{_COOKIE}{_NAV}<section class="content"><div data-main="1"><h1>Letter</h1><p>{_MID}</p><p>{_LONG}</p><pre>a = 1</pre></div>{_FORM}</section>{_COMMENTS}{_FOOT}</body></html>',
    f'<html>{_HEAD}<body><div class="banner"><p>{_MID}</p></div><header><p>{_SHORT}</p>{_NAV}</header><article data-main="1"><h1>On foot</h1><p>{_LONG}</p><figure><figcaption>The old path in March.</figcaption></figure><h2>Day two</h2><p>{_MID}</p><aside class="related" data-main="0"><p>See also: <a href="/z">the long way home</a></p></aside>'
    f'<div class="advert" data-main="0"><p>{_MID}</p></div><p>{_LONG}</p><section class="comments" data-main="0"><p>{_LONG}</p><p>{_SHORT}</p></section></article>{_ASIDE}{_FOOT}</body></html>',
    f'<html>{_HEAD}<body><main data-main="1"><h1>Notes</h1><p>{_LONG}</p><p>See <a href="/q">this page</a> for more. {_MID}</p><ol><li>{_MID}</li><li>{_SHORT}</li></ol></main><div class="newsletter"><p>{_MID}</p></div><div role="alert" class="notice"><p>{_LONG}</p></div>{_FOOT}</body></html>',
    # articles of a few words
    f'<html>{_HEAD}<body>{_NAV}{_AD}<article data-main="1"><h1>{_SHORT}</h1><p><b>{_SHORT}<br><p>Play starts again at noon.</p></article><footer>&copy; b.example.com &middot; {_MID} {_SHORT}</footer></body></html>',
    f'<html>{_HEAD}<body>{_NAV}<div class="ad">{_SHORT}</div><article data-main="1"><h1>No trains today because of the wind</h1><p>No trains today because of the wind on the coast.</p></article>{_FOOT}',
    f'<html>{_HEAD}<body>{_NAV}<article data-main="1"><p>Closed</p></article>{_FOOT}</body></html>',
    f'<html>{_HEAD}<body>{_NAV}{_AD}<article data-main="1"><h1>Lost</h1></article><footer>&copy; 1999</footer></body></html>',
    # content in named elements, with parts inside that are none
    f'<html>{_HEAD}<body>{_NAV}<div id="main-content" data-main="1"><h2>The mill</h2><p>{_MID}</p><p>{_LONG}</p><p>{_SHORT}</p><table><tr><th>Year</th><td>1901</td></tr></table></div><div id="sidebar"><p>{_SHORT}</p></div>{_FOOT}</body></html>',
    f'<html>{_HEAD}<body><div class="site-header"><p>{_SHORT}</p></div><div class="entry-content" data-main="1"><h1>First snow</h1><p>{_SHORT}</p><p>{_LONG}</p><div class="sharing" data-main="0"><a href="#">Share this</a></div><p>{_MID}</p></div><div class="comments-area"><p>{_LONG}</p></div><div class="promo"><p>{_MID}</p></div></body></html>',
    f'<html>{_HEAD}<body><div role="main" data-main="1"><div class="story"><h1>Two goals</h1><p>{_MID}</p><p>{_LONG}</p></div></div><div role="navigation"><a href="/">Home</a></div><div class="popup"><p>{_MID}</p></div>{_FOOT}</body></html>',
    f'<html>{_HEAD}<body>{_NAV}<article data-main="1"><h1>The choir</h1><p>{_MID}</p><div class="ad" data-main="0">{_MID}</div><p>{_LONG}</p><div class="advertisement" data-main="0"><p>{_LONG}</p></div><div class="newsletter-signup" data-main="0"><p>{_SHORT}</p><form><input><button>Go</button></form></div><p>{_SHORT}</p></article>{_FOOT}</body></html>',
    f'<html>{_HEAD}<body>{_NAV}<article data-main="1"><h1>Late bus</h1><p>{_LONG}</p><div id="comments" data-main="0"><h3>Comments</h3><div class="comment-body"><p>{_LONG}</p></div><div class="comment-body"><p>{_SHORT}</p></div></div></article><div class="cookie-bar"><p>{_LONG}</p></div>{_FOOT}</body></html>',
    f'<html>{_HEAD}<body>{_NAV}<main data-main="1"><section><h2>Part one</h2><p>{_LONG}</p></section><section><h2>Part two</h2><p>{_MID}</p><form class="login" data-main="0"><label>Name</label><p>{_SHORT}</p></form></section><footer data-main="0"><a href="/x">More by this author</a></footer></main><section class="comments"><p>{_MID}</p></section>{_FOOT}</body></html>',
    f'<html>{_HEAD}<body><div><div><a href="/">Start</a></div><div data-main="1"><h1>Old maps</h1><div><p>{_LONG}</p></div><p>{_MID}</p></div></div><aside class="widget"><p>{_MID}</p></aside><footer><p>{_SHORT}</p></footer></body></html>',
    f'<html>{_HEAD}<body>{_NAV}{_COOKIE}<div class="page"><div class="article-body" data-main="1"><h1>Quince</h1><p>{_MID}</p><ul><li>Two quinces.</li><li>Sugar.</li></ul><p>{_LONG}</p></div><ul class="related-links"><li><a href="/1">Apples in autumn</a></li></ul></div><div class="alert"><p>{_MID}</p></div><section class="responses"><article class="comment"><p>{_LONG}</p></article></section>{_FOOT}</body></html>',
    f'<html>{_HEAD}<body><header><p>{_MID}</p></header><article data-main="1"><h1>Tide tables</h1><p>{_SHORT}</p><section><h2>Spring</h2><p>{_LONG}</p></section><aside data-main="0"><p>{_SHORT}</p></aside><section><h2>Autumn</h2><p>{_MID}</p></section></article><form><p>{_MID}</p><button>Send</button></form><div class="modal"><p>{_MID}</p></div>{_FOOT}',
    # only boilerplate
    f"<html>{_HEAD}<body>{_NAV}{_ASIDE}{_FORM}{_COOKIE}{_FOOT}</body></html>",
    f'<html>{_HEAD}<body><header class="site-header"><div><p>{_MID}</p></div></header><div role="main" data-main="1"><div><h1>Market day</h1><div><p>{_LONG}</p></div><div><p>{_SHORT}</p><p>{_MID}</p></div></div></div><aside><p>{_LONG}</p></aside><div class="comment-list"><ul><li><p>{_LONG}</p></li></ul></div><div hidden=""><p>{_MID}</p></div>{_FOOT}</body></html>',
    # pages that are little more than their article
    f'<article data-main="1"><p>{_SHORT}</p></article>',
    f'<html>{_HEAD}<body><article data-main="1"><p>{_MID}</p></article></body></html>',
    f'<p data-main="1">{_LONG}</p>',
    f'<p data-main="1">{_SHORT}</p>',
    f'<html data-main="1">{_LONG}</html>',
    f'<html data-main="1">{_SHORT}</html>',
    '<html data-main="1">a line of words without a full stop</html>',
    f'<html>{_HEAD}<body data-main="1">{_LONG}</body></html>',
    f'<div data-main="1"><h1>Rain</h1><p>{_SHORT}</p></div>',
    # paragraphs that are mostly links, and lists of sources, inside an article
    f'<html>{_HEAD}<body>{_NAV}<article data-main="1"><h1>Sources</h1><p><a href="/1">The report of the harbour office</a> says so.</p><p>{_LONG}</p><p>See <a href="/2">the second report on the bridge</a>.</p></article>{_FOOT}</body></html>',
    f'<html>{_HEAD}<body>{_NAV}<article data-main="1"><p><a href="/1">The whole council</a> met.</p><p>{_LONG}</p><p><a href="/2">The minutes of the last meeting</a></p><ul><li><a href="/3">A map of the old road</a></li></ul></article>{_ASIDE}{_FOOT}</body></html>',
    f'<article data-main="1"><p><a href="/1">Rain in the north</a></p><p>{_LONG}</p><p><a href="/2">Sun in the south</a></p></article>',
    # text inside named parts of an article
    f'<html>{_HEAD}<body>{_NAV}<article data-main="1"><div class="more"><p>{_LONG}</p></div></article>{_FOOT}</body></html>',
    f'<html>{_HEAD}<body>{_NAV}<article data-main="1"><h1>Ferry</h1><div class="lead">{_MID}</div><div class="more">{_LONG}</div><div class="share" data-main="0"><a href="#">Share</a></div></article>{_COMMENTS}{_FOOT}</body></html>',
    # older markup: tables, font and centre
    f'<html>{_HEAD}<body><table><tr><td class="menu"><a href="/">Home</a><br><a href="/a">About</a></td><td data-main="1"><h2>Annual fair</h2><font>{_LONG}</font><p>{_MID}</td></tr></table><center class="footer">&copy; 1998</center></body></html>',
    f'<html>{_HEAD}<body><div id="nav"><a href="/">Home</a> | <a href="/a">About</a></div><center><h1 data-main="1">Old mill</h1></center><p data-main="1">{_LONG}<p data-main="1">{_MID}<div id="copyright">&copy; 1999</div></body></html>',
    # definition lists, code, quotes
    f'<html>{_HEAD}<body>{_NAV}<main data-main="1"><h1>Terms</h1><dl><dt>Ebb</dt><dd>{_MID}</dd><dt>Flow</dt><dd>{_SHORT}</dd></dl><pre>x = 1</pre><blockquote>{_MID}</blockquote></main>{_FORM}{_FOOT}</body></html>',
    f'<html>{_HEAD}<body>{_COOKIE}<div class="site"><div class="topbar"><a href="/">Home</a></div><section class="story-body" data-main="1"><h1>Salt</h1><p>{_MID}</p><p>{_MID}</p></section><section class="recommended"><h2>More</h2><ul><li><a href="/1">Pepper from afar</a></li></ul></section></div>{_FOOT}</body></html>',
    f"<html>{_HEAD}<body>{_NAV}{_FOOT}</body></html>",
    f"{_NAV}{_COOKIE}{_AD}",
    f"{_COMMENTS}",
)
