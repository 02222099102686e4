"""Labelled pages for training the extractor: a seeded generator of page layouts, each text marked as article or not."""

from __future__ import annotations

import random

#: What adverts, notices and the like say, and articles seldom.
SAID = [
    "buy now", "click here", "order today", "best offers", "special offer", "sponsored", "advertisement", "free trial", "learn more", "sign up", "subscribe", "newsletter", "log in", "cookies", "accept all", "privacy policy", "terms of use",
    "all rights reserved", "share this", "follow us", "leave a comment", "read more", "related articles", "jetzt kaufen", "hier klicken", "newsletter abonnieren", "anzeige", "alle rechte vorbehalten", "acheter maintenant", "cliquez ici", "abonnez-vous", "publicité",
    "tous droits réservés", "compra ahora", "haz clic", "suscríbete", "publicidad", "todos los derechos reservados",
]
SYLLABLES = "ka lo mi ren tus vel dor fin gra hel jo lin mar nos pe qua ris sol ten ul".split()


def _words(r: random.Random, lo: int, hi: int) -> str:
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi)))


def _sentences(r: random.Random, lo: int, hi: int) -> str:
    return " ".join(_words(r, 5, 18).capitalize() + r.choice([".", ".", ".", "?", "!"]) for _ in range(r.randint(lo, hi)))


def _links(r: random.Random, n: int, tag: str = "li") -> str:
    return "".join(f'<{tag}><a href="/{i}">{_words(r, 1, 3)}</a></{tag}>' for i in range(n))


#: How often a part has a name that says nothing, and a part of an article one that says something else.
ODD, MISLEADING = 0.08, 0.08


def _name(r: random.Random, names: list[str]) -> str:
    """One of the names or, now and then, one that no list has."""
    return r.choice(names) if r.random() >= ODD else f"{_words(r, 1, 1)}-{r.randint(1, 99)}"


def _mark(r: random.Random, names: list[str], always: bool = True) -> str:
    kind = r.random() * (0.9 if always else 1)
    name = _name(r, names)
    name = r.choice([name, name + r.choice(["-1", "-box", "_main", "-wrapper", " clearfix"])])
    return f' class="{name}"' if kind < 0.5 else f' id="{name}"' if kind < 0.8 else f' class="{name}" id="{r.choice(names)}"' if kind < 0.9 else ""


def _inner(r: random.Random) -> str:
    """Parts of an article, with the markup that texts have."""
    parts = [f"<h1>{_words(r, 1, 9)}</h1>"] if r.random() < 0.85 else []
    for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 12])):
        k = r.random()
        text = _sentences(r, 1, 6) if k < 0.8 else _words(r, 1, 6)
        if r.random() < 0.04:  # an article may speak of such things
            text = f"{_sentences(r, 1, 3)} {_words(r, 2, 6).capitalize()} {r.choice(SAID)} {_words(r, 2, 6)}. {_sentences(r, 1, 2)}"
        if r.random() < 0.3:
            text += f" <{(t := r.choice(['b', 'i', 'em', 'strong', 'code', 'span']))}>{_words(r, 1, 5)}</{t}> " + _words(r, 0, 8)
        if r.random() < 0.2:
            text += f' <a href="#">{_words(r, 1, 3)}</a>.'
        if r.random() < 0.1:
            text = f"<b>{text}<br>"  # left open, as pages do
        kind = r.random()
        if kind < 0.75:
            parts.append(f"<p>{text}" + "</p>" * (r.random() < 0.9))
        elif kind < 0.82:
            parts.append(f"<h2>{_words(r, 1, 6)}</h2>")
        elif kind < 0.88:
            parts.append("<ul>" + "".join(f"<li>{_words(r, 2, 12)}</li>" for _ in range(r.randint(1, 6))) + "</ul>")
        elif kind < 0.91:
            parts.append(f"<blockquote>{text}</blockquote>")
        elif kind < 0.94:
            parts.append("<table>" + "".join(f"<tr><td>{_words(r, 1, 4)}</td><td>{r.randint(0, 99)}</td></tr>" for _ in range(r.randint(1, 5))) + "</table>")
        elif kind < 0.97:
            parts.append(f"<figure><figcaption>{_words(r, 3, 12)}</figcaption></figure>")
        else:
            parts.append(f"<div>{text}</div>")
        if r.random() < MISLEADING:
            own = r.choice(["more", "story-tags", "share-quote", "post-meta", "side-note", "header-text", "related-facts", "top-banner"])
            parts[-1] = f"<div {r.choice(['class', 'id'])}=\"{own}\">{parts[-1]}</div>"
    for kind in ("ad", "share", "related", "aside", "comments", "notice", "form", "nav", "footer"):
        if r.random() < 0.06:
            parts.insert(r.randint(0, len(parts)), f"<x-noise>{_noise(r, kind)}</x-noise>")
    if not parts or not any("<p" in x for x in parts):
        parts.append(f"<p>{_sentences(r, 1, 3)}</p>")
    return "".join(parts)


def _saying(r: random.Random) -> str:
    """A line that an advert or a notice says."""
    return " ".join(filter(None, (_words(r, 0, 4), r.choice(SAID), _words(r, 0, 5)))).capitalize() + r.choice([".", ".", "!", ""])


def _noise(r: random.Random, kind: str) -> str:
    text = _sentences(r, 1, 3)
    if kind in ("ad", "notice", "aside", "footer", "form", "related") and r.random() < 0.5:
        text = " ".join(r.sample([_saying(r), _saying(r), _words(r, 1, 6) + "."], r.randint(1, 3))) if r.random() < 0.8 else _saying(r)
        if kind in ("ad", "notice") and r.random() < 0.5:  # with no name, or one that says nothing
            name = r.choice(["", f' class="{_words(r, 1, 1)}-{r.randint(1, 99)}"', ' class="zone"', ' class="box"', ' id="block"'])
            return r.choice([f"<div{name}>{text}</div>", f"<div{name}><p>{text}</p></div>", f"<section{name}>{text}</section>", f"<p{name}>{text}</p>"])
    if kind == "nav":
        body = f"<ul>{_links(r, r.randint(2, 9))}</ul>" if r.random() < 0.7 else _links(r, r.randint(2, 7), "span")
        return f"<nav{_mark(r, ['menu', 'nav', 'top'])}>{body}</nav>" if r.random() < 0.6 else f"<div{_mark(r, ['menu', 'navigation', 'navbar', 'breadcrumb', 'breadcrumbs'])}>{body}</div>"
    if kind == "header":
        body = r.choice([f"<a href='/'>{_words(r, 1, 3)}</a>", f"<h1>{_words(r, 1, 3)}</h1>", f"<p>{_words(r, 2, 7)}</p>", f"<div>{_words(r, 1, 4)}</div>"])
        return f"<header>{body}</header>" if r.random() < 0.7 else f'<div{_mark(r, ["header", "site-header", "masthead", "banner", "logo"])}>{body}</div>'
    if kind == "footer":
        body = r.choice([f"&copy; {_words(r, 1, 3)} &middot; {text}", f"<p>&copy; {_words(r, 2, 8)}</p>", f"<ul>{_links(r, 4)}</ul>", f"<div>{text}</div>"])
        return f"<footer>{body}</footer>" if r.random() < 0.7 else f'<div{_mark(r, ["footer", "site-footer", "copyright", "bottom"])}>{body}</div>'
    if kind == "aside":
        body = r.choice([f"<h3>{_words(r, 1, 3)}</h3><ul>{_links(r, r.randint(2, 8))}</ul>", f"<p>{text}</p>", f"<div><p>{text}</p></div>"])
        return f"<aside>{body}</aside>" if r.random() < 0.6 else f'<div{_mark(r, ["sidebar", "side", "widget", "rail"])}>{body}</div>'
    if kind == "ad":
        return f'<{(t := r.choice(["div", "div", "section", "ins", "p"]))} class="{_name(r, ["ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "ad-box", "ad-slot"])}">{r.choice([text, f"<p>{text}</p>", f"<a href=#>{_words(r, 2, 6)}</a>"])}</{t}>'
    if kind == "notice":
        return f'<div{_mark(r, ["cookie", "cookie-notice", "notice", "consent", "gdpr", "alert", "newsletter", "popup", "modal"])}><p>{text}</p><button>{_words(r, 1, 2)}</button></div>'
    if kind == "form":
        return f"<form action=/x><label>{_words(r, 1, 3)}</label><input name=q><select><option>{_words(r, 1, 2)}</option></select><button>{_words(r, 1, 2)}</button>{r.choice(['', f'<p>{text}</p>'])}</form>"
    if kind == "comments":
        each = "".join(f'<{(t := r.choice(["div", "li", "article"]))} class="{_name(r, ["comment", "reply", "comment-body"])}"><b>{_words(r, 1, 2)}</b><p>{_sentences(r, 1, 4)}</p></{t}>' for _ in range(r.randint(1, 5)))
        return f'<{(t := r.choice(["section", "div", "ol"]))} {r.choice(["class", "id"])}="{_name(r, ["comments", "comment-list", "disqus", "responses", "discussion", "replies"])}">{r.choice(["", f"<h2>{_words(r, 1, 3)}</h2>"])}{each}</{t}>'
    if kind == "share":
        return f'<div class="{_name(r, ["share", "social", "tags", "meta", "byline", "toolbar"])}">{_links(r, r.randint(1, 5), "span")}</div>'
    return f'<div class="{_name(r, ["related", "recommended", "more", "related-posts", "popular"])}"><h3>{_words(r, 1, 3)}</h3><ul>{_links(r, r.randint(2, 7))}</ul></div>'


def pages(n: int, seed: int = 17) -> list[str]:
    """n pages; the subtrees of article content are between <x-content> tags, which the trainer reads and takes out."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        inner = _inner(r)
        if r.random() < 0.06:  # a page of an article and nothing else
            short = r.choice([inner, f"<p>{_words(r, 1, 4).capitalize()}.</p>", f"<p>{_sentences(r, 1, 2)}</p>", f"<h1>{_words(r, 1, 4)}</h1><p>{_words(r, 2, 9)}.</p>", f"<div>{_words(r, 2, 6)}.</div>"])
            body = f"<x-content>{short}</x-content>" if r.random() < 0.7 else f"<div><x-content>{short}</x-content></div>"
            out.append(f"<html><body>{body}</body></html>")
            continue
        kind = r.random()
        if kind < 0.45:
            body = f"<article{_mark(r, ['post', 'entry', 'story']) if r.random() < 0.4 else ''}>{inner}</article>"
        elif kind < 0.6:
            body = f"<main{_mark(r, ['main', 'content']) if r.random() < 0.5 else ''}>{inner}</main>"
        else:
            body = f"<div{_mark(r, ['content', 'main-content', 'article-body', 'post-content', 'entry-content', 'story', 'text', 'article', 'post', 'body'], False)}>{inner}</div>"
        bare = r.random()
        body = f"<x-content>{inner if bare < 0.12 else body}</x-content>"
        if bare < 0.04:
            body = f"<table><tr><td>{body}</td>{'<td>' + _noise(r, 'aside') + '</td>' if r.random() < 0.5 else ''}</tr></table>"
        if r.random() < 0.3:
            body = f"<div{_mark(r, ['wrapper', 'container', 'page', 'layout', 'row', 'col'], False)}>{body}{_noise(r, r.choice(['aside', 'related', 'comments', 'ad'])) if r.random() < 0.5 else ''}</div>"
        if r.random() < 0.2 and "<main" not in body:
            body = f"<main>{body}{_noise(r, r.choice(['aside', 'related', 'comments', 'ad', 'share'])) if r.random() < 0.5 else ''}</main>"
        before = [_noise(r, k) for k in ("header", "nav", "ad", "notice", "form") if r.random() < 0.45]
        after = [_noise(r, k) for k in ("aside", "related", "comments", "ad", "form", "share", "footer", "notice") if r.random() < (0.8 if k == "footer" else 0.3)]
        r.shuffle(before)
        out.append(f"<!DOCTYPE html><html><head><title>{_words(r, 2, 8)}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>")
    return out
