"""Labelled pages for the block labeller: made by a grammar of page layouts, with a fixed seed.

Each text begins with MAIN or OTHER, from which the labels are read after
parsing. Words are random syllables, so the labeller can't learn a vocabulary.
Articles carry class words that elsewhere name noise ("popular", "print",
"alert-levels"), on single blocks and on parts of several, and noise carries
such words too, so that one word alone decides nothing.
"""

from __future__ import annotations

import random

from .html_blocks import FRAME, GROUPS, MAYBE, TAKEN_BACK

MAIN, OTHER = "\x01", "\x02"
#: Words that an article's own elements may have: those that only may name noise, and others beside a word of their own.
ODD = sorted(" ".join(MAYBE.values()).split())
NAMING = sorted(" ".join(GROUPS[g] for g in ("menu", "comment", "side", "foot", "notice", "share", "form", "meta")).split())
SYLLABLES = "ka lo mi tu re san vor pel dic ent ari ost un be qua zil fra ment ing ter".split()


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def phrase(self, least: int, most: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(least, most))).capitalize()

    def sentence(self) -> str:
        return self.phrase(1, 18) + self.r.choice([".", ".", ".", "?", "!", ""])

    def prose(self, least: int, most: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(least, most)))

    def attribute(self, names: str, chance: float = 0.9) -> str:
        if self.r.random() > chance:
            return ""
        name = self.r.choice(names.split())
        name = self.r.choice([name, f"{name}-{self.r.randint(1, 9)}", f"{self.word()} {name}", f"{name}-{self.r.choice(sorted(FRAME))}", f"{name}_box", f"js-{name}"])
        return f' {self.r.choice(["class", "class", "id"])}="{name}"'

    def odd(self, chance: float) -> str:
        """A misleading class of a part of the article."""
        r = self.r
        if r.random() > chance:
            return ""
        name = r.choice([r.choice(ODD), r.choice(ODD), f"{r.choice(NAMING)}-{self.word()}", f"{self.word()}-{r.choice(ODD)}", f"{r.choice(NAMING)}-{r.choice(sorted(TAKEN_BACK))}", f"{r.choice(ODD)}-{r.choice(sorted(FRAME))}", self.word()])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.8:
            out.append(f"<h1>{MAIN}{self.phrase(1, 12)}</h1>")
        for _ in range(r.randint(1, 12)):
            kind = r.random()
            if kind < 0.6:
                text = self.prose(1, r.choice([1, 1, 3, 8]))
                if r.random() < 0.3:
                    text = text.replace(" ", f' <a href="/{self.word()}">{self.word()}</a> ', 1)
                a = self.odd(0.25)
                out.append(r.choice([f"<p{a}>{MAIN}{text}</p>", f"<p{a}>{MAIN}{text}</p>", f"<p{a}>{MAIN}{text}", f"<p><b>{MAIN}{text}<br>", f"<div{a}>{MAIN}{text}</div>"]))
            elif kind < 0.7:
                out.append(f"<h{(n := r.randint(2, 4))}{self.odd(0.2)}>{MAIN}{self.phrase(1, 8)}</h{n}>")
            elif kind < 0.8:
                tag = r.choice(["ul", "ol"])
                out.append(f"<{tag}{self.odd(0.2)}>" + "".join(f"<li>{MAIN}{self.phrase(1, 12)}</li>" for _ in range(r.randint(2, 6))) + f"</{tag}>")
            elif kind < 0.85:
                out.append(f"<blockquote><p>{MAIN}{self.prose(1, 3)}</p></blockquote>")
            elif kind < 0.9:
                out.append(f"<pre>{MAIN}{self.phrase(3, 20)}</pre>")
            elif kind < 0.94:
                out.append(f"<table{self.odd(0.2)}>" + "".join("<tr>" + "".join(f"<td>{MAIN}{self.phrase(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>")
            elif kind < 0.97:
                out.append(f'<figure><img src="x.png"><figcaption>{MAIN}{self.phrase(3, 12)}</figcaption></figure>')
            elif kind < 0.98:
                out.append(r.choice([f"<object data=x><p>{MAIN}{self.prose(1, 2)}</p></object>", f"<noscript><p>{MAIN}{self.prose(1, 2)}</p></noscript>", f"<canvas>{MAIN}{self.prose(1, 2)}</canvas>"]))
            else:
                tag = r.choice(["section", "div"])
                out.append(f"<{tag}{self.odd(0.5)}><h2>{MAIN}{self.phrase(1, 6)}</h2><p>{MAIN}{self.prose(1, 5)}</p></{tag}>")
            if r.random() < 0.12:
                out.append(self.noise(inside=True))
        return "".join(out)

    def menu(self) -> str:
        r = self.r
        links = [f'<a href="/{self.word()}">{OTHER}{self.phrase(1, 3)}</a>' for _ in range(r.randint(2, 9))]
        body = r.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>", " | ".join(links), "".join(f"<div>{x}</div>" for x in links)])
        return r.choice([f"<nav>{body}</nav>", f"<nav>{body}</nav>", f'<div{self.attribute("menu nav navbar navigation breadcrumb pagination", 1)}>{body}</div>', f'<ul{self.attribute("menu nav tabs", 1)}>' + "".join(f"<li>{x}</li>" for x in links) + "</ul>"])

    def paragraphs(self, least: int = 1, most: int = 4) -> str:
        r = self.r
        return "".join(r.choice([f"<p>{OTHER}{self.prose(1, 4)}</p>", f"<div>{OTHER}{self.prose(1, 3)}</div>", f"{OTHER}{self.prose(1, 2)}<br>"]) for _ in range(r.randint(least, most)))

    def advert(self) -> str:
        a = self.attribute("ad ads advert advertisement sponsored promo banner", 1)
        return self.r.choice([f"<div{a}>{OTHER}{self.prose(1, 4)}</div>", f"<div{a}>{self.paragraphs(1, 3)}</div>", f"<section{a}><h3>{OTHER}{self.phrase(1, 4)}</h3>{self.paragraphs(1, 2)}</section>", f"<p{a}>{OTHER}{self.prose(1, 2)}</p>"])

    def notice(self) -> str:
        a = self.attribute("cookie consent notice alert popup modal newsletter subscribe paywall", 1)
        return self.r.choice([f"<div{a}><p>{OTHER}{self.prose(1, 3)}</p></div>", f"<div{a}>{OTHER}{self.prose(1, 2)}</div>", f'<div role="alert">{OTHER}{self.prose(1, 2)}</div>', f"<section{a}>{self.paragraphs(1, 2)}</section>", f"<dialog>{self.paragraphs(1, 2)}</dialog>", f"<p{a}>{OTHER}{self.prose(1, 2)}</p>"])

    def form(self) -> str:
        a = self.attribute("search login signup", 0.3)
        return f'<form{a}><label>{OTHER}{self.phrase(1, 4)}</label><input name="q">' + self.r.choice(["", f"<p>{OTHER}{self.prose(1, 2)}</p>", f"<fieldset><legend>{OTHER}{self.phrase(1, 4)}</legend>{self.paragraphs(1, 2)}</fieldset>"]) + "</form>"

    def comments(self) -> str:
        r = self.r
        one = lambda: r.choice([f"<p>{OTHER}{self.prose(1, 6)}</p>", f'<div class="{r.choice(["comment", "reply"])}"><b>{OTHER}{self.word()}</b><p>{OTHER}{self.prose(1, 6)}</p></div>', f'<article class="comment"><p>{OTHER}{self.prose(1, 6)}</p></article>', f"<li>{OTHER}{self.prose(1, 5)}</li>"])
        tag = r.choice(["div", "section", "ol", "ul", "div"])
        return f'<{tag}{self.attribute("comments comment-list comments-area disqus responses reader-comments", 1)}>' + r.choice(["", f"<h3>{OTHER}{self.phrase(1, 3)}</h3>"]) + "".join(one() for _ in range(r.randint(1, 5))) + f"</{tag}>"

    def side(self) -> str:
        body = self.r.choice([self.paragraphs(1, 4), f"<h3>{OTHER}{self.phrase(1, 4)}</h3>" + self.paragraphs(1, 3), "<ul>" + "".join(f'<li><a href="/x">{OTHER}{self.phrase(2, 8)}</a></li>' for _ in range(4)) + "</ul>"])
        return self.r.choice([f"<aside>{body}</aside>", f"<aside>{body}</aside>", f'<div{self.attribute("sidebar related widget trending recommended", 1)}>{body}</div>', f'<section{self.attribute("related sidebar recommended", 1)}>{body}</section>'])

    def share(self) -> str:
        return f'<div{self.attribute("share social follow", 1)}>' + "".join(f'<a href="#">{OTHER}{self.word()}</a> ' for _ in range(3)) + "</div>"

    def button(self) -> str:
        return self.r.choice([f"<button>{OTHER}{self.phrase(1, 3)}</button>", f"<div><button{self.attribute('open close more', 0.5)}>{OTHER}{self.phrase(1, 3)}</button></div>"])

    def script_off(self) -> str:
        return f"<noscript>{OTHER}{self.prose(1, 2)}</noscript>"

    def weak(self) -> str:
        """A part that only a word of ODD names: lists of links, or short texts."""
        r = self.r
        a = f' class="{r.choice(ODD)}"'
        links = "".join(f'<li><a href="/x">{OTHER}{self.phrase(2, 8)}</a></li>' for _ in range(r.randint(2, 6)))
        return r.choice([f"<div{a}><h3>{OTHER}{self.phrase(1, 4)}</h3><ul>{links}</ul></div>", f"<ul{a}>{links}</ul>", f"<div{a}>{self.paragraphs(1, 2)}</div>" if r.random() < 0.5 else f"<div{a}><ul>{links}</ul></div>"])

    def hidden(self) -> str:
        return f'<div {self.r.choice(["hidden", "style=display:none", chr(34).join(["style=", "display: none", ""])])}>{self.paragraphs(1, 2)}</div>'

    def noise(self, inside: bool = False) -> str:
        kinds = [self.advert, self.notice, self.form, self.side, self.share, self.hidden, self.button] + ([] if inside else [self.menu, self.comments, self.weak, self.script_off])
        return self.r.choice(kinds)()

    def head(self) -> str:
        body = self.r.choice([f"<p>{OTHER}{self.phrase(1, 6)}</p>", f"<h1>{OTHER}{self.phrase(1, 4)}</h1><p>{OTHER}{self.phrase(2, 8)}</p>", f"{OTHER}{self.phrase(1, 5)}", f"<div>{OTHER}{self.phrase(1, 5)}</div>" + self.menu()])
        return self.r.choice([f"<header>{body}</header>", f"<header>{body}</header>", f'<div{self.attribute("header masthead topbar", 1)}>{body}</div>'])

    def foot(self) -> str:
        body = self.r.choice([f"&copy; {OTHER}{self.word()}.example &middot; {self.prose(1, 2)}", self.paragraphs(1, 3), f"<p>{OTHER}{self.prose(1, 3)}</p>" + self.menu()])
        return self.r.choice([f"<footer>{body}</footer>", f"<footer>{body}</footer>", f'<div{self.attribute("footer copyright colophon", 1)}>{body}</div>'])

    def page(self) -> str:
        r = self.r
        some = lambda chance, make: make() if r.random() < chance else ""
        article = self.article()
        if r.random() < 0.12:
            article = f"<header>{OTHER}{self.phrase(1, 6)}<h1>{MAIN}{self.phrase(2, 9)}</h1></header>" + article.replace("<h1>", "<h2>").replace("</h1>", "</h2>")
        if r.random() < 0.12:
            article += f"<footer>{OTHER}{self.phrase(1, 9)}</footer>"
        inner = some(0.2, self.comments)
        shape = r.random()
        if shape < 0.5:
            core = f"<article>{article}{inner}</article>"
        elif shape < 0.62:
            core = f"<main>{article}{inner}</main>"
        elif shape < 0.74:
            core = f"<main><article>{article}{inner}</article>{some(0.5, self.noise)}</main>"
        elif shape < 0.88:
            core = f'<div{self.attribute("content article post entry story main-content article-body", 1)}>{article}{inner}</div>'
        else:
            core = f"<div>{article}</div>" if r.random() < 0.5 else article
        before = [some(0.3, self.notice), some(0.6, self.head), some(0.7, self.menu), some(0.4, self.advert), some(0.15, self.hidden), some(0.2, self.form), some(0.2, self.side), some(0.15, self.weak), some(0.15, self.script_off), some(0.1, self.button)]
        after = [some(0.3, self.share), some(0.4, self.comments), some(0.4, self.side), some(0.3, self.advert), some(0.2, self.form), some(0.2, self.notice), some(0.1, self.menu), some(0.2, self.weak), some(0.1, self.button)]
        if r.random() < 0.5:
            r.shuffle(before)
            r.shuffle(after)
        body = "".join(before) + core + "".join(after) + some(0.8, self.foot)
        if r.random() < 0.12:  # a layout by tables
            rows = [f'<td{self.attribute("header masthead topbar", 0.7)}>{OTHER}{self.phrase(1, 6)}</td>', f'<td{self.attribute("menu nav navbar", 0.7)}>' + " | ".join(f'<a href="x">{OTHER}{self.word()}</a>' for _ in range(4)) + "</td>"]
            rows += [f"<td>{x}</td>" for x in before if x] + [f'<td{self.attribute("content article main", 0.5)}>{core}</td>'] + [f"<td>{x}</td>" for x in after if x]
            rows.append(f'<td{self.attribute("footer foot copyright", 1)}>{OTHER}{self.prose(1, 2)}</td>')
            body = "<table>" + "".join(f"<tr>{x}</tr>" for x in rows) + "</table>"
        if r.random() < 0.25:
            body = f'<div{self.attribute("page wrapper container site", 0.7)}>{body}</div>'
        return f"<html><head><title>x</title></head><body>{body}</body></html>"


def labelled_pages(n: int, seed: int = 7) -> list[str]:
    """n pages; the same for the same seed."""
    made = Maker(seed)
    return [made.page() for _ in range(n)]
