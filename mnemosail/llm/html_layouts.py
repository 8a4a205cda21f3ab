"""Pages composed by rule, with the label of every block, to train the block labeller.

Texts are sentences of the corpus's own pages, so that what is learnt is where and how text stands, not what it says. A page mixes an article with the
things around one: menus, headers, side columns, notices, adverts, forms, readers' comments. Layouts
name their parts by elements, by class or id, or not at all. ``MARKS`` are comments that switch the label.
"""

from __future__ import annotations

import random

#: Comments between parts, and the label of the blocks that begin after them.
MARKS = {"+": True, "-": False}
MAIN, REST = "<!--+-->", "<!----->"

# Fixed names: how pages commonly name their parts.
ARTICLE = "article content main post entry story body text page article-body post-content entry-content main-content story-body articleText blog-post".split()
MENU = "nav menu navbar navigation main-menu topnav breadcrumb breadcrumbs nav-links tabs pagination pager".split()
HEADER = "header masthead site-header top topbar banner branding logo page-header".split()
FOOTER = "footer site-footer bottom copyright legal colophon page-footer credits".split()
SIDE = "sidebar side aside widget related recommended popular trending more-stories right-column secondary tags".split()
NOTICE = "notice cookie cookie-banner consent alert message popup modal overlay announcement gdpr warning subscribe newsletter".split()
ADVERT = "ad ads advert advertisement sponsored promo promotion banner-ad adsbygoogle ad-slot sponsor".split()
FORM = "form search search-form login signup contact newsletter-form comment-form respond".split()
COMMENTS = "comments comment-list commentlist discussion responses replies comment-section reader-comments disqus".split()
SHARE = "share social share-buttons toolbar tools meta post-meta author-box print".split()
NEUTRAL = "wrap wrapper container row col inner box outer section block group grid layout site".split()
PHRASES = {
    "menu": "Home|News|About us|Contact|Sport|Start|Inicio|Accueil|Über uns|Kontakt|Noticias|Archives|Shop|Help|Next|Previous|Politik|Culture",
    "footer": "© 2024|All rights reserved.|Privacy policy|Terms of use|Impressum|Datenschutz|Mentions légales|Aviso legal|Powered by|Sitemap",
    "notice": "We use cookies to improve your experience.|Accept|This site uses cookies.|Wir verwenden Cookies.|Ce site utilise des cookies.|Subscribe to our newsletter.|Utilizamos cookies.|OK|Maintenance tonight.",
    "advert": "Advertisement|Sponsored|Anzeige|Publicité|Publicidad|Buy now|50 % off today|Shop the sale|Learn more",
    "form": "Search|E-mail|Name|Password|Send|Log in|Suche|Rechercher|Buscar|Your comment|Subscribe|Submit",
    "comments": "Comments|Leave a reply|3 comments|Kommentare|Commentaires|Comentarios|Reply|Report|Antworten|Répondre",
    "share": "Share|Tweet|Print|E-mail this|Teilen|Partager|Compartir|Tags:",
    "side": "Related articles|Most read|Popular|Ähnliche Artikel|À lire aussi|Lo más leído|Follow us|Latest news",
}
PHRASES = {k: v.split("|") for k, v in PHRASES.items()}


class Composer:
    def __init__(self, sentences: list[str], seed: int):
        self.r = random.Random(seed)
        self.odd = 0.0
        self.bank = sentences or ["Lorem ipsum dolor sit amet.", "Consectetur adipiscing elit, sed do eiusmod.", "Ut enim ad minim veniam?"]

    def sentence(self) -> str:
        s = self.r.choice(self.bank)
        return s.replace("&", "&amp;").replace("<", "&lt;") if self.r.random() < 0.9 else s.replace("<", "&lt;")

    def prose(self, most: int) -> str:
        if self.r.random() < self.odd:  # articles of tables, lists, repeats and nonsense are articles too
            ws = self.sentence().split() or ["x"]
            n = self.r.randint(1, 40)
            return self.r.choice([" ".join(ws[:1] * n), " | ".join(self.r.choice(ws) for _ in range(n)), " ".join(str(self.r.randrange(10**6)) for _ in range(n)), " ".join(ws).upper(), " ".join(ws).strip(".!?")])
        return " ".join(self.sentence() for _ in range(self.r.randint(1, most)))

    def words(self, most: int) -> str:
        return " ".join(self.sentence().split()[: self.r.randint(1, most)])

    def phrase(self, kind: str) -> str:
        return self.r.choice(PHRASES[kind]) if self.r.random() < 0.6 else self.words(4)

    def link(self, text: str) -> str:
        return f'<a href="/{self.r.randrange(999)}">{text}</a>'

    def wrap(self, inner: str, tag: str, names: list[str]) -> str:
        """An element that is named by tag, class, id or nothing, as the page's style has it."""
        r, style = self.r, self.style
        if style == "elements" or (style == "mixed" and r.random() < 0.5):
            name = f' class="{r.choice(names)}"' if r.random() < 0.3 else ""
            return f"<{tag}{name}>{inner}</{tag}>"
        if style == "bare":
            return f"<div>{inner}</div>"
        shell = r.choice(["div", "div", "div", "section", "table"]) if tag != "ul" else "div"
        kind = r.choice(["class", "class", "id"])
        name = r.choice(names) + r.choice(["", "", "", f"-{r.randrange(9)}", " " + r.choice(NEUTRAL)])
        if shell == "table":
            return f'<table {kind}="{name}"><tr><td>{inner}</td></tr></table>'
        return f'<{shell} {kind}="{name}">{inner}</{shell}>'

    def links(self, kind: str, most: int) -> str:
        items = [self.link(self.phrase(kind)) for _ in range(self.r.randint(2, most))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.r.choice([" ", " | ", " &middot; "]).join(items)

    def inline(self, text: str) -> str:
        """Prose with a word or two marked up."""
        ws = text.split(" ")
        for _ in range(self.r.choice([0, 0, 1, 2])):
            k = self.r.randrange(len(ws))
            tag = self.r.choice(["b", "i", "em", "strong", "span", "a"])
            ws[k] = self.link(ws[k]) if tag == "a" else f"<{tag}>{ws[k]}</{tag}>"
        return " ".join(ws)

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.9:
            head = f"<h1>{self.title}</h1>"
            out.append(head if r.random() < 0.8 else f"<header>{head}</header>")
        shape = r.choice(["p", "p", "p", "open", "div", "td"])
        for _ in range(r.choice([1, 2, 3, 5, 8, 12, 20])):
            text, kind = self.inline(self.prose(r.choice([1, 2, 5, 12]))), r.random()
            if r.random() < 0.05:  # one line over and over
                out += [f"<p>{self.words(5)}</p>"] * r.randint(2, 30)
            if kind < 0.76:
                out.append({"p": f"<p>{text}</p>", "open": f"<p><b>{text}<br>", "div": f"<div>{text}</div>", "td": f"<p>{text}"}[shape if r.random() < 0.8 else "p"])
            elif kind < 0.84:
                out.append(f"<h{r.choice('2223')}>{self.words(8)}</h2>")
            elif kind < 0.88:
                out.append("<ul>" + "".join(f"<li>{self.prose(1)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote>{self.prose(3)}</blockquote>")
            elif kind < 0.94:
                out.append(f"<pre>{self.prose(2)}</pre>")
            elif kind < 0.96:
                out.append("<table>" + "".join(f"<tr><td>{self.words(3)}</td><td>{r.randrange(99)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                out.append(REST + r.choice([self.advert, self.share, self.subscribe])() + MAIN)
        return "".join(out)

    def menu(self) -> str:
        return self.wrap(self.links("menu", 9), "nav", MENU)

    def header(self) -> str:
        inner = self.link(self.words(3)) + (f"<p>{self.words(9)}</p>" if self.r.random() < 0.5 else "")
        return self.wrap(inner + (self.menu() if self.r.random() < 0.4 else ""), "header", HEADER)

    def footer(self) -> str:
        r = self.r
        inner = f"&copy; {self.words(2)} &middot; {self.prose(2)}" if r.random() < 0.5 else f"<p>{self.phrase('footer')} {self.phrase('footer')}</p>"
        return self.wrap(inner + (self.links("footer", 6) if r.random() < 0.5 else ""), "footer", FOOTER)

    def side(self) -> str:
        title = f"<h{self.r.choice('34')}>{self.phrase('side')}</h3>"
        inner = self.links("side", 8) if self.r.random() < 0.6 else "".join(f"<p>{self.prose(2)}</p>" for _ in range(self.r.randint(1, 3)))
        return self.wrap(title + inner, "aside", SIDE)

    def notice(self) -> str:
        text = self.phrase("notice") + " " + (self.prose(2) if self.r.random() < 0.5 else "")
        return self.wrap(f"<p>{text}</p>" if self.r.random() < 0.5 else text, "div", NOTICE) if self.style != "bare" else f"<div>{self.r.choice(PHRASES['notice'])}</div>"

    def advert(self) -> str:
        text = self.phrase("advert") if self.r.random() < 0.5 else self.prose(3)
        style, self.style = self.style, "classes"  # adverts are named in any style
        out = self.wrap(text if self.r.random() < 0.6 else f"<p>{text}</p>", "div", ADVERT).replace("<table", "<div").replace("</table", "</div")
        self.style = style
        return out

    def form(self) -> str:
        fields = "".join(f"<label>{self.phrase('form')}</label><input><p>{self.phrase('form')}</p>" for _ in range(self.r.randint(1, 3)))
        return self.wrap(f"<form>{fields}<button>{self.phrase('form')}</button></form>", "div", FORM)

    def share(self) -> str:
        return self.wrap(self.links("share", 5), "div", SHARE)

    def subscribe(self) -> str:
        return self.wrap(f"<p>{self.r.choice(PHRASES['notice'])}</p><form><input><button>{self.phrase('form')}</button></form>", "div", NOTICE)

    def comments(self) -> str:
        r = self.r
        each = []
        for _ in range(r.randint(1, 6)):
            tag = r.choice(["h4", "div", "p", "cite"])
            who = f"<{tag}>{self.words(2)} {r.choice(['', '12:30', '2 days ago', 'says:'])}</{tag}>"
            text = "".join(f"<p>{self.prose(4)}</p>" for _ in range(r.choice([1, 1, 2])))
            each.append(who + text)
        if r.random() < 0.5:
            inner = "<ol>" + "".join(f"<li>{x}</li>" for x in each) + "</ol>"
        elif self.style == "bare":
            inner = "".join(f"<div>{x}</div>" for x in each)
        else:
            inner = "".join(f'<div class="comment">{x}</div>' for x in each)
        title = f"<h3>{self.r.choice(PHRASES['comments'])}</h3>" if r.random() < 0.7 or self.style == "bare" else ""
        return self.wrap(title + inner + (self.form() if r.random() < 0.4 else ""), "section", COMMENTS)

    def some(self, chances: list[tuple[float, str]]) -> str:
        return "".join(getattr(self, name)() for chance, name in chances if self.r.random() < chance)

    def page(self) -> str:
        r = self.r
        self.style = r.choice(["elements", "classes", "classes", "mixed", "bare"])
        self.odd = r.choice([0.0, 0.05, 0.05, 0.9])
        self.title = self.words(12)
        before = self.some([(0.3, "notice"), (0.5, "header"), (0.8, "menu"), (0.15, "menu"), (0.4, "advert"), (0.2, "form"), (0.2, "side")])
        after = self.some([(0.3, "share"), (0.4, "side"), (0.45, "comments"), (0.3, "side"), (0.2, "advert"), (0.15, "form"), (0.15, "notice"), (0.85, "footer")])
        main = MAIN + self.article() + REST
        tag = r.choice(["article", "article", "main"])
        main = self.wrap(main, tag, ARTICLE)
        for _ in range(r.choice([0, 0, 1, 2])):
            shell = f'class="{r.choice(NEUTRAL)}"' if self.style != "bare" else ""
            if r.random() < 0.5:
                main = f"<div {shell}>{main}</div>"
            else:
                main, before, after = f"<div {shell}>{before}{main}{after}</div>", "", ""
        site = self.title if r.random() < 0.6 else f"{self.title} - {self.words(2)}"
        return f"<html><head><title>{site}</title></head><body>{REST}{before}{main}{after}</body></html>"
