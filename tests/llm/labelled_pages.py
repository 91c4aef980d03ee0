"""Generated pages whose blocks are known to be content (C) or boilerplate (B).

Sections come with semantic elements, with telling class names, or in plain div
elements. ``python -m tests.llm.labelled_pages`` prints the weights that
`html_extraction.fit` finds on them; they stand in the module as WEIGHTS.
"""

from __future__ import annotations

import random

from leadloom.llm import html_extraction as H

WORDS = "the of and river to in station that it was house for on are with as his they at be this stone have from or one had by word but not what all were we".split()


def sentence(r, least=6, most=18):
    return " ".join(r.choice(WORDS) for _ in range(r.randint(least, most))).capitalize() + r.choice(".....!?")


def prose(r):
    return " ".join(sentence(r) for _ in range(r.choice((1, 1, 2, 3, 5, 8))))


def link(r):
    return f"<a href=/{r.randrange(99)}>{' '.join(r.choice(WORDS) for _ in range(r.randint(1, 4)))}</a>"


class Page:
    def __init__(self, seed):
        self.r, self.labels = random.Random(seed), []
        self.style = self.r.choice(["semantic", "semantic", "named", "plain"])
        body = [self.top(), self.notice(), self.article(), self.side(), self.comments(), self.bottom()]
        self.html = "<html><head><title>T</title></head><body>" + "".join(x for x in body if x) + "</body></html>"

    def block(self, tag, text, content, attributes=""):
        self.labels.append(content)
        return f"<{tag}{attributes}>{text}</{tag}>"

    def box(self, tag, names, inner):
        if self.style == "semantic" and tag:
            return f"<{tag}>{inner}</{tag}>"
        if self.style == "plain":
            return f"<div>{inner}</div>"
        return f'<div class="{self.r.choice(names.split())}">{inner}</div>'

    def menu(self, n):
        return "<ul>" + "".join(self.block("li", link(self.r), False) for _ in range(n)) + "</ul>"

    def top(self):
        name = self.block("div", link(self.r), False)
        return self.box("header", "header masthead", name) + self.box("nav", "menu nav navbar", self.menu(self.r.randint(2, 8)))

    def notice(self):
        r = self.r
        if r.random() < 0.5:
            return ""
        return f'<div class="{r.choice(("ad", "cookie-notice", "promo", "ad-slot", "newsletter"))}">' + self.block("p", sentence(r), False) + "</div>"

    def article(self):
        r, out = self.r, []
        out.append(self.block(r.choice(("h1", "h1", "h2")), " ".join(r.choice(WORDS) for _ in range(r.randint(2, 9))), True))
        for _ in range(r.randint(2, 10)):
            kind = r.random()
            if kind < 0.62:
                text = prose(r)
                out.append(self.block("p", text + (" " + link(r) if r.random() < 0.3 else ""), True))
            elif kind < 0.7:
                out.append(self.block("p", sentence(r, 1, 3), True))
            elif kind < 0.78:
                out.append(self.block("h2", " ".join(r.choice(WORDS) for _ in range(r.randint(1, 5))), True))
            elif kind < 0.88:
                out.append("<ul>" + "".join(self.block("li", sentence(r, 2, 9), True) for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.93:
                out.append("<blockquote>" + self.block("p", sentence(r), True) + "</blockquote>")
            elif kind < 0.97 or self.style == "plain":
                out.append("<table><tr>" + "".join(self.block("td", r.choice(WORDS), True) for _ in range(r.randint(2, 4))) + "</tr></table>")
            else:
                out.append('<div class="ad">' + self.block("p", prose(r), False) + "</div>")
        if self.style != "plain" and r.random() < 0.2:
            out.append("<form>" + self.block("p", sentence(r), False) + "</form>")
        if self.style == "semantic" and r.random() < 0.4:
            return f'<main><div class="{r.choice(("post-body", "content"))}">' + "".join(out) + "</div></main>"
        return self.box("article", "article post-body entry content story main", "".join(out))

    def side(self):
        r = self.r
        if r.random() < 0.4:
            return ""
        parts = self.block("h3", r.choice(WORDS), False) + self.menu(r.randint(2, 5))
        if r.random() < 0.5 and self.style != "plain":
            parts += self.block("p", prose(r), False)
        return self.box("aside", "sidebar related widget", parts)

    def comments(self):
        r = self.r
        if r.random() < 0.5 or self.style == "plain":
            return ""
        said = "".join(self.block("p", prose(r), False) for _ in range(r.randint(1, 6)))
        return f'<section {r.choice(("id=comments", "class=comment-list", "class=replies"))}>' + self.block("h2", "Comments", False) + said + "</section>"

    def bottom(self):
        r = self.r
        parts = self.block("p", f"&copy; {r.randint(1990, 2030)} {r.choice(WORDS)}", False)
        if r.random() < 0.5:
            parts += self.menu(r.randint(2, 6))
        if r.random() < 0.3 and self.style != "plain":
            parts += self.block("p", sentence(r), False)
        return self.box("footer", "footer", parts)


def labelled(seeds):
    found = []
    for seed in seeds:
        page = Page(seed)
        blocks = H.blocks_of(page.html)
        assert len(blocks) == len(page.labels)
        found.append((blocks, page.labels))
    return found


if __name__ == "__main__":
    print(H.fit(labelled(range(400))))
