"""Pages unlike those that the extractor is trained on, for an evaluation by layout.

Nothing is shared with the training pages: no class or id of theirs, other
sentence lengths, other alphabets, other nesting.
"""

import random

LAYOUTS = ("german", "hashed", "tables", "unnamed", "semantic", "cyrillic")
# Class names of each part: article, menu, header, footer, side, advert, notice, comments, form.
GERMAN = {
    "article": ["beitrag", "artikeltext", "inhalt", "fliesstext"], "menu": ["hauptnavi", "brotkrumen", "seitenleiste-oben"], "header": ["kopfzeile", "markenzeile"], "footer": ["fusszeile", "rechtliches"],
    "side": ["randspalte", "verwandtes", "beliebt"], "ad": ["anzeige", "werbung", "reklame"], "notice": ["hinweis", "einwilligung", "rundbrief"], "comments": ["kommentare", "leserbriefe"], "form": ["suchfeld", "anmeldung"],
}


def pages(layout: str, n: int, seed: int = 1):
    """(page, its article blocks)."""
    r = random.Random(f"{layout}{seed}")
    letters = "бвгдклмнопрст" if layout == "cyrillic" else "bdfgklmnrstz"
    vowels = "аеиоу" if layout == "cyrillic" else "aeiouäü"

    def word():
        return "".join(r.choice(letters) + r.choice(vowels) + r.choice(["", "", "n", "r"] if layout != "cyrillic" else ["", "й"]) for _ in range(r.randint(1, 3)))

    def words(a, b):
        return " ".join(word() for _ in range(r.randint(a, b)))

    def sentence():
        return words(5, 18).capitalize() + "."

    def paragraph():
        return " ".join(sentence() for _ in range(r.randint(2, 6)))

    def attr(part):
        if layout == "german":
            return f' class="{r.choice(GERMAN[part])}"'
        if layout in ("hashed", "cyrillic"):
            return f' class="{"".join(r.choice("qxzjkvw") for _ in range(6))}"'
        return ""

    def links(k):
        return "".join(f'<li><a href="/{r.randrange(999)}">{words(1, 2)}</a></li>' for _ in range(k))

    for _ in range(n):
        article = []

        def put(tag, text):
            article.append(text)  # noqa: B023
            return f"<{tag}>{text}</{tag}>"

        body = put("h1", words(3, 8).capitalize())
        for _ in range(r.randint(2, 8)):
            body += put("p", paragraph())
            if r.random() < 0.2:
                body += put("h2", words(2, 5).capitalize())
        menu, foot = f"<ul{attr('menu')}>{links(r.randint(3, 8))}</ul>", f"<p>© {r.randint(1999, 2024)} {words(1, 3)}</p>"
        side = f"<h4>{words(1, 2)}</h4><ul>{links(r.randint(3, 6))}</ul>"
        form = f"<form{attr('form')}><label>{words(1, 2)}</label><input><button>{word()}</button></form>"
        comments = "".join(f"<div><b>{word()}</b> <i>12:0{k}</i><p>{sentence()}</p></div>" for k in range(r.randint(1, 3))) if layout in ("german", "semantic") else ""
        notice = f"<div{attr('notice')}><p>{sentence()} <a href='/p'>{words(1, 2)}</a></p><button>{word()}</button></div>"
        if layout == "tables":
            page = f"<table><tr><td colspan=2><font size=5>{words(1, 2)}</font><td></tr><tr><td><ul>{links(6)}</ul></td><td>{body}</td></tr><tr><td colspan=2><small>{foot}</small></td></tr></table>"
        elif layout == "unnamed":
            page = f"<div><div>{menu}</div></div><div><div>{body}</div><div>{side}</div></div><div>{foot}</div>"
        elif layout == "semantic":
            page = f"<header><p>{words(1, 2)}</p><nav>{menu}</nav></header><main><article>{body}</article></main><aside>{side}</aside><footer>{foot}</footer>"
        else:
            page = f"<div{attr('header')}><p>{words(1, 2)}</p></div>{menu}{form}<div{attr('article')}>{body}</div><div{attr('side')}>{side}</div>{notice}"
            if comments:
                page += f"<div{attr('comments')}>{comments}</div>"
            page += f"<div{attr('footer')}>{foot}</div>"
        yield f"<!DOCTYPE html><html><body>{page}</body></html>", article
