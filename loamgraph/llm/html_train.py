"""Fits the weights of html_extract.py on generated pages: python -m loamgraph.llm.html_train FILE.

Pages are drawn from a grammar of site layouts: semantic and div-only markup, class names in several styles, menus,
headers, footers, sidebars, notices, adverts, forms, reader comments and related links around and inside
articles, in invented words of several syllable sets. Each leaf's label is known from the grammar. The random
seed is fixed, so a fit can be repeated.
"""

from __future__ import annotations

import random
import sys

import numpy as np

from loamgraph.llm import html_extract as H

SYLLABLES = ("th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve", "de la es en el os as do ra ci ar ta ue lo un mi bo ja ga co", "le de en on re nt es ou an it ai eu ch er la qu un", "en er ch ei in te nd ge ie un be sc it st ic", "ka to mi su no ra ne ki ha shi")
NAV = ("nav navbar menu main-menu topnav site-nav navigation breadcrumb breadcrumbs nav-links menu-primary mainNav tabs pagination pager skip-link toc-nav language-switch".split(), ("nav", "div", "ul", "menu", "nav"))
HEAD = ("header site-header masthead top-bar banner branding logo page-header topbar site-title headline-bar search-bar".split(), ("header", "div", "header", "section"))
FOOT = ("footer site-footer copyright bottom foot page-footer colophon legal footer-links credits imprint".split(), ("footer", "div", "footer", "section"))
SIDE = ("sidebar aside widget side-column right-col secondary rail left-rail tag-cloud archives recent-posts trending most-read popular toc related related-posts recommended more-stories see-also".split(), ("aside", "div", "section", "aside"))
NOTICE = ("notice cookie cookie-banner cookie-notice alert consent gdpr warning message popup modal overlay newsletter-popup announcement info-bar paywall disclaimer toast dialog".split(), ("div", "section", "aside", "dialog", "p"))
AD = ("ad ads advert advertisement ad-slot adsbox sponsored sponsor promo promotion promoted banner-ad google-ad commercial adContainer dfp affiliate partner-content".split(), ("div", "aside", "section", "ins", "p"))
FORM = ("form search-form login signup newsletter subscribe subscription contact-form comment-form respond mailing-list register".split(), ("form", "div", "form", "form"))
COMMENT = ("comments comment comment-list commentlist comments-area reader-comments discussion responses replies disqus comment-body comment-thread user-comments feedback reviews".split(), ("section", "div", "ol", "aside"))
SHARE = ("share social share-buttons tags byline meta post-meta author author-bio tools toolbar print-link rating views likes posted-on category-links".split(), ("div", "ul", "p", "span", "section"))
BODY = ("content main-content article article-body post post-content entry entry-content story story-body text body-text page-content main-text articleBody post-body single hentry prose".split(), ("article", "main", "div", "section", "div", "article"))
PHRASES = {
    "nav": "Home|About|About us|News|Contact|Products|Blog|Sitemap|Next|Previous|Sports|World|Menu|Help|FAQ|Log in|Archive".split("|"),
    "notice": "We use cookies to improve your experience.|This site uses cookies. By continuing you accept our policy.|Accept all|Please enable JavaScript.|Your browser is out of date.|Our offices are closed today.|Dismiss|Subscribe to continue reading.".split("|"),
    "ad": "Advertisement|Sponsored content|Buy now and save 20%!|Limited offer: order today.|Sponsored|Free shipping on all orders.|Click here for a great deal".split("|"),
    "form": "Search|Email address|Subscribe|Your name|Submit|Sign up for our newsletter|Password|Leave a reply|Post comment|Your message|Required fields are marked".split("|"),
    "foot": "© 2021 All rights reserved|Privacy policy|Terms of use|Powered by|Imprint|Contact us|Follow us|Back to top|Copyright 2019".split("|"),
    "comment": "Great article, thanks for sharing.|I disagree with this.|Reply|3 comments|First!|Thanks, this helped me a lot.|Posted by|says:|2 days ago|Report|Comments|Leave a comment".split("|"),
    "share": "Share|Tweet|Posted on|By|Print this page|Tags:|Filed under|5 min read|Email this|Updated|Read more".split("|"),
    "side": "Recent posts|Popular|Archives|Related articles|Categories|Most read|See also|Trending|Tag cloud|You may also like".split("|"),
}


class Site:
    """Draws one page; blocks come out as text with a mark that tells main text from other text."""

    def __init__(self, rng: random.Random) -> None:
        self.r = rng
        self.syl = rng.choice(SYLLABLES).split()
        self.plain = rng.random() < 0.15  # no class names at all
        self.obfuscated = rng.random() < 0.12
        self.bare = self.plain or self.obfuscated  # nothing would tell other text inside an article
        self.semantic = rng.random() < 0.6
        self.noise = rng.random() < 0.15
        self.closed = rng.random() < 0.85
        self.mark = 0

    def word(self) -> str:
        return "".join(self.r.choice(self.syl) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, n: int) -> str:
        ws = [self.word() for _ in range(n)]
        if self.noise:
            ws = [w + self.r.choice(("###", "%%%", "&amp;&amp;", "***", "$$$")) for w in ws]
        return " ".join(ws)

    def sentence(self) -> str:
        s = self.words(self.r.randint(2, 18))
        if self.r.random() < 0.4 and " " in s:
            s = s.replace(" ", ", ", 1)
        return s[:1].upper() + s[1:] + self.r.choice(".....?!")

    def prose(self, most: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(1, most)))

    def text(self, main: bool, s: str) -> str:
        """A leaf's text; the mark is a private character that labels() reads and removes."""
        return ("\ue001" if main else "\ue000") + s

    def open(self, kind: tuple[list[str], tuple[str, ...]]) -> tuple[str, str]:
        names, tags = kind
        tag = tags[0] if self.semantic and self.r.random() < 0.7 else self.r.choice(tags)
        if not self.semantic and self.r.random() < 0.6:
            tag = "div"
        attr = ""
        if tag in ("div", "p", "span", "section", "ul", "ol") or self.r.random() < 0.5:
            name = self.r.choice(names)
            if self.obfuscated:
                name = "c" + str(self.r.randint(100, 999))
            elif self.r.random() < 0.2:
                name = name + self.r.choice((" wrap", "-inner", "_box", " col-md-8", "-container", " clearfix"))
            if not self.plain:
                attr = f' {self.r.choice(("class", "class", "class", "id"))}="{name}"'
        return f"<{tag}{attr}>", f"</{tag}>"

    def links(self, key: str, n: int) -> str:
        item = lambda: f'<a href="/{self.word()}">{self.text(False, self.r.choice(PHRASES[key]) if self.r.random() < 0.4 else self.words(self.r.randint(1, 5)))}</a>'
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>"
        return " | ".join(item() for _ in range(n)) if self.r.random() < 0.5 else "".join(f"<div>{item()}</div>" for _ in range(n))

    def small(self, key: str, tag: str | None = None) -> str:
        tag = tag or self.r.choice(("p", "div", "span", "h3", "li"))
        s = self.r.choice(PHRASES[key]) if self.r.random() < 0.4 else (self.prose(3) if self.r.random() < 0.7 else self.words(self.r.randint(1, 6)))
        return f"<{tag}>{self.text(False, s)}</{tag}>"

    def other(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            o, c = self.open(NAV)
            return o + self.links("nav", r.randint(2, 9)) + c
        if kind == "head":
            o, c = self.open(HEAD)
            return o + r.choice((f"<h1>{self.text(False, self.words(2))}</h1>", f'<a href="/">{self.text(False, self.words(2))}</a>', self.small("nav", "p"))) + (self.other("nav") if r.random() < 0.4 else "") + c
        if kind == "foot":
            o, c = self.open(FOOT)
            return o + "".join(r.choice((self.small("foot"), self.links("foot", r.randint(1, 5)), self.text(False, "&copy; " + self.words(3) + " &middot; " + self.prose(2)))) for _ in range(r.randint(1, 3))) + c
        if kind == "side":
            o, c = self.open(SIDE)
            return o + (f"<h3>{self.text(False, r.choice(PHRASES['side']))}</h3>" if r.random() < 0.6 else "") + r.choice((self.links("side", r.randint(2, 8)), self.small("side") + self.small("side"), f"<p>{self.text(False, self.prose(4))}</p>")) + c
        if kind == "notice":
            o, c = self.open(NOTICE)
            return o + (self.text(False, r.choice(PHRASES["notice"]) if r.random() < 0.5 else self.prose(3)) if r.random() < 0.5 else self.small("notice", r.choice(("p", "p", "div"))) + (self.small("notice") if r.random() < 0.3 else "")) + c
        if kind == "ad":
            o, c = self.open(AD)
            return o + (self.text(False, self.prose(3)) if r.random() < 0.6 else self.small("ad")) + c
        if kind == "form":
            o, c = self.open(FORM)
            field = lambda: f"<label>{self.text(False, r.choice(PHRASES['form']))}</label><input name='x'>"
            return o + "".join(r.choice((field(), self.small("form", "p"), f"<button>{self.text(False, r.choice(PHRASES['form']))}</button>")) for _ in range(r.randint(1, 4))) + c
        if kind == "share":
            o, c = self.open(SHARE)
            return o + r.choice((self.text(False, r.choice(PHRASES["share"]) + " " + self.words(2)), self.links("share", r.randint(1, 5)))) + c
        o, c = self.open(COMMENT)
        one = lambda: "<{0}{1}><b>{2}</b> {3}</{0}>".format(r.choice(("li", "div", "article", "p")), "" if self.plain else f' class="{r.choice(("comment", "comment-item", "reply", "c", "media"))}"', self.text(False, self.words(1)), r.choice((f"<p>{self.text(False, self.prose(4))}</p>", self.text(False, self.prose(3)))))
        return o + (f"<h3>{self.text(False, r.choice(PHRASES['comment']))}</h3>" if r.random() < 0.6 else "") + "".join(one() for _ in range(r.randint(1, 6))) + (self.other("form") if r.random() < 0.2 else "") + c

    def leaf(self) -> str:
        r, x = self.r, self.r.random()
        if x < 0.05:  # articles quote such phrases too: the path and the context decide
            return f"<p>{self.text(True, r.choice(PHRASES[r.choice(sorted(PHRASES))]))}</p>"
        if x < 0.70:
            s = self.prose()
            if r.random() < 0.2 and " " in s:
                a, b = s.split(" ", 1)
                s = f"{a} <{(t := r.choice(('b', 'i', 'em', 'strong', 'span')))}>{b}</{t}>"
            if r.random() < 0.1:
                s += f' <a href="/x">{self.words(2)}</a>'
            if r.random() < 0.08:
                s = f"<b>{s}<br>{self.text(True, self.prose(2))}"
            return f"<p>{self.text(True, s)}" + ("</p>" if self.closed else "")
        if x < 0.79:
            t = r.choice(("h2", "h3", "h4"))
            return f"<{t}>{self.text(True, self.words(r.randint(1, 8)))}</{t}>"
        if x < 0.90:
            return "<{0}>{1}</{0}>".format(r.choice(("ul", "ol")), "".join(f"<li>{self.text(True, self.prose(2) if r.random() < 0.7 else self.words(3))}</li>" for _ in range(r.randint(2, 5))))
        if x < 0.94:
            return f"<blockquote>{self.text(True, self.prose(3))}</blockquote>"
        if x < 0.97:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.text(True, self.words(2))}</td>" for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>"
        return r.choice((f"<pre>{self.text(True, self.words(8))}</pre>", f"<figure><img src=x><figcaption>{self.text(True, self.sentence())}</figcaption></figure>", f"<div>{self.text(True, self.prose(3))}</div>"))

    def article(self) -> str:
        r = self.r
        o, c = self.open(BODY)
        title = f"<h1>{self.text(True, self.words(r.randint(1, 10)))}</h1>" if r.random() < 0.85 else ""
        parts = [title] if title else []
        n = 1 if r.random() < 0.1 else r.randint(2, 12)
        for _ in range(n):
            parts.append(self.leaf())
            if r.random() < 0.12 and not self.bare:
                parts.append(self.other(r.choice(("ad", "ad", "share", "side", "form", "notice"))))
        if r.random() < 0.15 and not self.bare:
            parts.insert(1, self.other("share"))
        if r.random() < 0.08 and not self.bare:
            parts.append(self.other("comment"))
        if r.random() < 0.3 and not self.plain:
            o2, c2 = self.open(BODY)
            parts = [o2.replace("<article", "<div").replace("<main", "<div"), *parts, c2.replace("article", "div").replace("main", "div")]
        return o + "".join(parts) + c

    def page(self) -> str:
        r = self.r
        top = [self.other(k) for k in ("head", "nav", "notice", "ad", "nav", "form") if r.random() < 0.4]
        low = [self.other(k) for k in ("share", "comment", "side", "form", "ad", "notice", "comment", "foot") if r.random() < 0.35]
        r.shuffle(top)
        body = self.article()
        if r.random() < 0.3:
            body = self.other("side") + body if r.random() < 0.5 else body + self.other("side")
        if r.random() < 0.4:
            o, c = self.open((["wrapper", "container", "page", "main", "site", "row", "layout", "root"], ("div", "main", "div")))
            body = o + body + c
        return f"<!DOCTYPE html><html><head><title>{self.words(3)}</title><style>p{{}}</style><script>var a='<p>';</script></head><body>" + "".join(top) + body + "".join(low) + ("</body></html>" if r.random() < 0.9 else "")


def labelled(page: str) -> tuple[list[H.Block], np.ndarray]:
    """The blocks without marks, and 1 for main text."""
    out, y = [], []
    for b in H.blocks(page):
        y.append(float("\ue001" in b.text))
        b.text = b.text.replace("\ue001", "").replace("\ue000", "").strip() or "-"
        out.append(b)
    return out, np.array(y, np.float32)


def _forward(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
    n, steps, _ = x.shape
    u = wh.shape[0]
    h = c = np.zeros((n, u), np.float32)
    z = x @ wx + b
    out, kept = np.empty((n, steps, u), np.float32), []
    for t in range(steps):
        a = z[:, t] + h @ wh
        s = 1 / (1 + np.exp(-a[:, : 3 * u]))
        g = np.tanh(a[:, 3 * u :])
        new = s[:, u : 2 * u] * c + s[:, :u] * g
        tc = np.tanh(new)
        live = mask[:, t : t + 1]
        kept.append((h, c, s, g, tc, live))
        c = np.where(live, new, c)
        h = np.where(live, s[:, 2 * u :] * tc, h)
        out[:, t] = h
    return out, kept


def _backward(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, kept: list, dout: np.ndarray) -> tuple[np.ndarray, ...]:
    n, steps, _ = x.shape
    u = wh.shape[0]
    dz = np.zeros((n, steps, 4 * u), np.float32)
    dwh = np.zeros_like(wh)
    dh = dc = np.zeros((n, u), np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, s, g, tc, live = kept[t]
        dh = dh + dout[:, t]
        dn = np.where(live, dc + dh * s[:, 2 * u :] * (1 - tc * tc), 0)
        da = np.concatenate([dn * g, dn * c, np.where(live, dh * tc, 0)], axis=1) * s * (1 - s)
        da = np.concatenate([da, dn * s[:, :u] * (1 - g * g)], axis=1)
        dz[:, t] = da
        dwh += h.T @ da
        dh = np.where(live, 0, dh) + da @ wh.T
        dc = np.where(live, dn * s[:, u : 2 * u], dc)
    return dz @ wx.T, x.reshape(-1, x.shape[2]).T @ dz.reshape(-1, 4 * u), dwh, dz.sum(axis=(0, 1))


def train(pages: int = 12000, epochs: int = 8, units: int = 20, dims: int = 20, batch: int = 48, seed: int = 7) -> tuple[dict[str, np.ndarray], float]:
    """Weights, and the share of right labels on a tenth of the pages that is held out."""
    rng = random.Random(seed)
    nr = np.random.default_rng(seed)
    data = [labelled(Site(rng).page()) for _ in range(pages)]
    data = [d for d in data if d[0]]
    held, data = data[: len(data) // 10], data[len(data) // 10 :]
    size = 2 * dims + H.NUMBERS
    init = lambda *s: nr.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
    w = {"path": nr.normal(0, 0.3, (H.PATH_SLOTS, dims)).astype(np.float32), "word": nr.normal(0, 0.1, (H.WORD_SLOTS, dims)).astype(np.float32), "o": np.zeros(1, np.float32), "o_f": init(units), "o_b": init(units), "o_x": init(size) * 0.1}
    for d in "fb":
        w |= {f"{d}_wx": init(size, 4 * units), f"{d}_wh": init(units, 4 * units), f"{d}_b": np.concatenate([np.zeros(units), np.ones(units), np.zeros(2 * units)]).astype(np.float32)}
    m, v, k = {n: np.zeros_like(a) for n, a in w.items()}, {n: np.zeros_like(a) for n, a in w.items()}, 0
    slots = H.Slots(H.PATH_SLOTS), H.Slots(H.WORD_SLOTS)
    for epoch in range(epochs):
        order = sorted(range(len(data)), key=lambda i: len(data[i][0]) + rng.random() * 8)
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        rng.shuffle(groups)
        for group in groups:
            some = [data[i] for i in group]
            p, pe, ws, we, num = H.features([b for b, _ in some], *slots)
            keep_w = nr.random(len(ws)) > 0.5  # words are a weak hint: some are hidden
            ws_n = np.maximum(1, np.diff(we, prepend=0))[:, None]
            p_n = np.sqrt(np.maximum(1, np.diff(pe, prepend=0)))[:, None]
            hide = (nr.random(len(pe)) > 0.08)[:, None]  # so is, now and then, the whole path
            word_of, path_of = np.repeat(np.arange(len(we)), np.diff(we, prepend=0)), np.repeat(np.arange(len(pe)), np.diff(pe, prepend=0))
            xw, xp = np.zeros((len(we), w["word"].shape[1]), np.float32), np.zeros((len(pe), w["path"].shape[1]), np.float32)
            np.add.at(xw, word_of[keep_w], w["word"][ws[keep_w]])
            np.add.at(xp, path_of, w["path"][p])
            flat = np.concatenate([xp / p_n * hide, xw / ws_n, num], axis=1)
            sizes = np.array([len(b) for b, _ in some])
            mask = np.arange(sizes.max())[None, :] < sizes[:, None]
            x, y = np.zeros((len(some), sizes.max(), size), np.float32), np.zeros(mask.shape, np.float32)
            x[mask], y[mask] = flat, np.concatenate([q for _, q in some])
            hf, kf = _forward(x, w["f_wx"], w["f_wh"], w["f_b"], mask)
            xb, mb = x[:, ::-1], mask[:, ::-1]
            hb, kb = _forward(xb, w["b_wx"], w["b_wh"], w["b_b"], mb)
            z = hf @ w["o_f"] + hb[:, ::-1] @ w["o_b"] + x @ w["o_x"] + w["o"]
            dz = np.where(mask, 1 / (1 + np.exp(-z)) - y, 0).astype(np.float32) / mask.sum()
            g = {"o": dz.sum().reshape(1), "o_f": np.einsum("nt,ntu->u", dz, hf), "o_b": np.einsum("nt,ntu->u", dz, hb[:, ::-1]), "o_x": np.einsum("nt,ntu->u", dz, x)}
            dx = dz[:, :, None] * w["o_x"]
            d1, g["f_wx"], g["f_wh"], g["f_b"] = _backward(x, w["f_wx"], w["f_wh"], kf, dz[:, :, None] * w["o_f"])
            d2, g["b_wx"], g["b_wh"], g["b_b"] = _backward(xb, w["b_wx"], w["b_wh"], kb, (dz[:, :, None] * w["o_b"])[:, ::-1])
            dflat = (dx + d1 + d2[:, ::-1])[mask]
            dims_ = w["path"].shape[1]
            g["path"], g["word"] = np.zeros_like(w["path"]), np.zeros_like(w["word"])
            np.add.at(g["path"], p, (dflat[:, :dims_] / p_n * hide)[path_of])
            np.add.at(g["word"], ws[keep_w], (dflat[:, dims_ : 2 * dims_] / ws_n)[word_of[keep_w]])
            k += 1
            rate = 0.01 * (0.5 ** (epoch / 2.5))
            for n in w:
                m[n] = 0.9 * m[n] + 0.1 * g[n]
                v[n] = 0.99 * v[n] + 0.01 * g[n] * g[n]
                w[n] = (w[n] - rate * (m[n] / (1 - 0.9**k)) / (np.sqrt(v[n] / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
    label = H.Labeller(w)
    right = [((q >= 0.5) == (y > 0)).mean() for q, (_, y) in zip(label([b for b, _ in held]), held, strict=True)]
    return w, float(np.mean(right))


if __name__ == "__main__":
    fitted, share = train()
    np.savez_compressed(sys.argv[1], **{k: a.astype(np.float16) for k, a in fitted.items()})
    print(f"held-out share of right labels: {share:.4f}")
