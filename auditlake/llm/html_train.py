"""Learn the weights of html_text.py on generated pages: python -m auditlake.llm.html_train.

Pages are put together from sections of known kind; tags, class names, order,
nesting and wording vary, and words are random syllables, so that the labeller
learns from tag paths, figures and neighbours rather than from a vocabulary.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np

from .html_text import FIGURES, HASHES, HIDDEN, PATH, WORD, Bags, blocks, one_way, scores

_SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
#: Section: (tags, class words, words that it likes).
_OTHER = {
    "nav": ("nav div ul", "nav navbar menu navigation mainmenu topbar breadcrumbs breadcrumb pagination links toc skip", "Home About Contact Login News Shop Next Previous"),
    "header": ("header div", "header masthead banner top logo branding hero tagline", "Welcome Search Menu"),
    "footer": ("footer div", "footer bottom copyright colophon legal credits", "Copyright © All rights reserved Privacy Terms"),
    "side": ("aside div section", "sidebar side aside widget related recommended popular trending tags categories archive rail more", "Related Popular Tags Archive Read more"),
    "ad": ("div aside section", "ad ads advert advertisement sponsor sponsored promo adsense banner promoted", "Advertisement Sponsored Buy now"),
    "notice": ("div section p", "notice cookie cookies consent alert gdpr warning popup modal overlay message", "We use cookies Accept Dismiss"),
    "form": ("form div", "form newsletter subscribe signup login search contact optin", "Subscribe Email Submit Sign up"),
    "comments": ("section div ol", "comments comment replies discussion disqus responses reviews", "says Reply Comments Report"),
    "share": ("div ul", "share social sharing follow buttons", "Share Tweet Facebook Email"),
}
_MAIN = ("article main div section", "article content post entry main body story text page prose single blog")
_PLAIN = "wrapper container row col page site wrap inner outer block box layout grid left right center clearfix".split()


class Pages:
    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)

    def pick(self, words: str | list[str]) -> str:
        words = words.split() if isinstance(words, str) else words
        return words[self.rng.integers(len(words))]

    def words(self, low: int, high: int) -> str:
        n = int(np.exp(self.rng.uniform(np.log(low), np.log(high))))
        return " ".join("".join(self.pick(_SYLLABLES) for _ in range(self.rng.integers(1, 5))) for _ in range(n)).capitalize() + self.pick([".", ".", "", "!", "?"])

    def attrs(self, names: str, likely: float = 0.8) -> str:
        if self.rng.random() > likely:
            return ""
        own = [self.pick(names)] + ([self.pick(_PLAIN)] if self.rng.random() < 0.3 else []) + ([self.pick(names)] if self.rng.random() < 0.3 else [])
        self.rng.shuffle(own)
        joined = self.pick(["-", "_", " ", " "]).join(own)
        return f' {self.pick(["class", "class", "class", "id"])}="{joined}{self.pick(["", "", "-1", "2"])}"'

    def leaf(self, kind: str, mark: str) -> str:
        """One block whose text begins with a mark of its label."""
        r = self.rng
        liked = _OTHER[kind][2] if kind in _OTHER else ""
        say = (liked if liked and r.random() < 0.3 else self.words(1, 60 if kind in ("comments", "ad", "footer", "notice", "side", "header") else 6)) if kind != "main" else self.words(1, 3) if r.random() < 0.15 else self.words(1, 150)
        if r.random() < 0.05:  # the same few words over and over
            say = " ".join([say.split(" ")[0]] * int(r.integers(2, 40)))
        if kind == "main":
            tag = self.pick("p p p p p h2 h3 li blockquote pre div td dd figcaption")
            if r.random() < 0.2:
                say = f'{say} <a href="/x">{self.words(1, 6)}</a> {self.words(1, 20)}'
            if r.random() < 0.2:
                say = f"<{(t := self.pick('b i em strong span'))}>{say}" + (f"</{t}>" if r.random() < 0.6 else "<br>")
        else:
            tag = self.pick("p div li span h3 h4 td") if kind != "nav" else "li"
            if r.random() < (0.9 if kind in ("nav", "share") else 0.3):
                say = f'<a href="/{self.pick(_SYLLABLES)}">{say}</a>'
        close = "" if tag in ("p", "li") and r.random() < 0.3 else f"</{tag}>"
        block = f"<{tag}>{mark}{say}{close}"
        return block if tag != "span" else f"<div>{block}</div>"

    def section(self, kind: str) -> str:
        tags, names, _ = _OTHER[kind]
        tag = self.pick(tags)
        plain = tag in ("div", "ul", "section", "p", "ol")
        n = int(self.rng.integers(1, 4 if kind in ("ad", "notice", "header", "share") else 9))
        inner = "".join(self.leaf(kind, "0 ") for _ in range(n)) if self.rng.random() < 0.75 else "0 " + self.words(2, 30)
        if kind == "nav" and tag != "ul":
            inner = f"<ul>{inner}</ul>"
        return f"<{tag}{self.attrs(names, 1.0 if plain else 0.5)}>{inner}</{tag}>"

    def main(self) -> str:
        tags, names = _MAIN
        tag = self.pick(tags)
        inside = [f"<h1>1 {self.words(2, 14)}</h1>"] if self.rng.random() < 0.8 else []
        for _ in range(int(self.rng.integers(1, 14))):
            inside.append(self.leaf("main", "1 "))
            if self.rng.random() < 0.06:
                inside.append(self.section(self.pick("ad share side form notice")))
        return f"<{tag}{self.attrs(names, 0.3 if tag in ('article', 'main') else 0.8)}>{''.join(inside)}</{tag}>"

    def page(self) -> str:
        r = self.rng
        kinds = list(_OTHER)
        before = [self.section(self.pick("nav nav header ad notice side share form")) for _ in range(r.integers(0, 5))]
        after = [self.section(self.pick("footer footer comments comments side form ad nav share notice")) for _ in range(r.integers(0, 5))]
        body = "".join([*before, *(self.main() for _ in range(1 if r.random() < 0.9 else 2)), *after, *([self.section(self.pick(kinds))] if r.random() < 0.1 else [])])
        for _ in range(r.integers(0, 3)):
            body = f"<div{self.attrs(' '.join(_PLAIN), 0.8)}>{body}</div>"
        end = "</body></html>" if r.random() < 0.8 else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title></head><body>{body}{end}"


def labelled(html: str) -> tuple[list, np.ndarray]:
    """Blocks of a generated page without their marks, and their labels."""
    found, labels = [], []
    for names, text, linked in blocks(html):
        mark, _, rest = text.partition(" ")
        if mark in ("0", "1") and rest:
            found.append((names, rest.replace(" 0 ", " ").replace(" 1 ", " "), linked))
            labels.append(float(mark))
    return found, np.array(labels, np.float32)


def start(seed: int = 0) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    size = PATH + WORD + FIGURES
    draw = lambda *s: (r.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
    net = {"path": draw(HASHES, PATH) * 5, "word": draw(HASHES, WORD) * 5, "wo": draw(2 * HIDDEN + size, 1), "bo": np.zeros(1, np.float32)}
    for d in "fb":
        net |= {f"w{d}": draw(size, 4 * HIDDEN), f"u{d}": draw(HIDDEN, 4 * HIDDEN), f"b{d}": np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)}
    return net


def _backward(kept: list, upstream: np.ndarray, x: np.ndarray, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    dw, du, db, dx = np.zeros_like(w), np.zeros_like(u), np.zeros(w.shape[1], np.float32), np.zeros_like(x)
    dh = dc = np.zeros(upstream.shape[1:], np.float32)
    for t in range(len(kept) - 1, -1, -1):
        h, c, i, f, o, g, tc, m = kept[t]
        dh = dh + upstream[t]
        d1, through = dh * m, dh * (1 - m)
        dc1 = dc * m + d1 * o * (1 - tc**2)
        dz = np.concatenate([dc1 * g * i * (1 - i), dc1 * c * f * (1 - f), d1 * tc * o * (1 - o), dc1 * i * (1 - g**2)], 1)
        dw += x[t].T @ dz
        du += h.T @ dz
        db += dz.sum(0)
        dx[t] = dz @ w.T
        dh, dc = dz @ u.T + through, dc1 * f + dc * (1 - m)
    return dw, du, db, dx


def gradients(net: dict[str, np.ndarray], bags: Bags, labels: np.ndarray) -> dict[str, np.ndarray]:
    x, there = bags.padded(bags.vectors(net))
    kf: list = []
    kb: list = []
    ahead, back = one_way(x, there, net["wf"], net["uf"], net["bf"], kf), one_way(x[::-1], there[::-1], net["wb"], net["ub"], net["bb"], kb)[::-1]
    full = np.concatenate([ahead, back, x], 2)
    p = 1 / (1 + np.exp(-np.clip(full @ net["wo"] + net["bo"], -30, 30)))
    y = np.zeros_like(p)
    at = 0
    for i, n in enumerate(bags.lengths):
        y[:n, i, 0] = labels[at : at + n]
        at += n
    d = (p - y) * there / max(1, len(labels))
    out = {"wo": np.einsum("tbf,tbo->fo", full, d), "bo": d.sum((0, 1))}
    up = d @ net["wo"].T
    out["wf"], out["uf"], out["bf"], dx = _backward(kf, up[:, :, :HIDDEN], x, net["wf"], net["uf"])
    out["wb"], out["ub"], out["bb"], dy = _backward(kb, up[::-1, :, HIDDEN : 2 * HIDDEN], x[::-1], net["wb"], net["ub"])
    dx = dx + dy[::-1] + up[:, :, 2 * HIDDEN :]
    flat = np.concatenate([dx[:n, i] for i, n in enumerate(bags.lengths)])
    out["path"], out["word"] = np.zeros_like(net["path"]), np.zeros_like(net["word"])
    np.add.at(out["path"], bags.path, flat[bags.at_path, :PATH])
    np.add.at(out["word"], bags.word, (flat[:, PATH : PATH + WORD] * bags.share[:, None])[bags.at_word])
    return out


def train(pages: int = 6000, rounds: int = 8, batch: int = 32, rate: float = 0.004, seed: int = 1) -> tuple[dict[str, np.ndarray], float]:
    """Weights by Adam, and the accuracy on generated pages that were held out."""
    make = Pages(seed)
    data = [x for x in (labelled(make.page()) for _ in range(pages)) if len(x[1])]
    held, data = data[: pages // 10], data[pages // 10 :]
    net = start()
    m, v, step = {k: np.zeros_like(x) for k, x in net.items()}, {k: np.zeros_like(x) for k, x in net.items()}, 0
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        by = order.permutation(len(data))
        for i in range(0, len(by), batch):
            own = [data[j] for j in by[i : i + batch]]
            g = gradients(net, Bags([b for b, _ in own]), np.concatenate([y for _, y in own]))
            step += 1
            for k in net:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                net[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    right = total = 0
    for i in range(0, len(held), 64):
        own = held[i : i + 64]
        p, y = scores(Bags([b for b, _ in own]), net), np.concatenate([y for _, y in own])
        right, total = right + int(((p > 0.5) == y).sum()), total + len(y)
    return net, right / max(1, total)


if __name__ == "__main__":
    learned, accuracy = train()
    np.savez_compressed(Path(__file__).with_name("html_net.npz"), **{k: x.astype(np.float16) for k, x in learned.items()})
    print(f"held-out blocks right: {accuracy:.4f}")
