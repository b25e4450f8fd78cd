"""Pages whose article is known, for the costs of blocks: the given pages and what other sites put around an article.

`python -m tests.llm.html_training FOLDER` prints the WEIGHTS of `html_extraction`.
"""

import random
import re
import sys

import pyarrow.parquet as pq

from quillmark.llm import html_extraction as h

#: Pages that are read; each is varied six times.
SAMPLE_PAGES = 512
SHORT = "Home News Sport Menu Search Share Print Login Subscribe Tags: 12.03.2024 Advertisement More Top © Contact Imprint Privacy Next Previous".split()


def _call(rng: random.Random, words: list[str]) -> str:
    """A sentence of the page's own words with one or two calls to the reader among them."""
    out = rng.choices(words, k=rng.randint(3, 12))
    for call in rng.sample(sorted(h.CALLS), rng.randint(1, 2)):
        out.insert(rng.randint(0, len(out)), call)
    return " ".join(out) + rng.choice([".", "!", ""])


def _around(rng: random.Random, words: list[str]) -> str:
    """A piece of boilerplate: links, short labels, or now and then a sentence."""
    out = []
    for _ in range(rng.randint(1, 6)):
        tag = rng.choice(["div", "p", "li", "td", "div"])
        text = " ".join(rng.choices(words, k=rng.randint(4, 14))) if rng.random() < 0.35 else rng.choice(SHORT)
        text = _call(rng, words) if rng.random() < 0.5 else text
        link = rng.random() < 0.6
        out.append(f"<{tag}>{'<a href=/x>' if link else ''}{text}{'</a>' if link else ''}{rng.choice(['', '', ' |', '.'])}</{tag}>")
    return f"<div>{''.join(out)}</div>"


def labelled(folder: str, seed: int = 1) -> tuple[list[h.Page], list[list[bool]]]:
    rng, pages, content = random.Random(seed), [], []
    for row in pq.read_table(f"{folder}/pages.parquet").slice(0, SAMPLE_PAGES).to_pylist():
        words = re.sub(r"<[^>]*>", " ", row["html"]).split()
        for k in range(6):
            html = row["html"]
            if k % 3:
                html = re.sub(r"<(/?)article", r"<\1section", html)
            if k % 2:
                html = re.sub(r"<(/?)p>", r"<\1div>", html)
            if k > 1:
                first = re.search(r"<(?:article|section)>", html).start()
                html = html[:first] + _around(rng, words) + html[first:]
                html = html.replace("<footer", _around(rng, words) + "<footer", 1)
            page = h.parse(html)
            inside = [False]
            for tag, above in zip(page.tag[1:], page.parent[1:], strict=True):
                inside.append(tag in ("article", "section") or inside[above])
            pages.append(page)
            content.append([inside[b.element] for b in page.blocks])
    return pages, content


if __name__ == "__main__":
    print(tuple(h.fit_costs(*labelled(sys.argv[1])).round(2).tolist()))
