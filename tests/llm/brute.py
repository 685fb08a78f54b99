"""Plain versions of the operators' contracts, for tests on small tables."""

import re
from collections import Counter
from html.parser import HTMLParser

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, k):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def components(rows, k, percent):
    """doc_id -> (set size, least doc_id reachable); every pair is compared."""
    sets = {i: shingle_set(t, k) for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                shared = len(a & b)
                if 100 * shared >= percent * (len(a) + len(b) - shared):
                    ri, rj = find(i), find(j)
                    root[max(ri, rj)] = min(ri, rj)
    return {i: (len(sets[i]), find(i)) for i in ids}


def base_counts(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(covered), "base_failed": len(w) < 50 or 100 * len(covered) > 50 * len(w)}


def kept(text):
    """Whether the base and every quality rule let a text pass."""
    text = text or ""
    c, w = base_counts(text), words(text)
    lines = [x for x in text.split("\n") if words(x)]
    rejected = [
        c["base_failed"],
        100 * c["n_symbols"] > 30 * c["n_words"],
        not 2 * c["n_words"] <= c["word_chars"] <= 30 * c["n_words"],
        100 * c["n_dup_lines"] > 60 * len(lines),
        100 * sum(x.endswith("!") for x in w) > 50 * c["n_words"],
        100 * sum(x.rstrip(" \t\n\x0b\x0c\r").endswith(("...", "…")) for x in lines) > 60 * len(lines),
        100 * sum(x.isalpha() for x in text) < 40 * c["word_chars"],
        100 * sum(a == b for a, b in zip(w, w[1:])) > 40 * c["n_words"],
    ]
    return not any(rejected)


def kept_lines(rows):
    """doc_id -> (lines, dropped, kept text)."""
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    docs = {i: (t or "").split("\n") for i, t in rows}
    holders = {}
    for i, lines in docs.items():
        for line in lines:
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, lines in docs.items():
        stay = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def judge_url(url, rules=RULES, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = re.search(r"[/?#]", rest)
        host, rest = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "")
        path = re.split(r"[?#]", rest, maxsplit=1)[0]
    host = lower(host)
    fit = ((len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p))
    best = max(fit, default=(0, 0, None, default))  # of two of one length the one with the longer host
    return host, path, best[2], best[3]


class Article(HTMLParser):
    """The text inside <article> of a well-formed enough page: a line for each stretch between block tags."""

    INLINE = {"a", "b", "i", "em", "strong", "span", "small", "code", "u"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.hidden, self.lines = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.hidden += tag in ("script", "style")
        if tag not in self.INLINE:
            self.lines.append("")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.hidden -= tag in ("script", "style")
        if tag not in self.INLINE:
            self.lines.append("")

    def handle_data(self, data):
        if self.depth and not self.hidden:
            self.lines[-1] += data


def article_text(page):
    reader = Article()
    reader.feed(page or "")
    reader.close()
    return "\n".join(x for line in reader.lines if (x := " ".join(line.split())))
