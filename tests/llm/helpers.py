"""Documents with odd rows, and brute-force versions of the operators."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

from rillgraph.llm import html

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, h string, id string, shard int, word string"

LONG = " ".join(f"w{i % 977}" for i in range(40_000))


def prose(r, n, words=400):
    return " ".join(f"{r.choice('abcdefgh')}{r.randrange(words)}" for _ in range(n))


def odd_rows(seed=0):
    """Nulls, empties, white space, ties, repeats, near copies, shared passages, one very long text."""
    r = random.Random(seed)
    base, passage = prose(r, 120), prose(r, 60)
    texts = [None, "", " \t\n ", "one", "One", base, base, base.upper(), base + " tail", base.replace(" ", "  ", 3), LONG, LONG + " end", "!!! 123 ...", "é è ü " * 30, "a" * 350, "ab" * 300, base[:99], base[:100]]
    for i in range(12):
        words = base.split()
        for _ in range(i // 3):
            words[r.randrange(len(words))] = f"x{r.randrange(9)}"
        texts.append(" ".join(words))
    for _ in range(6):
        texts.append(prose(r, 40) + "\n" + passage + "\n" + prose(r, 30) + "\n\n" + passage)
    texts += [prose(r, r.randrange(1, 80)) for _ in range(20)]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["s0", "s0", "s1", "", None, "é"])) for i, t in enumerate(texts)]
    rows.append(rows[5])
    rows.append(rows[30])
    rows.append((None, "no id at all", "en", "s1"))
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    full = [(i, t, lang, source, None, 1, "h", "id", 2, "w") for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def folded(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def contaminated(text, items, window=10):
    words = folded(text)
    hit, found = set(), set()
    for item, t in items:
        w = folded(t)
        if item is None or not w:
            continue
        n = min(window, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def jaccard(rows, size=4, percent=85):
    sets = defaultdict(set)
    for i, t, *_ in rows:
        if i is None:
            continue
        w = spaced(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
        sets[i].add(s)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(s and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b] if t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def repeats(rows, length=100):
    """(id, text) -> result; ids here are unique but for fully repeated rows."""
    seen, out = set(), {}
    for i, t in sorted({(i if i is not None else 1 << 62, t or "") for i, t, *_ in rows}):
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            k = b[s : s + length]
            if k in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(k)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    p = s = 0
    while p < len(a) and a[p] == b[p]:
        p += 1
    while s < len(a) - p and a[-1 - s] == b[-1 - s]:
        s += 1
    return p + s >= (len(b) - 1 if len(a) == len(b) else len(a))


def dedup_lines(rows, least=8):
    seen, out = [], {}
    for i, t in sorted({(i if i is not None else 1 << 62, t) for i, t, *_ in rows}, key=lambda x: (x[0], x[1] or "")):
        if t is None:
            out[i] = (0, 0, 0, None)
            continue
        exact = near = 0
        stays = []
        for line in t.split("\n"):
            w = [x for x in re.split("[ \t-\r]", line.lower()) if x]
            if not w:
                stays.append(line)
                continue
            if w in seen:
                exact += 1
                continue
            if any(max(len(w), len(x)) >= least and within_one(w, x) for x in seen):
                near += 1
            else:
                stays.append(line)
            seen.append(w)
        out[i] = (len(t.split("\n")), exact, near, "\n".join(stays))
    return out


def quality(text):
    w = spaced(text)
    triples = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {j for k in range(len(w) - 2) if triples[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in (text or "").split("\n") if x.split()]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(hit)


class _Tree(HTMLParser):
    """The page as nested lists [tag, attributes, children]; tags are strings "+" among the children."""

    walls = "table ul ol dl article main section div aside nav footer header form blockquote body".split()

    def __init__(self):
        super().__init__()
        self.stack = [["html", {}, []]]

    def handle_starttag(self, tag, attrs):
        ends = {"li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr", "td", "th"], "td": ["td", "th"], "th": ["td", "th"], "option": ["option"]}.get(tag, [])
        if tag in html._BLOCKS and tag not in ("html", "body", "head", "title", "option", "optgroup", "legend"):
            ends = [*ends, "p"]
        inner = len(self.stack)
        while inner > 1 and self.stack[inner - 1][0] not in self.walls:
            inner -= 1
        at = [i for i in range(inner, len(self.stack)) if self.stack[i][0] in ends]
        # of each kind the last one counts, of these the first
        at = [max(i for i in at if self.stack[i][0] == e) for e in ends if any(self.stack[i][0] == e for i in at)]
        if tag in html._VOID:
            self.stack[-1][2].append([tag, dict(attrs), []])
            return
        if at:
            del self.stack[min(at) :]
        node = [tag, {k: v or "" for k, v in attrs}, []]
        self.stack[-1][2].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        at = [i for i in range(1, len(self.stack)) if self.stack[i][0] == tag]
        self.stack[-1][2].append("/" + tag)
        if at:
            del self.stack[at[-1] :]

    def handle_data(self, data):
        self.stack[-1][2].append((data,))


def page_text(source):
    """The text of a page, by whole trees and plain sums (no running state)."""
    tree = _Tree()
    tree.feed(source or "")
    tree.close()
    root = tree.stack[0]
    lines, state = [], {"text": "", "tags": 0, "linked": 0}
    chain = [root]

    def flush():
        line = re.sub(r"\s+", " ", state["text"]).strip()
        if line:
            lines.append({"text": line, "tags": state["tags"], "linked": state["linked"], "around": list(chain)})
            state["tags"] = 0
        if state["text"]:
            state["linked"] = 0
        state["text"] = ""

    def mark(node):
        tag, attrs, _ = node
        if tag in ("html", "body", "main", "h1", "h2", "h3", "h4", "h5", "h6"):
            return 0
        m = max(html.named(attrs.get("class", "")), html.named(attrs.get("id", "")))
        return min(m, 1) if tag == "p" else m

    def walk(node, dropped, links, article):
        for child in node[2]:
            if isinstance(child, tuple):
                if not dropped:
                    state["text"] += child[0]
                    state["linked"] += len(child[0].strip()) if links else 0
            elif isinstance(child, str):
                state["tags"] += not dropped
                if child[1:] in html._BLOCKS:
                    flush()
            else:
                tag, attrs, _ = child
                if tag in html._BLOCKS:
                    flush()
                state["tags"] += not dropped
                if tag == "br":
                    state["text"] += "" if dropped else " "
                    continue
                if tag in html._VOID:
                    continue
                gone = tag in html._DROPPED or (tag == "header" and not article) or attrs.get("role") in html._ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true"
                gone = gone or bool(html._UNSEEN.search(attrs.get("style", ""))) or (tag not in html._BLOCKS and max(html.named(attrs.get("class", "")), html.named(attrs.get("id", ""))) > 1 and tag not in html._HEADINGS)
                block = tag in html._BLOCKS and not dropped and not gone
                if block:
                    chain.append(child)
                walk(child, dropped or gone, links or tag == "a", article or tag in ("article", "main"))
                if tag in html._BLOCKS:
                    flush()
                if block:
                    chain.pop()

    walk(root, False, False, False)
    flush()
    if not lines:
        return ""
    nodes = []

    def collect(node, around):
        node_around = [*around, node]
        nodes.append((node, node_around))
        for child in node[2]:
            if isinstance(child, list):
                collect(child, node_around)

    collect(root, [])
    has = lambda line, node: any(x is node for x in line["around"])
    size = lambda some: sum(len(x["text"]) for x in some)
    within = lambda a, b: any(x is b for x in a)  # noqa: E731  b is around a, or it
    blocks = [(n, around) for n, around in nodes if n[0] in html._BLOCKS or n is root]
    comment = [n for n, _ in blocks if mark(n) == 3]
    commented = lambda around: any(any(x is c for x in around) for c in comment)
    mains = lambda n: any(m[0] == "main" and within(around, n) for m, around in blocks if visible(m, around))

    def visible(node, around):
        article = False
        for x in around[1:]:
            if x[0] in html._DROPPED or (x[0] == "header" and not article) or x[1].get("role") in html._ROLES or "hidden" in x[1] or x[1].get("aria-hidden") == "true" or html._UNSEEN.search(x[1].get("style", "")):
                return False
            if x[0] not in html._BLOCKS and x[0] not in html._HEADINGS and max(html.named(x[1].get("class", "")), html.named(x[1].get("id", ""))) > 1:
                return False
            article = article or x[0] in ("article", "main")
        return True

    blocks = [(n, around) for n, around in blocks if visible(n, around)]
    comment = [n for n, _ in blocks if mark(n) == 3]
    marked = [(n, around) for n, around in blocks if n[0] == "main" or (n[0] == "article" and not commented(around))] or [(n, around) for n, around in blocks if n[0] == "h1"]
    real = [n for n in comment if not mains(n)]
    others = size(x for x in lines if not any(has(x, c) for c in real))
    wraps = lambda n: mains(n) or (mark(n) != 3 and 2 * size(x for x in lines if has(x, n)) > others and all(within(around, n) for _, around in marked))
    gone = [n for n, _ in blocks if mark(n) >= 2 and not wraps(n)]
    left = [x for x in lines if not any(has(x, n) for n in gone)]
    if not left:
        return ""
    values = []
    for x in left:
        ratio = len(x["text"]) / max(1, x["tags"])
        values.append(math.log1p(ratio * (1.5 if any(n[0] in ("article", "main") for n in x["around"]) else 1)))
    smoothed = []
    for i in range(len(values)):
        weights = [(math.exp(-0.5 * d * d), i + d) for d in range(-3, 4) if 0 <= i + d < len(values)]
        smoothed.append(round(sum(w * values[k] for w, k in weights) / sum(w for w, _ in weights), 9))
    order = sorted(smoothed)
    best, cut = 0, order[0]
    for k in range(1, len(order)):
        a, b = order[:k], order[k:]
        between = round(len(a) * len(b) * (sum(b) / len(b) - sum(a) / len(a)) ** 2, 6)
        if order[k] > order[k - 1] and between > best:
            best, cut = between, order[k]
    for x, v in zip(left, smoothed):
        x["upper"] = v >= cut
    high = lambda n: size(x for x in left if x["upper"] and has(x, n))
    rest = lambda n: size(x for x in left if has(x, n))
    top = root
    for n, _ in blocks:
        if n[0] in html._REGIONS and high(n) >= 2 / 3 * high(root):
            top = n
    up = {id(n): [a for a in around[:-1] if a[0] in html._BLOCKS or a is root] for n, around in blocks}
    path = up[id(top)]
    while path:
        more, added = high(path[-1]) - high(top), rest(path[-1]) - rest(top)
        if added and not (more >= 0.15 * high(top) and more >= 0.8 * added):
            break
        top = path[-1]
        path = path[:-1]
    line_of = [*path, top]
    for wide in ("article", "main"):
        found = [n for n in line_of if n[0] == wide]
        if found:
            top = found[0]
            break
    heads = [x for x in left if x["around"][-1][0] == "h1"]
    out = []
    for x in left:
        around = x["around"]
        menu = any(n is not top and n[0] in ("ul", "ol", "dl", "div", "table", "section", "p") and not any(a[0] in ("article", "main") for a in around[: k + 1]) and not high(n) and sum(y["linked"] for y in lines if has(y, n)) > 0.5 * rest(n) for k, n in enumerate(around))
        weak = around[-1][0] not in html._HEADINGS and any(mark(n) == 1 and not high(n) and not mains(n) for n in around)
        if (has(x, top) and not menu and not weak) or (len(heads) == 1 and x is heads[0]):
            out.append(x["text"])
    return "\n".join(out)


def random_page(r):
    """Nested elements with names, texts and links; some tags are never closed or closed twice."""
    names = ["", ' class="ad"', ' class="content with-sidebar"', ' id="main"', ' class="comments"', ' class="related-work"', ' class="social"', ' class="entry-header"', ' role="navigation"', ' class="cookie-notice"', " hidden"]
    words = lambda n: " ".join(r.choice(["lorem", "ipsum", "dolor", "&amp;", "sit\n", "é", "x<b>y</b>"]) for _ in range(n))

    def part(depth):
        kind = r.randrange(9)
        if depth == 0 or kind < 3:
            tag = r.choice(["p", "p", "p", "h2", "li", "h1"])
            return f"<{tag}{r.choice(names) if r.random() < 0.2 else ''}>{words(r.choice([1, 3, 20, 60]))}" + r.choice([f"</{tag}>", f"</{tag}>", ""])
        if kind == 3:
            return "<ul>" + "".join(f"<li><a href=x>{words(1)}</a>" for _ in range(r.randrange(1, 5))) + r.choice(["</ul>", "</ul>", ""])
        tag = r.choice(["div", "div", "section", "article", "main", "nav", "header", "footer", "aside", "table", "blockquote"])
        inner = "".join(part(depth - 1) for _ in range(r.randrange(1, 4)))
        if tag == "table":
            inner = f"<tr><td>{inner}<td>{words(2)}"
        return f"<{tag}{r.choice(names) if r.random() < 0.3 else ''}>{inner}" + r.choice([f"</{tag}>"] * 6 + ["", "</div>"])

    body = "".join(part(3) for _ in range(r.randrange(1, 6)))
    return f"<html><head><title>t</title><style>x</style></head><body>{body}</body></html>" if r.random() < 0.8 else body


def mixture(rows, block_words=256, weights=(5, 2, 1), share=1.5, most=2.0):
    """What a mix takes of each row (place, id, source, size), slot by slot and word by word."""
    phi = 0.6180339887498949
    sources = sorted({r[2] for r in rows if r[2] is not None}) + [None] * any(r[2] is None for r in rows)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    size = {s: sum(r[3] for r in rows if r[2] == s) for s in sources}
    target, capped = {}, set()
    while True:
        left = share * sum(size.values()) - sum(most * size[s] for s in capped)
        of = sum(weight[s] for s in sources if s not in capped)
        target = {s: most * size[s] if s in capped else left * weight[s] / of for s in sources}
        over = {s for s in sources if s not in capped and target[s] > most * size[s] * (1 + 1e-12)}
        if not over:
            break
        capped |= over
    mixed = [s for s in sources if size[s]]
    take = {s: math.floor(target[s] + 0.5) for s in mixed}
    blocks = {s: -(-size[s] // block_words) for s in mixed}
    need = {s: take[s] // size[s] * blocks[s] + -(-(take[s] % size[s]) // block_words) for s in mixed}
    slots = sum(need.values())
    points = Counter()
    for i in range(slots):
        u = ((i >> 20) * ((phi * (1 << 20)) % 1.0) + (i % (1 << 20)) * phi + phi / 2) % 1.0
        low = 0
        for s in mixed:
            points[s] += low / slots <= u < (low + need[s]) / slots
            low += need[s]
    assert all(abs(points[s] - need[s]) <= 4 + math.log2(slots) for s in mixed)  # low discrepancy
    taken = Counter()
    for s in mixed:
        words: list[int] = []
        for k in sorted((k for k, r in enumerate(rows) if r[2] == s), key=lambda k: (rows[k][0] & (1 << 64) - 1, rows[k][1] is not None, rows[k][1] or 0, rows[k][3])):
            words += [k] * rows[k][3]
        for rank in range(need[s]):  # those that the schedule gave and those added
            block, turn = rank % blocks[s], rank // blocks[s]
            part = words[block * block_words : (block + 1) * block_words]
            taken.update(part[: max(0, take[s] - turn * size[s] - block * block_words)])
    return [taken[k] for k in range(len(rows))], target
