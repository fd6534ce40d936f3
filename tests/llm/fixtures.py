"""Small awkward inputs and plain models of the operators."""

from collections import Counter, defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, kept string, digest string, n string"
LONG = " ".join(f"wört{i % 977}" for i in range(60_000))
PASSAGE = "First line of a passage.\nSecond line of it.\nThird one, longer than the rest.\nFourth.\nFifth line.\nSixth and last."


def documents(spark, rows):
    """``(doc_id, text, lang, source)`` rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, x, s, None if t is None else len(t), "a", "b", "c", "d", "e") for i, t, x, s in rows], DOCS)


def awkward():
    base = [f"w{i}" for i in range(120)]
    near = [*base[:60], "other", *base[61:]]
    return [
        (1, None, "en", "a"), (2, "", "en", None), (3, "   \t\n", None, "a"), (4, "one two", "en", "a"), (5, "one two", "fr", "b"),
        (5, "one two", "fr", "b"), (None, "one two", "en", "a"), (6, LONG, "de", "a"), (7, LONG, "de", "a"), (-8, " ".join(base), "en", "a"),
        (9, " ".join(near), "en", "a"), (10, " ".join(base).upper(), "en", "b"), (11, PASSAGE + "\nEnd of the first.", "en", "a"),
        (12, "A new start.\n" + PASSAGE, "en", "a"), (13, PASSAGE + "\n" + PASSAGE, "en", "c"), (14, "naïve 😀 日本語 <|endoftext|>   x", "en", "c"),
        (None, None, None, None), (15, "!!! 123 ...", "en", "a"), (16, "Ünïcødé" * 3000, "de", "a"), (17, "a\r\nb\x0bc\x0cd e", "en", "a"),
    ]


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


class Sets:
    """Disjoint sets with the smallest member as their name."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near_model(rows):
    """Component of each id by comparing all pairs."""
    sets, found = Sets(), [(i, shingles(t)) for i, t in rows if i is not None]
    for k, (a, x) in enumerate(found):
        sets.find(a)
        for b, y in found[:k]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                sets.join(a, b)
    return {i: sets.find(i) for i, _ in found}


def best_fit_model(items, capacity):
    """``(size, source, cluster)`` items in order; the bin of each, by looking at all bins."""
    bins, out = [], []
    for size, source, cluster in items:
        fits = [b for b in bins if capacity - b[0] >= size and not (source is not None and source in b[1]) and not (cluster is not None and cluster in b[2])]
        best = max(fits, key=lambda b: b[0], default=None)
        if best is None:
            best = [0, set(), set(), len(bins)]
            bins.append(best)
        best[0] += size
        best[1].add(source)
        best[2].add(cluster)
        out.append(best[3])
    return out, {b[3]: b[0] for b in bins}


def counted(rows):
    return Counter(tuple(r) for r in rows)


def grouped(pairs):
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out
