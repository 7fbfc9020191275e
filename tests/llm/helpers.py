import re

SPACED = r"[^\x20\x09-\x0D]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(text, width):
    w = re.findall(SPACED, lower(text))
    if len(w) >= width:
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def components(texts, width, percent):
    """Least index reachable of each text, by all pairs."""
    sets = [shingles(t, width) for t in texts]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return [root(i) for i in range(len(sets))], sets
