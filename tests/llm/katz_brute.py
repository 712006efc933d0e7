"""A plain Katz model to hold the operator against."""
import math
import re
from collections import Counter, defaultdict

from quarry.llm.katz import K, LARGE, discounts


def brute(docs, is_held):
    tok = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + [None]
    uni, bi = Counter(), Counter()
    for i, t in docs:
        if not is_held(i):
            ws = tok(t)
            uni.update(ws)
            bi.update(zip(["\n", *ws[:-1]], ws))
    n, v = sum(uni.values()), len(uni)
    d1, d2 = discounts(Counter(uni.values())), discounts(Counter(bi.values()))
    disc = lambda c, d: c * (d[c] if c <= K else LARGE)
    p1 = {w: disc(c, d1) / n for w, c in uni.items()}
    unk = 1 - sum(p1.values())
    ctx, seen = Counter(), defaultdict(list)
    for (h, w), c in bi.items():
        ctx[h] += c
        seen[h].append(w)
    alpha = {h: (1 - sum(disc(bi[h, w], d2) for w in ws) / ctx[h]) / (1 - sum(p1[w] for w in ws)) for h, ws in seen.items()}

    def p(h, w):
        if bi[h, w]:
            return disc(bi[h, w], d2) / ctx[h]
        return alpha.get(h, 1.0) * p1.get(w, unk)

    out = {}
    for i, t in docs:
        ws = tok(t)
        out[i] = (len(ws), sum(w in uni for w in ws), n, sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), sum(math.log10(p(h, w)) for h, w in zip(["\n", *ws[:-1]], ws)))
    total = {h: sum(p(h, w) for w in uni) + alpha[h] * unk for h in list(alpha)[:50]}
    return out, total
