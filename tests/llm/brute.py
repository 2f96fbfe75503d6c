"""Plain Python versions to test against."""

import json
from datetime import datetime, timezone


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def tie(self, a, b):
        self.up[self.find(a)] = self.find(b)


def load(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def doi(text):
    return text[text.index("10.") :].strip().lower() if text and "10." in text else None


def bundle_groups(bundles, works):
    u = Union()
    for i, w, d in bundles:
        u.tie(("b", i), ("w", w) if w is not None else ("b", i))
        for x in (doi(d), doi(w[4:]) if w and w.startswith("doi:") else None):
            if x:
                u.tie(("b", i), ("d", x))
    for alternate in works:
        v = load(alternate)
        l = [doi(x) for x in v if isinstance(x, str) and doi(x)] if isinstance(v, list) else []
        for x in l[1:]:
            u.tie(("d", l[0]), ("d", x))
    groups = {}
    for i, _, _ in bundles:
        groups.setdefault(u.find(("b", i)), set()).add(i)
    return {(i, min(g)) for g in groups.values() if len(g) > 1 for i in g}


def survivors(works, stamps):
    order = {"doi": ["crossref", "openalex", "pdf"], "title": ["openalex", "crossref", "pdf"], "authors": ["openalex", "crossref", "pdf"], "year": ["crossref", "openalex", "pdf"]}
    u, src = Union(), {}
    for w in works:
        v = load(w["source_bundle_ids"])
        src[w["id"]] = [int(x) for x in v if x is not None] if isinstance(v, list) else []
        for b in src[w["id"]]:
            u.tie(("w", w["id"]), ("b", b))
    groups = {}
    for w in works:
        groups.setdefault(u.find(("w", w["id"])), []).append(w)
    out = set()
    for g in groups.values():
        if len(g) < 2:
            continue
        for f, o in order.items():
            best = []
            for w in g:
                x = w[f]
                if x is None or x != x or x == "" or f == "authors" and load(x) in (None, []):
                    continue
                p = load(w["provenance"])
                s = (p.get(f) or "").strip().lower() if isinstance(p, dict) else ""
                at = max([stamps[b] for b in src[w["id"]] if b in stamps], default=datetime.min.replace(tzinfo=timezone.utc))
                c = w["confidence"]
                best.append((len(o) - o.index(s) if s in o else 0, at, -1 if c is None or c != c else c, -w["id"]))
            if best:
                out.add((min(w["id"] for w in g), f, -max(best)[3]))
    return out
