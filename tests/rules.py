"""The search rules said once more in plain Python, for comparison on small fixtures."""

import re

CORPUS = ("dataset int, filename string, filepath string, pages int, text string, "
          "page_offsets array<int>")


def offsets(text, sep="\f"):
    starts = [0]
    for piece in text.split(sep)[:-1]:
        starts.append(starts[-1] + len(piece) + len(sep))
    return starts


def document(dataset, filename, text, folder=""):
    path = f"/data-set-{dataset}/{folder}{filename}"
    return (dataset, filename, path, text.count("\f") + 1, text, offsets(text))


def spans(text, term, flags=re.I):
    return [m.span() for m in re.finditer(re.escape(term), text, flags)]


def words_between(text, a, b):
    """Words between two matches; None where they touch or overlap."""
    first, second = sorted((a, b))
    return len(text[first[1]:second[0]].split()) if first[1] < second[0] else None


def near_pairs(text, one, two, n, cap=10**9):
    found, others = [], spans(text, two)
    for m in spans(text, one):
        if len(found) < cap:
            close = [o for o in others if (gap := words_between(text, m, o)) is not None and gap <= n]
            found += [(min(m[0], o[0]), max(m[1], o[1])) for o in close]
    return found


def show(doc, start, end, match, chars):
    text, starts = doc[4], doc[5]
    left, right = max(0, start - chars), min(len(text), end + chars)
    snippet = ("..." if left else "") + text[left:right] + ("..." if right < len(text) else "")
    return (start, snippet, match, max(1, sum(o <= start for o in starts)))


def term_hits(docs, term, chars=300):
    """[(doc, count, contexts)] in corpus order."""
    out = []
    for doc in sorted(docs, key=lambda d: d[:3]):
        found = [show(doc, s, e, doc[4][s:e], chars) for s, e in spans(doc[4], term)]
        if found:
            out.append((doc[:4], len(found), found))
    return out


def near_hits(docs, one, two, n, chars=300, cap=10**9):
    out = []
    for doc in sorted(docs, key=lambda d: d[:3]):
        found = [show(doc, s, e, f"{one}...{two}", chars) for s, e in near_pairs(doc[4], one, two, n, cap)]
        if found:
            out.append((doc[:4], len(found), found))
    return out


def merged(hits, key):
    """Hits of one key added up; the first gives the document columns."""
    out = {}
    for doc, n, ctx in hits:
        k = key(doc)
        if k in out:
            first, total, have = out[k]
            out[k] = (first, total + n, have + ctx)
        else:
            out[k] = (doc, n, ctx)
    return list(out.values())


def whole(docs, all=(), any=(), none=(), near=(), key=lambda d: d[1], chars=300):
    if all:
        hits = term_hits(docs, all[0], chars)
        keys = [{key(d) for d, _, _ in term_hits(docs, t)} for t in all]
        hits = [h for h in hits if key(h[0]) in set.intersection(*keys)]
    elif any:
        hits = merged([h for t in any for h in term_hits(docs, t, chars)], key)
    else:
        hits = []
    gone = {key(d) for t in none for d, _, _ in term_hits(docs, t)}
    hits = [h for h in hits if key(h[0]) not in gone]
    if near:
        last = {key(d): (d, n, c) for d, n, c in hits}
        extra = [h for clause in near for h in near_hits(docs, *clause, chars=chars)]
        hits = merged(list(last.values()) + extra, key)
    return hits


def scanned(df):
    """Rows that the scans of a finished plan gave out."""
    df.collect()
    plan, total = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            plan.append(node.executedPlan())
        if "Scan parquet" in node.nodeName():
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        plan += [children.apply(i) for i in range(children.size())]
    return total
