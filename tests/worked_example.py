"""The worked graph's k-mers as text lines, with the nodes that follow."""

CHARS = "#GCATTCAGTA$"
EDGES = [(0, 1), (1, 2), (2, 3), (2, 4), (3, 5), (4, 5), (5, 6), (5, 8), (6, 7), (7, 9), (8, 9), (9, 10), (10, 11)]


def lines():
    """One line for each path of three nodes: the source is 0:2, 0:1, 0 as in the example, the sink loops to itself."""
    label, after, before = {}, {}, {}
    for i, c in enumerate(CHARS):
        name = f"{i}:0"
        label[name] = c
    label |= {"0:2": "#", "0:1": "#"}
    pairs = [(f"{a}:0", f"{b}:0") for a, b in EDGES] + [("0:2", "0:1"), ("0:1", "0:0"), ("11:0", "11:0")]
    for a, b in [*pairs, ("11:0", "0:2")]:
        before.setdefault(b, set()).add(label[a])
    for a, b in pairs:
        after.setdefault(a, []).append(b)
    out = {}
    for a in label:
        for b in after[a]:
            for c in after[b]:
                for d in after[c]:
                    out.setdefault((label[a] + label[b] + label[c], a), []).append(d)
    return "".join(f"{k}\t{a}\t{','.join(sorted(before[a]))}\t{','.join(sorted({label[d] for d in ds}))}\t{','.join(sorted(set(ds)))}\n" for (k, a), ds in sorted(out.items()))
