"""Plain versions of stages, over all pairs and windows."""

from test_simhash import plain_groups


def plain_lines(docs):
    def windows(text):
        lines = [(i, x) for i, x in enumerate(text.split("\n")) if x.strip(" \t\n\r\x0b\x0c")]
        return [(tuple(x for _, x in lines[k : k + 3]), [i for i, _ in lines[k : k + 3]]) for k in range(len(lines) - 2)]

    first = {}
    for d, text in docs:
        for w, at in windows(text):
            first[w] = min(first.get(w, (d, at[0])), (d, at[0]))
    out = {}
    for d, text in docs:
        gone = {i for w, at in windows(text) if first[w] != (d, at[0]) for i in at}
        out[d] = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
    return out


def plain_simhash(docs):
    return {d: root for d, _, root in plain_groups(docs)}
