"""Brute-force scorer of the tests, written from the definitions and not from the engine."""

DELETED = {0x983: None, 0x964: None, 0x9CD: None, 0x20: None}


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by the full table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j] + (x == y), row[j + 1], new[j]))
        row = new
    return row[-1]


def share(dist: int, total: int) -> float:
    return 100.0 - 100.0 * dist / total if total else 100.0


def token_set(a: str, b: str) -> float:
    """Similarity of two token sets: the rests against each other, and each side against the shared tokens."""
    sa, sb = set(a.split()), set(b.split())
    if not sa or not sb:
        return 0.0
    both = " ".join(sorted(sa & sb))
    if both and (sa <= sb or sb <= sa):
        return 100.0
    sides = [both + " " * bool(both) + " ".join(sorted(s)) for s in (sa - sb, sb - sa)]
    rests = [" ".join(sorted(s)) for s in (sa - sb, sb - sa)]
    scores = [share(sum(map(len, rests)) - 2 * common(*rests), sum(map(len, sides)))]
    if both:
        scores += [share(len(s) - len(both), len(s) + len(both)) for s in sides]
    return max(scores)


def matches(name: str | None, query: str | None, threshold: int) -> bool:
    if not name or not query:
        return False
    return token_set(name.translate(DELETED).strip(), query.translate(DELETED).strip()) >= threshold
