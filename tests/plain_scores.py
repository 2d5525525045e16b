"""Scores of one pair, written plainly: what the batch scorers are checked against."""


def common_length(a, b):
    line = [0] * (len(b) + 1)
    for x in a:
        before = line
        line = [0]
        for j, y in enumerate(b):
            line.append(before[j] + 1 if x == y else max(before[j + 1], line[j]))
    return line[-1]


def ratio(a, b):
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def _windows(short, long):
    m = len(short)
    return max(ratio(short, long[max(k, 0) : k + m]) for k in range(1 - m, len(long)))


def partial_ratio(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    short, long = sorted((a, b), key=len)
    return max(_windows(short, long), _windows(long, short)) if len(a) == len(b) else _windows(short, long)


def token_set_ratio(a, b):
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = " ".join(sorted(left & right))
    x, y = (" ".join(filter(None, [shared, " ".join(sorted(own - other))])) for own, other in ((left, right), (right, left)))
    return max([ratio(x, y), *(ratio(shared, z) for z in (x, y) if shared)])


def _sorted(text):
    return " ".join(sorted(text.split()))


def wratio(a, b):
    if not a or not b:
        return 0.0
    stretch = max(len(a), len(b)) / min(len(a), len(b))
    if stretch < 1.5:
        return max(ratio(a, b), 0.95 * ratio(_sorted(a), _sorted(b)), 0.95 * token_set_ratio(a, b))
    sets = [" ".join(sorted(set(t.split()))) for t in (a, b)]
    words = 100.0 if set(a.split()) & set(b.split()) else max(partial_ratio(_sorted(a), _sorted(b)), partial_ratio(*sets))
    scale = 0.9 if stretch <= 8 else 0.6
    return max(ratio(a, b), scale * partial_ratio(a, b), scale * 0.95 * words)


def jaro_winkler(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    reach, free, first = max(max(len(a), len(b)) // 2 - 1, 0), [True] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == x:
                free[j] = False
                first.append(x)
                break
    second = [y for y, f in zip(b, free) if not f]
    m = len(first)
    if not m:
        return 0.0
    jaro = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(first, second)) // 2) / m) / 3
    same = next((k for k in range(4) if k >= min(len(a), len(b)) or a[k] != b[k]), 4)
    return 100.0 * (jaro + 0.1 * same * (1 - jaro) if jaro > 0.7 else jaro)


SCORERS = {"token_set_ratio": token_set_ratio, "partial_ratio": partial_ratio, "jaro_winkler": jaro_winkler, "wratio": wratio}
