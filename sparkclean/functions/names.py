"""Column names. Pure metadata: nothing here touches data."""

from __future__ import annotations


def snake_case(name: str) -> str:
    """The words of a name in lower case, joined by underscores.

    White space, hyphens and underscores end a word, and so does a capital A-Z behind a-z or a digit. Any other sign is
    left out and joins what stands on both sides of it.
    """
    words, before = [""], ""
    for sign in name:
        if sign.isspace() or sign in "-_":
            words.append("")
        elif sign.isalnum():
            if "A" <= sign <= "Z" and ("a" <= before <= "z" or "0" <= before <= "9"):
                words.append("")
            words[-1] += sign
        before = sign
    return "_".join(w for w in words if w).lower()


def unique_names(names: list[str]) -> list[str]:
    """Give empty names a positional one and repeated names a suffix _2, _3 ...

    Names are compared without case, as Spark resolves them.
    """
    taken: set[str] = set()
    out = []
    for position, name in enumerate(names):
        base = name or f"col_{position}"
        candidate, n = base, 2
        while candidate.lower() in taken:
            candidate, n = f"{base}_{n}", n + 1
        taken.add(candidate.lower())
        out.append(candidate)
    return out


def free_name(wanted: str, taken: set[str]) -> str:
    """`wanted`, or the first of wanted2, wanted3 ... that does not collide (case-insensitive)."""
    candidate, n = wanted, 2
    lowered = {t.lower() for t in taken}
    while candidate.lower() in lowered:
        candidate, n = f"{wanted}{n}", n + 1
    return candidate


def free_prefix(wanted: str, taken: list[str]) -> str:
    """`wanted` with underscores behind it, so many that no name begins with it (case-insensitive)."""
    while any(t.lower().startswith(wanted.lower()) for t in taken):
        wanted += "_"
    return wanted
