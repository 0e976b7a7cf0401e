"""Linked credential parts by plain loops over one text."""

import re

ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "ident": "identifier", "opaque": "secret", "endpoint": "endpoint"}
NEEDS = {"ident": ("secret",), "opaque": ("identifier",), "endpoint": ("secret", "identifier")}
FOUND = {
    "assign": re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"(AKIA[A-Z0-9]+)"),
    "hex": re.compile(r"([0-9a-f]+)"),
    "ident": re.compile(r"""\b(?:user(?:_?name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.IGNORECASE | re.ASCII),
    "opaque": re.compile(r"(?<![A-Za-z0-9+/_=-])([A-Za-z0-9+/_=-]{20,})"),
    "endpoint": re.compile(r"""([a-z][a-z0-9+.:-]*://[^\x20\x09-\x0D"'<>]+|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?![0-9.]))"""),
}
LEAST = {"assign": 12, "access": 18, "hex": 16, "ident": 3, "opaque": 20, "endpoint": 4}


def linked_truth(text, scope=200):
    """(start, kind number, kind, end) of base parts and of weak ones with their complements nearby, in order."""
    kinds = list(ROLES)
    parts = []
    for kind, pattern in FOUND.items():
        for m in pattern.finditer(text):
            mixed = kind != "opaque" or (re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1]))
            if len(m[1]) >= LEAST[kind] and mixed:
                parts.append((*m.span(), kind))
    base = [p for p in parts if kinds.index(p[2]) < 3]
    out = list(base)
    for a, b, kind in parts:
        if kinds.index(kind) < 3 or any((a, b) == (x, y) for x, y, _ in base):
            continue
        near = {ROLES[k] for x, y, k in parts if y >= a - scope and x <= b + scope}
        if all(n in near for n in NEEDS[kind]):
            out.append((a, b, kind))
    return sorted((a, kinds.index(k), k, b) for a, b, k in out)
