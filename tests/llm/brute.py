"""Plain Python statements of what the operators must return, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def pii(text):
    """Spans of the base kinds."""
    text = text or ""
    count = lambda x: len(re.sub("[^0-9]", "", x))
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 14 <= count(x) <= 19 and luhn(re.sub("[^0-9]", "", x))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 10 <= count(x) <= 15),
    )
    found = [(m.start(), i, m.end(), name) for i, (name, pattern, good) in enumerate(kinds) for m in re.finditer(pattern, text) if good(m[0])]
    found.sort()
    return [f"{name}:{start}:{end}" for start, _, end, name in found]


def digest(parts):
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for x in at.values() if len(x) > 1 for i in x for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def mod97(iban):
    moved = (iban := iban.replace(" ", ""))[4:] + iban[:4]
    return int("".join(str(ord(c) - 55) if c >= "A" else c for c in moved)) % 97 == 1


def pii_scored(text, reach=40):
    """Spans of the kinds that need a score, with it: (start, kind_no, end, kind, score)."""
    against = r"\b(?:version|build|isbn|serial)\b"
    kinds = (
        (4, "iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", mod97, 0.8, r"\b(?:iban|account|bank)\b"),
        (5, "ssn", r"\b(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}\b", lambda x: True, 0.3, r"\b(?:ssn|social|security)\b"),
        (6, "local_phone", r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])", lambda x: True, 0.3, r"\b(?:phone|call|tel|mobile|fax)\b"),
    )
    out = []
    for no, name, pattern, good, base, near in kinds:
        for m in re.finditer(pattern, text or "", re.ASCII):
            around = ((text[max(0, m.start() - reach) : m.start()]) + " " + text[m.end() : m.end() + reach]).lower()
            score = base + 0.3 * bool(re.search(near, around)) - 0.3 * bool(re.search(against, around))
            if good(m[0]) and score >= 0.5:
                out.append((m.start(), no, m.end(), name, round(score, 1)))
    return sorted(out)
