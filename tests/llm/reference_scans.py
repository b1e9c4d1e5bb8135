"""Plain one-text versions of the contract's scans, for comparison in tests."""

from __future__ import annotations

import hashlib
import re


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _listing(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))


def personal_base(text: str | None):
    text = text or ""
    spans = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        spans.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            spans.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and _luhn(digits):
            spans.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            spans.append((m.start(), 3, "phone", m.end()))
    counts = [sum(s[2] == k for s in spans) for k in ("email", "ip", "card", "phone")]
    return (*counts, hashlib.sha256(_listing(spans).encode()).hexdigest())


def secret_base(text: str | None):
    text = text or ""
    spans = []
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                        re.I | re.A)
    for m in assign.finditer(text):
        if len(m[2]) >= 12:
            spans.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 18:
            spans.append((m.start(), 1, "access", m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 16:
            spans.append((m.start(), 2, "hex", m.end()))
    counts = [sum(s[2] == k for s in spans) for k in ("assign", "access", "hex")]
    return (*counts, hashlib.sha256(_listing(spans).encode()).hexdigest())
